"""Quality, personal data, tokens, packing, joins and repeats against plain Python, odd cases included."""

from __future__ import annotations

import functools
import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import jaccard, langid, mixing, packing, pii, quality, substrings, token_counts
from emberlog.llm.pii_examples import TESTING, examples
from tests.llm import brute
from tests.llm.cases import ROWS, clashing, documents

IDS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(params=["plain", "clashing"])
def docs(request, spark):
    return documents(spark) if request.param == "plain" else clashing(spark)


@pytest.fixture
def table_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_quality(docs):
    rows = quality.apply_policy(quality.ledger(docs), "v3").collect()
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == sorted((i, *brute.quality(t)) for i, t in IDS)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_pii(docs, table_docs):
    for frame in (docs, table_docs):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        for r in pii.find(frame).collect():
            base = brute.personal(texts[r["doc_id"]])
            line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
            assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), r
            assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[2] == k for x in base) for k in pii.BASE_KINDS]
            spans = r["spans"].split(",") if r["spans"] else []
            assert not {f"{k}:{s}:{e}" for s, _, k, e in base} - set(spans)


def test_redaction_leaves_no_base_span(docs):
    assert pii.redact(docs).columns == docs.columns
    for r in pii.redact(docs).collect():
        assert "pii" not in docs.columns or r["pii"] == "other"
        assert r["text"] is None or not [x for x in brute.personal(r["text"]) if x[2] != "card"]


@pytest.fixture(scope="module")
def trained(spark):
    return pii.train(spark)


def test_cards_and_addresses_inside_longer_runs(spark, trained):
    a, b = "4012888888881881", "4111 1111 1111 1111"
    rows = [(1, f"pay {a} {a}"), (2, f"pay {b} 10.0.0.25"), (3, f"card 7 {b} 123 x"), (5, "host 300.10.0.0.25 now"), (6, "1 " * 2000), (8, "part 555-123-4567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.redact(docs, trained).collect()}
    assert texts[1] == "pay [CARD] [CARD]" and a not in texts[2] and b not in texts[2] and texts[3] == "card 7 [CARD] 123 x"
    assert texts[5] == "host 300.[IP] now" and texts[8] == dict(rows)[8]
    none = trained[0], dict.fromkeys(pii.KINDS, float("inf"))
    assert all(not r["spans"] for r in pii.find(docs.filter("doc_id in (1, 5)"), none).collect())


def test_trees_tell_personal_data_from_look_alikes(spark, trained):
    """Precision and recall of what the trees add, by kind, on sentences drawn anew; no added span overlaps another one."""
    rows = [r for r in examples(300, seed=99) if r[3] == TESTING]
    found = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in pii.find(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), trained).collect()}
    good, bad, missed = Counter(), Counter(), Counter()
    for i, text, true, _ in rows:
        base = {f"{k}:{s}:{e}" for s, _, k, e in brute.personal(text)}
        for span in set(found[i]) - base:
            (good if span in true else bad)[span.split(":")[0]] += 1
        for span in set(true) - set(found[i]):
            missed[span.split(":")[0]] += 1
        places = sorted(tuple(map(int, s.split(":")[1:])) for s in found[i])
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False)), (text, found[i])
    for kind in pii.KINDS:
        assert good[kind] >= 0.85 * (good[kind] + bad[kind]) and good[kind] >= 0.85 * (good[kind] + missed[kind]), (kind, good, bad, missed)


def test_boosting_separates():
    base = dict.fromkeys(pii.FEATURES, 0)
    rows = [base | {"groups": g, "cue": c, "positive": 10 * (g > 5) + 1, "negative": 10 * (g <= 5)} for g in range(9) for c in (0, 1)]
    trees = pii.boost(rows)
    score = lambda r: sum(t.value(r) for t in trees)
    limit = pii.calibrate(trees, rows)[pii.KINDS[0]]
    assert min(score(r) for r in rows if r["groups"] > 5) >= limit > max(score(r) for r in rows if r["groups"] <= 5)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, table_docs, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        size = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    else:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda text: len(m.encode(text))
    for frame in (docs, table_docs):
        texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
        for r in token_counts.token_counts(frame, path).collect():
            text = texts[r["doc_id"]]
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), size(text)), (r["doc_id"], text[:60])
            assert r["over_limit"] == (r["n_tokens"] > 4096)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_pieces_of_random_texts(name):
    """Ids and lengths against the library itself, on texts of any characters, white space and special tokens."""
    from emberlog.llm import pieces

    rng = np.random.default_rng(6)
    path = public_tokenizers.path(name)
    stock = ["a", "Z", "9", " ", " ", "  ", "\n", "\t", "é", "漢", "🙂", "▁", "<|endoftext|>", "<s>", "'s", "'LL", "\u00a0", "\u2028", "\x1c", "e\u0301", "ﬁ", "½", "\u200d", "the", "12345", "!!", "…", "\ufeff", "ß", "İ"]
    texts = ["".join(stock[int(k)] for k in rng.integers(0, len(stock), int(rng.integers(0, 30)))) for _ in range(3000)]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        wanted = [t.encode(x, add_special_tokens=False).ids for x in texts]
    else:
        import sentencepiece

        wanted = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    got = pieces.Encoded(pieces.model(path), pa.array(texts))
    assert got.lengths().tolist() == [len(x) for x in wanted]
    assert all(got.ids_of(i).tolist() == x for i, x in enumerate(wanted))


def test_placement_by_sums_of_squares():
    """Each remainder goes where the sum of the squared counts of partly filled windows comes out least; of equal ones to the fullest."""
    window, rng = 24, np.random.default_rng(2)
    packer, counts = packing.Packer(window, 0), [0] * window
    for doc in range(600):
        n = int(rng.integers(1, 60))
        packer.add(doc, np.arange(n, dtype="<u4"))
        r, best = n % window, None
        if not r:
            continue
        for h in [0, *(h for h in range(1, window - r + 1) if counts[h])]:
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + r < window:
                after[h + r] += 1
            cost = sum(x * x for x in after)
            if best is None or cost <= best[0]:
                best = cost, after
        counts = best[1]
        assert packer.counts[1:window].tolist() == counts[1:]
    assert sum(counts) > 3


def test_packing(docs, table_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for frame in (docs, table_docs):
        source = frame.select("doc_id", "text").collect()
        ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in source}
        rows = packing.pack(frame.repartition(3), path).collect()
        total: dict[int, int] = {}
        fill: dict[int, list] = {}
        for r in rows:
            own = ids[r["doc_id"]]
            assert r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
            fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        copies = {d: sum(r["doc_id"] == d for r in source) for d in ids}
        assert total == {d: copies[d] * len(x) for d, x in ids.items()}
        padding = 0
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding == 0


def test_components(docs):
    got = jaccard.jaccard_components(docs).collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(IDS))


def test_components_of_many_near_copies(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(160):
        w = [vocabulary[k] for k in rng.integers(0, 400, int(rng.integers(4, 90)))]
        rows.append((10 * i, " ".join(w)))
        for c in range(int(rng.integers(0, 6))):
            v = list(w)
            for _ in range(int(rng.integers(0, 4))):
                v[int(rng.integers(0, len(v)))] = "changed"
            rows.append((10 * i + 1 + c, " ".join(v)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(rows))


def components(spark, rows) -> list[tuple]:
    return sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))


def test_links_among_texts_of_common_shingles(spark, monkeypatch):
    """Short texts of few frequent shingles: most classes are long, and lists hold many components."""
    rng = np.random.default_rng(11)
    stock = [" ".join(f"s{p}x{k}" for k in range(12)) for p in range(9)]
    rows = []
    for i in range(150):
        parts = [stock[int(k)] for k in rng.choice(9, int(rng.integers(1, 5)), replace=False)]
        rows.append((i, " ".join(parts) + (f" own{i}" if i % 3 == 0 else "")))
    rows += [(1000 + i, rows[i][1].upper()) for i in range(0, 150, 4)]
    monkeypatch.setattr(jaccard, "HUBS", 3)
    assert components(spark, rows) == sorted(brute.components(rows))


def test_links_among_near_copies_of_all_degrees(spark):
    """A large group in which some are too far from the most central one."""
    rng = np.random.default_rng(1)
    base, rows = [f"b{k}" for k in range(150)], []
    for i in range(120):
        v = list(base)
        for _ in range(int(rng.integers(0, 12))):
            v[int(rng.integers(0, 150))] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(v)))
    found = components(spark, rows)
    assert found == sorted(brute.components(rows)) and 20 < len({r[2] for r in found}) < 110


def test_a_common_passage_makes_no_pairs(spark):
    """A passage that thousands of unlike texts hold costs no candidates; near copies among them are found."""
    passage = " ".join(f"licence{k}" for k in range(60))
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(120)) + " " + passage
    rows = [(i, text(i)) for i in range(2000)] + [(5000 + i, text(i) + " tail") for i in range(0, 2000, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    first = jaccard.prefixes(docs)
    active = jaccard._active(first)
    assert jaccard._candidates(active, jaccard._classes(first, active)).count() <= 200


def test_keep_one_judges_rows(spark):
    w, u, v = (" ".join(f"{x}{k}" for k in range(30)) for x in "wuv")
    rows = [(3, w, "a"), (7, w, "b"), (7, u, "c"), (9, v, "d"), (9, v, "d"), (9, v + " x", "e"), (None, u, "f"), (None, None, "g"), (4, "", "h"), (4, "", "h"), (None, " ".join(f"z{k}" for k in range(9)), "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    kept = sorted((r["_key"] for r in out.collect()))
    assert kept in (sorted("acdghhi"), sorted("aceghhi"))


def test_repeats(docs):
    distinct = docs.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(distinct.repartition(3)).collect()}
    assert got == brute.repeats(dict(IDS).items())


def test_repeats_in_random_runs(spark):
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{k}" for k in rng.integers(0, 30, int(rng.integers(15, 50)))) for _ in range(12)]
    rows = [(i, " ".join(passages[int(k)] if k < 12 else f"x{int(rng.integers(0, 3))}" for k in rng.integers(0, 24, 40))) for i in range(60)]
    rows.append((100, "same " * 200))
    rows.append((101, "a b " * 100))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute.repeats(rows)


@pytest.mark.parametrize("stretch", [substrings.LONG, 1000, substrings.STRETCH])
def test_word_names_whatever_the_stretch(monkeypatch, stretch):
    """Against plain polynomials and digests: words longer than a stretch, at its ends and at those of texts."""
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    texts = ["not read", None, "", "a", *["x" * n + " " + "y" * m for n in (254, 255, 256, 257) for m in (1, 256, 257)], " lead tail\n", "ab", "ab cd " * 40, "é" * 300 + "\tend", "z" * 70_000, *[t for _, t in IDS], "last"]

    @functools.cache
    def name(word: str) -> int:
        data, values = word.encode(), [0, 0]
        for b in reversed(data):
            values = [(v * substrings._BASES[k] + int(substrings._BYTES[k][b])) % (1 << 64) for k, v in enumerate(values)]
        if len(data) > substrings.LONG:
            digest = hashlib.blake2b(data, digest_size=16).digest()
            values = [int.from_bytes(digest[i : i + 8], "little") for i in (0, 8)]
        low, high = (np.array([v], np.uint64) for v in values)
        return int(substrings._mix(substrings._mix(low, np.uint64(len(data) - 1)), high)[0])

    names, bounds = substrings.word_names(pa.array(texts).slice(1))
    words = [brute.WORD.findall(t or "") for t in texts[1:]]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    assert names.tolist() == [name(x) for w in words for x in w]


def test_long_words_that_polynomials_take_for_equal(spark):
    """Thue-Morse words, whose polynomials modulo 2^64 are equal at every odd base."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows) and [got[i][1] for i in (1, 2, 3)] == [0, 0, 20]


@pytest.mark.parametrize("text", [" ".join(f"word{i}" for i in range(300_000)), "x" * (3 << 20)], ids=["words", "one word"])
def test_word_names_take_little_memory(text):
    """No tables or sums of eight bytes for each byte of the texts; with them it was 28 to 73 times the text."""
    texts = pa.array([text])
    tracemalloc.start()
    try:
        substrings.word_names(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * len(text)


def test_language_gradients():
    """Backpropagation against differences of the loss, in double precision."""
    rng = np.random.default_rng(2)
    model = langid.new_model(["a", "b", "c"], hidden=3, seed=1)
    for part in (model.ahead, model.back):
        part.w, part.u, part.b = (rng.standard_normal(x.shape) * 0.5 for x in (part.w, part.u, part.b))
    model.out, model.bias = (rng.standard_normal(x.shape) for x in (model.out, model.bias))
    sizes = np.array([7, 5, 6, 1])
    x, mask = langid.padded(rng.integers(0, 6, int(sizes.sum())).astype(np.uint8), np.cumsum(sizes) - sizes, sizes)
    target = np.array([0, 2, 1, 1])
    grads = model.gradients(x, mask, target)[1]
    for p, g in zip(model.parameters(), grads, strict=True):
        for i in rng.choice(p[:6].size if p.ndim == 2 else p.size, 6):
            at = np.unravel_index(int(i), p.shape)
            old, step = p[at], 1e-5
            p[at] = old + step
            up = model.gradients(x, mask, target)[0]
            p[at] = old - step
            down = model.gradients(x, mask, target)[0]
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-7


def test_language_windows_cover_every_byte():
    texts = ["", "a" * 300, "ä漢🙂" * 200, "x", "", "é" * 64, "b" * 128, ""]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, sizes, text = langid.windows(data, np.concatenate([[0], np.cumsum([len(t) for t in raw])]))
    got = ["".join(bytes(data[a : a + n]).decode() for a, n, of in zip(starts, sizes, text, strict=True) if of == i) for i in range(len(texts))]
    assert got == texts and sizes.max() <= langid.WINDOW + 3


def test_language_held_out_accuracy(table_docs):
    rows = langid.identify(table_docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in table_docs.collect()}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in judged) >= 0.9 * len(judged)


def test_many_languages_over_one_alphabet():
    """Twelve made-up vocabularies: accuracy on other texts, and scores that say how often they are right."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(12):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(200)]
        rows += [(" ".join(rng.choice(words, 60)), f"l{k:02}") for _ in range(60)]
    model = langid.train([r for i, r in enumerate(rows) if i % 4 != 2])
    other = [r for i, r in enumerate(rows) if i % 4 == 2]
    found = langid._probabilities(langid._evidence(model, pa.array([t for t, _ in other])), model.positions)
    right = np.mean([model.languages[k] == lang for k, (_, lang) in zip(found.argmax(axis=1), other, strict=True)])
    assert right >= 0.9
    assert abs(found.max(axis=1).mean() - right) < 0.05


def test_language_sample_is_bounded_in_all(spark, monkeypatch):
    """Beyond the bound every language gives its equal share, a rare one all it has."""
    rows = [(i, f"text {i}", f"l{i % 6}") for i in range(3000)] + [(9000 + i, f"rare {i}", "rare") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_ROWS", 350)
    got = Counter(lang for _, lang in langid.sample(docs, 100))
    left = sum(zlib.crc32(str(9000 + i).encode()) % 4 != 2 for i in range(12))
    assert got["rare"] == left
    assert all(20 <= got[f"l{k}"] <= 90 for k in range(6))
    monkeypatch.setattr(langid, "MOST_ROWS", 30_000)
    assert all(150 <= n <= 250 for lang, n in Counter(lang for _, lang in langid.sample(docs, 100)).items() if lang != "rare")


def test_language_odd_cases(docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = dict(IDS)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))


def test_repeats_keep_columns_of_any_name(spark):
    """Names of the operator's own columns, and one with a dot."""
    names = ["_mark", "_id", "starts", "_row", "_r", "mark", "part", "a.b"]
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(2, text), (1, text), (3, None)], "doc_id long, text string").select("*", *[F.lit("own").alias(n) for n in names])
    got = {r["doc_id"]: r for r in substrings.without_repeats(docs).collect()}
    assert substrings.without_repeats(docs).columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    assert all(r[n] == "own" for r in got.values() for n in names)
    assert [(got[i]["kept_text"], got[i]["text"]) for i in (1, 2, 3)] == [(text, text), ("", text), ("", None)]


def test_repeats_of_one_text_have_no_hot_key(spark):
    """2,000 copies of a text: their windows are dealt by document, and those that most runs share by hash."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("mark"), F.lit(text).alias("text")).repartition(40)
    bits, hot = substrings._repeated_bits(rows.select("text").mapInArrow(substrings._count, "symbol long, n int"))
    windows = rows.mapInArrow(substrings._file(bits, hot), "doc_id long, mark long, symbol long, part int, starts array<int>, hashes array<long>, late boolean")
    per = [r["n"] for r in windows.groupBy("symbol", "part").agg(F.sum(F.size("starts")).alias("n")).collect()]
    assert len(hot) > 3 and sum(per) == 2000 * 181 and max(per) < sum(per) / 500
    got = substrings.dedup(rows.drop("mark")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(0, 0), *((i, 200) for i in range(1, 2000))]


def deadlines(weights: list[int], blocks: list[int], n: int) -> list[tuple[int, int, int]]:
    """The first n blocks in the order of plain earliest deadlines: source, block, slot."""
    all_, k, t, out = sum(weights), [0] * len(weights), 0, []
    while len(out) < n and any(a < b for a, b in zip(k, blocks, strict=True)):
        left = [i for i, b in enumerate(blocks) if k[i] < b]
        t = max(t, min(k[i] * all_ // weights[i] for i in left))
        due, i = min((-(-(k[i] + 1) * all_ // weights[i]), i) for i in left if k[i] * all_ // weights[i] <= t)
        assert t < due
        out.append((i, k[i], t))
        k[i] += 1
        t += 1
    return out


def test_schedule_of_exact_weights(spark):
    """100,000 slots of weights that no period fits: each source is less than one block from its share at each slot."""
    weights = {"a": 0.3, "b": 1 / 7, "c": 0.00001, "d": 1 - 0.3 - 1 / 7 - 0.00001}
    sizes = spark.createDataFrame([(s, 10**5) for s in weights], "mix_source string, bytes long")
    share = mixing.shares(sizes, weights, block_bytes=1).withColumn("blocks", F.greatest(F.ceil(F.lit(100_000) * F.col("weight") / F.col("all")), F.lit(1)).cast("long"))
    rows = mixing.schedule(share).orderBy("mix_rank").collect()
    exact = {r["mix_source"]: r["weight"] for r in share.collect()}
    all_ = sum(exact.values())
    assert all(abs(exact[s] / all_ - w) < 1e-11 for s, w in weights.items())
    names = sorted(weights)
    want = deadlines([exact[s] for s in names], [r["blocks"] for s in names for r in share.filter(F.col("mix_source") == s).collect()], len(rows))
    assert [(r["mix_source"], r["mix_block"], r["mix_slot"]) for r in rows] == [(names[i], k, t) for i, k, t in want]
    done = dict.fromkeys(names, 0)
    for r in rows[:99_000]:
        done[r["mix_source"]] += 1
        assert r["mix_slot"] == r["mix_rank"]
        assert all(abs(done[s] * all_ - exact[s] * (r["mix_slot"] + 1)) < all_ for s in names), "of the weights as they are, in whole numbers"
        assert all(abs(done[s] - weights[s] * (r["mix_slot"] + 1)) < 1 + 1e-6 for s in names), "of the weights as they were given"


def test_mixing_against_earliest_deadlines(spark, monkeypatch):
    """Blocks, slots and the order, against plain Python; a source without a weight comes last, and blocks grow where they would be too many."""
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.integers(0, 400)), None if i % 11 == 0 else f"s{int(rng.integers(0, 5)) if i % 3 else 0}") for i in range(400)]
    weights = {"s0": 0.5, "s1": 0.25, "s2": 0.1, "s4": 0.05, "absent": 0.3}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    names = sorted({r[2] is None and "null" or f"s:{r[2]}" for r in rows})
    size = {x: sum(max(len(t), 1) for _, t, s in rows if (s is None and "null" or f"s:{s}") == x) for x in names}
    for most in (1 << 17, 40):
        monkeypatch.setattr(mixing, "MOST_BLOCKS", most)
        got = {r["doc_id"]: r for r in mixing.mix(docs, weights, 1000).withColumn("mark", F.xxhash64("doc_id", "text")).collect()}
        block = max(1000, -(-sum(size.values()) // most))
        known = sum(weights.get(x[2:], 0.0) for x in names)
        whole = [max(1, round(weights.get(x[2:], 0.0) / known * mixing.SCALE)) for x in names]
        slot = {(names[i], k): t for i, k, t in deadlines(whole, [-(-size[x] // block) for x in names], 1 << 30)}
        order = []
        for name in names:
            at = 0
            own = [r for r in rows if (r[2] is None and "null" or f"s:{r[2]}") == name]
            for d, text, _ in sorted(own, key=lambda r: (got[r[0]]["mark"] % mixing.BUCKETS, got[r[0]]["mark"], r[0])):
                assert (got[d]["mix_block"], got[d]["mix_slot"]) == (at // block, slot[name, at // block])
                order.append((got[d]["mix_slot"], at, d))
                at += max(len(text), 1)
        assert [d for _, _, d in sorted(order)] == sorted(got, key=lambda d: got[d]["mix_position"])
        assert sorted(r["mix_position"] for r in got.values()) == list(range(400))


@pytest.mark.parametrize("frame", [documents, clashing])
def test_mixing_keeps_rows(spark, frame):
    docs = frame(spark)
    rows = mixing.mix(docs).collect()
    assert sorted(r["mix_position"] for r in rows) == list(range(len(ROWS)))
    mixed = mixing.in_mixed_order(docs)
    assert mixed.columns == docs.columns and Counter(mixed.collect()) == Counter(docs.collect())


def test_empty_tables(spark, tmp_path):
    none = documents(spark, [])
    path = public_tokenizers.path("byte_bpe_50k.json")
    for f in (quality.ledger, lambda d: quality.ablation(quality.ledger(d)), pii.find, pii.redact, jaccard.jaccard_components, jaccard.keep_one, substrings.dedup, langid.identify, mixing.mix, mixing.in_mixed_order, lambda d: packing.pack(d, path), lambda d: token_counts.token_counts(d, path)):
        assert f(none).count() == 0
