"""The pipeline's stages, each against plain Python over what the stage before it kept."""

from __future__ import annotations

import corpus_pipeline
from emberlog.llm import mixing
from tests.llm import brute


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == columns
    rows = docs.collect()
    base_failed = {r["doc_id"] for r in rows if brute.quality(r["text"])[5]}
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert left and not base_failed & set(left)

    single = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert single.columns == columns
    first = {c for _, _, c in brute.components(list(left.items()))}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(first)

    clean = corpus_pipeline.personal_data(spark, single, sf_dir)
    assert clean.columns == columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(texts) == first
    for doc, text in texts.items():
        if not brute.personal(left[doc]) and "[" not in text:
            assert text == left[doc]
        assert not [x for x in brute.personal(text) if x[2] in ("email", "phone")]

    mixed = corpus_pipeline.source_mix(spark, clean, sf_dir)
    assert mixed.columns == columns and {r["doc_id"]: r["text"] for r in mixed.collect()} == texts

    packed = corpus_pipeline.sequences(spark, mixed, sf_dir).collect()
    done: dict[int, list] = {}
    for r in packed:
        done.setdefault(r["doc_id"], []).append(r)
    assert set(done) == first
    assert all(sum(r["length"] for r in parts) == parts[0]["doc_tokens"] for parts in done.values())


def test_sequences_follow_the_mixed_order_over_several_files(spark, sf_dir, tmp_path):
    """Of two tasks that pack, the one with smaller sequence ids has the earlier documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").dropDuplicates(["doc_id"])
    place = {r["doc_id"]: r["mix_position"] for r in mixing.mix(docs).select("doc_id", "mix_position").collect()}
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "64k"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        corpus_pipeline.source_mix(spark, docs, sf_dir).write.parquet(f"{tmp_path}/mixed")
        rows = corpus_pipeline.sequences(spark, spark.read.parquet(f"{tmp_path}/mixed"), sf_dir).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tasks: dict[int, list] = {}
    for r in rows:
        tasks.setdefault(r["sequence_id"] >> 36, []).append(place[r["doc_id"]])
    order = [sorted(tasks[t]) for t in sorted(tasks)]
    assert len(order) > 1
    assert all(a[-1] < b[0] for a, b in zip(order, order[1:], strict=False))


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, unlike texts of one id, columns with the stages' own names, and an empty table."""
    text = lambda x: " ".join(f"{x}{'abcdefghij'[k % 10]} of{x} the{k}" for k in range(12)).replace("0", "o")
    ids = [(1, None), (2, ""), (None, text("n")), (3, text("w")), (7, text("w")), (7, text("u")), (9, text("v")), (9, text("v")), (10, text("v") + " more")]
    names = ["_words", "_lines", "n_words", "kept", "_row", "_key", "mix_slot", "pii", "part", "key", "a.b"]
    frame = spark.createDataFrame(ids, "doc_id long, text string").selectExpr("*", "'en' AS lang", "cast(null AS string) AS source", "cast(length(text) AS long) AS n_chars", *[f"'own' AS `{n}`" for n in names])
    for folder, rows in (("odd", frame), ("none", frame.limit(0))):
        rows.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{folder}")
            assert docs.columns == frame.columns
        left = docs.collect()
        assert all(r[n] == "own" for r in left for n in names)
        assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == ([(0, text("n")), (3, text("w")), (7, text("u")), (9, text("v"))] if folder == "odd" else [])
        got = corpus_pipeline.run(spark, f"{tmp_path}/{folder}").collect()
        assert {r["doc_id"] for r in got} == ({None, 3, 7, 9} if folder == "odd" else set())
