"""Personal data: candidate spans and boosted trees that select among them.

Patterns propose spans in high recall, which may overlap. Spans of the base kinds whose format holds
(parts of an address, Luhn sum, number of digits) are always taken. The others are scored by boosted
regression trees over coarse features of format and context, and taken above a threshold of their
kind: written-out addresses, numbers with an area code, cards and addresses inside longer runs of
digits, and long tokens that may be secrets. Of the taken ones, those that overlap a base span or a
better one that is taken leave.

The trees are fitted to labelled sentences with personal data and look-alikes (``pii_examples``), whose
labels come from no pattern; a second fold of them calibrates each kind's threshold for precision, a
third is for tests. What a pattern's own check has looked at (digits of a card, sums) is no feature.
Everything that touches text is a native expression, and documents are scanned once.

Null texts are empty: no spans. Repeated rows are searched once each. Other columns do not pass
through ``find`` and all pass through ``redact``. An empty table gives an empty result. Positions
count code points; ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.pii_examples import CALIBRATION, FITTING, TESTING, examples
from emberlog.llm.words import let, running_sums, sha256_utf8

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
# A search goes on at the end of the last match (\G) or at the start of a run of the pattern's first
# characters, which are the only places where a leftmost match can begin. Possessive repeats match the
# same texts as greedy ones here and need no stack.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for the pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# Candidates beyond the base: written-out addresses, numbers with an area code, long tokens of letters and digits.
MORE_PATTERNS = {
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+=*",
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[\[(]?\x20?\bat\b\x20?[\])]?\x20?[A-Za-z0-9-]{{1,63}}\x20?[\[(]?\x20?\bdot\b\x20?[\])]?\x20?[A-Za-z]{{2,24}}\b",
    "phone": r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
# Runs of groups of digits, in which shorter spans of whole groups are candidates.
RUN_PATTERNS = {
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){4,}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){14,}+",
}
_TOKENS = {"ip": r"[0-9]+\.?", "card": r"[0-9]+[\x20-]?"}
# Card numbers as they are printed: in one group, in fours, or as 4-6-4 and 4-6-5.
USUAL_CARD = r"^(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5})$"
CONTEXT = 24
# Words before a span that speak for and against it.
CUES = r"(?i)\b(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|number|reach|card|visa|paid|pay|iban|account|ip|host|server|ping|address|write|token|api_?key|key|secret|passw(?:or)?d|bearer|auth)\b"
AGAINST = r"(?i)\b(?:order|part|item|serial|version|release|build|oid|section|chapter|invoice|isbn|sku|ref|lot|tracking|sequence|checksum|sha\d*|md5|etag|commit|hash|uuid|file)\b"
EXAMPLES = 400  # labelled texts per kind, and as many look-alikes
ROUNDS = 40
RATE = 0.3
PRECISION = 0.9
NEAR = 300  # candidates that may begin within reach of a span, to either side, after overlaps of one start are put in order


_SPAN = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"


def _spans(text: Column, pattern: str, needs: str | None, plausible) -> Column:
    """The plausible matches with the characters beside them, up to the next match: ``_SPAN``.

    Positions are running sums of the lengths of matches and of the pieces between them.
    """

    def build(found: Column, between: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.char_length(F.get(between, i)) + F.char_length(m))

        def one(m: Column, i: Column, ends: Column) -> Column:
            stop = F.get(ends, i)
            fields = {"start": stop - F.char_length(m), "stop": stop, "value": m, "before": F.right(F.get(between, i), F.lit(CONTEXT)), "after": F.left(F.get(between, i + 1), F.lit(1))}
            return F.when(plausible(m), F.struct(*[c.alias(name) for name, c in fields.items()]))

        return let(running_sums(sizes), lambda ends: F.filter(F.transform(found, lambda m, i: one(m, i, ends)), lambda s: s.isNotNull()))

    hit = text.contains(needs) & text.rlike(pattern) if needs else text.rlike(pattern)
    matched = lambda t, between: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: build(found, between))
    return F.when(hit, let(text, lambda t: let(F.split(t, pattern, -1), lambda between: matched(t, between)))).otherwise(F.array().cast(_SPAN))


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern has the kind's format."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # Leading zeros are harmless; more than three digits after them exceed 255.
        part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255"))
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False)
    return (n >= 10) & (n <= 15)


def _plausible(kind: str, base: bool):
    """Which matches are proposed: a card number has 12 to 22 digits or so, with at most a separator between two."""
    return (lambda m: (F.char_length(m) >= 12) & (F.char_length(m) <= 43)) if kind == "card" and base else lambda m: F.lit(True)


def _inner(run: Column, kind: str) -> Column:
    """The spans of whole groups in a run that have the kind's format and are shorter than it: ``_SPAN``."""

    def build(tokens: Column, stops: Column) -> Column:
        n = F.size(tokens)
        most = 4 if kind == "ip" else 19  # groups
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(stops, i - 1))
        end = lambda j: F.get(stops, j) - F.when(j == n - 1, 0).otherwise(1)
        digits = lambda i, j: end(j) - begin(i) - (j - i)
        # Not slice, which copies the whole array.
        joined = lambda i, size: F.when(size == 0, "").otherwise(F.array_join(F.transform(F.sequence(i, i + size - 1), lambda k: F.get(tokens, k)), ""))

        def one(i: Column, j: Column) -> Column:
            near = F.least(i, F.lit(CONTEXT))
            before = F.concat(F.when(near == i, run["before"]).otherwise(""), joined(i - near, near))
            fields = {"start": run["start"] + begin(i), "stop": run["start"] + end(j), "value": F.left(joined(i, j - i + 1), end(j) - begin(i)), "before": F.right(before, F.lit(CONTEXT)), "after": F.when(j == n - 1, run["after"]).otherwise(F.right(F.get(tokens, j), F.lit(1)))}
            return F.struct(*[c.alias(name) for name, c in fields.items()])

        def fits(i: Column, j: Column) -> Column:
            return j - i == 3 if kind == "ip" else (digits(i, j) >= 14) & (digits(i, j) <= 19) & (j - i < n - 1)

        ends = lambda i: F.filter(F.sequence(i, F.least(i + (most - 1), n - 1)), lambda j: fits(i, j))
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(F.transform(ends(i), lambda j: one(i, j)), lambda s: valid(kind, s["value"]))))

    tokens = F.regexp_extract_all(run["value"], F.lit(_TOKENS[kind]), F.lit(0))
    return let(tokens, lambda t: let(running_sums(F.transform(t, lambda x: F.char_length(x))), lambda stops: build(t, stops)))


def _inside(text: Column, kind: str) -> Column:
    """All spans of ``_inner``; a run that is a card itself has none."""
    failed = (lambda m: ~valid("card", m)) if kind == "card" else lambda m: F.lit(True)
    return F.flatten(F.transform(_spans(text, RUN_PATTERNS[kind], _NEEDS[kind], failed), lambda run: _inner(run, kind)))


def candidates(text: Column) -> Column:
    """All proposed spans: array<struct<start, rank, stop, kind, base, confirmed, value, before, after>>, kinds in order."""

    def tagged(kind: str, base: bool):
        def one(s: Column) -> Column:
            fields = {"start": s["start"], "rank": F.lit(KINDS.index(kind)), "stop": s["stop"], "kind": F.lit(kind), "base": F.lit(base), "confirmed": valid(kind, s["value"]) if base else F.lit(False), "value": s["value"], "before": s["before"], "after": s["after"]}
            return F.struct(*[c.alias(name) for name, c in fields.items()])

        return one

    found = [F.transform(_spans(text, patterns[kind], _NEEDS.get(kind) if base else None, _plausible(kind, base)), tagged(kind, base)) for kind in KINDS for patterns, base in ((BASE_PATTERNS, True), (MORE_PATTERNS, False)) if kind in patterns]
    return F.concat(*found, *[F.transform(_inside(text, kind), tagged(kind, False)) for kind in RUN_PATTERNS])


# Features by name: whole numbers of few values over a candidate and the text around it.
FEATURES = ["kind", "groups", "first", "last", "separator", "bracket", "usual", "hex", "cue", "against", "left", "right"]


def _features(s: Column) -> Column:
    value, before, after = s["value"], s["before"], s["after"]
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"[\x20\x09-\x0D]"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    flag = lambda c: F.when(c, 1).otherwise(0)
    separator = F.when(value.rlike("^[A-Za-z0-9]+$"), 0).when(value.rlike(r"^[A-Za-z0-9\x20]+$"), 1).when(value.rlike("^[A-Za-z0-9-]+$"), 2).when(value.rlike(r"^[A-Za-z0-9.]+$"), 3).otherwise(4)
    parts = F.filter(F.split(value, r"[^A-Za-z0-9]+"), lambda x: x != "")
    size = lambda x: F.least(F.coalesce(F.char_length(x), F.lit(0)), F.lit(8))
    return F.struct(
        s["rank"].alias("kind"),
        F.least(F.size(parts), F.lit(7)).alias("groups"),
        size(F.get(parts, F.lit(0))).alias("first"),
        size(F.get(parts, F.size(parts) - 1)).alias("last"),
        separator.alias("separator"),
        flag(value.rlike(r"[(\[]")).alias("bracket"),
        flag((s["kind"] == "card") & value.rlike(USUAL_CARD)).alias("usual"),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        flag(before.rlike(CUES)).alias("cue"),
        flag(before.rlike(AGAINST)).alias("against"),
        side(F.right(before, F.lit(1))).alias("left"),
        side(after).alias("right"),
    )


@dataclass
class Tree:
    """A stump with one split on each side: (feature, threshold) and leaf values."""

    root: tuple[str, int]
    low: tuple[str, int, float, float]
    high: tuple[str, int, float, float]

    def value(self, x: dict[str, int]) -> float:
        name, cut, a, b = self.low if x[self.root[0]] <= self.root[1] else self.high
        return a if x[name] <= cut else b

    def column(self, x: Column) -> Column:
        side = lambda s: F.when(x[s[0]] <= s[1], s[2]).otherwise(s[3])
        return F.when(x[self.root[0]] <= self.root[1], side(self.low)).otherwise(side(self.high))


Model = tuple[list[Tree], dict[str, float]]


def boost(rows: list[dict]) -> list[Tree]:
    """Gradient boosting of depth-two trees on feature vectors with ``positive`` and ``negative`` counts."""
    trees: list[Tree] = []
    score = [0.0] * len(rows)
    cuts = [(f, c) for f in FEATURES for c in sorted({r[f] for r in rows})[:-1]]

    def gain(members: list[int], g: list[float], h: list[float]):
        best = (-1.0, (FEATURES[0], 0, 0.0, 0.0))
        for f, c in cuts:
            sums = [[0.0, 1.0], [0.0, 1.0]]
            for i in members:
                s = sums[rows[i][f] > c]
                s[0] += g[i]
                s[1] += h[i]
            (ga, ha), (gb, hb) = sums
            if (now := ga * ga / ha + gb * gb / hb) > best[0] + 1e-12:
                best = (now, (f, c, RATE * ga / ha, RATE * gb / hb))
        return best

    for _ in range(ROUNDS if rows else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [r["positive"] - (r["positive"] + r["negative"]) * q for r, q in zip(rows, p, strict=True)]
        h = [(r["positive"] + r["negative"]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        everyone = list(range(len(rows)))
        f, c = gain(everyone, g, h)[1][:2]
        low, high = ([i for i in everyone if (rows[i][f] > c) == side] for side in (False, True))
        trees.append(Tree((f, c), gain(low, g, h)[1], gain(high, g, h)[1]))
        score = [s + trees[-1].value(r) for s, r in zip(score, rows, strict=True)]
    return trees


def calibrate(trees: list[Tree], rows: list[dict]) -> dict[str, float]:
    """Per kind the lowest score from which on the share of positives is at least ``PRECISION``; infinite if there is none."""
    out = {}
    for rank, kind in enumerate(KINDS):
        own = sorted(((sum(t.value(r) for t in trees), r["positive"], r["negative"]) for r in rows if r["kind"] == rank), reverse=True)
        out[kind], good, all_ = math.inf, 0, 0
        for i, (s, p, n) in enumerate(own):
            good, all_ = good + p, all_ + p + n
            if (i + 1 == len(own) or own[i + 1][0] < s) and good >= PRECISION * all_:
                out[kind] = s
    return out


def labelled(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Feature vectors of the candidates beyond the base in labelled texts: the features, positive, negative, fold."""
    docs = spark.createDataFrame(rows, "id long, text string, spans array<string>, fold int")
    own = lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string"))
    found = F.filter(candidates(F.col("text")), lambda c: ~c["base"])
    each = docs.select("spans", "fold", F.explode(found).alias("c")).select(_features(F.col("c")).alias("f"), "fold", F.array_contains("spans", own(F.col("c"))).alias("ok"))
    return each.groupBy("f", "fold").agg(F.count_if("ok").alias("positive"), F.count_if(~F.col("ok")).alias("negative")).select("f.*", "fold", "positive", "negative")


def train(spark: SparkSession, per_case: int = EXAMPLES) -> Model:
    """Trees from one fold of the labelled examples and thresholds by kind from another; bounded by ``per_case`` texts a kind."""
    rows = [r.asDict() for r in labelled(spark, [r for r in examples(per_case) if r[3] != TESTING]).orderBy("fold", *FEATURES).collect()]
    trees = boost([r for r in rows if r["fold"] == FITTING])
    return trees, calibrate(trees, [r for r in rows if r["fold"] == CALIBRATION])


def _selected(found: Column, model: Model) -> Column:
    """Confirmed spans, and those of the others whose score reaches their kind's threshold and that overlap no better one; by start, then kind."""
    trees, limits = model
    finite = {k: v for k, v in limits.items() if not math.isinf(v)}

    def scored(s: Column) -> Column:
        if not trees or not finite:
            return F.lit(None).cast("double")
        limit = F.lit(None).cast("double")
        for kind, value in finite.items():
            limit = F.when(s["kind"] == kind, value).otherwise(limit)
        total = let(_features(s), lambda x: sum((t.column(x) for t in trees), F.lit(0.0)))
        return let(total, lambda v: F.when(v >= limit, v))

    # A base span is better than any other, then the score, the length and the earlier start decide.
    rated = lambda s: F.struct(s["start"], s["rank"], s["stop"], s["kind"], s["base"], F.when(s["confirmed"], F.lit(float("inf"))).when(~s["base"], scored(s)).alias("score"))
    taken = F.filter(F.transform(found, rated), lambda s: s["score"].isNotNull())
    worth = lambda s: F.struct(s["score"], s["stop"] - s["start"], -s["start"], -s["rank"])
    beaten = lambda s, o: (o["start"] < s["stop"]) & (s["start"] < o["stop"]) & (worth(o) > worth(s))
    near = lambda all_, i: F.slice(all_, F.greatest(i + 1 - NEAR, F.lit(1)), 2 * NEAR)
    free = lambda all_: F.filter(all_, lambda s, i: s["base"] | ~F.exists(near(all_, i), lambda o: beaten(s, o)))
    return let(F.sort_array(taken), lambda t: F.when(F.forall(t, lambda s: s["base"]), t).otherwise(free(t)))


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def with_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Adds ``pii_text`` (null as empty) and ``pii`` (the selected spans); fits the trees first unless they are given."""
    model = model or train(docs.sparkSession)
    text = docs.drop("pii", "pii_text").withColumn("pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return text.withColumn("pii", let(F.col("pii_text"), lambda t: let(candidates(t), lambda c: _selected(c, model))))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (kind:start:end, by start and kind), n_secret, n_spans."""
    marked = with_spans(docs.select("doc_id", "text"), model)
    kept = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "pii", F.filter("pii", lambda s: s["base"]).alias("base"))
    count = lambda of, kind: F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return kept.select("doc_id", *[count("base", k) for k in BASE_KINDS], sha256_utf8(_join(F.col("base"))).alias("base_sha256"), _join(F.col("pii")).alias("spans"), count("pii", "secret"), F.size("pii").cast("long").alias("n_spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with each run of overlapping spans replaced by the first one's kind in brackets.

    ``n_chars`` follows the new text. Null texts stay null.
    """
    marked = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), model)
    # A span opens a replacement if it begins at or after all ends before it.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<gap:int,start:int,stop:int,rank:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(acc["at"].alias("gap"), s["start"].alias("start"), s["stop"].alias("stop"), s["rank"].alias("rank"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    def cleaned(t: Column, spans: Column) -> Column:
        label = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["rank"] + 1)
        part = lambda s: F.concat(F.substring(t, s["gap"] + 1, s["start"] - s["gap"]), label(s))
        return let(F.aggregate(spans, start, step), lambda acc: F.concat(F.array_join(F.transform(acc["out"], part), ""), F.substring(t, acc["at"] + 1, F.char_length(t))))

    new = F.when(F.size("pii") > 0, cleaned(F.col("pii_text"), F.col("pii"))).otherwise(F.col("text"))
    replaced = {"text": new}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(F.size("pii") > 0, F.char_length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return marked.select(*[replaced.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
