"""Quality rules: text statistics and a learned decision list, all as Spark expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind
from .common import WORD, hash_cut, stash

WINDOW = 8
SAMPLE_ROWS = 20_000
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "digits")


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and counts of capitals,
    exclamation marks and digits) of every whole text, one row per input row.

    A word of an 8-word window that occurs twice in the text is repeated. Windows are compared by a
    64-bit hash of their words inside one document only: for a document of a million windows a
    false match has a chance below 1 in 10^7. Arrays belong to one row, nothing is shuffled.
    Null text counts as empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = bind(rows, "words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = bind(rows, "lines", lines)
    codes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"!")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        codes.alias("codes"),
    )
    rows = bind(rows, "codes", F.col("codes"))
    window = lambda i: F.xxhash64(*[F.get("codes", i + j) for j in range(WINDOW)])
    keys = F.when(F.size("codes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("codes") - WINDOW), window))
    rows = bind(rows.withColumn("keys", keys).drop("codes"), "keys", F.col("keys"))
    # only texts that hold some window twice sort their windows
    twice = F.size(F.array_distinct("keys")) < F.size("keys")
    rows = bind(
        rows,
        "sorted",
        F.when(twice, F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))),
    ).drop("keys")
    same = lambda a, b: F.get("sorted", a)["k"] == F.get("sorted", b)["k"]
    places = F.transform(
        F.sequence(F.lit(0), F.size("sorted") - 1),
        lambda j: F.when(
            ((j > 0) & same(j - 1, j)) | F.coalesce(same(j, j + 1), F.lit(False)), F.get("sorted", j)["i"]
        ),
    )
    rows = bind(rows, "places", F.when(F.col("sorted").isNotNull(), F.sort_array(F.filter(places, lambda p: p.isNotNull())))).drop("sorted")
    steps = F.zip_with("places", F.slice("places", F.lit(2), F.size("places")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.coalesce(F.when(F.size("places") > 0, covered), F.lit(0)).cast("long")).drop("places")


def features() -> dict[str, Column]:
    """The ratios that rules may test, all from :func:`text_statistics`."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per_word("word_chars"),
        "symbols": per_word("n_symbols"),
        "dup_lines": per_word("n_dup_lines"),
        "repeats": per_word("n_repeat_words"),
        "capitals": per_word("n_capitals"),
        "marks": per_word("n_marks"),
        "digits": per_word("n_digits"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, operator, threshold) that says a document is bad."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self, known: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, limit in self.tests:
            out = out & (known[name] > F.lit(limit) if op == ">" else known[name] <= F.lit(limit))
        return out

    def matches(self, row: dict[str, float]) -> bool:
        return all(row[f] > t if op == ">" else row[f] <= t for f, op, t in self.tests)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that matches says bad, none says good."""

    rules: tuple[Rule, ...]

    def good(self) -> Column:
        known, out = features(), None
        for r in self.rules:
            out = (F.when if out is None else out.when)(r.column(known), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(rows: list[dict[str, float]], bad: list[bool], cuts: int = 32, max_rules: int = 12, min_precision: float = 0.8, min_cover: int = 5) -> DecisionList:
    """Sequential covering. A rule grows on two thirds of what is left by the test of best FOIL gain
    until it covers no good row or nothing gains, is pruned from its end on the last third to the
    best (p - n) / (p + n), and stays if its precision over all that is left is ``min_precision`` on
    ``min_cover`` rows or more. Thresholds are quantiles of the sample, at most ``cuts`` a feature.
    """
    if not rows or not any(bad) or all(bad):
        return DecisionList(())
    thresholds = {}
    for f in FEATURES:
        values = sorted(r[f] for r in rows)
        picked = {values[min(len(values) - 1, (i * len(values)) // cuts)] for i in range(1, cuts)} | {0.0}
        rare = [v for v, b in zip((r[f] for r in rows), bad, strict=True) if b]
        rare.sort()
        picked |= {rare[min(len(rare) - 1, (i * len(rare)) // 16)] for i in range(16)}
        thresholds[f] = sorted(picked)
    left = list(range(len(rows)))
    found: list[Rule] = []

    def counts(idx, rule):
        hit = [i for i in idx if rule.matches(rows[i])]
        p = sum(bad[i] for i in hit)
        return p, len(hit) - p

    while len(found) < max_rules and any(bad[i] for i in left):
        grow = [i for k, i in enumerate(left) if k % 3 != 2]
        prune = [i for k, i in enumerate(left) if k % 3 == 2]
        tests: list[tuple[str, str, float]] = []
        cover = grow
        while len(tests) < len(FEATURES):
            p0 = sum(bad[i] for i in cover)
            n0 = len(cover) - p0
            if not p0 or not n0:
                break
            best, choice = 1e-9, None
            for f in FEATURES:
                ordered = sorted((rows[i][f], bad[i]) for i in cover)
                p = n = k = 0
                for t in thresholds[f]:
                    while k < len(ordered) and ordered[k][0] <= t:
                        p, n, k = p + ordered[k][1], n + (not ordered[k][1]), k + 1
                    for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                        g = _gain(p0, n0, a, b)
                        if g > best:
                            best, choice = g, (f, op, t)
            if choice is None:
                break
            tests.append(choice)
            cover = [i for i in cover if Rule((choice,)).matches(rows[i])]
        if not tests:
            break

        def worth(rule):
            p, n = counts(prune, rule)
            return (p - n) / (p + n) if p + n else -1.0

        options = [Rule(tuple(tests[:k])) for k in range(len(tests), 0, -1)]
        rule = max(options, key=lambda r: (worth(r), -len(r.tests)))
        p, n = counts(left, rule)
        if p + n < min_cover or p < min_precision * (p + n):
            break
        found.append(rule)
        left = [i for i in left if not rule.matches(rows[i])]
    return DecisionList(tuple(found))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """A decision list from labelled statistics: ``labels`` has doc_id and quality (0 is bad).

    Learns from at most ``sample_rows`` rows that pass the base rules, those of smallest hash of their id; null
    labels and ids are left out. No labels give an empty list. Labels and statistics meet below a bound on the
    hash, which is taken from counts of labels and raised fourfold until enough rows are below it: neither the
    corpus nor a share of it per task is sorted for the sample.
    """
    h = lambda c: F.xxhash64(c)
    named = labels.select(F.col("doc_id").cast(stats.schema["doc_id"].dataType).alias("_id"), F.col("quality").alias("_q")).where("_id is not null and _q is not null")
    known = {f: c.alias(f) for f, c in features().items()}
    want = 2 * sample_rows
    while True:
        cut = hash_cut(named, h("_id"), want)
        ours, theirs = (named, stats) if cut is None else (named.where(h("_id") <= F.lit(cut)), stats.where(h("doc_id") <= F.lit(cut)))
        sample = theirs.where(~base_failed()).join(ours, F.col("doc_id") == F.col("_id"))
        sample = sample.select(F.xxhash64("doc_id").alias("_h"), "doc_id", *known.values(), (F.col("_q") == 0).alias("_bad"))
        got = sample.orderBy("_h", "doc_id", "_bad", *FEATURES).limit(sample_rows).collect()
        if cut is None or len(got) == sample_rows:
            break
        want *= 4
    return learn([{f: r[f] for f in FEATURES} for r in got], [r["_bad"] for r in got])


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of every document with ``base_failed`` and ``kept``.

    ``kept`` is false where the base rules fail, else what the learned list says. The statistics
    are computed once and written; learning and judging read numbers only.
    """
    stats = stash(text_statistics(docs), "quality")
    verdict = fit(stats, labels, sample_rows)
    return stats.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict.good()})
