"""Quality rules: learned decision lists, in DataFrame functions only.

``text_features`` measures each text with higher-order SQL functions (no
shuffle, no Python).  ``learn_rules`` bins the features of labelled documents
at quantiles, lets Spark count the labels per cell of bins, and runs sequential
covering on those counts: a rule is a conjunction of threshold tests grown by
FOIL gain on two thirds of the labelled rows and pruned on the other third.
``rules_to_column`` emits the list as one ordered CASE expression.

Defined results: null and empty texts have no words (all measures 0);
repeated rows are judged one by one; an empty table gives an empty result; with
no labels the list is empty and only the base test rejects; labels without a
doc_id or quality are not learned from, of several labels of one document the
worst counts, and every row with that doc_id is learned from; columns other than
``doc_id`` and ``text`` pass through unread, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS

#: Labelled rows that a list is learned from, at most (chosen by hash).
MAX_LABELLED = 20_000
#: Quantiles of the good documents at which a feature may be cut.  Where the bad
#: documents lie wholly beyond an outer quantile, the cut is half-way to them.
CUTS = (0.002, 0.02, 0.5, 0.98, 0.998)
BAD_ENDS = (0.95, 0.05)
FEATURES = ("mean_word_len", "symbols_per_word", "bangs_per_word", "dup_line_frac", "repeat_frac", "upper_frac")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, n: Column) -> Column:
    """Words that lie in 3-word windows found at least twice."""
    starts = F.sequence(F.lit(1), n - 2)
    grams = F.transform(
        starts, lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))
    )

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            last = F.size(s) - 1
            hits = F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return _let(
                F.sort_array(hits),
                lambda p: F.aggregate(
                    F.transform(
                        p, lambda i, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), i - F.get(p, k - 1)))
                    ),
                    F.lit(0),
                    lambda acc, x: acc + x,
                ),
            )

        return _let(placed, of_sorted)

    return F.when(n < 3, F.lit(0)).otherwise(
        _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    )


def text_features(docs: DataFrame) -> DataFrame:
    """``row``, a struct of the columns of ``docs``, and ``f``, a struct of the
    measures of its text: no column of theirs can meet one of ours."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    text, w = F.col("t"), F.col("w")
    out = out.withColumn("w", F.array_remove(F.split(text, WS + "+"), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = _let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
    out = out.withColumns({
        "m": F.struct(
            F.size(w).alias("n_words"),
            F.char_length(F.array_join(w, "")).alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
            F.regexp_count(text, F.lit(r"[!]")).alias("n_bangs"),
            F.regexp_count(text, F.lit(r"[A-Z]")).alias("n_upper"),
            line_counts.alias("lines"),
            _repeated_words(w, F.size(w)).alias("n_repeat_words"),
        )
    }).drop("t", "w")
    m = F.col("m")
    per_word = F.greatest(m["n_words"], F.lit(1)).cast("double")
    return out.withColumn(
        "f",
        F.struct(
            m["n_words"].cast("long").alias("n_words"),
            m["word_chars"].cast("long").alias("word_chars"),
            m["n_symbols"].cast("long").alias("n_symbols"),
            m["lines"]["dup"].cast("long").alias("n_dup_lines"),
            m["n_repeat_words"].cast("long").alias("n_repeat_words"),
            ((m["n_words"] < 50) | (100 * m["n_repeat_words"].cast("long") > 50 * m["n_words"].cast("long"))).alias("base_failed"),
            (m["word_chars"] / per_word).alias("mean_word_len"),
            (m["n_symbols"] / per_word).alias("symbols_per_word"),
            (m["n_bangs"] / per_word).alias("bangs_per_word"),
            (m["lines"]["dup"] / F.greatest(m["lines"]["n"], F.lit(1))).alias("dup_line_frac"),
            (m["n_repeat_words"] / per_word).alias("repeat_frac"),
            (m["n_upper"] / F.greatest(m["word_chars"], F.lit(1))).alias("upper_frac"),
        ),
    ).drop("m")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self, f: Column) -> Column:
        return f[self.feature] > self.cut if self.above else f[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass
class DecisionList:
    """Ordered rules; each rejects what it covers, the rest is accepted."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def reject_rule(self, f: Column) -> Column:
        """Number of the first rule that fires, from 1; null if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            cond = rule[0].column(f)
            for t in rule[1:]:
                cond = cond & t.column(f)
            out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
        return F.lit(None).cast("int") if out is None else out


def _cover(cells, tests, min_precision: float, max_rules: int, max_tests: int) -> list[tuple[Test, ...]]:
    """Sequential covering on counted cells ``(tests that hold, fold, bad, good)``."""

    def count(rows, rule, fold):
        bad = good = 0
        for held, at, b, g in rows:
            if at == fold and all(held[t] for t in rule):
                bad, good = bad + b, good + g
        return bad, good

    rules: list[tuple[int, ...]] = []
    left = cells
    while len(rules) < max_rules:
        rule: tuple[int, ...] = ()
        p0, n0 = count(left, rule, 0)
        if not p0:
            break
        while n0 and len(rule) < max_tests:
            best, gain = None, 0.0
            for t in range(len(tests)):
                p, n = count(left, (*rule, t), 0)
                if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain + 1e-9:
                    best, gain = t, g
            if best is None:
                break
            rule = (*rule, best)
            p0, n0 = count(left, rule, 0)
        if not rule:
            break

        def worth(r):
            p, n = count(left, r, 1)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = (sum(x) for x in zip(count(left, rule, 0), count(left, rule, 1), strict=True))
        if p + n < 5 or p / (p + n) < min_precision:
            break
        rules.append(rule)
        left = [c for c in left if not all(c[0][t] for t in rule)]
    return [tuple(tests[t] for t in r) for r in rules]


def _cuts(good: list[float] | None, bad: list[float] | None) -> list[float]:
    if not good or not bad:
        return []
    cuts = list(good)
    if bad[1] > good[-1]:
        cuts[-1] = (good[-1] + bad[1]) / 2
    if bad[0] < good[0]:
        cuts[0] = (good[0] + bad[0]) / 2
    return sorted(set(cuts))


def learn_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_labelled: int = MAX_LABELLED,
    min_precision: float = 0.95,
    max_rules: int = 12,
    max_tests: int = 3,
) -> DecisionList:
    """Learn a list from ``labels`` (doc_id, quality 0/1) and the texts of ``docs``.

    At most ``max_labelled`` labelled documents are measured; that bound also
    proves the size of the only broadcast.  What reaches the driver is one row
    per occupied cell, at most ``2 * (len(CUTS) + 1) ** len(FEATURES)`` and at
    most ``max_labelled``.
    """
    picked = (
        labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    f = F.col("f")
    seen = (
        text_features(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
        .select("row.doc_id", "row.quality", *[f[x].alias(x) for x in FEATURES])
        .persist()
    )
    try:
        ends = {
            bad: seen.filter(f"(quality = 0) = {bad}")
            .agg(*[F.percentile_approx(x, list(BAD_ENDS if bad else CUTS), 10_000).alias(x) for x in FEATURES]).first()
            for bad in (True, False)
        }
        tests = [
            Test(x, above, float(cut))
            for x in FEATURES
            for cut in _cuts(ends[False][x], ends[True][x])
            for above in (True, False)
        ]
        if not tests:
            return DecisionList()
        held = F.array(*[t.column(F.struct(*[F.col(x) for x in FEATURES])) for t in tests])
        cells = (
            seen.groupBy(held.alias("held"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("fold"))
            .agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good"))
            .collect()
        )
    finally:
        seen.unpersist()
    rows = sorted((tuple(c["held"]), c["fold"], c["bad"], c["good"]) for c in cells)
    return DecisionList(_cover(rows, tests, min_precision, max_rules, max_tests))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``row`` and ``f`` of each document, ``rule`` (number of the first that fires) and ``kept``."""
    out = text_features(docs)
    f = F.col("f")
    out = out.withColumn("rule", rules.reject_rule(f))
    # A filter on what is deterministic would be pushed below the projections that
    # hold the measures and would evaluate the split words once per word.
    guard = F.monotonically_increasing_id() >= 0
    return out.withColumn("kept", ~f["base_failed"] & F.col("rule").isNull() & guard)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base test and the learned list accept, columns unchanged."""
    return judge(docs, learn_rules(docs, labels)).filter("kept").select("row.*")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"), learn_rules(docs, labels))
    f = F.col("f")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select("row.doc_id", *[f[x].alias(x) for x in names], "rule", "kept")
