"""PII: candidate spans scored by boosted trees, in DataFrame functions only.

Generators (regular expressions, high recall) propose spans: those of the base
kinds and, beyond them, national phone numbers, identity numbers, masked e-mail
addresses, long digit runs that the base dropped, and key-like strings.  Each
candidate gets format and context features, small integers.  Gradient-boosted
trees of depth 2 score it; a threshold per kind, calibrated for precision on
examples that took no part in boosting, selects.  Base spans always stay; an
added span goes where it overlaps a base span or a better added one.

The trees are learned from ``EXAMPLES`` generated sentences whose personal data
are known by construction; Spark makes the sentences, runs the generators on
them and counts examples per combination of features, and only those counts
(a number bounded by ``EXAMPLES``) reach the driver.  The model is emitted as
CASE expressions.

Positions come from cutting the text at the matches and adding up lengths, so
a text is scanned once per generator and never searched again.  All quantifiers
that could backtrack are possessive, and starts are tied to the start of a run,
so long runs take linear time; the spans are those of the plain patterns.

Defined results: null and empty texts have no spans; repeated rows are judged
one by one; an empty table gives an empty result; other columns pass through
``redact`` untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize

EXAMPLES = 12_000
ROUNDS, RATE, PRECISION = 40, 0.3, 0.98
KINDS = ("email", "ip", "card", "phone", "id", "secret")
#: How the base kinds are found (equivalent to the plain patterns).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators beyond the base: kind, pattern.
MORE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++"),
    ("phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+"),
)
_CUES = r"(token|secret|passw|pwd|api.?key|access.?key|bearer|credential)[^a-z0-9]{0,6}$"
_PERSONAL = r"(card|visa|mastercard|ssn|social security|phone|tel|call|mobile|mail|contact|reach)[^0-9]{0,12}$"
_NEUTRAL = r"(order|isbn|commit|sha1?|etag|digest|build|version|page|ticket|invoice|part|no\.?|#)[^a-z0-9]{0,6}$"
FEATURES = ("source", "length", "digits", "luhn", "upper", "cue", "quoted", "dashes", "distinct")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _found(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<m, start, end>> of a pattern's leftmost, non-overlapping matches."""
    none = F.array().cast("array<struct<m:string,start:int,end:int>>")

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        both = F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda x, g: F.struct(x.alias("m"), F.char_length(g).alias("g")))
        return F.aggregate(
            both, F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["g"] + F.char_length(x["m"])).alias("at"),
                F.concat(s["out"], F.array(F.struct(x["m"].alias("m"), (s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + F.char_length(x["m"])).alias("end")))).alias("out"),
            ),
            lambda s: s["out"],
        )

    hits = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))
    return F.when(gate, hits).otherwise(none)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """The contract's test of a base match."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.char_length(_digits(m)).between(14, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(10, 15)
    return F.lit(True)


def _bucket(value: Column, *edges: int) -> Column:
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(value <= edges[k], F.lit(k)).otherwise(out)
    return out


def features(source: int, m: Column, before: Column, after: Column) -> list[Column]:
    """In the order of FEATURES; all small integers."""
    n, d = F.char_length(m), F.char_length(_digits(m))
    low = F.lower(before)
    return [
        F.lit(source),
        _bucket(n, 9, 12, 15, 19, 31, 40, 64),
        F.floor(4 * d / F.greatest(n, F.lit(1))).cast("int"),
        F.when((d >= 12) & (d == F.char_length(F.regexp_replace(m, r"[\x20-]", ""))), F.when(_luhn(_digits(m)), 2).otherwise(1)).otherwise(0),
        F.when(m.rlike("[A-Z]"), F.when(m.rlike("[a-z]"), 2).otherwise(1)).otherwise(0),
        F.when(low.rlike(_CUES), 3).when(low.rlike(_PERSONAL), 2).when(low.rlike(_NEUTRAL), 0).otherwise(1),
        (before.rlike(r"[\"'=:]\x20?$").cast("int") + after.rlike(r"^[\"']").cast("int")),
        _bucket(F.char_length(F.regexp_replace(m, "[^_-]", "")), 0, 1, 2, 4),
        _bucket(F.size(F.array_distinct(F.split(m, ""))), 4, 8, 12, 16, 24),
    ]


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus ``__pii_base`` and ``__pii_more``: arrays of candidate spans.

    base: struct<start, rank, end>; more: struct<start, rank, end, x> with x the
    features."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digit = t.rlike("[0-9]")
    gates = {"email": F.contains(t, F.lit("@")), "ip": digit & t.rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": F.contains(t, F.lit("+")) & digit}
    cols = {f"__pii_{k}": _found(t, p, gates[k]) for k, p in BASE.items()}
    gate_more = (t.rlike(r"[\[(](?:at|AT)[\])]"), digit, digit & F.contains(t, F.lit("-")), digit)
    cols |= {f"__pii_m{k}": _found(t, p, gate_more[k]) for k, (_, p) in enumerate(MORE)}
    out = df.withColumns(cols)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    base = F.concat(empty, *[
        F.transform(F.filter(F.col(f"__pii_{k}"), _tester(k)), _plain(KINDS.index(k)))
        for k in BASE
    ])

    def described(source: int, rank: int):
        def one(x: Column) -> Column:
            before = F.substring(t, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
            after = F.substring(t, x["end"] + 1, F.lit(2))
            return F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
                F.array(*[f.cast("int") for f in features(source, x["m"], before, after)]).alias("x"),
            )

        return one

    dropped = F.filter(F.col("__pii_card"), lambda x: ~_valid("card", x["m"]) & F.char_length(_digits(x["m"])).between(9, 19))
    more = F.concat(
        F.transform(dropped, described(0, KINDS.index("card"))),
        *[F.transform(F.col(f"__pii_m{k}"), described(k + 1, KINDS.index(kind))) for k, (kind, _) in enumerate(MORE)],
    )
    return out.withColumns({"__pii_base": base, "__pii_more": more}).drop(*cols)


def _tester(kind: str):
    return lambda x: _valid(kind, x["m"])


def _plain(rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """id, text, start, end, truth: sentences with one marked string each."""
    def pick(salt: int, *options: str) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))

    number = F.concat(*[F.lpad(F.pmod(F.xxhash64("id", F.lit(100 + k)), F.lit(10**9)).cast("string"), 9, "0") for k in range(3)])
    digits = lambda a, k: F.substring(number, a, k)
    stem = digits(1, 15)
    wrong = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(stem, d.cast("string"))), lambda c: ~_luhn(c))[0]
    hexa = F.sha1(F.col("id").cast("string").cast("binary"))
    key = F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "[+/=]", "x"), 1, 40)
    any_case = F.when(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0, F.upper(hexa)).otherwise(hexa)
    slug = F.concat_ws("-", pick(20, "annual", "north", "second"), pick(21, "report", "meeting", "garden"), pick(22, "summary", "minutes", "notes"), F.concat(F.lit("20"), digits(1, 2)))
    name = F.concat(pick(23, "ann", "li", "omar", "eva"), digits(3, 2))
    makers = [
        (pick(1, "card ", "visa ", "pay with card number ", "card: ", "reach me, "), wrong, 0, ""),
        (pick(2, "call ", "phone ", "tel. ", "mobile ", "contact us at ", "or "), F.concat(F.lit("("), digits(1, 3), F.lit(") "), digits(4, 3), F.lit("-"), digits(7, 4)), 1, ""),
        (pick(3, "call ", "tel ", "my phone is "), F.concat_ws("-", digits(1, 3), digits(4, 3), digits(7, 4)), 1, ""),
        (pick(4, "page ", "part ", "invoice ", "ticket "), F.concat_ws("-", digits(1, 3), digits(4, 3), digits(7, 4)), 0, ""),
        (pick(5, "ssn ", "ssn: ", "social security ", "her id "), F.concat_ws("-", digits(1, 3), digits(4, 2), digits(6, 4)), 1, ""),
        (pick(6, "part ", "order ", "invoice "), F.concat_ws("-", digits(1, 3), digits(4, 2), digits(6, 4)), 0, ""),
        (pick(8, 'token = "', 'TOKEN = "', 'secret: "', 'api_key="', "password='", 'access_key = "'), any_case, 1, '"'),
        (pick(9, "token = ", "Bearer ", "api-key: ", "secret="), key, 1, ""),
        (pick(10, "commit ", "sha1 ", "etag ", "digest ", "build "), hexa, 0, ""),
        (pick(11, "order ", "isbn ", "no. ", "ticket #", "and "), digits(1, 13), 0, ""),
        (pick(12, "see ", "the ", "at /"), slug, 0, ""),
        (pick(13, "mail ", "contact ", "write to "), F.concat(name, F.lit(" (at) example (dot) com")), 1, ""),
        (pick(14, "mail ", "reach ", "is "), F.concat(name, F.lit("[at]mail.example.org")), 1, ""),
    ]
    which = F.pmod(F.col("id"), F.lit(len(makers)))
    lead, mark, truth, tail = (None,) * 4
    for k, (a, b, c, d) in enumerate(makers):
        step = lambda have, v, k=k: F.when(which == k, v) if have is None else have.when(which == k, v)
        lead, mark, truth, tail = step(lead, a), step(mark, b), step(truth, F.lit(c)), step(tail, F.lit(d))
    words = pick(30, "in the end we met, ", "as said before ", "", "Later on: ", "of those that came ")
    rows = spark.range(n).select("id", F.concat(words, lead).alias("head"), mark.alias("mark"), truth.alias("truth"), F.concat(tail, pick(31, " and so on.", ".", "\nNext line", ", thanks")).alias("rest"))
    return rows.select(
        "id", F.concat("head", "mark", "rest").alias("text"), F.char_length("head").alias("s"), (F.char_length("head") + F.char_length("mark")).alias("e"), "truth"
    )


@dataclass
class Trees:
    """Depth-2 trees: (feature, cut, left, right) with left and right each
    (feature, cut, value, value); a test goes left where x <= cut."""

    trees: list
    thresholds: dict[int, float]
    bias: float

    def margin(self, x: tuple[int, ...]) -> float:
        out = self.bias
        for f, c, left, right in self.trees:
            g, d, lo, hi = left if x[f] <= c else right
            out += lo if x[g] <= d else hi
        return out

    def column(self, x: Column) -> Column:
        out = F.lit(self.bias)
        for f, c, left, right in self.trees:
            a, b = (F.when(x[g] <= d, F.lit(lo)).otherwise(F.lit(hi)) for g, d, lo, hi in (left, right))
            out = out + F.when(x[f] <= c, a).otherwise(b)
        return out


def boost(cells: list[tuple[tuple[int, ...], int, int]], rounds: int = ROUNDS) -> tuple[float, list]:
    """Newton boosting on counted cells (features, positives, negatives)."""
    pos, neg = sum(p for _, p, _ in cells), sum(n for *_, n in cells)
    bias = math.log((pos + 1) / (neg + 1))
    margins = [bias] * len(cells)
    cuts = [(f, c) for f in range(len(FEATURES)) for c in sorted({x[f] for x, *_ in cells})[:-1]]
    trees = []

    def split(rows, grads):
        """The best cut of the rows and its two sums."""
        best = (-1.0, 0, 0, (0.0, 1e-9), (0.0, 1e-9))
        total = [sum(grads[r][k] for r in rows) for k in (0, 1)]
        for f, c in cuts:
            g = h = 0.0
            for r in rows:
                if cells[r][0][f] <= c:
                    g, h = g + grads[r][0], h + grads[r][1]
            score = g * g / (h + 1) + (total[0] - g) ** 2 / (total[1] - h + 1)
            if score > best[0] + 1e-12:
                best = (score, f, c, (g, h), (total[0] - g, total[1] - h))
        return best

    for _ in range(rounds if cuts else 0):
        grads = []
        for m, (_, p, n) in zip(margins, cells, strict=True):
            q = 1 / (1 + math.exp(-m))
            grads.append((p - (p + n) * q, (p + n) * q * (1 - q)))
        _, f, c, *_ = split(range(len(cells)), grads)
        sides = []
        for below in (True, False):
            rows = [r for r, cell in enumerate(cells) if (cell[0][f] <= c) == below]
            _, g, d, lo, hi = split(rows, grads)
            sides.append((g, d, RATE * lo[0] / (lo[1] + 1), RATE * hi[0] / (hi[1] + 1)))
        trees.append((f, c, *sides))
        for r, (x, *_) in enumerate(cells):
            g, d, lo, hi = sides[0] if x[f] <= c else sides[1]
            margins[r] += lo if x[g] <= d else hi
    return bias, trees


def learn(spark: SparkSession, n: int = EXAMPLES) -> Trees:
    # written first: else the sentences' expressions stand in the plan once for each use
    sentences = materialize(examples(spark, n), "examples")
    made = candidates(sentences).select("id", "s", "e", "truth", F.explode("__pii_more").alias("c")).select(
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).alias("aside"), F.col("c.x").alias("x"), F.col("c.rank").alias("rank"),
        ((F.col("c.start") < F.col("e")) & (F.col("c.end") > F.col("s")) & (F.col("truth") == 1)
         & (2 * (F.col("c.end") - F.col("c.start")) >= F.col("e") - F.col("s"))).alias("y"),
    )
    rows = made.groupBy("aside", "x", "rank").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n")).collect()
    discard(sentences)
    rows = sorted((r["aside"], tuple(r["x"]), r["rank"], r["p"], r["n"]) for r in rows)
    bias, trees = boost([(x, p, q) for aside, x, _, p, q in rows if not aside])
    model = Trees(trees, {}, bias)
    for rank in range(len(KINDS)):
        scored = sorted(((model.margin(x), p, q) for aside, x, k, p, q in rows if aside and k == rank), reverse=True)
        best, p_all, q_all = math.inf, 0, 0
        for m, p, q in scored:
            p_all, q_all = p_all + p, q_all + q
            if p_all and p_all / (p_all + q_all) >= PRECISION and m > 0:
                best = m
        model.thresholds[rank] = best
    return model


def find(df: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``df`` plus ``__pii_base`` and ``__pii_spans``, arrays of struct<start,
    rank, end> in order of start and rank."""
    out = candidates(df, text)

    def threshold(rank: Column) -> Column:
        c = F.lit(math.inf)
        for k, value in model.thresholds.items():
            c = F.when(rank == k, F.lit(value)).otherwise(c)
        return c

    chosen = F.filter(
        F.transform("__pii_more", lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), model.column(c["x"]).alias("margin"))),
        lambda c: (c["margin"] >= threshold(c["rank"])) & ~F.exists(F.col("__pii_base"), lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])),
    )
    out = out.withColumn("__pii_chosen", F.array_sort(F.when(F.size("__pii_more") > 0, chosen).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,margin:double>>"))))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,margin:double>>")
    # left to right: of overlapping spans the one with the larger margin stays
    best = F.aggregate(
        F.col("__pii_chosen"), none,
        lambda kept, c: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= c["start"]), F.concat(kept, F.array(c)))
        .when(F.element_at(kept, -1)["margin"] >= c["margin"], kept)
        .otherwise(F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(c))),
    )
    added = F.when(F.size("__pii_chosen") > 0, F.transform(best, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"))))
    spans = F.coalesce(F.concat("__pii_base", added), F.col("__pii_base"))
    return out.withColumns({"__pii_base": F.array_sort("__pii_base"), "__pii_spans": F.array_sort(spans)}).drop("__pii_more", "__pii_chosen")


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    out = find(docs.select("doc_id", "text"), learn(docs.sparkSession))

    def count(kind: str) -> Column:
        return F.size(F.filter("__pii_base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_shown(F.col("__pii_base")), 256).alias("base_sha256"), _shown(F.col("__pii_spans")).alias("spans"),
        F.size("__pii_spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t"))
    found = find(rows, learn(docs.sparkSession), "t")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col("t")
    # overlapping spans: what an earlier one covers is not shown again
    pieces = F.aggregate(
        F.col("__pii_spans"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"])
            .otherwise(F.concat(s["out"], F.array(F.substring(t, s["at"] + 1, x["start"] - s["at"]), F.element_at(names, x["rank"] + 1)))).alias("out"),
        ),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, s["at"] + 1, F.char_length(t))),
    )
    changed = F.when(F.size("__pii_spans") > 0, pieces).otherwise(t)
    return found.withColumn("new", changed).select(*[F.col("new").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
