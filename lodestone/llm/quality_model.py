"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades, from the labels: 0 toxic, 1 poor, 2 good.  One weight vector over
hashed words (and a few hashed measures of form) is shared by all thresholds;
P(grade > j) = sigmoid(w.x - theta_j) with theta_0 < theta_1.  A document gets
its expected grade and its tail probability P(grade >= 2), which selects.

Training uses at most ``MAX_LABELLED`` labelled documents, chosen by hash, in
one task; of those, ``VALIDATE`` of a hundred are set aside and choose nothing
but the reported accuracy.  Words are presence features: a single slur in a long
text must count in full.  Only slots that occur in at least ``MIN_DOCS``
training documents and tell grades apart (largest chi-square first) keep a
weight, so unseen words say nothing.

Defined results: null and empty texts have no words and only measures of form;
without labels every document has tail probability 1 and is kept; labels with a
null are not learned from, of several labels of one document the lowest grade
counts, and of several rows with its doc_id one is learned from (the least in
order of its slots); repeated rows are scored one by one; an empty table gives
an empty result; only doc_id, text and the labels' doc_id, quality and toxic are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, slices, trimmed

MAX_LABELLED, VALIDATE, MIN_DOCS = 8_000, 20, 3
SLOT_BITS, KEPT_SLOTS, STEPS, RATE, L2 = 18, 4_096, 400, 0.05, 1e-4
GRADES = 3


class Hasher:
    """Texts to arrays of distinct slots."""

    LIMIT = 100_000

    def __init__(self) -> None:
        from xxhash import xxh32_intdigest

        self.digest, self.known = xxh32_intdigest, {}

    def slots(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(ASCII_LOWER).split()
        distinct = set(words)
        if len(self.known) > self.LIMIT:
            self.known.clear()
        known, mask = self.known, (1 << SLOT_BITS) - 1
        out = set()
        for w in distinct:
            s = known.get(w)
            if s is None:
                bare = w.strip(b".,;:!?\"'()")
                s = known[w] = self.digest(bare or w) & mask
            out.add(s)
        n = max(1, len(words))
        symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
        upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
        form = (
            ("words", min(7, int(np.log2(n)) // 2)), ("distinct", int(10 * len(distinct) / n)), ("symbols", min(9, int(5 * symbols / n))),
            ("upper", min(9, int(10 * upper / max(1, len(raw) - n)))), ("bangs", min(5, int(3 * raw.count(b"!") / n))),
        )
        out.update(self.digest(f"\0{name}={v}".encode()) & mask for name, v in form)
        return np.sort(np.fromiter(out, np.int64, len(out)))


def likelihood(params: np.ndarray, at: np.ndarray, which: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
    """Penalised mean negative log-likelihood and its gradient.

    params: weights, the lower threshold, the logarithm of the gap to the upper
    one; document ``which[k]`` has slot ``at[k]``."""
    n, w, low, gap = len(grades), params[:-2], params[-2], np.exp(params[-1])
    s = np.bincount(which, w[at], n)
    p = [np.ones(n), *(1 / (1 + np.exp(-np.clip(s - t, -30, 30))) for t in (low, low + gap)), np.zeros(n)]
    prob = np.maximum(np.choose(grades, [p[g] - p[g + 1] for g in range(GRADES)]), 1e-9)
    # each tail P(grade >= j) enters the probability of grade j with +, of j - 1 with -
    by_tail = [((grades == j).astype(float) - (grades == j - 1)) / prob * p[j] * (1 - p[j]) for j in (1, 2)]
    ds = -(by_tail[0] + by_tail[1])
    d_low, d_up = by_tail[0].sum(), by_tail[1].sum()
    grad = np.concatenate([np.bincount(at, ds[which], len(w)) / n + L2 * w, [(d_low + d_up) / n, gap * d_up / n]])
    return float(-np.log(prob).mean() + L2 / 2 * (w @ w)), grad


def fit(rows: list[np.ndarray], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted slots, weights, thresholds) by full-batch Adam on the likelihood."""
    n = len(rows)
    which = np.repeat(np.arange(n), [len(r) for r in rows])
    flat = np.concatenate(rows) if n else np.empty(0, np.int64)
    size = 1 << SLOT_BITS
    seen = np.bincount(flat, minlength=size)
    chi = np.zeros(size)
    for g in range(GRADES):
        share = (grades == g).mean()
        if 0 < share < 1:
            got = np.bincount(flat[grades[which] == g], minlength=size)
            chi += (got - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-9)
    chi[seen < MIN_DOCS] = 0
    slots = np.sort(np.argsort(-chi, kind="stable")[:KEPT_SLOTS])
    slots = slots[chi[slots] > 4]
    if not len(slots):
        return slots, np.zeros(0), np.array([-30.0, -29.0])
    at = np.minimum(np.searchsorted(slots, flat), len(slots) - 1)
    ok = slots[at] == flat
    at, which = at[ok], which[ok]
    tails = np.array([np.clip((grades > j).mean(), 0.01, 0.99) for j in range(GRADES - 1)])
    theta = -np.log(tails / (1 - tails))
    params = np.concatenate([np.zeros(len(slots)), [theta[0], np.log(max(theta[1] - theta[0], 0.1))]])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        _, grad = likelihood(params, at, which, grades)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return slots, params[:-2], np.array([params[-2], params[-2] + np.exp(params[-1])])


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> dict:
    """slots, weights, thresholds and held-out accuracy; a bounded model."""
    picked = (
        labels.select("doc_id", "quality", "toxic").dropna()
        .groupBy("doc_id").agg(F.min(F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")
    schema = "doc_id long, grade int, slots array<long>"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for some in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1).cast(pa.int32()), pa.array([hasher.slots(t) for t in some.column(2).to_pylist()], pa.list_(pa.int64()))],
                    names=["doc_id", "grade", "slots"],
                )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grades, sets = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            grades += batch.column(1).to_pylist()
            sets += [np.asarray(x.values) if x.is_valid else np.empty(0, np.int64) for x in batch.column(2)]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        sets, grades = [sets[k] for k in order], np.array(grades, np.int64)[order]
        aside = (np.arange(len(order)) * 37) % 100 < VALIDATE
        slots, weights, theta = fit([s for s, a in zip(sets, aside, strict=True) if not a], grades[~aside])
        good = [
            (1 / (1 + np.exp(theta[1] - weights[np.isin(slots, s)].sum())) >= 0.5) == (g == 2)
            for s, g, a in zip(sets, grades, aside, strict=True) if a
        ]
        yield pa.RecordBatch.from_pylist(
            [{"slots": slots.tolist(), "weights": weights.tolist(), "theta": theta.tolist(), "accuracy": float(np.mean(good)) if good else None}],
            schema=pa.schema([("slots", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("theta", pa.list_(pa.float64())), ("accuracy", pa.float64())]),
        )

    # one row for each label, so that the bound on labels is one on rows
    one = rows.mapInArrow(trimmed(hashed), schema).groupBy("doc_id").agg(F.min(F.struct("grade", "slots")).alias("x")).select("doc_id", "x.grade", "x.slots").repartition(1)
    return one.mapInArrow(trimmed(fitted), "slots array<long>, weights array<double>, theta array<double>, accuracy double").first().asDict()


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, expected_grade, tail_probability, p_toxic and kept."""
    slots, weights, theta = (np.array(model[x]) for x in ("slots", "weights", "theta"))
    sent = docs.sparkSession.sparkContext.broadcast((slots.astype(np.int64), weights.astype(np.float64), theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, theta = sent.value
        dense = np.zeros(1 << SLOT_BITS)
        dense[at] = weights
        hasher = Hasher()
        for batch in batches:
            for some in slices(batch):
                s = np.array([dense[hasher.slots(t)].sum() for t in some.column(1).to_pylist()])
                tail = [1 / (1 + np.exp(np.clip(t - s, -30, 30))) for t in theta]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(tail[0] + tail[1]), pa.array(tail[1]), pa.array(1 - tail[0]), pa.array(tail[1] >= 0.5)],
                    names=["doc_id", "expected_grade", "tail_probability", "p_toxic", "kept"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        trimmed(run), "doc_id long, expected_grade double, tail_probability double, p_toxic double, kept boolean"
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
