"""MinHash near-dedup by a signature-coordinate inverted join.

1.  Each text becomes its set of k-word shingles, as 64-bit hashes, and
    ``MINIMA`` minima.  Rows with equal sets form a class; one row of it stands
    for them from here on.
2.  A signature has ``COORDS`` coordinates, each the hash of three neighbouring
    minima, so texts that merely share a common shingle seldom meet.  Every class
    is posted under its (coordinate, value) pairs.  Two signatures that collide in
    at least ``t`` coordinates share a posting within the first ``COORDS - t + 1``
    of each in any common order (prefix filter), so only those are posted.  The
    order puts frequent values last: those lists are skipped.
3.  A posting carries a sketch, two bits of each minimum, so lists need no second
    look at the signatures.  Within a list the collisions of two members are
    counted on packed words, a word at a time; a member is skipped as soon as what
    is left cannot lift it to the match threshold, and sizes that cannot reach the
    similarity are skipped before.  First pass: each member is taken by the
    one before it that it collides with most, or by a leader in a long list, so
    pairs grow as the postings, not their squares.  They are
    confirmed on the full shingle sets of both texts, and confirmed links merge
    into components.
4.  Second pass, over lists that had further pairs above the threshold and still
    hold several components: all such pairs of different components, each reported
    from its first common list only, are confirmed and merged, so no candidate is
    lost.  Pairs within one component need no test.  Here the members carry the
    counts of their shingles in ``BUCKETS`` buckets too: two sets share no more
    than the sum of the smaller counts, so pairs that this bound puts below the
    similarity go without loss.

A list longer than ``BLOCK`` is dealt to several tasks.  In the second pass the
members of its largest component stay each in one part, and only the others are
sent to all parts.

Both thresholds follow from the similarity: a pair that has it misses either with
a probability of ``MISS`` at most (binomial).  At 0.8 they are 36 of 64 minima and
2 of 21 coordinates; together such a pair is lost with a probability below 2.1e-5,
one more alike more rarely.  Sets so small that no other set can be similar enough
are not posted at all.

The frequency table only orders values and finds lists to split; it is cut at
``HEAVY`` entries, which bounds its broadcast and cannot lose a pair, since every
class uses the same order.  All other tables stay distributed, written to the
shared folder, and are deleted after their last use.

Defined results: null and empty texts have empty sets and are linked with
nothing; with fewer than k words the whole sequence is one shingle; all rows that
share a doc_id are one document, so what any of them is linked with belongs to
its component, and all of them stay or go together; a null doc_id has a null
component, is kept and linked with nothing; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fitting, materialize, trimmed
from .components import components
from .shingles import by_bytes, mixed, shingle_sets

MINIMA, GRAM, MISS, HEAVY = 64, 3, 1e-4, 100_000
COORDS = MINIMA // GRAM
#: Buckets of the second pass's bound.
BUCKETS = 1024
#: Members that one task compares with a leader, at most.
GROUP = 512
#: Members of a list that meet in one task.
BLOCK = 1024
#: Lists up to this length are compared member by member, all lists at once.
SHORT = 16

_U = np.uint64
_M1 = _U(0x9E3779B97F4A7C15)
_ODD = _U(0x5555555555555555)
_BY = np.random.default_rng(20_240_229).integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def thresholds(percent: int) -> tuple[int, int]:
    """Equal minima and equal coordinates that a pair of ``percent`` similarity
    has but for a probability of ``MISS`` divided by ten."""

    def least(n: int, p: float) -> int:
        t, below = 0, 0.0
        while (below := below + math.comb(n, t) * p**t * (1 - p) ** (n - t)) <= MISS / 10:
            t += 1
        return t

    minima, coords = least(MINIMA, percent / 100), least(COORDS, (percent / 100) ** GRAM)
    if coords < 1:
        raise ValueError("the similarity is too low for this signature")
    return minima, coords


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 32-bit minima of a set that is not empty."""
    x = (shingles >> _U(32)).astype(np.uint32)
    out = (_BY[:, None] * x[None, :1024]).min(axis=1)
    for at in range(1024, len(x), 1024):
        np.minimum(out, (_BY[:, None] * x[None, at : at + 1024]).min(axis=1), out=out)
    return out


_SIGS = "doc_id long, th long, n long, set_hash binary, sig binary"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (a hash of the text), n (size of the set), set_hash and sig, a row
    for each row of ``docs``.  Rows without words are a class for each doc_id; rows
    without a doc_id have no set_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in by_bytes(batch.column(2)):
                ids, sets = batch.column(0)[low:high], shingle_sets(batch.column(2)[low:high], k)
                raw = [
                    None if i is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"no words%d" % i
                    for i, s in zip(ids.to_pylist(), sets, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, batch.column(1)[low:high], pa.array([len(s) for s in sets], pa.int64()), pa.array(raw, pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "th", "n", "set_hash", "sig"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(trimmed(run), _SIGS).withColumn("row", F.monotonically_increasing_id())


def _minima(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(-1, MINIMA)


def _keys(minima: np.ndarray) -> np.ndarray:
    """Rows of posting keys: coordinate in the high half, value in the low."""
    value = np.zeros((len(minima), COORDS), np.uint64)
    for j in range(GRAM):
        value = mixed(value * _M1 + minima[:, j : GRAM * COORDS : GRAM])
    return (np.arange(COORDS, dtype=np.int64) << 32)[None, :] | (value >> _U(32)).astype(np.int64)


def _sketch(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, in rows of packed words."""
    bits = (minima * np.uint32(0x9E3779B1) >> np.uint32(30)).astype(np.uint64)
    shift = (2 * np.arange(32, dtype=np.uint64))[None, :]
    return np.stack([np.bitwise_or.reduce(bits[:, at : at + 32] << shift, axis=1) for at in range(0, MINIMA, 32)], axis=1)


def _word(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count((x | (x >> _U(1))) & _ODD)


def differing(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """In how many minima rows of sketches differ, as far as two bits tell: never
    more than in truth.  Rows beyond ``most`` in the first word are skipped: 255."""
    out = _word(a[..., 0], b[..., 0])
    on = out <= most
    at = np.flatnonzero(on)
    out[~on] = 255
    if len(at):
        out[at] += _word(a[at, 1] if a.ndim > 1 else a[1], b[at, 1] if b.ndim > 1 else b[1])
    return out


def bucket_counts(shingles: np.ndarray) -> np.ndarray:
    """Shingles per bucket, at most 255; what is beyond is n less their sum."""
    return np.minimum(np.bincount((shingles % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def shared_bound(n: np.ndarray, counts: np.ndarray, m: int, other: np.ndarray) -> np.ndarray:
    """At least as many as the shingles that sets of sizes ``n`` share with one of size ``m``."""
    beyond = np.minimum(n - counts.sum(axis=1, dtype=np.int64), m - other.sum(dtype=np.int64))
    return np.minimum(counts, other).sum(axis=1, dtype=np.int64) + beyond


def _frequent(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent posting keys, sorted, with their estimated numbers of
    postings; at most HEAVY.  A batch counts keys that it holds more than once; the
    estimate takes a key as spread evenly over the batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(_keys(_minima(batch.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[n > 1], -1)), pa.array(np.append(n[n > 1], 1).astype(np.int64))], names=["key", "n"])

    top = (
        reps.select("sig").mapInArrow(trimmed(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        .filter("n > 3 or key = -1").orderBy(F.col("key") != -1, F.desc("n"), "key").limit(HEAVY + 1).toArrow()
    )
    keys, n = (np.asarray(top.column(c)).astype(np.int64) for c in ("key", "n"))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    if not len(keys):
        return keys, n
    batches, y = n[0], n[1:] / n[0]
    rate = np.maximum(y, np.sqrt(y))
    for _ in range(8):  # y = rate * (1 - exp(-rate))
        e = np.exp(-rate)
        rate -= (rate * (1 - e) - y) / (1 - e + rate * e)
    return keys[1:], np.maximum(n[1:], (rate * batches)).astype(np.int64)


def _often(keys: np.ndarray, heavy: np.ndarray, count: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(keys.shape, np.int64)
    ix = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
    return np.where(heavy[ix] == keys, count[ix], 0)


def _prefix(keys: np.ndarray, often: np.ndarray, size: int) -> np.ndarray:
    """Coordinates of the ``size`` rarest keys of each row."""
    tie = ((keys.astype(np.uint64) * _M1) >> _U(34)).astype(np.int64)
    return np.argsort((np.minimum(often, 1 << 31) << 30) | tie, axis=1, kind="stable")[:, :size]


def _postings(reps: DataFrame, sent, size: int) -> DataFrame:
    """key, part, id, n and the sketch: the prefix of each signature, rare values first."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                minima = _minima(some.column(2))
                keys = _keys(minima)
                often = _often(keys, *heavy)
                order = _prefix(keys, often, size)
                own, parts = (np.take_along_axis(x, order, 1).ravel() for x in (keys, -(-often // BLOCK)))
                ids, n = (np.repeat(np.asarray(some.column(k)), size) for k in (0, 1))
                part = mixed((ids ^ own).astype(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)
                sketch = np.repeat(_sketch(minima), size, axis=0).view(np.int64)
                # in a list that is dealt to several tasks, parts are numbered from 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array((part + (parts > 1)).astype(np.int32)), pa.array(ids), pa.array(n), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in (0, 1))],
                    names=["key", "part", "id", "n", "s0", "s1"],
                )

    return reps.select("id", "n", "sig").mapInArrow(trimmed(post), "key long, part int, id long, n long, s0 long, s1 long")


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """The rows of sorted batches again, such that rows equal in the first
    ``columns`` columns are never apart."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k)) for k in range(columns)]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            held.append(batch.slice(0, cut))
        if held and (cut or last != tuple(int(k[-1]) for k in keys)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
        last = tuple(int(k[-1]) for k in keys)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, k: int) -> np.ndarray:
    return table.column(k).to_numpy()


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.logical_or.reduce([np.diff(k) != 0 for k in keys])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def first_pass(key: np.ndarray, part: np.ndarray, n: np.ndarray, sketch: np.ndarray, most: int, likely: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of list and n: the row that takes each (-1: none), and
    whether its list has pairs left to the second pass.

    In a short list a row is taken by the one before it that differs least, by
    ``most`` at most.  In a long one leaders take what differs by ``likely`` at most."""
    starts = _starts(key, part)
    sizes = np.diff(starts, append=len(key))
    group = np.repeat(np.arange(len(starts)), sizes)
    taker, least, left_over = np.full(len(key), -1), np.full(len(key), 255, np.uint8), part[starts] > 0
    i = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= SHORT))
    for d in range(1, SHORT):
        i = i[i + d < len(key)]
        i = i[group[i + d] == group[i]]
        if not len(i):
            break
        a = i[100 * n[i] >= percent * n[i + d]]
        apart = differing(sketch[a], sketch[a + d], most)
        hit = apart <= most
        a, b, apart = a[hit], a[hit] + d, apart[hit]
        left_over[group[b[taker[b] >= 0]]] = True
        nearer = apart <= least[b]  # of equals the one that comes first
        taker[b[nearer]], least[b[nearer]] = a[nearer], apart[nearer]
    for g in np.flatnonzero(sizes > SHORT):
        rest = np.arange(starts[g], starts[g] + sizes[g])
        while len(rest) > 1:
            leader, rest = rest[0], rest[1:]
            fits = int(np.searchsorted(n[rest], 100 * n[leader] // percent, "right"))
            apart = differing(sketch[rest[:fits]], sketch[leader], most)
            if (apart <= most).any():
                left_over[g] = True
                hit = apart <= likely
                taker[rest[:fits][hit]] = leader
                rest = np.concatenate([rest[:fits][~hit], rest[fits:]])
    return taker, left_over[group]


def _met(posted: DataFrame, most: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) with ``open`` 0; with ``open`` 1 a key, a member of a
    list that has pairs left, its n and sketch."""

    # what a pair at the similarity differs by on average, and half as much again
    likely = min(most, math.ceil(1.5 * MINIMA * (1 - percent / 100) * 0.75))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            key, part, ids, n, s0, s1 = (_column(table, k) for k in range(6))
            taker, left_over = first_pass(key, part, n, np.stack([s0, s1], 1).view(np.uint64), most, likely, percent)
            taken = np.flatnonzero(taker >= 0)
            none, again = np.zeros(len(taken), np.int64), np.flatnonzero(left_over)
            both = zip((ids[taker[taken]], ids[taken], none, none, none, none), (key[again], ids[again], none[:0] + 1, n[again], s0[again], s1[again]), strict=True)
            kind = np.repeat([0, 1], [len(taken), len(again)])
            columns = [kind if k == 2 else np.concatenate(x) for k, x in enumerate(both)]
            if len(kind):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "open", "n", "s0", "s1"])

    dealt = posted.repartition("key", "part").sortWithinPartitions("key", "part", "n", "id")
    return dealt.mapInArrow(trimmed(meet), "a long, b long, open long, n long, s0 long, s1 long")


def _texts(docs: DataFrame, members: DataFrame, met: DataFrame) -> DataFrame:
    """id, text of all classes that a pair or a list is left to try of, written: the
    one time that the whole corpus may have to be shuffled, so that what follows
    joins this much smaller table only."""
    both = F.when(F.col("open") == 0, F.array("a", "b")).otherwise(F.array("b"))
    ids = materialize(met.select(F.explode(both).alias("id")).distinct(), "ids")
    n = ids.count()
    known = members.filter("doc_id is not null and row = id").select("id", "doc_id", "th").join(fitting(ids, n), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    out = materialize(texts.join(fitting(known, n), ["doc_id", "th"]).select("id", "text"), "texts")
    discard(ids)
    return out


def _counted(texts: DataFrame, k: int) -> DataFrame:
    """id, counts: the bucket counts of each class's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in by_bytes(batch.column(1)):
                counts = [bucket_counts(s).tobytes() for s in shingle_sets(batch.column(1)[low:high], k)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(counts, pa.binary())], names=["id", "counts"])

    return texts.select("id", "text").mapInArrow(trimmed(run), "id long, counts binary").dropDuplicates(["id"])


def _rest_met(rows: DataFrame, sent, size: int, most: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that collide often enough, each from its
    first common list, and that the bound of their bucket counts allows.

    ``rows``: key, part, home (its own part), main (of the list's largest
    component), id, comp, n, sig, counts."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = sent.value
        for table in whole_groups(batches, 2):
            key, part, home, main, ids, comp, n = (_column(table, k) for k in range(7))
            minima = _minima(table.column(7))
            counts = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(-1, BUCKETS)
            sketch, keys = _sketch(minima), _keys(minima)
            posted = np.zeros(keys.shape, bool)
            np.put_along_axis(posted, _prefix(keys, _often(keys, *heavy), size), True, 1)
            starts = _starts(key, part)
            found: list[np.ndarray] = []
            for x, y in zip(starts, np.append(starts[1:], len(key)), strict=True):
                for i in x + np.flatnonzero(~main[x:y]):
                    js = x + np.flatnonzero(
                        (comp[x:y] != comp[i]) & (main[x:y] | (home[i] & (ids[x:y] > ids[i])))
                        & (100 * np.minimum(n[x:y], n[i]) >= percent * np.maximum(n[x:y], n[i]))
                    )
                    js = js[differing(sketch[js], sketch[i], most) <= most]
                    if len(js):
                        shared = (keys[js] == keys[i]) & posted[js] & posted[i]
                        js = js[shared.argmax(axis=1) == key[i] >> 32]
                    if len(js):
                        bound = shared_bound(n[js], counts[js], n[i], counts[i])
                        js = js[100 * bound >= percent * (n[i] + n[js] - bound)]
                        found.append(np.stack([np.full(len(js), ids[i]), ids[js]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names=["a", "b"])

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.select("key", "part", "home", "main", "id", "comp", "n", "sig", "counts").mapInArrow(trimmed(meet), "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets meet 100 * shared >= percent * union.

    ``a`` is a group's leader.  Groups above ``GROUP`` members are split and the
    leader's text goes to each part; a task streams its groups, leader first.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    members = dealt.select("a", "part", F.col("b").alias("id"), F.lit(1).alias("member"))
    rows = materialize(members.unionByName(members.select("a", "part", F.col("a").alias("id"), F.lit(0).alias("member")).distinct()), "rows")
    texts = texts.join(fitting(rows, rows.count()), "id").select("a", "part", "id", "member", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, None
        for batch in batches:
            for low, high in by_bytes(batch.column(4)):
                found: list[tuple[int, int]] = []
                rows = zip(*(batch.column(c)[low:high].to_pylist() for c in range(4)), shingle_sets(batch.column(4)[low:high], k), strict=True)
                for a, part, one, member, own in rows:
                    if not member:
                        group, leader = (a, part), own
                    elif group == (a, part):
                        shared = len(np.intersect1d(leader, own, assume_unique=True))
                        if 100 * shared >= percent * (len(leader) + len(own) - shared):
                            found.append((a, one))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt_texts = texts.repartition("a", "part").sortWithinPartitions("a", "part", "member")
    links = materialize(dealt_texts.mapInArrow(trimmed(compare), "a long, b long"), "links")
    discard(pairs, rows)
    return links


def _mixed_lists(left_over: DataFrame, labels: DataFrame) -> DataFrame:
    """``left_over`` (key, id, n and the sketch) with part, home, main and comp:
    members of the lists that hold several components, dealt to parts."""
    named = materialize(left_over.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "named")
    by = named.groupBy("key", "comp").agg(F.count("*").alias("n"))
    lists = by.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("most"), F.sum("n").alias("members"), F.count("*").alias("comps"))
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    rows = named.join(lists.filter("comps > 1"), "key").withColumns({"main": F.col("comp") == F.col("most"), "own": own})
    dealt = rows.withColumn("part", F.explode(F.when(F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), parts - 1))))
    out = materialize(dealt.select("key", "part", (F.col("part") == F.col("own")).alias("home"), "main", "id", "comp", "n", "s0", "s1"), "mixed")
    discard(named)
    return out


def _nearest(rows: DataFrame, most: int, percent: int) -> DataFrame:
    """Pairs (a, b): for each member outside its list's main component the one of
    another component that it differs least from, in each part."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            key, part, main, ids, comp, n, s0, s1 = (_column(table, k) for k in range(8))
            sketch, starts = np.stack([s0, s1], 1).view(np.uint64), _starts(key, part)
            found: list[tuple[int, int]] = []
            for x, y in zip(starts, np.append(starts[1:], len(key)), strict=True):
                for i in x + np.flatnonzero(~main[x:y]):
                    js = x + np.flatnonzero((comp[x:y] != comp[i]) & (100 * np.minimum(n[x:y], n[i]) >= percent * np.maximum(n[x:y], n[i])))
                    if len(js):
                        apart = differing(sketch[js], sketch[i], most)
                        j = apart.argmin()
                        if apart[j] <= most:
                            found.append((ids[i], ids[js[j]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(found, np.int64).T], names=["a", "b"])

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "id")
    return dealt.select("key", "part", "main", "id", "comp", "n", "s0", "s1").mapInArrow(trimmed(meet), "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    matches, coords = thresholds(percent)
    most, size = MINIMA - matches, COORDS - coords + 1
    sigs = materialize(signatures(docs, k), "signatures")
    copies = sigs.filter("set_hash is not null").groupBy("set_hash").agg(F.min("row").alias("class"), F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    members = materialize(
        sigs.join(copies.filter("rows > 1").drop("rows"), "set_hash", "left").select(
            "row", "doc_id", "th", "n", F.coalesce("class", "row").alias("id"), F.coalesce("least", "doc_id").alias("least"),
            F.when(F.coalesce("class", "row") == F.col("row"), F.col("sig")).alias("sig"),
        ),
        "members",
    )
    discard(sigs)
    reps = members.filter(f"doc_id is not null and row = id and n * {100 - percent} >= {percent}").select("id", "n", "sig")
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(reps))
    met = materialize(_met(_postings(reps, sent, size), most, percent), "met")
    texts = _texts(docs, members, met)
    links = confirmed(met.filter("open = 0"), texts, k, percent)
    # classes of one doc_id belong together
    twice = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("doc_id is not null and a < b")
    same = members.join(twice.select("doc_id", "a"), "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    labels = components(links.unionByName(same))
    left_over = met.filter("open = 1").select(F.col("a").alias("key"), F.col("b").alias("id"), "n", "s0", "s1")
    for every in (False, True):
        rest = _mixed_lists(left_over, labels)
        if rest.isEmpty():  # and stays so: components only grow
            discard(rest)
            break
        if every:
            ids = materialize(rest.select("id").distinct(), "ids")
            many = ids.count()
            counts = materialize(_counted(texts.join(fitting(ids, many), "id"), k), "counts")
            signed = reps.select("id", "sig").join(fitting(ids, many), "id").join(counts, "id")
            more = confirmed(_rest_met(rest.join(signed, "id"), sent, size, most, percent), texts, k, percent)
            discard(ids, counts)
        else:
            more = confirmed(_nearest(rest, most, percent), texts, k, percent)
        merged = components(more.unionByName(labels.select(F.col("id").alias("a"), F.col("comp").alias("b"))))
        discard(rest, labels, more)
        labels = merged
    sent.destroy()
    # a component goes by its smallest doc_id
    of = labels.join(members.filter("row = id").select("id", "least"), "id").select("id", "comp", "least")
    named = materialize(of.join(of.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("id", "component"), "named")
    discard(met, links, labels, texts)
    out = members.select("doc_id", "n", "id", "least").join(named, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component, columns unchanged.  Rows that
    share a doc_id stay or go together; rows with a null doc_id stay."""
    gone = materialize(near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct(), "gone")
    return docs.join(fitting(gone, gone.count()), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
