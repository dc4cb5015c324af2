"""LM scoring: context-tree weighting over bytes, learned from the whole corpus.

Texts are read as their words, lower-cased (A-Z), joined by one space and closed
by an end mark, so that the model gives a probability to the same sequence of
tokens as the unigram base does.  Bytes are decomposed into eight binary
decisions.  For every context of 0 to ``depth`` bytes and every decision, the
counts of zeros and ones give a Krichevsky-Trofimov estimate; the estimates of
all depths are mixed with the weights of context-tree weighting (Willems,
Shtarkov, Tjalkens 1995): half for stopping at a node, half for its children,
so a node's posterior weight is  1/2 Pe / Pw.

Learning counts the distinct (depth + 1)-byte strings of all texts and keeps
every one; held-out texts add strings with a count of zero, which changes no
weight.  All tables stay distributed, in the shared folder:

1.  Strings are dealt by the last ``SPLIT`` bytes of their context.  Whatever lies
    below such a context is one subtree, of at most 2^24 strings at any input
    size; a task computes it alone, up to the node at ``SPLIT``, and what it says
    about each string's last byte.
2.  Nodes above are summed depth by depth, up to the root, and get from their
    parents, down again, the weight that reaches them.
3.  A join of both gives each string its probability.  Where a node was never
    seen, the deepest seen one on its path takes what is left.

Scoring: the ``MAX_STRINGS`` most frequent strings are broadcast, which bounds
that table and only saves work; the others are counted per document and joined
with the table of strings, where no key is frequent.

Words go by 64-bit hashes.  The ``HOT`` most frequent are broadcast (a bounded
table); the others are counted per document and joined with the counts by hash,
where no key is frequent.  Nothing is left out of either sum.

Defined results: null and empty texts are one end mark; repeated rows are
scored one by one; with no training text at all every decision has probability
1/2; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, materialize, slices, trimmed
from .shingles import by_bytes, word_hashes

DEPTH, MAX_STRINGS, HOT = 5, 400_000, 100_000
#: Bytes of the contexts that subtrees hang from.
SPLIT = 3
#: Bytes of text that are counted or scored at once.
CHUNK = 2_000_000
#: Distinct strings or words of a partition that are held before they are summed up.
HELD = 2_000_000
#: Strings of whole subtrees that are weighted at once, about.
STRINGS = 500_000
_END = 10  # the byte of the end mark; also what precedes a text
_U = np.uint64


def held_out(doc_id) -> bool:
    """Rows whose crc32(doc_id as text) mod 5 is 1 are not learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def _strings(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth + 1)-byte string that ends at each byte of each body, oldest
    byte highest, and the number of bytes of each body."""
    pad = bytes([_END]) * depth
    flat = np.frombuffer(b"".join(pad + b for b in bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    key = flat.astype(np.uint64)
    for j in range(1, depth + 1):
        key[j:] |= flat[:-j].astype(np.uint64) << _U(8 * j)
    inside = np.ones(len(flat), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    for j in range(depth):
        inside[starts + j] = False
    return key[inside], sizes


def _body(text: str | None) -> bytes:
    return b" ".join(words_of(text)) + bytes([_END])


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(n[order], first) if len(first) else n for n in counts)


def _count_strings(docs: DataFrame, depth: int) -> DataFrame:
    """key, n (in training texts), m (in all texts): sums of parts of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merge():
            if len(held) > 1:
                held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        def out():
            for keys, n, m in held:
                for at in range(0, len(keys), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].astype(np.int64)), pa.array(n[part]), pa.array(m[part])], names=["key", "n", "m"])
            held.clear()

        for batch in batches:
            for low, high in by_bytes(batch.column(1), CHUNK):
                both: dict[bool, list[bytes]] = {True: [], False: []}
                for doc, text in zip(batch.column(0)[low:high].to_pylist(), batch.column(1)[low:high].to_pylist(), strict=True):
                    both[not held_out(doc)].append(_body(text))
                for learned, bodies in both.items():
                    if bodies:
                        keys, m = np.unique(_strings(bodies, depth)[0], return_counts=True)
                        held.append((keys, m * learned, m))
                if sum(len(x[0]) for x in held) > HELD:
                    merge()
                    if len(held[0][0]) > HELD // 2:
                        yield from out()
        merge()
        yield from out()

    return docs.mapInArrow(trimmed(run), "key long, n long, m long")


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving x up by 8."""
    shift = np.zeros_like(x, dtype=np.float64)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8.0
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(index, values, size) if len(index) else np.zeros(size)


class ContextTree:
    """The weighted model in memory, for small tables; ``learn`` gives the same
    from distributed ones.  nodes[d][b]: (sorted keys, probability of a one) of
    decision b in contexts of d bytes; key: context << 8 | (1 << b | bits so far)."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """tables[d]: sorted (d + 1)-byte strings and their counts."""
        self.depth = len(tables) - 1
        raw: list[list[tuple]] = []
        for d, (keys, n) in enumerate(tables):
            ctx, byte = keys >> _U(8), keys & _U(255)
            level = []
            for b in range(8):
                node = (ctx << _U(8)) | _U(1 << b) | (byte >> _U(8 - b))
                own, ix = np.unique(node, return_inverse=True)
                one = (byte >> _U(7 - b)) & _U(1) == 1
                ones = _sums(ix[one], n[one].astype(np.float64), len(own))
                level.append((own, _sums(ix, n.astype(np.float64), len(own)) - ones, ones))
            raw.append(level)
        self.nodes: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in tables]
        for b in range(8):
            weighted, parents = None, []
            stops: list[np.ndarray] = []
            for d in range(self.depth, -1, -1):
                own, a, c = raw[d][b]
                pe = _log_kt(a, c)
                if d == self.depth:
                    pw, stop = pe, np.ones(len(own))
                else:
                    child_keys, ca, cc = raw[d + 1][b]
                    mask = _U((1 << (8 * (d + 1))) - 1)
                    up = np.searchsorted(own, child_keys & mask)
                    parents.append(up)
                    rest_a, rest_c = a - _sums(up, ca, len(own)), c - _sums(up, cc, len(own))
                    below = _sums(up, weighted, len(own)) + _log_kt(np.maximum(rest_a, 0), np.maximum(rest_c, 0))
                    pw = np.logaddexp(pe, below) - np.log(2)
                    stop = np.exp(np.minimum(pe - np.log(2) - pw, 0))
                weighted = pw
                stops.append(stop)
            parents, stops = parents[::-1], stops[::-1]
            one = None
            # from the root down: what the tree above says is replaced, not mixed in twice:
            # p_d = sum over depths e <= d of the posterior weight of stopping at e
            reach = spent = None
            for d in range(self.depth + 1):
                own, a, c = raw[d][b]
                est = (c + 0.5) / (a + c + 1.0)
                if d == 0:
                    reach, spent = np.ones(len(own)), np.zeros(len(own))
                else:
                    up = parents[d - 1]
                    reach, spent = (reach * (1 - stops[d - 1]))[up], (spent + reach * stops[d - 1] * raw_est)[up]
                raw_est = est
                one = spent + reach * est  # the deepest node on the path takes what is left
                self.nodes[d].append((own, one))
        keys, _ = tables[-1]
        self.table = self._hash_table(keys, self.slow(keys))

    @staticmethod
    def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        bits = max(4, int(len(keys)).bit_length() + 2)
        slots, held = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, np.float32)
        at = ContextTree._slot(keys, bits)
        slots[at], held[at] = keys, values  # of several keys in a slot one stays; the others are computed
        return bits, slots, held

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)

    def slow(self, strings: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last byte, from the nodes."""
        out = np.zeros(len(strings))
        byte = strings & _U(255)
        for b in range(8):
            one = np.full(len(strings), 0.5)
            open_ = np.ones(len(strings), bool)
            prefix = _U(1 << b) | (byte >> _U(8 - b))
            for d in range(self.depth, -1, -1):
                own, p = self.nodes[d][b]
                if not len(own) or not open_.any():
                    continue
                want = (((strings[open_] >> _U(8)) & _U((1 << (8 * d)) - 1)) << _U(8)) | prefix[open_]
                ix = np.minimum(np.searchsorted(own, want), len(own) - 1)
                hit = own[ix] == want
                where = np.flatnonzero(open_)[hit]
                one[where] = p[ix[hit]]
                open_[where] = False
            bit = (byte >> _U(7 - b)) & _U(1) == 1
            out += np.log10(np.maximum(np.where(bit, one, 1 - one), 1e-12))
        return out

    def log10(self, strings: np.ndarray) -> np.ndarray:
        bits, slots, held = self.table
        at = self._slot(strings, bits)
        out = held[at].astype(np.float64)
        miss = np.flatnonzero(slots[at] != strings)
        if len(miss):
            new, back = np.unique(strings[miss], return_inverse=True)
            out[miss] = self.slow(new)[back]
        return out


def _weigh(keys: np.ndarray, n: np.ndarray, depth: int, split: int) -> tuple[np.ndarray, list[tuple]]:
    """Whole subtrees below contexts of ``split`` bytes; keys distinct, sorted.
    For each string and decision, what the subtree says of the bit it takes (not a
    number where it was never seen); the nodes at ``split``: key, zeros, ones, ln Pw."""
    says, tops = np.empty((len(keys), 8)), []
    ctx, byte = keys >> _U(8), keys & _U(255)
    for b in range(8):
        one = (byte >> _U(7 - b)) & _U(1) == 1
        own, at = np.unique((ctx << _U(8)) | _U(1 << b) | (byte >> _U(8 - b)), return_inverse=True)
        zeros, ones = _sums(at[~one], n[~one], len(own)), _sums(at[one], n[one], len(own))
        pw = _log_kt(zeros, ones)
        levels = [(at, zeros, ones, np.ones(len(own)))]
        for d in range(depth - 1, split - 1, -1):
            own, up = np.unique(own & _U((1 << (8 * (d + 1))) - 1), return_inverse=True)
            zeros, ones = _sums(up, zeros, len(own)), _sums(up, ones, len(own))
            pw, stop = _mixed(zeros, ones, _sums(up, pw, len(own)))
            at = up[at]
            levels.append((at, zeros, ones, stop))
        tops.append((own, zeros, ones, pw))
        say = np.full(len(keys), np.nan)
        for at, zeros, ones, stop in levels:
            total = (zeros + ones)[at]
            est = (np.where(one, ones[at], zeros[at]) + 0.5) / (total + 1.0)
            say = np.where(np.isnan(say), np.where(total > 0, est, np.nan), stop[at] * est + (1 - stop[at]) * say)
        says[:, b] = say
    return says, [np.concatenate(x) for x in zip(*tops, strict=True)]


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln Pw of inner nodes, and their posterior weights."""
    pe = _log_kt(zeros, ones)
    pw = np.logaddexp(pe, below) - np.log(2)
    return pw, np.exp(np.minimum(pe - np.log(2) - pw, 0))


def _lists(owner: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Distinct owners (ascending as given), and each column as one list an owner."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    cuts = pa.array(np.concatenate([first, [len(owner)]]).astype(np.int32))
    return owner[first], [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in columns]


def _subtrees(strings: DataFrame, depth: int, split: int) -> DataFrame:
    """One row per context of ``split`` bytes: its strings, their occurrences and
    what is said of their bits (eight each), and its nodes."""
    dealt = strings.withColumn("top", F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * split)) - 1)))
    dealt = dealt.repartition("top").groupBy("top", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).sortWithinPartitions("top")

    def weigh(parts: list[tuple]) -> pa.RecordBatch:
        _, keys, n, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys, n, m = keys[order], n[order], m[order]
        says, (nodes, *values) = _weigh(keys, n.astype(np.float64), depth, split)
        mask = _U((1 << (8 * split)) - 1)
        order = np.argsort((keys >> _U(8)) & mask, kind="stable")
        tops, lists = _lists(((keys >> _U(8)) & mask)[order].astype(np.int64), keys[order].astype(np.int64), m[order])
        widths = pa.array(np.asarray(lists[0].offsets) * 8)
        says = pa.ListArray.from_arrays(widths, pa.array(says[order].ravel().astype(np.float32)))
        by = np.argsort(nodes)
        _, more = _lists((nodes[by] >> _U(8)).astype(np.int64), nodes[by].astype(np.int64), *(v[by] for v in values))
        return pa.RecordBatch.from_arrays([pa.array(tops), *lists, says, *more], names=["top", "keys", "m", "says", "nodes", "zeros", "ones", "pw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(np.asarray(c) for c in batch.columns)
            now = (now[0], now[1].astype(np.uint64), *now[2:])
            if many >= STRINGS:  # up to where the last subtree begins
                cut = int(np.searchsorted(now[0], now[0][-1]))
                if not cut and parts[-1][0][-1] != now[0][0]:
                    yield weigh(parts)
                    parts, many = [], 0
                elif cut:
                    yield weigh([*parts, tuple(c[:cut] for c in now)])
                    now, parts, many = tuple(c[cut:] for c in now), [], 0
            parts.append(now)
            many += len(now[0])
        if parts:
            yield weigh(parts)

    floats = "array<double>"
    return dealt.mapInArrow(trimmed(run), f"top long, keys array<long>, m array<long>, says array<float>, nodes array<long>, zeros {floats}, ones {floats}, pw {floats}")


def _above(nodes: DataFrame, split: int) -> tuple[DataFrame, list[DataFrame]]:
    """key, reach, spent, above of the nodes (key, zeros, ones, pw) at ``split``:
    the weight that reaches the node, what shallower ones have said of a one, and
    the probability of a one as far as seen above it; and the tables it reads."""

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, zeros, ones, below = batch.columns
            pw, stop = _mixed(*(np.asarray(c) for c in (zeros, ones, below)))
            yield pa.RecordBatch.from_arrays([key, zeros, ones, pa.array(pw), pa.array(stop)], names=["key", "zeros", "ones", "pw", "stop"])

    def parent(d: int):
        return F.col("key").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1))

    levels = [nodes]
    for d in range(split - 1, -1, -1):
        sums = levels[-1].groupBy(parent(d).alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("pw"))
        levels.append(materialize(sums.mapInArrow(mix, "key long, zeros double, ones double, pw double, stop double"), "nodes"))
    here = levels[-1].withColumns({"reach": F.lit(1.0), "spent": F.lit(0.0), "above": F.lit(0.5)})
    total = F.col("zeros") + F.col("ones")
    said = F.col("spent") + F.col("reach") * (F.col("ones") + 0.5) / (total + 1)
    for d in range(1, split + 1):
        up = here.select(
            F.col("key").alias("up"), (F.col("reach") * (1 - F.col("stop"))).alias("reach"),
            (F.col("spent") + F.col("reach") * F.col("stop") * (F.col("ones") + 0.5) / (total + 1)).alias("spent"),
            F.when(total > 0, said).otherwise(F.col("above")).alias("above"),
        )
        up = F.broadcast(up) if d <= 2 else up  # 255 or 65,280 rows at most
        here = levels[split - d].withColumn("up", parent(d - 1)).join(up, "up").drop("up")
    return here.select("key", "reach", "spent", "above"), levels[1:]


def learn(docs: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """key, m, p of every distinct (depth + 1)-byte string of ``docs`` (doc_id,
    text): occurrences, and log10 of the probability of its last byte by the model
    of the rows not held out."""
    split = min(SPLIT, depth)
    trees = materialize(_subtrees(_count_strings(docs.select("doc_id", "text"), depth), depth, split), "subtrees")
    nodes = trees.select(F.explode(F.arrays_zip("nodes", "zeros", "ones", "pw")).alias("x")).select(F.col("x.nodes").alias("key"), "x.zeros", "x.ones", "x.pw")
    above, levels = _above(nodes, split)
    packed = above.groupBy(F.shiftrightunsigned("key", 8).alias("top")).agg(F.collect_list(F.struct("key", "reach", "spent", "above")).alias("x"))
    packed = packed.select("top", *(F.col(f"x.{c}").alias(c) for c in ("key", "reach", "spent", "above")))
    both = trees.select("top", "keys", "m", "says").join(packed, "top").drop("top")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 64):
                keys, m, says, node, *values = (np.asarray(c.flatten()) for c in some.columns)
                keys, says = keys.astype(np.uint64), says.reshape(-1, 8).astype(np.float64)
                order = np.argsort(node)
                node, (reach, spent, above) = node[order].astype(np.uint64), (v[order] for v in values)
                short, byte = (keys & _U((1 << (8 * (split + 1))) - 1)) & ~_U(255), keys & _U(255)
                p = np.zeros(len(keys))
                for b in range(8):
                    at = np.searchsorted(node, short | _U(1 << b) | (byte >> _U(8 - b)))
                    one = (byte >> _U(7 - b)) & _U(1) == 1
                    said = np.where(one, spent[at], 1 - reach[at] - spent[at]) + reach[at] * says[:, b]
                    p += np.log10(np.maximum(np.where(np.isnan(says[:, b]), np.where(one, above[at], 1 - above[at]), said), 1e-12))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(m), pa.array(p)], names=["key", "m", "p"])

    strings = materialize(both.mapInArrow(trimmed(finish), "key long, m long, p double"), "strings")
    discard(trees, *levels)
    return strings


def _frequent(strings: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent strings, ``most`` at most, sorted, and their p: whole
    classes of an eighth of a power of two."""
    size = F.floor(F.log2("m") * 8).cast("int")
    least, room = 1 << 30, most
    for r in strings.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        if r["count"] > room:
            break
        room -= r["count"]
        least = r["size"]
    top = strings.filter(size >= least).select("key", "p").toArrow()
    keys, p = np.asarray(top.column("key")).astype(np.uint64), np.asarray(top.column("p"))
    order = np.argsort(keys)
    return keys[order], p[order]


def _count_words(docs: DataFrame) -> DataFrame:
    """word (its hash), c: all tokens of the training texts but the end marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merge():
            if len(held) > 1:
                held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        def out():
            for words, c in held:
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c)], names=["word", "c"])
            held.clear()

        for batch in batches:
            for low, high in by_bytes(batch.column(1), CHUNK):
                words, before = word_hashes(batch.column(1)[low:high])
                learned = np.array([not held_out(doc) for doc in batch.column(0)[low:high].to_pylist()])
                held.append(np.unique(words[np.repeat(learned, np.diff(before))], return_counts=True))
                if sum(len(x[0]) for x in held) > HELD:
                    merge()
                    if len(held[0][0]) > HELD // 2:
                        yield from out()
        merge()
        yield from out()

    return docs.mapInArrow(trimmed(run), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _by_owner(owner: np.ndarray, keys: np.ndarray, n: int, names: list[str]) -> pa.Array:
    """For each of ``n`` owners the list of its distinct keys and how often each comes."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])) if len(owner) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(owner))))], names=names),
    )


def score(docs: DataFrame, *, depth: int = DEPTH, most: int = MAX_STRINGS, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    score_per_token and bits_per_byte (the model's code length)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counts = materialize(_count_words(docs), "words")
    ends = docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True))).count()
    words, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    total, kinds = words + ends, distinct + (ends > 0)
    first = counts.orderBy(F.desc("c"), "word").limit(hot).toArrow()
    hot_words = np.asarray(first.column("word")).astype(np.int64).view(np.uint64)
    order = np.argsort(hot_words)
    hot_words, hot_logs = hot_words[order], np.log10(np.asarray(first.column("c")).astype(np.float64) + 0.5)[order]
    strings = learn(docs, depth=depth)
    sent = spark.sparkContext.broadcast((_frequent(strings, most), hot_words, hot_logs))

    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double, bytes long, rare array<struct<word:long,n:long>>, cold array<struct<key:long,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (keys, logs), known, known_logs = sent.value
        bits, slots, held = ContextTree._hash_table(keys, logs)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, high in by_bytes(batch.column(1), CHUNK):
                n, texts = high - low, batch.column(1)[low:high]
                own_keys, sizes = _strings([_body(t) for t in texts.to_pylist()], depth)
                at = ContextTree._slot(own_keys, bits)
                said = held[at].astype(np.float64)
                miss = np.flatnonzero(slots[at] != own_keys)
                said[miss] = 0.0
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own_keys[miss]), len(keys) - 1)
                    hit = keys[at] == own_keys[miss]
                    said[miss[hit]] = logs[at[hit]]
                    miss = miss[~hit]
                sums = np.add.reduceat(said, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                words, before = word_hashes(texts)
                many = np.diff(before)
                owner = np.repeat(np.arange(n), many)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1) if len(known) else np.zeros(len(words), np.int64)
                hit = known[at] == words if len(known) else np.zeros(len(words), bool)
                base = np.bincount(owner[hit], known_logs[at[hit]], n) + float(np.log10(ends + 0.5))
                columns = [
                    pa.array(np.arange(row, row + n)), batch.column(0)[low:high], pa.array(many + 1), pa.array(np.bincount(owner[hit], minlength=n) + int(ends > 0)),
                    pa.array(base), pa.array(sums), pa.array(sizes), _by_owner(owner[~hit], words[~hit], n, ["word", "n"]),
                    _by_owner(np.repeat(np.arange(n), sizes)[miss], own_keys[miss], n, ["key", "n"]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "bytes", "rare", "cold"])
                row += n

    scored = materialize(docs.mapInArrow(trimmed(run), schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    rest = (
        rare.join(counts, "word", "left")
        .groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more_known"))
    )
    norm = float(np.log10(total + 0.5 * (kinds + 1)))
    cold = scored.select("row", F.explode("cold").alias("r")).select("row", "r.key", "r.n")
    colder = cold.join(strings.select("key", "p"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("p")).alias("more_score"))
    both = scored.drop("rare", "cold").join(rest, "row", "left").join(colder, "row", "left")
    both = both.withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return both.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        "score",
        (F.col("score") / F.col("n_tokens")).alias("score_per_token"),
        (-F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
