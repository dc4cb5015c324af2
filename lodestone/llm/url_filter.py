"""URL filters: exact allow and block lists in Bloom filter cascades.

A rule is a host and a path prefix.  A URL's candidate keys are its host
suffixes joined with its path prefixes, of the label counts and path lengths
that rules have; the longest candidate on a list decides.  Each list is held by
a cascade: level 0 is a Bloom filter of the listed keys, level 1 one of the
keys of the universe that level 0 lets through wrongly, level 2 one of the
listed keys that level 1 holds wrongly, and so on until a level has no false
positives.  The universe is every distinct candidate key of the corpus, so the
answer for any of them is exact, without a join.

A level is dealt by key hash to shards of about ``SHARD_KEYS`` keys.  Spark's
bitmap aggregates build them, with partial aggregation; the tasks that hold a
shard's bitmaps write it as a flat file to the shared folder, and the tasks that
ask it map the file.  Neither lists nor filters pass through the driver, and a
list of any size takes the same way.

Defined results: a null url or one without ``://`` has an empty host and path
and fits no rule; repeated rows are judged one by one; an empty list builds an
empty cascade; a rule listed twice has the first of its verdicts in alphabetical
order; an empty table gives an empty result; columns other than the id and
``url`` are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitting, materialize, scratch_path
from .files import Mapped, writer

#: Bits per key and hash functions of a level, and keys in one shard of it, about.
BITS, HASHES, SHARD_KEYS = 10, 4, 1_000_000
#: Shards that a task holds open at once.
OPEN = 256
_BUCKET = 32_768  # bits of one aggregate bitmap in Spark

#: The rules of op4 (host/path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class Level:
    """A Bloom filter in files: bits of each shard, number of shards, and the
    files of those that hold keys."""

    bits: int
    shards: int
    files: dict[int, str]


class Cascade:
    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels
        self.open: dict[str, tuple[Mapped, np.ndarray]] = {}

    def __getstate__(self) -> list[Level]:
        return self.levels

    def __setstate__(self, levels: list[Level]) -> None:
        self.__init__(levels)

    def _shard(self, url: str) -> np.ndarray:
        if url not in self.open:
            if len(self.open) >= OPEN:
                self.open.pop(next(iter(self.open)))
            file = Mapped(url)
            self.open[url] = file, np.frombuffer(file.read(), np.uint8)
        return self.open[url][1]

    def passes(self, level: int, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether a level lets keys through, by their shard hash and its two hashes."""
        own = self.levels[level]
        of, out = np.mod(shard, own.shards), np.zeros(len(shard), bool)
        for s in np.unique(of):
            if int(s) in own.files:
                at = np.flatnonzero(of == s)
                out[at] = _probe(self._shard(own.files[int(s)]), own.bits, h1[at], h2[at])
        return out

    def holds(self, shard: np.ndarray, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether keys are listed; hashes: two 64-bit ones for each level."""
        inside, active = np.zeros(len(shard), bool), np.arange(len(shard))
        for level in range(len(self.levels)):
            active = active[self.passes(level, shard[active], *(h[active] for h in hashes[level]))]
            inside[active] = level % 2 == 0
        return inside


def _probe(filter_: np.ndarray, bits: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    a, b = np.mod(h1, bits), np.mod(h2, bits)
    out = np.ones(len(a), bool)
    for i in range(HASHES):
        at = (a + i * b) % bits
        out &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def _hash(level: int, which: int, key: Column) -> Column:
    return F.xxhash64(F.lit(2 * level + which), key)


def _shard_hash(key: Column) -> Column:
    return F.xxhash64(F.lit(-1), key)


def _build_level(keys: DataFrame, level: int, n: int) -> Level:
    shards = -(-n // SHARD_KEYS)
    key, shard = F.col("key"), F.pmod(_shard_hash(F.col("key")), F.lit(shards)).cast("int")
    most = keys.groupBy(shard.alias("shard")).count().agg(F.max("count")).first()[0]
    bits = max(64, -(-most * BITS // 8) * 8)
    a, b = (F.pmod(_hash(level, w, key), F.lit(bits)) for w in (0, 1))
    at = keys.select(shard.alias("shard"), F.explode(F.array(*[F.pmod(a + i * b, F.lit(bits)) for i in range(HASHES)])).alias("at"))
    bitmaps = at.groupBy("shard", (F.col("at") / _BUCKET).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(_BUCKET))).alias("bitmap"))
    url = scratch_path(keys.sparkSession, "cascade")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come by shard and bucket; a shard's file is written as they come."""
        own, names, file, opened, end = None, [], None, None, 0
        for batch in batches:
            for s, bucket, bitmap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != own:
                    if opened is not None:
                        file.write(bytes(bits // 8 - end))
                        opened.__exit__(None, None, None)
                    own, end = s, 0
                    names.append((s, f"{url}/{level}-{s}-{uuid.uuid4().hex}"))
                    opened = writer(names[-1][1])
                    file = opened.__enter__()
                start = bucket * _BUCKET // 8
                piece = bitmap[: bits // 8 - start]
                file.write(bytes(start - end) + piece)
                end = start + len(piece)
        if opened is not None:
            file.write(bytes(bits // 8 - end))
            opened.__exit__(None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in names], pa.int32()), pa.array([u for _, u in names], pa.string())], names=["shard", "file"])

    files = bitmaps.repartition("shard").sortWithinPartitions("shard", "bucket").mapInArrow(write, "shard int, file string").collect()
    return Level(bits, shards, {r["shard"]: r["file"] for r in files})


def _passing(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """The keys that a cascade's last level lets through."""
    level = len(cascade.levels) - 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = cascade.passes(level, *(np.asarray(batch.column(k)) for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok))], names=["key"])

    key = F.col("key")
    return keys.select("key", _shard_hash(key), _hash(level, 0, key), _hash(level, 1, key)).mapInArrow(probe, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed and universe: distinct ``key``.  Keys outside the universe do no harm."""
    rest = universe.join(fitting(listed, listed.count()), "key", "left_anti")
    mine, other, cascade = listed, materialize(rest, "universe"), Cascade([])
    while n := mine.count():
        cascade.levels.append(_build_level(mine, len(cascade.levels), n))
        mine, other = materialize(_passing(other, cascade), "wrong"), mine
    return cascade


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """A URL's keys with those numbers of labels and lengths of path, longest first."""
    if not labels:
        return F.array().cast("array<string>")
    count = F.size(F.split(host, r"\."))
    hosts = F.array(*[F.when((count >= n) & (host != ""), F.substring_index(host, ".", -n)) for n in labels])
    paths = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    keys = F.array_compact(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))
    return F.array_sort(F.array_distinct(keys), lambda x, y: F.char_length(y) - F.char_length(x))


def judge(pages: DataFrame, rules=RULES, *, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """id, host, path, rule (the longest that fits, else null) and verdict.

    ``rules``: pairs of rule and verdict, or a DataFrame with these columns."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "rule string, verdict string")
    listed = materialize(rules.dropna().groupBy("rule").agg(F.min("verdict").alias("verdict")), "rules")
    name = F.substring_index("rule", "/", 1)
    shape = (F.size(F.split(name, r"\.")), F.char_length("rule") - F.char_length(name))
    labels, lengths = (sorted(r[0] for r in listed.select(s).distinct().collect()) for s in shape)
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keyed = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), labels, lengths))
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    verdicts = sorted(r[0] for r in listed.select("verdict").distinct().collect())
    built = {v: build_cascade(listed.filter(F.col("verdict") == v).select(F.col("rule").alias("key")), universe) for v in verdicts}
    depth = max((len(c.levels) for c in built.values()), default=0)
    fields = [rows.schema[id_col]]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists_ = batch.column(3)
            keys, shard = lists_.flatten(), np.asarray(batch.column(4).flatten())
            hashes = [tuple(np.asarray(batch.column(5 + 2 * k + w).flatten()) for w in (0, 1)) for k in range(depth)]
            held = {v: c.holds(shard, hashes) for v, c in built.items()}
            owner = np.repeat(np.arange(batch.num_rows), [0 if n is None else n for n in lists_.value_lengths().to_pylist()])
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [default] * batch.num_rows
            any_ = np.logical_or.reduce(list(held.values())) if held else np.zeros(len(keys), bool)
            for at in np.flatnonzero(any_)[::-1]:  # the longest, written last, stays
                rule[owner[at]] = keys[int(at)].as_py()
                verdict[owner[at]] = next(v for v, h in held.items() if h[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[fields[0].name, "host", "path", "rule", "verdict"],
            )

    hashed = [F.transform("keys", _shard_hash).alias("shard")] + [
        F.transform("keys", partial(_hash, k, w)).alias(f"h{k}_{w}") for k in range(depth) for w in (0, 1)
    ]
    kind = fields[0].dataType.simpleString()
    return keyed.select("*", *hashed).mapInArrow(decide, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
