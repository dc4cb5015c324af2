"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the training documents into index segments.  A segment
covers a run of documents with about ``SEGMENT_WORDS`` words; it stores its
term dictionary and, per term, the ascending positions of the term in the
segment, with a gap between documents so that no phrase crosses one.  Segments
are written as rows of a Parquet table in the shared folder.  The index is
sharded by document, so neither building nor asking it shuffles texts or
postings, and a frequent term costs each segment only its own share.

``phrase_hits`` asks every segment for all benchmark windows at once: windows
with a term that the segment lacks are out; of each other one the list of the
term that is rarest in that segment gives the candidates, shifted by the term's
offset, and the lists of the further terms, in order of rarity, are intersected
with them.  ``proximity_matches`` does the same with a tolerance.

The benchmark is asked in blocks of ``BLOCK_CHARS`` characters, cut by running
length, an item longer than that between its windows, so that each broadcast has
a proven bound; hits of several blocks are merged by segment and place in it, so
by input row.

Defined results: null and empty texts have no words and are never hit; an item
without words matches nothing; windows of an item with a null id count in n_hit,
but it has no place in items, n_items and items_sha256; repeated rows and rows with a null doc_id are
judged one by one; an empty
benchmark hits nothing; an empty table gives an empty result; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitting, materialize, slices, trimmed

WINDOW = 13
SEGMENT_WORDS = 1_000_000
BLOCK_CHARS = 4_000_000
#: Windows that are asked together, and candidate places that are looked at together, about.
WINDOWS, PLACES = 100_000, 1_000_000

#: Lower-cases A-Z and turns \x00-\x2F, \x3A-\x60 (A-Z aside) and \x7B-\x7F into a space.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

INDEX_SCHEMA = "segment string, doc_ids array<long>, doc_starts array<long>, n_words array<int>, terms binary, term_counts binary, steps binary"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class _Segment:
    """Collects documents; ``row`` gives them as one row of the index."""

    def __init__(self) -> None:
        self.ids: list = []
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.end = 0

    def add(self, doc_id, words: list[bytes]) -> None:
        number = self.terms.setdefault
        terms = self.terms
        self.parts.append(np.fromiter((number(w, len(terms)) for w in words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.starts.append(self.end)
        self.sizes.append(len(words))
        self.end += len(words) + 1

    def row(self) -> dict:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        at = np.arange(len(ids), dtype=np.int64) + np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(self.terms)).astype(np.uint32)
        at = at[order]
        steps = np.diff(at, prepend=0)
        steps[np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)[counts > 0]] = at[
            np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)[counts > 0]
        ]  # each term's list starts anew
        return {
            "segment": uuid.uuid4().hex,
            "doc_ids": self.ids,
            "doc_starts": self.starts,
            "n_words": self.sizes,
            "terms": b" ".join(self.terms),
            "term_counts": counts.tobytes(),
            "steps": steps.astype(np.uint32).tobytes(),
        }


def _arrow_schema(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_INDEX_ARROW = _arrow_schema(
    segment=pa.string(), doc_ids=pa.list_(pa.int64()), doc_starts=pa.list_(pa.int64()), n_words=pa.list_(pa.int32()),
    terms=pa.binary(), term_counts=pa.binary(), steps=pa.binary(),
)


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), written to the shared folder."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _Segment()
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    if seg.ids and seg.end + len(words) > segment_words:
                        yield pa.RecordBatch.from_pylist([seg.row()], schema=_INDEX_ARROW)
                        seg = _Segment()
                    seg.add(doc_id, words)
        if seg.ids:
            yield pa.RecordBatch.from_pylist([seg.row()], schema=_INDEX_ARROW)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(segments), INDEX_SCHEMA), "postings")


class _Postings:
    """A segment read back: the ascending positions of the terms that ``number``
    numbers, in one array in order of (number, position)."""

    def __init__(self, row: dict, number: dict[bytes, int]) -> None:
        terms = row["terms"].split(b" ") if row["terms"] else []
        counts = np.frombuffer(row["term_counts"], np.uint32).astype(np.int64)
        ends = np.cumsum(counts)
        steps = np.frombuffer(row["steps"], np.uint32)
        own = sorted((number[t], k) for k, t in enumerate(terms) if t in number)
        self.lists = {n: np.cumsum(steps[ends[k] - counts[k] : ends[k]], dtype=np.int64) for n, k in own}
        self.often = np.zeros(len(number), np.int64)
        self.first = np.zeros(len(number), np.int64)
        for n, at in self.lists.items():
            self.often[n] = len(at)
        self.first[1:] = np.cumsum(self.often)[:-1]
        self.all = np.concatenate([(n << 40) | at for n, at in self.lists.items()]) if own else np.empty(0, np.int64)
        self.starts = np.asarray(row["doc_starts"], np.int64)

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``windows`` (of term numbers) that occur, and where each begins."""
        often = self.often[windows]
        here = np.flatnonzero((often > 0).all(axis=1))
        order = np.argsort(often[here], axis=1, kind="stable")
        many = often[here, order[:, 0]]
        low = 0
        while low < len(here):
            high = max(low + 1, int(np.searchsorted(np.cumsum(many[low:]), PLACES, "right")) + low)
            n = many[low:high]
            of = np.repeat(np.arange(low, high), n)
            k = order[of, 0]
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[windows[here[of], k]]
            at = (self.all[at] & ((1 << 40) - 1)) - k
            for r in range(1, windows.shape[1]):
                k = order[of, r]
                want = (windows[here[of], k].astype(np.int64) << 40) | np.maximum(at + k, 0)
                hit = (self.all[np.minimum(np.searchsorted(self.all, want), len(self.all) - 1)] == want) & (at >= 0)
                of, at = of[hit], at[hit]
                if not len(of):
                    break
            yield here[of], at
            low = high

    def near(self, words: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest term that have each other term within ``slop``
        words of where the phrase would put it."""
        found = [(self.lists.get(w), k) for k, w in enumerate(words)]
        if any(x is None for x, _ in found):
            return np.empty(0, np.int64)
        found.sort(key=lambda x: len(x[0]))
        at, k0 = found[0]
        for where, k in found[1:]:
            low = at + (k - k0) - slop
            ix = np.searchsorted(where, low)
            at = at[(ix < len(where)) & (where[np.minimum(ix, len(where) - 1)] <= low + 2 * slop)]
        return at

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _blocks(benchmark: DataFrame, id_col: str, window: int, block_chars: int) -> Iterator[list[tuple]]:
    """The items, as (id, words), in blocks of about ``block_chars`` characters; a
    longer item is several, which share ``window`` - 1 words."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), "text").dropna(subset=["text"])
    held, size = [], 0
    for r in items.toLocalIterator():
        words = words_of(r["text"])
        low = 0
        while low < len(words):
            high, chars = low, 0
            while high < len(words) and (chars < block_chars or high - low < window):
                chars += len(words[high]) + 1
                high += 1
            if held and size + chars > block_chars:
                yield held
                held, size = [], 0
            held.append((r["item"], words[low:high]))
            size += chars
            low = high if high == len(words) else high - window + 1
    yield held


def _numbered(block: list[tuple]) -> tuple[dict[bytes, int], list[tuple]]:
    """The block's terms, numbered, and its items as (id, term numbers)."""
    number: dict[bytes, int] = {}
    return number, [(item, np.array([number.setdefault(w, len(number)) for w in words], np.int32)) for item, words in block]


def _windows(items: list[tuple], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the windows, rows of term numbers, and the item of each."""
    by: dict[int, list] = {}
    for k, (_, words) in enumerate(items):
        rows = np.lib.stride_tricks.sliding_window_view(words, min(size, len(words)))
        by.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), k)))
    return [(np.concatenate([r for r, _ in x]), np.concatenate([o for _, o in x])) for x in by.values()]


_HITS = "segment string, doc_id long, seg_doc int, n_words int, spans array<int>, items array<string>"
_HITS_ARROW = _arrow_schema(
    segment=pa.string(), doc_id=pa.int64(), seg_doc=pa.int32(), n_words=pa.int32(), spans=pa.list_(pa.int32()), items=pa.list_(pa.string())
)


def phrase_hits(index: DataFrame, benchmark: DataFrame, *, id_col: str = "item_id", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per indexed document: ``n_words``, ``n_hit`` (words inside any
    occurrence of a window) and ``items`` (sorted ids of the items that occur)."""
    spark = index.sparkSession
    parts = []
    for block in _blocks(benchmark, id_col, window, block_chars):
        sent = spark.sparkContext.broadcast(_numbered(block))

        def ask(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number, asked = sent.value
            windows = _windows(asked, window)
            for batch in batches:
                for one in slices(batch, 1):
                    row = one.to_pylist()[0]
                    post = _Postings(row, number)
                    found = [np.empty((3, 0), np.int64)]
                    for rows, owner in windows:
                        for low in range(0, len(rows), WINDOWS):
                            for of, at in post.phrases(rows[low : low + WINDOWS]):
                                found.append(np.stack([at, np.full(len(at), rows.shape[1]), owner[low + of]]))
                    at, size, owner = np.concatenate(found, axis=1)
                    docs = post.doc_of(at)
                    order = np.argsort(docs, kind="stable")
                    docs, local, size, owner = docs[order], (at - post.starts[docs])[order] if len(at) else at, size[order], owner[order]
                    spans: dict[int, list[int]] = {}
                    items: dict[int, list[str]] = {}
                    for x in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(docs)) + 1) if len(docs) else ():
                        spans[int(docs[x[0]])] = _union(np.stack([local[x], local[x] + size[x]], 1))
                        items[int(docs[x[0]])] = sorted({asked[k][0] for k in np.unique(owner[x])} - {None})
                    ids, sizes = row["doc_ids"], row["n_words"]
                    for low in range(0, len(ids), 4096):
                        ks = range(low, min(low + 4096, len(ids)))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "segment": [row["segment"]] * len(ks),
                                "doc_id": [ids[k] for k in ks],
                                "seg_doc": list(ks),
                                "n_words": [sizes[k] for k in ks],
                                "spans": [spans.get(k, []) for k in ks],
                                "items": [items.get(k, []) for k in ks],
                            },
                            schema=_HITS_ARROW,
                        )

        parts.append(index.mapInArrow(trimmed(ask), _HITS))
    hits = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            hits = hits.unionByName(p)
        # a document has one row per block; repeated rows of a document stay apart by segment and place
        merged = hits.groupBy("segment", "doc_id", "seg_doc", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        hits = merged.withColumn("spans", _union_column())
    length = F.aggregate(
        F.transform(F.col("spans"), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return hits.select("doc_id", F.col("n_words").cast("long").alias("n_words"), length.alias("n_hit"), "items")


def _union(s: np.ndarray) -> list[int]:
    """Rows of start and end as disjoint ascending spans, flat: start, end, start, end ..."""
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    last = np.concatenate([new[1:], [True]])
    return np.stack([s[new, 0], reach[last]], 1).ravel().tolist()


def _union_column():
    """``_union`` over the spans of several blocks, as an expression."""
    pairs = F.sort_array(
        F.transform(
            F.filter(F.transform(F.col("spans"), lambda x, i: F.when(i % 2 == 0, i)), lambda i: i.isNotNull()),
            lambda i: F.struct(F.get(F.col("spans"), i).alias("a"), F.get(F.col("spans"), i + 1).alias("b")),
        )
    )
    none = F.array().cast("array<int>")
    grown = F.aggregate(
        pairs,
        F.struct(none.alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b")),
        lambda s, x: F.when(x["a"] <= s["b"], F.struct(s["done"].alias("done"), s["a"].alias("a"), F.greatest(s["b"], x["b"]).alias("b")))
        .otherwise(F.struct(F.when(s["b"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(s["a"], s["b"]))).alias("done"), x["a"].alias("a"), x["b"].alias("b"))),
        lambda s: F.when(s["b"] < 0, none).otherwise(F.concat(s["done"], F.array(s["a"], s["b"]))),
    )
    return grown


def proximity_matches(index: DataFrame, phrases: list[tuple[str, str]], slop: int) -> DataFrame:
    """Rows ``phrase_id, doc_id, position``: places of each phrase's rarest term
    with all other terms within ``slop`` words of their place in the phrase."""
    number, items = _numbered([(name, words) for name, text in phrases if (words := words_of(text))])
    asked = [(name, words.tolist()) for name, words in items]
    schema = _arrow_schema(phrase_id=pa.string(), doc_id=pa.int64(), position=pa.int32())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, 1):
                row = one.to_pylist()[0]
                post = _Postings(row, number)
                ids = np.asarray(row["doc_ids"], np.int64)
                ends = post.starts + np.asarray(row["n_words"], np.int64)
                for name, words in asked:
                    at = post.near(words, slop)
                    docs = post.doc_of(at)
                    inside = at < ends[docs]
                    at, docs = at[inside], docs[inside]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(at), pa.string()), pa.array(ids[docs]), pa.array((at - post.starts[docs]).astype(np.int32))], schema=schema
                    )

    return index.mapInArrow(ask, "phrase_id string, doc_id long, position int")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "item_id", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = phrase_hits(build_index(docs), benchmark, id_col=id_col, **options)
    return hits.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents, columns unchanged.  Rows that
    share a doc_id go together; rows with a null doc_id stay."""
    bad = materialize(contamination(docs, benchmark).filter("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(fitting(bad, bad.count()), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
