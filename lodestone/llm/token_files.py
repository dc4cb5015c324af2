"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A store is a folder of shards and a manifest.  ``*.bin`` holds the ids of a
shard's documents back to back, as unsigned 16-bit integers where the
vocabulary fits, else 32-bit; ``*.idx`` holds the number of documents, their
ids and their shard-relative offsets (documents + 1 of them), all 64-bit little
endian.  Documents are range-partitioned by doc_id, so shard order is doc_id
order; the manifest gives each shard's first document and first token, as
prefix sums over the shards' counts.  Only one small row per shard reaches the
driver.

Every attempt of a task writes files of its own name and only the names that
successful tasks return enter the manifest, so a lost executor or a speculative
copy cannot mix shards.  Readers memory-map local or mounted files and fetch
ranges of others through ``pyarrow.fs``, ``RUN`` documents at a time.

Defined results: null and empty texts give the end id alone; rows with equal
doc_id are adjacent, ordered by text; a null doc_id sorts first and is stored
as the smallest 64-bit integer; an empty table gives a manifest without shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, slices, trimmed
from .files import Mapped, read_file, writer
from .tokens import CachedEncoder, default_tokenizer

_NULL_ID = -(1 << 63)
#: Documents whose ids are read at once.
RUN = 2_048


_SHARD = "part int, name string, n_docs long, n_tokens long"
_SHARD_ARROW = pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_store(docs: DataFrame, url: str, *, tokenizer: str | None = None, end_id: int = 2) -> dict:
    """Encode ``docs`` (doc_id, text) into a store at ``url``; returns the manifest."""
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = CachedEncoder(tokenizer, end_id)
        kind = np.dtype("<u2" if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        ids: list[int] = []
        sizes: list[int] = []
        with writer(f"{url}/{name}.bin") as out:
            for batch in batches:
                for some in slices(batch):
                    ids += [_NULL_ID if x is None else x for x in some.column(0).to_pylist()]
                    coded = coder.encode(some.column(1))
                    sizes += [len(x) // 4 for x in coded]
                    for x in coded:
                        out.write(np.frombuffer(x, "<u4").astype(kind).tobytes())
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.uint64)]).astype("<u8")
        with writer(f"{url}/{name}.idx") as out:
            out.write(np.array([len(ids)], "<u8").tobytes())
            out.write(np.array(ids, "<i8").tobytes())
            out.write(offsets.tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "name": f"{name}:{kind.itemsize}", "n_docs": len(ids), "n_tokens": int(offsets[-1])}], schema=_SHARD_ARROW
        )

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards, doc_base, token_base = [], 0, 0
    for r in sorted(ordered.mapInArrow(trimmed(encode), _SHARD).collect(), key=lambda r: r["part"]):
        name, _, width = r["name"].partition(":")
        if r["n_docs"]:
            shards.append({"name": name, "width": int(width), "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "doc_base": doc_base, "token_base": token_base})
            doc_base, token_base = doc_base + r["n_docs"], token_base + r["n_tokens"]
    manifest = {"format": 1, "url": url, "end_id": end_id, "n_docs": doc_base, "n_tokens": token_base, "shards": shards}
    with writer(f"{url}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(url: str) -> dict:
    return json.loads(read_file(f"{url}/manifest.json").to_pybytes())


class Shard:
    """Documents of a shard, by place: views of mapped files, or ranges fetched."""

    def __init__(self, url: str, shard: dict) -> None:
        self.index, self.tokens = Mapped(f"{url}/{shard['name']}.idx"), Mapped(f"{url}/{shard['name']}.bin")
        self.width, self.n = shard["width"], int(np.frombuffer(self.index.read(0, 8), "<u8")[0])

    def run(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc ids and offsets (one more) of the documents [low, high), and their ids."""
        ids = np.frombuffer(self.index.read(8 + 8 * low, 8 * (high - low)), "<i8")
        offsets = np.frombuffer(self.index.read(8 + 8 * (self.n + low), 8 * (high - low + 1)), "<u8").astype(np.int64)
        size = int(offsets[-1] - offsets[0])
        return ids, offsets, np.frombuffer(self.tokens.read(int(offsets[0]) * self.width, size * self.width), f"<u{self.width}")

    def close(self) -> None:
        self.index.close()
        self.tokens.close()


_DOC = "doc_id long, start long, n_tokens long, ids_crc32 long"
_DOC_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read_digests(spark: SparkSession, url: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and the crc32 of its ids as
    32-bit integers, read back from the files."""
    manifest = read_manifest(url)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                shard = json.loads(text)
                files = Shard(url, shard)
                for at in range(0, files.n, RUN):
                    ids, cut, tokens = files.run(at, min(at + RUN, files.n))
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(cut[:-1] - cut[0], cut[1:] - cut[0], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64(), mask=ids == _NULL_ID), pa.array(cut[:-1] + shard["token_base"]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        schema=_DOC_ARROW,
                    )
                files.close()

    shards = [(k, json.dumps(s)) for k, s in enumerate(manifest["shards"])]
    listed = spark.createDataFrame(shards, "part int, shard string").repartitionByRange(max(1, len(shards)), "part").select("shard")
    return listed.mapInArrow(trimmed(digest), _DOC)


def round_trip(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    url = scratch_path(docs.sparkSession, "tokens")
    write_store(docs, url, tokenizer=tokenizer, end_id=end_id)
    return read_digests(docs.sparkSession, url)
