"""The same operators over a streaming DataFrame: selection and grouped sums
are incremental plans; Structured Streaming keeps the sums as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.relops import group_total, select


def select_stream(stream: DataFrame, cnf: str) -> DataFrame:
    return select(stream, cnf)


def group_total_stream(stream: DataFrame, keys: list[str], text: str, name: str) -> StreamingQuery:
    """Running sums in an in-memory table ``name``, in complete mode."""
    return group_total(stream, keys, text).writeStream.outputMode("complete").format("memory").queryName(name).start()
