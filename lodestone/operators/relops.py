"""Selection, projection, join, distinct, sums, order and text rows.

All are plans only: Catalyst pushes filters and columns into the scans, picks
join strategies from sizes, and adaptive execution splits skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arith
from ..plans import predicate
from ..sources import storage


def select(df: DataFrame, cnf: str) -> DataFrame:
    """Rows that satisfy the predicate."""
    return df.filter(predicate.compile_text(cnf, df))


def project(df: DataFrame, keep: list[int]) -> DataFrame:
    """Attributes by position, in the order given."""
    return df.select(*[df[f"`{df.columns[k]}`"] for k in keep])


def join(left: DataFrame, right: DataFrame, cnf: str | None = None, *, hint: str | None = None) -> DataFrame:
    """All left attributes, then all right ones, of the pairs that satisfy the
    whole predicate; without one, the cross product."""
    if cnf is None:
        return left.crossJoin(right)
    condition = predicate.compile_text(cnf, left, right)
    return left.join(right.hint(hint) if hint else right, condition, "inner")


def qualify(df: DataFrame, name: str) -> DataFrame:
    """An alias: every attribute becomes ``name.attribute``."""
    return df.select(*[df[f"`{c}`"].alias(f"{name}.{c}") for c in df.columns])


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def total(df: DataFrame, text: str) -> DataFrame:
    """One row, ``sum``; 0 for no rows."""
    column, kind = arith.compile_text(text, df)
    return df.agg(F.coalesce(F.sum(column), F.lit(0) if kind == "int" else F.lit(0.0)).alias("sum"))


def group_total(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``sum`` first, then the keys."""
    column, _ = arith.compile_text(text, df)
    names = [F.col(f"`{k}`") for k in keys]
    return df.groupBy(*names).agg(F.sum(column).alias("sum")).select("sum", *names)


def sort(df: DataFrame, spec: str | None = None) -> DataFrame:
    keys = predicate.all_attributes(df) if spec is None else predicate.sort_keys(spec, df)
    return df.orderBy(*[F.col(f"`{k}`").asc() for k in keys])


def with_position(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """Each row's place in the order, from 1, without one task seeing all rows:
    range partitions, sorted and written, and prefix sums of their sizes."""
    order = [F.col(f"`{k}`").asc() for k in keys]
    spark, path = df.sparkSession, storage.scratch(df.sparkSession, "positions")
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    rows = spark.read.schema(numbered.schema).parquet(path)
    part = F.shiftright("__at", 33)  # the id holds the partition above the place in it
    base, at = {}, 0
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):
        base[r["part"]] = at - (r["part"] << 33) + 1
        at += r["count"]
    if not base:
        return rows.withColumn(name, F.lit(None).cast("long")).drop("__at")
    offsets = F.create_map(*[F.lit(x).cast("long") for kv in base.items() for x in kv])
    return rows.withColumn(name, F.col("__at") + offsets[part]).drop("__at")


def format_rows(df: DataFrame) -> DataFrame:
    """``line``: ``name: [value], name: [value]``; doubles with six decimals."""
    parts = []
    for k, field in enumerate(df.schema.fields):
        c = df[f"`{field.name}`"]
        number = isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType))
        parts += [F.lit(f"{', ' if k else ''}{field.name}: ["), F.format_string("%f", c.cast("double")) if number else c.cast("string"), F.lit("]")]
    return df.select(F.concat(*parts).alias("line"))


def write_rows(df: DataFrame, path: str) -> None:
    format_rows(df).write.mode("overwrite").text(path)


def print_rows(df: DataFrame) -> int:
    """The rows on the console, a partition at a time; their number."""
    n = 0
    for r in format_rows(df).toLocalIterator():
        print(r["line"])
        n += 1
    return n
