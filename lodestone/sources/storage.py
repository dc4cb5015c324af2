"""Table files: heap and sorted, each a folder of Parquet versions with a layout
record.

A sorted table is range-partitioned and sorted within partitions, so its row
groups hold narrow key ranges and a filter on the leading key skips most of
them.  Appending to it merges: the union is sorted into a new version.  The
layout record that names the current version is appended last, so a driver that
dies on the way leaves the old table as it was.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.predicate import all_attributes, sort_keys

_own: str | None = None
_LAYOUT = "version long, kind string, keys array<string>, folder string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share:
    ``spark.checkpoint.dir``, or a temporary folder where all runs on one machine."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        base = _own
    return f"{base.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _layout(spark: SparkSession, path: str):
    return spark.read.schema(_LAYOUT).json(f"{path}/layout").orderBy(F.desc("version")).first()


def _put(df: DataFrame, path: str, kind: str, keys: list[str]) -> None:
    """A new version of the table, which then takes the place of the one before."""
    spark = df.sparkSession
    old = _layout(spark, path) if _exists(spark, f"{path}/layout") else None
    folder = f"{path}/{uuid.uuid4().hex}"
    (_ordered(df, keys) if kind == "sorted" else df).write.parquet(folder)
    row = (old["version"] + 1 if old else 1, kind, keys, folder)
    spark.createDataFrame([row], _LAYOUT).coalesce(1).write.mode("append").json(f"{path}/layout")
    if old:
        _delete(spark, old["folder"])


def _ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    names = [F.col(f"`{k}`") for k in keys]
    return df.repartitionByRange(*names).sortWithinPartitions(*names)


def create_heap(df: DataFrame, path: str) -> None:
    _put(df, path, "heap", [])


def create_sorted(df: DataFrame, path: str, spec: str | None = None) -> None:
    _put(df, path, "sorted", all_attributes(df) if spec is None else sort_keys(spec, df))


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_layout(spark, path)["folder"])


def append(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    now = _layout(spark, path)
    if now["kind"] == "heap":
        df.write.mode("append").parquet(now["folder"])
    else:
        _put(open_table(spark, path).unionByName(df), path, "sorted", now["keys"])


def verify_order(spark: SparkSession, path: str) -> DataFrame:
    """One row, ``checked`` and ``errors``: rows of a sorted table, and those that
    are below the row before them in file order.  Windows are per file; one row a
    file crosses from file to file."""
    now = _layout(spark, path)
    keys = F.struct(*[F.col(f"`{k}`") for k in now["keys"]])
    rows = spark.read.parquet(now["folder"]).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), keys.alias("k"))
    from pyspark.sql.window import Window

    within = rows.withColumn("last", F.lag("k").over(Window.partitionBy("file").orderBy("at")))
    files = within.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("k") < F.col("last")).alias("bad"), F.min_by("k", "at").alias("low"), F.max_by("k", "at").alias("high"))
    files = files.withColumn("before", F.lag("high").over(Window.orderBy("file")))
    return files.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.col("bad") + F.when(F.col("low") < F.col("before"), 1).otherwise(0)), F.lit(0)).alias("errors")
    )
