"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z only, on UTF-8 bytes.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: The white space that separates words, \x20 and \x09-\x0D.
WS = r"[\x20\x09-\x0D]"

#: Rows of a few integers each that may be broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 200_000

#: Bytes that go to a Python worker at once, about: by Spark's own bound (64 MB) a whole
#: split of texts is one Arrow batch, which the JVM and the worker hold several times over.
BATCH_BYTES = 4 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Where that is unset, a temporary folder of our own, if all runs in one
    process tree on one machine (tests); on a cluster an error."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _own_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table: a lost executor costs a re-read only.
    What was shuffled to make it is of no use any more and goes at once.  Python
    workers get batches of ``BATCH_BYTES``, unless the session sets a bound itself."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before, own = spark.conf.get(_CLEANUP, "false"), spark.conf.get(_BATCH, None)
    spark.conf.set(_CLEANUP, "true")
    if own is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
        if own is None:
            spark.conf.unset(_BATCH)
    _trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _trim_driver(spark: SparkSession) -> None:
    """Native memory that the driver's many threads have freed goes back to the
    system (a diagnostic command of the JVM, a few milliseconds): plans of hundreds
    of short queries leave much of it behind.  A JVM without it goes on as it is."""
    from py4j.protocol import Py4JError

    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = command, "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def discard(*tables: DataFrame) -> None:
    """Delete written tables after their last use."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fitting(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` short rows, to be broadcast if they are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch, rows: int = 512):
    """An Arrow batch in slices, so that Python objects exist for few rows at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker gives its free memory back to the system:
    workers live on and serve other tasks."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
