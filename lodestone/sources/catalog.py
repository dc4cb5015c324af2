"""Schemas from catalog text, tables, and ``|``-delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"Int": T.IntegerType(), "Double": T.DoubleType(), "String": T.StringType()}


def parse_catalog(text: str) -> dict[str, T.StructType]:
    """``BEGIN relation file (name Type)* END`` entries, by relation."""
    out: dict[str, T.StructType] = {}
    words = iter(text.split())
    for word in words:
        if word != "BEGIN":
            raise ValueError(f"expected BEGIN, found {word}")
        relation, _ = next(words), next(words)
        fields = []
        for name in words:
            if name == "END":
                break
            kind = next(words)
            if kind not in _TYPES:
                raise ValueError(f"unknown type {kind}")
            fields.append(T.StructField(name, _TYPES[kind]))
        else:
            raise ValueError("missing END")
        out[relation] = T.StructType(fields)
    return out


def parse_files(text: str) -> dict[str, str]:
    """The file name of each relation of a catalog."""
    parse_catalog(text)
    words = text.split()
    return {words[k + 1]: words[k + 2] for k, w in enumerate(words) if w == "BEGIN"}


def schema_of(text: str, relation: str) -> T.StructType:
    found = parse_catalog(text)
    if relation not in found:
        raise ValueError(f"no relation {relation}")
    return found[relation]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lenient(value: Column, kind: T.DataType) -> Column:
    """A number as far as the text begins with one, else 0."""
    shape = r"^\s*([+-]?[0-9]+)" if isinstance(kind, T.IntegerType) else r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    found = F.regexp_extract(F.coalesce(value, F.lit("")), shape, 1)
    return F.when(found == "", F.lit("0")).otherwise(found).try_cast(kind)


def load_delimited(spark: SparkSession, path: str, schema: T.StructType, *, mode: str = "PERMISSIVE", lenient: bool = False) -> DataFrame:
    """Lines ``value|value|...|`` under a declared schema.

    A field that is no number is null (mode PERMISSIVE), drops its line
    (DROPMALFORMED) or is an error (FAILFAST); ``lenient`` reads the number that
    it begins with, 0 if none."""
    reader = spark.read.option("sep", "|").option("quote", "").option("mode", mode)
    after = [T.StructField("_after", T.StringType())]  # what stands behind the last bar: nothing
    if not lenient:
        return reader.schema(T.StructType([*schema, *after])).csv(path).drop("_after")
    text = reader.schema(T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema), *after])).csv(path)
    return text.select(*[(F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else _lenient(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in schema])


def load_relation(spark: SparkSession, text: str, relation: str, folder: str, **options) -> DataFrame:
    """A relation from the file that the catalog names, in ``folder``."""
    return load_delimited(spark, f"{folder}/{parse_files(text)[relation]}", schema_of(text, relation), **options)


def record(line: Column, schema: T.StructType) -> Column:
    """One record from a string of the same format."""
    return F.from_csv(line, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": "|"})


def write_delimited(df: DataFrame, path: str) -> None:
    df.select(F.concat(*[p for c in df.columns for p in (df[f"`{c}`"].cast("string"), F.lit("|"))]).alias("line")).write.mode("overwrite").text(path)
