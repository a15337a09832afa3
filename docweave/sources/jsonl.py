"""JSON lines: one document a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.deploy import ship


def lines(df: DataFrame, name: str = "value") -> DataFrame:
    """Lines as documents: one trailing carriage return goes, empty lines go, lines of white space stay."""
    return df.select(F.regexp_replace(name, "\r$", "").alias(name)).where(F.length(name) > 0)


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A column value of the raw text of each document. Files split at line ends over tasks."""
    return lines(spark.read.option("lineSep", "\n").text(path))


def read_jsonl_as(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Typed columns by a declared schema, pruned to what is used; rows that are no JSON are null throughout."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(f"struct<{schema}>")
    return read_jsonl(spark, path).select(F.from_json("value", kind).alias("d")).select("d.*")


def write_jsonl(df: DataFrame, path: str, doc: Column | str = "value", mode: str = "errorifexists") -> None:
    """Writes documents, one a line; null documents are left out. Text must hold no line ends outside strings."""
    column = F.col(doc) if isinstance(doc, str) else doc
    df.select(column.alias("value")).where("value IS NOT NULL").write.mode(mode).option("lineSep", "\n").text(path)


def write_jsonl_views(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes rows as objects; nulls are written."""
    write_jsonl(df, path, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), mode)


def written_bytes(df: DataFrame, doc: str = "value") -> DataFrame:
    """How many bytes write_jsonl would write, and how many lines: n_bytes, n_lines."""
    return df.where(F.col(doc).isNotNull()).agg(F.coalesce(F.sum(F.octet_length(doc) + 1), F.lit(0)).cast("long").alias("n_bytes"), F.count("*").alias("n_lines"))


def for_each_document(df: DataFrame, function, doc: str = "value") -> None:
    """Calls function(text) for every document, on the executors; its first error fails the job."""
    ship(df.sparkSession)

    def run(rows):
        for r in rows:
            function(r[0])

    df.select(doc).foreachPartition(run)
