"""Helpers shared by the corpus operators: durable intermediate tables and Arrow column access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docweave.deploy import ship

#: The white space that separates words in every operator that counts words: space and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what spark.checkpoint.dir names; only where that is unset and all runs in one process (tests) a temporary
    folder is made and set. On a cluster without it this is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    conf = conf or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docweave"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and every reader sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing will read any more."""
    for t in tables:
        if hasattr(t, "_stored_at"):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left.join(right) by sorting and merging, for sides that both grow with the corpus.

    Left to itself Spark goes by the size of files, which says nothing of the rows that explode makes of them, and broadcasts through the
    driver what it takes for small.
    """
    return left.join(right.hint("merge"), on, how)


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, after whose partitions the workers give the memory back that they no longer need."""
    ship(df.sparkSession)

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def texts(column: pa.Array) -> list[str | None]:
    """A string column of an Arrow batch as Python strings."""
    return column.to_pylist()


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def crc32_of_id(doc_id: object) -> int:
    """crc32 of an id written as text; the folds of the labelled rows follow from it."""
    return zlib.crc32(str(doc_id).encode())


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
