"""JSON lines as streams: the same stateless columns and operators over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.sources.jsonl import lines


def stream_jsonl(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Documents of files that turn up in a folder."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return lines(reader.text(path))


def write_stream(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts writing a stream of a text column as lines of text; exactly once, by the checkpoint."""
    return df.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
