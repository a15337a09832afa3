"""Labelled samples of bounded size, and texts joined end to end for vectorised features."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for null ids."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def lowest(df: DataFrame, key: Column, tie: str, limit: int, total: int) -> DataFrame:
    """At most limit of df's total rows, those with the smallest hash of key, of equal ones those with the smaller tie column.

    All but about twice as many are left out where they are read, so that no task returns more than its share.
    """
    space = 1 << 30
    rows = df.withColumn("_hash", F.pmod(F.xxhash64(key), F.lit(space)))
    share = min(space, space * (2 * limit + 100) // max(total, 1))
    return rows.where(F.col("_hash") < share).orderBy("_hash", tie).limit(limit).drop("_hash")


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, limits: dict[int, int]) -> DataFrame:
    """doc_id, text, y, whole: labelled documents, at most limits[y] ids of each label y, chosen by a hash of the id.

    whole is the number of labelled ids of that y. The ids are at most sum(limits) rows, which bounds what is broadcast to
    the scan of documents. Null ids and labels are left out; of repeated labels of one id the smallest counts, and of its texts the first
    in order.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(list(limits)) & train)
    marks = marks.groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    whole = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each label
    parts = [lowest(marks.where(F.col("y") == y), F.col("i"), "i", limit, whole.get(y, 0)).withColumn("whole", F.lit(whole.get(y, 0)).cast("long")) for y, limit in limits.items()]
    chosen = reduce(DataFrame.union, parts)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("i"))
    return found.groupBy("doc_id", "y", "whole").agg(F.min("text").alias("text")).select("doc_id", "text", "y", "whole")


def joined(texts: list[bytes], pad: int, most: int = 1 << 20, rows: int = 256):
    """Texts end to end, each followed by pad zero bytes: pieces of (first row, rows, bytes, row of each byte, is text).

    A text over `most` bytes comes in several pieces, whose grams overlap by pad - 1 bytes, so that every gram that starts in the text is
    met once.
    """
    held: list[tuple[int, bytes, int]] = []
    size = 0

    def out():
        data = np.frombuffer(b"".join(p for _, p, _ in held), np.uint8)
        lengths = np.array([len(p) for _, p, _ in held])
        row = np.repeat([r for r, _, _ in held], lengths)
        own = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat([n for _, _, n in held], lengths)
        return held[0][0], held[-1][0] - held[0][0] + 1, data, row - held[0][0], own

    for r, text in enumerate(texts):
        for at in range(0, max(1, len(text)), most):
            part = text[at : at + most + pad].ljust(min(most, len(text) - at) + pad, b"\0")
            held.append((r, part, len(part) - pad))
            size += len(part)
            if size >= most or len(held) >= rows:
                yield out()
                held, size = [], 0
    if held:
        yield out()
