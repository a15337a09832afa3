"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Best fit decreasing looks at lengths only, and there are at most `capacity` different ones. So the driver packs the
histogram of lengths, exactly as if it placed piece after piece: a segment tree over remaining capacities gives the tightest
open bin that still fits, and a run of pieces of one length that lands in a run of alike bins is placed at once. The plan is a
table of runs whose size depends on the capacity, not on the corpus. Pieces are numbered within their length by
distributed prefix sums and look up their run.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import mapped, stored, texts

#: Texts of these characters are split alike by both tokenizer libraries, whatever their Unicode versions.
_PLAIN = re.compile("[\x00-ɏ]*")
_loaded: dict = {}


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(vocabulary: str, ranks: str | None):
    """A function from a list of texts to their ids.

    vocabulary is a tokenizers file. ranks, if given, is the same vocabulary as a tiktoken file: that library applies the same merges
    several times faster, and is used for texts of plain characters, where both give the same ids. Strings of special tokens
    within a text are ordinary text.
    """
    if (vocabulary, ranks) not in _loaded:
        _loaded[vocabulary, ranks] = _encoder(vocabulary, ranks)
    return _loaded[vocabulary, ranks]


def _encoder(vocabulary: str, ranks: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    @cache
    def slow():
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(vocabulary)
        out.encode_special_tokens = True
        return out

    @cache
    def fast():
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(batch: list[str]):
        for text in batch:
            if ranks and _PLAIN.fullmatch(text):
                yield fast().encode_ordinary(text)
            else:
                yield slow().encode(text, add_special_tokens=False).ids

    return encode


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity that tells which have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, remaining: int, is_open: bool) -> None:
        at = remaining + self.size
        self.open[at] = is_open
        at //= 2
        while at:
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]
            at //= 2

    def tightest(self, needed: int) -> int | None:
        """The smallest remaining capacity of at least `needed` that has an open bin."""
        at = needed + self.size
        if self.open[at]:
            return needed
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan: runs (length, first rank, first bin, pieces a bin, offset in the bin).

    The pieces of a length, numbered from 0, fill the runs of that length in turn: `pieces a bin` consecutive ones go
    to one bin, from the offset on, and the next ones to the next bin.
    """
    tree = CapacityTree(capacity)
    bins: dict[int, deque[tuple[int, int]]] = {}
    plan, opened = [], 0

    def put(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            bins.setdefault(remaining, deque()).append((first, count))
            tree.set(remaining, True)

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                first, count = opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = bins[remaining].popleft()
                if not bins[remaining]:
                    tree.set(remaining, False)
            each = remaining // length  # best fit goes on in the same bin while it fits
            full = min(count, left // each)
            if full:
                plan.append((length, rank, first, each, capacity - remaining))
                put(remaining - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:  # fewer than a bin's worth are left
                plan.append((length, rank, first + full, each, capacity - remaining))
                put(remaining - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < count and remaining < capacity:
                bins.setdefault(remaining, deque()).appendleft((first + full, count - full))
                tree.set(remaining, True)
    return plan


def tokenised(documents: DataFrame, id_col: str, text_col: str, vocabulary: str, ranks: str | None, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and end_id, cut into pieces of at most capacity."""
    kind = documents.schema[id_col].dataType.simpleString()

    def cut(batches):
        encode = encoder(vocabulary, ranks)
        for b in batches:
            names, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, ids in enumerate(encode([t or "" for t in texts(b.column(1))])):
                whole = np.empty(len(ids) + 1, dtype="<u4")
                whole[:-1] = ids
                whole[-1] = end_id
                edges = [0, *range(len(whole) % capacity or capacity, len(whole) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    names.append(row)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(whole[lo:hi].tobytes()))
                    if keep_ids:
                        kept.append(whole[lo:hi].astype(np.int32))
            columns = [b.column(0).take(pa.array(names, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(docs, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def best_fit_pack(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    vocabulary: str | None = None,
    ranks: str | None = None,
    end_id: int = 2,
    keep_ids: bool = False,
    buckets: int = 256,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row for each piece.

    A document's ids are those of the vocabulary and then end_id. Only a document of more than capacity ids is cut, into
    pieces of capacity ids; its first piece holds what is over. Sequences are filled by best fit decreasing.
    vocabulary and ranks are tokenizer files that every executor can open. Pieces are numbered in `buckets` buckets of each length, or as many
    as keep them near 100,000 pieces.

    Defined cases: a null or empty text is one piece that holds end_id alone. Null ids and repeated rows are packed like any
    other. An empty table gives no rows. Other columns are ignored.
    """
    if vocabulary is None:
        vocabulary, ranks = default_vocabulary()
    pieces = tokenised(documents, id_col, text_col, vocabulary, ranks, end_id, capacity, keep_ids)
    pieces = stored(pieces.withColumn("salt", F.monotonically_increasing_id()), "pieces")  # so that rows that are alike spread over the buckets
    # numbers within each length: counts of (length, bucket), prefix sums over buckets, and a number within the bucket
    buckets = max(buckets, pieces.count() // 100_000)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(buckets)))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own"))

    plan = best_fit_decreasing(histogram, capacity)
    runs: dict[int, tuple[np.ndarray, ...]] = {}
    for length in {p[0] for p in plan}:
        runs[length] = tuple(np.array(x, dtype=np.int64) for x in zip(*(p[1:] for p in plan if p[0] == length)))
    shared = documents.sparkSession.sparkContext.broadcast(runs)  # at most some runs for each pair of capacities

    def place(batches):
        for b in batches:
            lengths, ranks_ = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                first_rank, first_bin, each, at = shared.value[length]
                rows = np.flatnonzero(lengths == length)
                run = np.searchsorted(first_rank, ranks_[rows], side="right") - 1
                nth = ranks_[rows] - first_rank[run]
                sequence[rows] = first_bin[run] + nth // each[run]
                offset[rows] = at[run] + nth % each[run] * length
            columns = [b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(kept).schema.fields)
    return mapped(ranked.select(*kept, "rank"), place, f"{fields}, sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir):
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
