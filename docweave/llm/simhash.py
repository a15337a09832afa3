"""SimHash near-duplicate detection with multi-index hashing.

Each fingerprint of 64 bits is indexed by its two halves. Two fingerprints that differ in at most two bits either
have upper halves that differ in at most one bit, or equal lower halves; so every fingerprint looks up the Hamming
ball of radius one around its upper half, and its lower half itself, fetches what the tables hold there and verifies
the complete distance. Only distinct fingerprints take part, so exact copies cost nothing here.

A half that very many fingerprints share is not fetched whole: there the other half is indexed too, by its ball of
radius one. Two members whose balls meet are within two bits of each other, so at most 65 fingerprints share such a
key and each needs one link, to the smallest of them. That is exact and linear, however large the bucket.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import discard, fresh, joined, mapped, raw, stored

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprints(documents: list[bytes | None], size: int = 3, slice_of: int = 65536) -> np.ndarray:
    """The 64-bit SimHash of each text; a bit is set if more than half the shingle hashes have it.

    Long texts are hashed slice by slice, so memory does not follow the longest one.
    """
    total = np.zeros(len(documents), dtype=np.int64)
    counts = np.zeros((len(documents), 64), dtype=np.int32)
    held: list[int] = []
    spans: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            hashes = np.array(held, dtype=np.uint64).view(np.uint8).reshape(-1, 8).astype(np.int64)
            docs = np.repeat(np.arange(len(spans)), [n for _, n in spans]) * 256
            at = [i for i, _ in spans]
            for j in range(8):
                seen = np.bincount(docs + hashes[:, j], minlength=256 * len(spans)).reshape(-1, 256) @ _BITS
                np.add.at(counts, (at, slice(8 * j, 8 * j + 8)), seen)
            held.clear()
            spans.clear()

    for i, text in enumerate(documents):
        words = text.lower().split() if text else []
        if not words:
            continue
        n = total[i] = max(1, len(words) - size + 1)
        for lo in range(0, n, slice_of):
            hi = min(n, lo + slice_of)
            part = words[lo : hi + size - 1]
            shingles = zip(*(part[k:] for k in range(size))) if len(words) >= size else [words]
            held.extend(map(_hash, map(b" ".join, shingles)))
            spans.append((i, hi - lo))
            if len(held) >= slice_of or len(spans) >= 512:
                flush()
    flush()
    return np.packbits(counts * 2 > total[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def with_fingerprint(documents: DataFrame, text_col: str, name: str) -> DataFrame:
    """documents with one more column, the fingerprint as a signed long."""
    at = documents.columns.index(text_col)

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fingerprints(raw(b.column(at))).view(np.int64))], names=[*b.schema.names, name])

    return mapped(documents, add, T.StructType([*documents.schema.fields, T.StructField(name, T.LongType())]))


def links(distinct: DataFrame, hot: int = 64) -> DataFrame:
    """Links a, b (a < b) that connect exactly what Hamming distances of at most two connect; see _links."""
    return _links(distinct, hot)[0]


def _links(distinct: DataFrame, hot: int = 64) -> tuple[DataFrame, DataFrame]:
    """The links, and the table that they are read from.

    distinct: one long column f of distinct fingerprints. Buckets of up to hot fingerprints are fetched and verified pair by
    pair; larger ones go by the balls of the other half.
    """
    halves = distinct.selectExpr("f", "shiftrightunsigned(f, 32) AS hi", "f & 4294967295L AS lo")
    table = halves.selectExpr("f", "inline(array(struct(0 AS seg, hi AS key), struct(1 AS seg, lo AS key)))")
    ball = "transform(sequence(0, 31), b -> struct(0 AS seg, hi ^ shiftleft(1L, b) AS key, 1 AS off))"
    probes = halves.selectExpr("f", f"inline(concat(array(struct(0 AS seg, hi AS key, 0 AS off), struct(1 AS seg, lo AS key, 0 AS off)), {ball}))")
    sizes = table.groupBy("seg", "key").agg(F.count("*").alias("n"))
    hits = stored(joined(probes, sizes, ["seg", "key"]).where("off = 1 OR n > 1"), "simhash-hits")
    fetched = joined(hits.where(F.col("n") <= hot).select("seg", "key", F.col("f").alias("a")), table.withColumnRenamed("f", "b"), ["seg", "key"])
    near = fetched.where("a < b AND bit_count(a ^ b) <= 2").select("a", "b")
    rest = "CASE WHEN seg = 0 THEN f & 4294967295L ELSE shiftrightunsigned(f, 32) END"
    crowded = hits.where(F.col("n") > hot).selectExpr("seg", "key", "off", "f", f"{rest} AS rest")
    points = crowded.selectExpr("seg", "key", "f", "explode(CASE WHEN off = 1 THEN array(rest) ELSE concat(array(rest), transform(sequence(0, 31), b -> rest ^ shiftleft(1L, b))) END) AS point")
    stars = points.groupBy("seg", "key", "point").agg(F.collect_set("f").alias("fs")).where(F.size("fs") > 1)
    stars = stars.select(F.array_min("fs").alias("a"), F.explode("fs").alias("b")).where("a < b AND bit_count(a ^ b) <= 2")
    return near.union(stars).distinct(), hits


def components(edges: DataFrame, *done: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, for every node that has a link and isn't itself the root.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until nothing changes. Each round is a written
    table; only a count and a checksum reach the driver. Tables done are removed once the edges are read.
    """
    edges, before = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "components"), None
    discard(*done)
    while True:
        both = edges.union(edges.select("v", "u"))
        nearest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components")  # apart, so that the join of a root with very many nodes can be split
        large = joined(both, nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges, old = stored(small.distinct(), "components"), edges
        discard(old, nearest)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def roots(distinct: DataFrame) -> DataFrame:
    """f, root for every distinct fingerprint; root is the fingerprint that stands for its component."""
    linked = components(*_links(distinct))
    return joined(distinct, linked, F.col("f") == F.col("node"), "left").select("f", F.coalesce("root", "f").alias("root"))


def simhash_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row for each row of documents.

    Words are [^\\x20\\x09-\\x0D]+ after A-Z become a-z; shingles are 3 words, repeats included, hashed by XXH64 with seed 42.
    Fingerprints at 2 or fewer differing bits are linked; component_id is the smallest id that links reach, the row's own
    included.

    Defined cases: a text of fewer than three words is one shingle; a null, empty or blank text has fingerprint zero and is
    linked like any other. Null ids are ignored by the smallest id (null if a component has no other). Repeated rows are returned
    each. An empty table gives no rows. Other columns are ignored.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = stored(with_fingerprint(docs, "text", "f").select("doc_id", "f"), "simhash")
    each = marked.groupBy("f").agg(F.min("doc_id").alias("least"))
    named = stored(joined(roots(each.select("f")), each, "f"), "simhash-roots")
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = joined(named, whole, "root").select("f", "component_id")
    return joined(marked, ids, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that stay when one of each component stays: the one with the smallest id.

    All columns are returned, whatever their names. Null ids come after all others; among repeated ids an arbitrary but single row stays.
    Nulls and empty texts are one component (fingerprint zero). An empty table gives no rows.
    """
    f, uid, root = fresh(documents, "fingerprint_", "row_", "root_")
    marked = stored(with_fingerprint(documents.withColumn(uid, F.monotonically_increasing_id()), text_col, f), "near-dedup")
    found = stored(roots(marked.select(F.col(f).alias("f")).distinct()), "near-dedup-roots").select(F.col("f").alias(f), F.col("root").alias(root))
    order = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.col(uid).alias("c"))
    chosen = joined(marked.select(f, order.alias("o")).groupBy(f).agg(F.min("o").alias("o")), found, f).groupBy(root).agg(F.min("o").alias("o"))
    return joined(marked, chosen.select(F.col("o.c").alias(uid)), uid, "left_semi").select(*documents.columns)


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
