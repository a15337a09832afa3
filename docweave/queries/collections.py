"""Typed collections: lists, maps, nested values."""

from pyspark.sql import functions as F

from docweave.operators.collections import ListView, MapView, Nested, Policy
from docweave.operators.frames import explode_entries
from docweave.queries.base import LINES, customer_docs, order_docs, part_docs, query

ITEM = "struct<part: bigint, qty: double, flag: string>"


@query("list_view", f"WITH {LINES} SELECT l_orderkey AS id, n AS size, false AS empty, max(CASE WHEN rn = 2 THEN l_partkey END) AS second FROM lines GROUP BY l_orderkey, n")
def list_view(spark, d):
    docs, items = order_docs(spark, d), ListView(F.col("value"), "lines", ITEM)
    return docs.select(F.col("key").alias("id"), items.size().cast("long").alias("size"), items.is_empty().alias("empty"), items.get(1)["part"].alias("second"))


@query("value_list", "SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS first, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n FROM part")
def value_list(spark, d):
    tags = ListView(F.col("value"), "tags", "string")
    return part_docs(spark, d).select(F.col("key").alias("id"), tags.get(0).alias("first"), tags.size().cast("long").alias("n"))


@query("list_stream", "SELECT l_orderkey AS id, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def list_stream(spark, d):
    return order_docs(spark, d).select(F.col("key").alias("id"), ListView(F.col("value"), "lines", ITEM).collect(Policy.STREAM).alias("r")).select("id", "r.part")


@query("list_cards", f"WITH {LINES} SELECT l_orderkey AS id, '{{\"part\":' || l_partkey || ',\"none\":null}}' AS card FROM lines")
def list_cards(spark, d):
    items = ListView(F.col("value"), "lines", "struct<part: bigint, none: string>")
    return order_docs(spark, d).select(F.col("key").alias("id"), F.explode(items.collect(Policy.PROJECTED)).alias("card"))


@query("list_filtered", f"WITH {LINES} SELECT l_orderkey AS id, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n FROM lines GROUP BY l_orderkey")
def list_filtered(spark, d):
    items = ListView(F.col("value"), "lines", ITEM)
    return order_docs(spark, d).select(F.col("key").alias("id"), F.size(items.filtered(lambda x: x["flag"] == "R")).cast("long").alias("n"))


@query("sum_field", f"WITH {LINES} SELECT l_orderkey AS id, CAST(sum(l_partkey) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS none FROM lines GROUP BY l_orderkey")
def sum_field(spark, d):
    items = ListView(F.col("value"), "lines", "struct<part: bigint, none: bigint>")
    return order_docs(spark, d).select(F.col("key").alias("id"), items.sum_field("part").alias("total"), items.sum_field("none").alias("none"))


@query("nested_fields", "SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS BIGINT) AS size, CAST(p_size AS BIGINT) AS total FROM part")
def nested_fields(spark, d):
    """A value at a path as a root of its own, and a nested field of each element of a list."""
    meta = Nested(F.col("value"), "meta", "struct<brand: string, size: bigint>")
    listed = ListView(F.concat(F.lit("["), "value", F.lit("]")), "", "struct<meta: struct<size: bigint>>")
    return part_docs(spark, d).select(F.col("key").alias("id"), meta.get("brand").alias("brand"), meta.get("size").alias("size"), listed.sum_field("meta", "size").alias("total"))


@query("map_view", "SELECT o_custkey AS id, count(*) AS n, round(sum(o_totalprice), 2) AS total, false AS zero, round(max(CASE WHEN o_orderkey = first THEN o_totalprice END), 4) AS price FROM (SELECT o.*, min(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey) AS f, CAST(min(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey) AS BIGINT) AS first FROM orders o JOIN customer ON c_custkey = o_custkey) GROUP BY o_custkey")
def map_view(spark, d):
    prices = MapView(F.col("value"), "prices", "double")
    values = F.map_values(prices.map)
    return customer_docs(spark, d).select(
        F.col("key").alias("id"), prices.size().cast("long").alias("n"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 2).alias("total"),
        prices.contains("none").alias("zero"), F.round(prices.get(prices.entries()[0]["key"]), 4).alias("price"),
    )


@query("map_rows", "SELECT o_custkey AS id, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey")
def map_rows(spark, d):
    rows = explode_entries(customer_docs(spark, d).withColumnRenamed("key", "id"), "value", "orders", "struct<status: string>", ["id"])
    return rows.select("id", "key", "value.status")


@query("map_probe", "SELECT o_orderkey AS order, o_custkey AS id, round(o_totalprice, 4) AS price FROM orders JOIN customer ON c_custkey = o_custkey")
def map_probe(spark, d):
    """Many probes into maps: the entries as rows, joined on their keys."""
    rows = explode_entries(customer_docs(spark, d).withColumnRenamed("key", "id"), "value", "prices", "double", ["id"])
    probes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("order"), F.col("o_orderkey").cast("string").alias("key"))
    return rows.join(probes, "key").select("order", "id", F.round("value", 4).alias("price"))
