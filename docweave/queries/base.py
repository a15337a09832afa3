"""Registration, and the documents that the queries read. Each is built from rows of a bounded group: an order's lines, a customer's orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A total order of an order's lines.
TOTAL = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
#: The same lines in SQL: rn is a line's place from 1 on, n how many its order has.
LINES = f"""lines AS (
  SELECT l.*, o.o_orderstatus, o.o_totalprice, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(TOTAL)})
)"""

def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value: {"id", "status", "total", "lines": [{"ln", "part", "supp", "qty", "price", "flag", "note" for flag R only}]}."""
    note = F.when(F.col("l_returnflag") == "R", F.lit("back"))
    line = F.struct(
        F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), note.alias("note"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*TOTAL, line.alias("x")).alias("r"))
    lines = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    doc = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "lines")
    return both.select(F.col("o_orderkey").alias("key"), F.to_json(doc).alias("value"))


def pack_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value: {"packs": [{"flag", "parts": [...]}], "nested": [[...], ...]}, an order's parts by flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    packs = F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), "parts")))
    docs = lines.groupBy(F.col("l_orderkey").alias("key")).agg(packs.alias("packs"))
    return docs.select("key", F.to_json(F.struct("packs", F.transform("packs", lambda p: p["parts"]).alias("nested"))).alias("value"))


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value: {"id", "name", "segment", "orders": {orderkey: {"price", "status"}}, "prices": {orderkey: price}}."""
    orders = table(spark, sf_dir, "orders")
    entry = lambda *cols: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), *cols))))
    full = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    grouped = orders.groupBy("o_custkey").agg(entry(full).alias("orders"), entry(F.col("o_totalprice")).alias("prices"))
    both = table(spark, sf_dir, "customer").join(grouped, F.col("c_custkey") == F.col("o_custkey"))
    doc = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "orders", "prices")
    return both.select(F.col("c_custkey").alias("key"), F.to_json(doc).alias("value"))


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value: {"id", "user", "type", "value": absent for ids 7 n, null for 7 n + 1, "props": {"k"}}."""
    value = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 7 == 1, ',"value":null').otherwise(F.concat(F.lit(',"value":'), F.to_json(F.array("value")).substr(F.lit(2), F.length(F.to_json(F.array("value"))) - 2)))
    text = F.concat(F.lit('{"id":'), "event_id", F.lit(',"user":'), "user_id", F.lit(',"type":"'), "event_type", F.lit('"'), value, F.lit(',"props":'), "props", F.lit("}"))
    return dealt(table(spark, sf_dir, "events")).select(F.col("event_id").alias("key"), text.alias("value"))


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value: {"id", "title", "price", "meta": {"brand", "size"}, "tags": words of the name}."""
    doc = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"),
        F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("meta"), F.split("p_name", " ").alias("tags"),
    )
    return dealt(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("key"), F.to_json(doc).alias("value"))


def dealt(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small file of one row group is one task else, whatever is then done to its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, within one process, a temporary one where that is unset."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/') if base else 'file://' + tempfile.mkdtemp(prefix='docweave')}/{name}-{uuid.uuid4().hex}"
