"""Edits of documents, each read back as typed columns."""

from pyspark.sql import functions as F

from docweave.functions.edit import Edits
from docweave.operators import columns as C
from docweave.operators.views import View, ViewField
from docweave.queries.base import event_docs, part_docs, query

TAGS = "string_split(p_name, ' ')"


def _edited(name, sql, edits, *columns, docs=part_docs):
    """Registers a query that applies a list of edits and reads columns back: (column, path, type)."""

    @query(name, sql)
    def run(spark, d):
        made = docs(spark, d).select(F.col("key").alias("id"), C.parsed(C.edited(F.col("value"), edits)).alias("v"))
        return made.select("id", *(C.find(F.col("v"), p, k).alias(c) if k != "size" else C.array_len(F.col("v"), p).cast("long").alias(c) for c, p, k in columns))

    return run


_edited("edit_set", "SELECT p_partkey AS id, 'new' AS title, CAST(5 AS BIGINT) AS size, p_brand AS brand FROM part", Edits().set("title", "new").set("meta.size", 5), ("title", "title", "string"), ("size", "meta.size", "bigint"), ("brand", "meta.brand", "string"))
_edited("edit_set_missing", "SELECT p_partkey AS id, p_name AS title, CAST(NULL AS BIGINT) AS none FROM part", Edits().set("title", "new").set("nothing", 1), ("title", "title", "string"), ("none", "nothing", "bigint"))
_edited("edit_set_raw", "SELECT p_partkey AS id, CAST(2 AS BIGINT) AS second, CAST(p_size AS BIGINT) AS size FROM part", Edits().set("title", "[1, 2]", raw=True), ("second", "title[1]", "bigint"), ("size", "meta.size", "bigint"))
_edited("edit_upsert", "SELECT p_partkey AS id, p_partkey + 0 AS own, 'x' AS brand, true AS deep, 'end' AS last FROM part", Edits().upsert("meta.brand", "x").upsert("a.b.c", True).upsert("tags[2]", "end"), ("own", "id", "bigint"), ("brand", "meta.brand", "string"), ("deep", "a.b.c", "boolean"), ("last", "tags[2]", "string"))
_edited("edit_delete", f"SELECT p_partkey AS id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS brand, CAST(p_size AS BIGINT) AS size, {TAGS}[2] AS first FROM part", Edits().delete("title").delete("meta.brand").delete("tags[0]"), ("title", "title", "string"), ("brand", "meta.brand", "string"), ("size", "meta.size", "bigint"), ("first", "tags[0]", "string"))
_edited("edit_arrays", f"SELECT p_partkey AS id, CAST(len({TAGS}) + 3 AS BIGINT) AS n, 'a' AS first, {TAGS}[1] AS second, 'b' AS third, 'z' AS last FROM part", Edits().append("tags", "z").prepend("tags", "a").insert("tags", 2, "b"), ("n", "tags", "size"), ("first", "tags[0]", "string"), ("second", "tags[1]", "string"), ("third", "tags[2]", "string"), ("last", "tags[4]", "string"))
_edited("edit_rename", "SELECT p_partkey AS id, p_name AS name, CAST(NULL AS VARCHAR) AS title, p_brand AS make FROM part", Edits().rename("", "title", "name").rename("meta", "brand", "make"), ("name", "name", "string"), ("title", "title", "string"), ("make", "meta.make", "string"))
_edited("edit_rename_taken", "SELECT p_partkey AS id, p_name AS title, p_partkey AS own FROM part", Edits().rename("", "title", "id"), ("title", "title", "string"), ("own", "id", "bigint"))
_edited("edit_merge_shallow", "SELECT p_partkey AS id, 'x' AS brand, CAST(p_size AS BIGINT) AS size, 'new' AS colour FROM part", Edits().merge_shallow("meta", {"brand": "x", "colour": "new"}), ("brand", "meta.brand", "string"), ("size", "meta.size", "bigint"), ("colour", "meta.colour", "string"))
_edited("edit_merge_patch", "SELECT p_partkey AS id, CAST(NULL AS VARCHAR) AS brand, CAST(p_size AS BIGINT) AS size, CAST(1 AS BIGINT) AS deep, CAST(0 AS BIGINT) AS tags FROM part", Edits().merge_patch("", {"meta": {"brand": None, "nothing": None}, "a": {"b": 1, "c": None}, "tags": []}), ("brand", "meta.brand", "string"), ("size", "meta.size", "bigint"), ("deep", "a.b", "bigint"), ("tags", "tags", "size"))
_edited("edit_batch", f"SELECT p_partkey AS id, 'n' AS name, CAST(NULL AS DOUBLE) AS price, p_brand AS brand, CAST(1 AS BIGINT) AS one, CAST(len({TAGS}) + 1 AS BIGINT) AS tags FROM part", Edits().rename("", "title", "name").set("name", "n").delete("price").merge_patch("meta", {"size": None, "one": 1}) + Edits().append("tags", "t"), ("name", "name", "string"), ("price", "price", "double"), ("brand", "meta.brand", "string"), ("one", "meta.one", "bigint"), ("tags", "tags", "size"))


@query("edit_errors", "SELECT event_id AS id, event_id % 7 = 0 AS failed, CASE WHEN event_id % 7 = 0 THEN event_type ELSE 'set' END AS kind FROM events")
def edit_errors(spark, d):
    """A list of edits that fails changes nothing; the error stands beside."""
    docs = event_docs(spark, d).select("key", C.edited(F.col("value"), Edits().set("type", "set").set("value", 1), on_error="column").alias("r"))
    return docs.select(F.col("key").alias("id"), F.col("r.error").isNotNull().alias("failed"), C.find(C.parsed("r.value"), "type", "string").alias("kind"))


@query("merge_patch_rows", "SELECT event_id AS id, CAST(json_merge_patch('{\"a\":1,\"k\":0}', props) ->> 'k' AS BIGINT) AS k, CAST(1 AS BIGINT) AS a FROM events")
def merge_patch_rows(spark, d):
    """Each document with the patch of its own row."""
    docs = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), C.parsed(C.merge_patched(F.lit('{"a":1,"k":0}'), F.col("props"))).alias("v"))
    return docs.select("id", C.find(F.col("v"), "k", "bigint").alias("k"), C.find(F.col("v"), "a", "bigint").alias("a"))


@query("edit_keeps_bytes", "SELECT event_id AS id, '{ \"k\" :  7, \"rest\": [1.50, 1e2] }' AS text FROM events")
def edit_keeps_bytes(spark, d):
    """What is not edited keeps its spacing and its numbers' digits."""
    text = F.concat(F.lit('{ "k" :  '), F.col("key").cast("string"), F.lit(', "rest": [1.50, 1e2] }'))
    return event_docs(spark, d).select(F.col("key").alias("id"), C.edited(text, Edits().set("k", 7)).alias("text"))


@query("view_editors", f"SELECT p_partkey AS id, 'x' AS title, CAST(len({TAGS}) + 2 AS BIGINT) AS n, 'b' AS second, {TAGS}[1] AS first FROM part")
def view_editors(spark, d):
    view, text = View(ViewField("title", "string"), ViewField("tags", "array<string>")), F.col("value")
    docs = part_docs(spark, d)
    for change in (lambda t: view.set_field(t, "title", "x"), lambda t: view.append_field(t, "tags", "e"), lambda t: view.prepend_field(t, "tags", "a"), lambda t: view.insert_field(t, "tags", 1, "b"), lambda t: view.delete_at(t, "tags", 0), lambda t: view.prepend_field(t, "tags", "p")):
        docs = docs.withColumn("value", change(text))
    docs = docs.select(F.col("key").alias("id"), C.parsed("value").alias("v"))
    v = F.col("v")
    return docs.select("id", C.find(v, "title", "string").alias("title"), (C.array_len(v, "tags").cast("long") - 1).alias("n"), C.find(v, "tags[1]", "string").alias("second"), C.find(v, "tags[2]", "string").alias("first"))
