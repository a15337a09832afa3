"""Cards, keep lists, transform pipelines, views, building and sizes."""

from pyspark.sql import functions as F

from docweave.functions.build import ArrayBuilder, JsonWriter, ObjectBuilder, array_from, object_from
from docweave.operators import columns as C
from docweave.operators.frames import card_lines, cards, each, each_card
from docweave.operators.plan import Plan
from docweave.operators.sql import register
from docweave.operators.transform import TransformPipeline
from docweave.operators.views import View, ViewField
from docweave.queries.base import LINES, event_docs, order_docs, part_docs, query, scratch, table
from docweave.sources import jsonl

PARTS = "SELECT p_partkey AS id, p_name AS title, p_brand AS brand, CAST(p_size AS BIGINT) AS size"


def _back(docs, *fields, text=None):
    """Typed columns of JSON text, by a schema of the fields: (column, path, type); and the text itself, if named."""
    v = C.parsed("value")
    return docs.select(F.col("key").alias("id"), *(C.find(v, p, k).alias(c) for c, p, k in fields), *([F.col("value").alias(text)] if text else []))


@query("thin_cards", "SELECT l_orderkey AS id, l_partkey AS part, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def thin_cards(spark, d):
    return cards(order_docs(spark, d).withColumnRenamed("key", "id"), "value", "lines", "part bigint, qty double", keep=["id"])


@query("filter_cards", "SELECT l_orderkey AS id, l_partkey AS part, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def filter_cards(spark, d):
    rows = cards(order_docs(spark, d).withColumnRenamed("key", "id"), "value", "lines", "part bigint, qty double, flag string", keep=["id"])
    return rows.where("flag = 'R'").drop("flag")


@query("numbered_cards", f"WITH {LINES} SELECT l_orderkey AS id, rn - 1 AS i, l_partkey AS part FROM lines")
def numbered_cards(spark, d):
    rows = cards(order_docs(spark, d).withColumnRenamed("key", "id"), "value", "lines", "part bigint", keep=["id"], index="i")
    return rows.select("id", F.col("i").cast("long").alias("i"), "part")


@query("each_cards", "SELECT l_orderkey AS id, l_partkey AS part, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def each_cards(spark, d):
    rows = each_card(order_docs(spark, d).withColumnRenamed("key", "id"), "value", "lines", ["part", "flag"], keep=["id"])
    return rows.select("id", C.find(F.col("card"), "part", "bigint").alias("part"), C.find(F.col("card"), "flag", "string").alias("flag"))


@query("each_spread", f"WITH {LINES} SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) - 1 AS i, l_partkey AS part FROM lines WHERE l_returnflag = 'R'")
def each_spread(spark, d):
    """Heavy work on elements, with documents dealt out first; i counts the cards that are kept."""
    rows = each(order_docs(spark, d).withColumnRenamed("key", "id"), "value", "lines[?flag == 'R'].part", keep=["id"], strict=True, spread=16)
    return rows.select("id", F.col("i").cast("long").alias("i"), C.decoded(F.col("card"), "bigint").alias("part"))


@query("card_lines", "SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'")
def card_lines_query(spark, d):
    path = scratch(spark, "cards")
    jsonl.write_jsonl(card_lines(order_docs(spark, d), "value", "lines[?flag == 'A'].{part: part}"), path)
    return jsonl.read_jsonl_as(spark, path, "part bigint").agg(F.count("*").alias("n"), F.sum("part").alias("parts"))


@query("keep_list", PARTS.replace("p_name", "CAST(NULL AS VARCHAR)") + ", '{\"id\":' || p_partkey || ',\"meta\":{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}}' AS text FROM part")
def keep_list(spark, d):
    docs = part_docs(spark, d).withColumn("value", C.keep(F.col("value"), ["meta.size", "meta.brand", "id", "nothing.at.all"]))
    return _back(docs, ("title", "title", "string"), ("brand", "meta.brand", "string"), ("size", "meta.size", "bigint"), text="text")


@query("keep_arrays", f"WITH {LINES} SELECT l_orderkey AS id, n, max(CASE WHEN rn = 1 THEN l_partkey END) AS first, max(CASE WHEN rn = n THEN l_partkey END) AS last, least(n, 2) AS two FROM lines GROUP BY l_orderkey, n")
def keep_arrays(spark, d):
    """Wildcards, one index (which yields the element), several indices and slices."""
    docs, text = order_docs(spark, d), F.col("value")
    made = docs.select(
        F.col("key").alias("id"), C.parsed(C.keep(text, ["lines[].part"])).alias("every"), C.parsed(C.keep(text, ["lines[0].part"])).alias("one"),
        C.parsed(C.keep(text, ["lines[-1].part"])).alias("last"), C.parsed(C.keep(text, ["lines[0:2].part"])).alias("cut"),
    )
    return made.select("id", C.array_len(F.col("every"), "lines").cast("long").alias("n"), C.find(F.col("one"), "lines.part", "bigint").alias("first"), C.find(F.col("last"), "lines.part", "bigint").alias("last"), C.array_len(F.col("cut"), "lines").cast("long").alias("two"))


@query("keep_styles", "SELECT p_partkey AS id, '{' || chr(10) || '  \"id\": ' || p_partkey || ',' || chr(10) || '  \"meta\": {' || chr(10) || '    \"size\": ' || p_size || chr(10) || '  }' || chr(10) || '}' AS pretty, '{  \"id\" :' || p_partkey || ' }' AS spaced, CAST(NULL AS VARCHAR) AS strict FROM part")
def keep_styles(spark, d):
    docs, text = part_docs(spark, d), F.col("value")
    spaced = F.concat(F.lit('{  "id" :'), F.col("key").cast("string"), F.lit(' ,"z" : 0 }'))
    return docs.select(F.col("key").alias("id"), C.keep(text, ["meta.size", "id"], style=2).alias("pretty"), C.keep(spaced, ["id"], style="preserve").alias("spaced"), C.keep(text, ["nothing"], strict=True).alias("strict"))


@query("pretty_documents", "SELECT event_id AS id, '{' || chr(10) || '  \"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || chr(10) || '}' AS text FROM events")
def pretty_documents(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), C.pretty(F.col("props")).alias("text"))


@query("sizes", "SELECT event_id AS id, CAST(strlen(props) AS BIGINT) AS whole, CAST(strlen(props) + length(CAST(event_id AS VARCHAR)) AS BIGINT) AS parts, CAST(strlen(props) + length(CAST(event_id AS VARCHAR)) + 16 AS BIGINT) AS estimate, CAST(2 AS BIGINT) AS none FROM events")
def sizes(spark, d):
    docs, text = event_docs(spark, d), F.col("value")
    return docs.select(F.col("key").alias("id"), C.projected_len(C.raw(text, "props")).alias("whole"), C.values_len(text, ["props", "id"]).alias("parts"), C.estimated_len(text, ["props", "id"]).alias("estimate"), C.estimated_len(text, []).alias("none"))


@query("transform_pipeline", "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, 'v1' AS version, '{\"id\":' || p_partkey || ',\"name\":\"' || p_name || '\",\"meta\":{\"brand\":\"' || p_brand || '\"},\"v\":\"v1\"}' AS text FROM part")
def transform_pipeline(spark, d):
    pipeline = TransformPipeline().keep(["id", "title", "price", "meta.brand"]).rename("title", "name").drop("price").drop("not there").inject("v", "v0").inject("v", "v1")
    docs = part_docs(spark, d).withColumn("value", pipeline.apply(F.col("value")))
    return _back(docs, ("name", "name", "string"), ("brand", "meta.brand", "string"), ("version", "v", "string"), text="text")


@query("transform_style", "SELECT p_partkey AS id, '{' || chr(10) || '  \"id\": ' || p_partkey || ',' || chr(10) || '  \"meta\": {' || chr(10) || '    \"size\": ' || p_size || chr(10) || '  }' || chr(10) || '}' AS text FROM part")
def transform_style(spark, d):
    """The style of a pipeline holds for its keep steps."""
    pipeline = TransformPipeline().keep(["id", "title", "meta.size"]).style(2).keep(["id", "meta.size"])
    return part_docs(spark, d).select(F.col("key").alias("id"), pipeline.apply(F.col("value")).alias("text"))


@query("transform_jmes", f"WITH {LINES} SELECT l_orderkey AS id, count(*) AS n, max(CASE WHEN rn = 1 THEN l_partkey END) AS first FROM lines GROUP BY l_orderkey")
def transform_jmes(spark, d):
    pipeline = TransformPipeline().jmes("{all: lines[*].part, drop: id}").drop("drop").plan(str.strip).rename("all", "parts")
    docs = order_docs(spark, d).withColumn("value", C.parsed(pipeline.apply(F.col("value"))))
    return docs.select(F.col("key").alias("id"), C.array_len(F.col("value"), "parts").cast("long").alias("n"), C.find(F.col("value"), "parts[0]", "bigint").alias("first"))


EVENT_VIEW = View(ViewField("id", "bigint"), ViewField("kind", "string", path="type"), ViewField("k", "bigint", path="props.k"), ViewField("amount", "double", path="value", optional=True))


@query("view_read", "SELECT event_id AS id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 7 > 1 THEN value END AS amount FROM events")
def view_read(spark, d):
    return event_docs(spark, d).select(EVENT_VIEW.read(C.parsed("value")).alias("r")).select("r.*")


@query("view_defaults", "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE value END AS amount, event_id % 7 = 1 AS rejected FROM events WHERE event_id % 7 <> 1 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 7 = 1")
def view_defaults(spark, d):
    """A default stands in for a missing value; null is no value, and a required field without one rejects the document."""
    view = View(ViewField("amount", "double", path="value", default=-1.0))
    docs = event_docs(spark, d).select(F.col("key").alias("id"), view.read(C.parsed("value")).alias("r"))
    return docs.select("id", "r.amount", F.col("r").isNull().alias("rejected"))


@query("view_expressions", f"WITH {LINES} SELECT l_orderkey AS id, o_orderstatus AS status, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS back FROM lines GROUP BY l_orderkey, o_orderstatus")
def view_expressions(spark, d):
    view = View(ViewField("id", "bigint"), ViewField("status", "string"), ViewField("back", "bigint", jmes="length(lines[?flag == 'R'])"))
    return order_docs(spark, d).select(view.read(C.parsed("value"), on_error="raise").alias("r")).select("r.*")


@query("view_each", f"WITH {LINES} SELECT l_orderkey AS id, l_partkey AS part, CASE WHEN l_returnflag = 'R' THEN 'back' ELSE '' END AS note FROM lines")
def view_each(spark, d):
    view = View(ViewField("part", "bigint"), ViewField("note", "string", default=""))
    docs = order_docs(spark, d).select(F.col("key").alias("id"), F.explode(view.read_each(C.parsed("value"), "lines")).alias("r"))
    return docs.select("id", "r.part", "r.note")


@query("view_project", "SELECT event_id AS id, event_type AS kind, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS cut FROM events")
def view_project(spark, d):
    view = View(ViewField("id", "bigint"), ViewField("type", "string"))
    named = View(ViewField("id", "bigint"), ViewField("kind", "string", jmes="type"))
    docs = event_docs(spark, d)
    return docs.select(F.col("key").alias("id"), C.find(C.parsed(view.project(F.col("value"))), "type", "string").alias("kind"), named.project(F.col("value")).alias("cut"))


@query("view_write", "SELECT p_partkey AS id, p_name AS title, 'own' AS brand, CAST(9 AS BIGINT) AS rank, CAST(p_size AS BIGINT) AS size FROM part")
def view_write(spark, d):
    view = View(ViewField("brand", "string", path="meta.brand"), ViewField("rank", "bigint", path="extra.rank"))
    docs = part_docs(spark, d).withColumn("value", view.write(F.col("value"), {"brand": "own", "rank": 9}))
    return _back(docs, ("title", "title", "string"), ("brand", "meta.brand", "string"), ("rank", "extra.rank", "bigint"), ("size", "meta.size", "bigint"))


@query("view_documents", "SELECT event_id AS id, CASE WHEN event_id % 7 > 1 THEN 'value' ELSE 'missing' END AS amount, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def view_documents(spark, d):
    """A view's rows as documents of their own, nested by their paths."""
    made = event_docs(spark, d).select("key", C.parsed(EVENT_VIEW.to_json(EVENT_VIEW.read(C.parsed("value")))).alias("v"))
    return made.select(F.col("key").alias("id"), C.presence(F.col("v"), "value").alias("amount"), C.find(F.col("v"), "props.k", "bigint").alias("k"))


@query("build_objects", "SELECT p_partkey AS id, '{\"a\":\"' || p_name || '\",\"n\":null}' AS kept, '{\"a\":\"' || p_name || '\"}' AS omitted, '[' || p_size || ',null]' AS list FROM part")
def build_objects(spark, d):
    parts = table(spark, d, "part")
    nil = F.lit(None).cast("string")
    return parts.select(F.col("p_partkey").alias("id"), C.object_of(a=F.col("p_name"), n=nil).alias("kept"), C.object_of(True, a=F.col("p_name"), n=nil).alias("omitted"), C.array_of(F.col("p_size"), F.lit(None).cast("int")).alias("list"))


@query("build_aggregated", f"WITH {LINES} SELECT l_orderkey AS id, '[' || string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rn) || ']' AS list FROM lines GROUP BY l_orderkey")
def build_aggregated(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))).alias("r"))
    made = lines.select(F.col("l_orderkey").alias("id"), F.to_json(F.transform("r", lambda r: r["l_partkey"])).alias("list"))
    return made.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")


@query("build_driver", "SELECT '{\"a\":1,\"b\":[true,null,{\"c\":\"x\"}]}' AS object, '[1,2]' AS list, '{\"k\":[1.5]}' AS written, '{\"x\":1}' AS pairs")
def build_driver(spark, d):
    """Builders on the driver give literals."""
    made = ObjectBuilder().field("a", 1).field_opt("skip", None).field_if(False, "no", 1).array_field("b", lambda b: b.item(True).null_item().item_opt(None).object(lambda o: o.field("c", "x"))).finish()
    written = JsonWriter().begin_object().key("k").begin_array().raw_value("1.5").finish()
    row = {"object": made, "list": ArrayBuilder().extend([1, 2]).finish(), "written": written, "pairs": object_from([("x", 1)])}
    assert array_from([1, 2]) == row["list"]
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items()))


@query("strings", "SELECT p_partkey AS id, '\"' || p_name || '\\\"' || chr(92) || 'n\"' AS escaped, p_name || '\"' || chr(10) AS text, CAST(NULL AS VARCHAR) AS none FROM part")
def strings(spark, d):
    text = F.concat("p_name", F.lit('"\n'))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.escaped(text).alias("escaped"), C.unescaped(C.escaped(text)).alias("text"), C.unescaped(F.lit("12")).alias("none"))


@query("plans", "SELECT p_partkey AS id, '{\"id\":' || p_partkey || '}' AS kept, p_name AS title, CAST(NULL AS VARCHAR) AS strict, true AS whole FROM part")
def plans(spark, d):
    """Plans built once: keep lists, expressions, the whole document, strict or not."""
    docs, text = part_docs(spark, d), F.col("value")
    strict = Plan.of_paths(["id", "nothing"]).with_missing(True)
    return docs.select(
        F.col("key").alias("id"), Plan.of_paths(["id"]).apply(text).alias("kept"), C.unescaped(Plan.of_jmes("title").apply(text)).alias("title"),
        strict.apply(text).alias("strict"), (Plan.identity().apply(text) == text).alias("whole"),
    )


@query("card_bytes", "SELECT CAST(sum(strlen('{\"part\":' || l_partkey || '}') + 1) AS BIGINT) AS n_bytes, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def card_bytes(spark, d):
    return jsonl.written_bytes(card_lines(order_docs(spark, d), "value", "lines[*].{part: part}"))


@query("sql_functions", "SELECT event_id AS id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || '}' AS kept, '1' AS one, 'x' AS two, CAST(NULL AS VARCHAR) AS gone FROM events")
def sql_functions(spark, d):
    register(spark)
    event_docs(spark, d).createOrReplaceTempView("docweave_events")
    return spark.sql("""
        SELECT key AS id, from_json(concat('[', json_jmes(value, 'type'), ']'), 'array<string>')[0] AS kind,
               CAST(json_find(value, 'props.k') AS BIGINT) AS k, json_keep(value, 'id,nothing') AS kept,
               json_find(json_set(value, 'type', '1'), 'type') AS one,
               json_find(json_upsert(json_merge_patch(value, '{"a": {}}'), 'a.b', '"x"'), 'a.b') AS quoted,
               json_find(json_delete(value, 'type'), 'type') AS gone
        FROM docweave_events
    """).select("id", "kind", "k", "kept", "one", C.unescaped(F.col("quoted")).alias("two"), "gone")
