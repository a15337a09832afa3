"""The expression language, node by node and function by function, in all three tiers."""

from pyspark.sql import functions as F

from docweave.operators import columns as C
from docweave.operators.frames import cards, each, typed
from docweave.queries.base import LINES, customer_docs, dealt, event_docs, order_docs, pack_docs, part_docs, query, table

LINE = "ln: int, part: bigint, supp: bigint, qty: double, price: double, flag: string, note: string"
ORDER = f"id bigint, status string, total double, lines array<struct<{LINE}>>"


def _orders(spark, d):
    return order_docs(spark, d).select(F.col("key").alias("id"), C.parsed("value").alias("v"))


def _of(name, sql, docs, *columns):
    """Registers a query of one expression a column over parsed documents: (column, expression, type)."""

    @query(name, sql)
    def run(spark, d):
        parsed = docs(spark, d).select(F.col("key").alias("id"), C.parsed("value").alias("v"))
        return parsed.select("id", *(C.jmes_as(F.col("v"), e, kind).alias(c) for c, e, kind in columns))

    return run


G = f"WITH {LINES} SELECT l_orderkey AS id"

_of("jmes_fields", "SELECT p_partkey AS id, p_name AS title, p_brand AS brand, CAST(p_size AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS none FROM part", part_docs, ("title", "title", "string"), ("brand", 'meta."brand"', "string"), ("size", "@.meta.size", "bigint"), ("none", "meta.size.deeper", "string"))
_of("jmes_index", G + ", max(CASE WHEN rn = 1 THEN l_partkey END) AS first, max(CASE WHEN rn = n THEN l_partkey END) AS last, max(CASE WHEN rn = n - 1 THEN l_partkey END) AS before_last, CAST(NULL AS BIGINT) AS past FROM lines GROUP BY l_orderkey", order_docs, ("first", "lines[0].part", "bigint"), ("last", "lines[-1].part", "bigint"), ("before_last", "lines[-2].part", "bigint"), ("past", "lines[999].part", "bigint"))
_of("jmes_list_nulls", G + ", count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS notes, count(*) AS parts FROM lines GROUP BY l_orderkey", order_docs, ("notes", "length(lines[*].note)", "bigint"), ("parts", "length(lines[*].part)", "bigint"))
_of("jmes_flatten", "SELECT l_orderkey AS id, count(*) AS parts, count(*) AS nested, CAST(sum(l_partkey) AS DOUBLE) AS total FROM lineitem GROUP BY l_orderkey", pack_docs, ("parts", "length(packs[].parts[])", "bigint"), ("nested", "length(nested[])", "bigint"), ("total", "sum(nested | [])", "double"))
@query("jmes_object_projection", "SELECT o_custkey AS id, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def jmes_object_projection(spark, d):
    docs, v = customer_docs(spark, d).select(F.col("key").alias("id"), C.parsed("value").alias("v")), F.col("v")
    return docs.select("id", C.jmes_as(v, "length(orders.*)", "bigint").alias("n"), F.round(C.jmes_as(v, "sum(orders.*.price)", "double"), 2).alias("total"), C.jmes_as(v, "length(orders.* | [?status == 'F'])", "bigint").alias("filled"))


@query("jmes_filter", f"WITH {LINES} SELECT l_orderkey AS id, l_partkey AS part, l_quantity AS qty FROM lines WHERE l_returnflag = 'R' AND l_quantity > 10")
def jmes_filter(spark, d):
    rows = each(_orders(spark, d), F.col("v"), "lines[?flag == 'R' && qty > `10`].{part: part, qty: qty}", keep=["id"])
    return rows.select("id", C.find(F.col("card"), "part", "bigint").alias("part"), C.find(F.col("card"), "qty", "double").alias("qty"))


_of("jmes_slice", G + ", CAST(sum(CASE WHEN rn BETWEEN 2 AND 3 THEN l_partkey ELSE 0 END) AS DOUBLE) AS middle, CAST(sum(CASE WHEN n - rn < 2 THEN l_partkey ELSE 0 END) AS DOUBLE) AS tail, CAST(sum(CASE WHEN rn % 2 = 1 THEN l_partkey ELSE 0 END) AS DOUBLE) AS odd, max(CASE WHEN rn = n THEN l_partkey END) AS turned FROM lines GROUP BY l_orderkey", order_docs, ("middle", "sum(lines[1:3].part)", "double"), ("tail", "sum(lines[-2:].part)", "double"), ("odd", "sum(lines[::2].part)", "double"), ("turned", "lines[::-1].part | [0]", "bigint"))
_of("jmes_hash", G + ", o_orderstatus AS status, max(CASE WHEN rn = 1 THEN l_partkey END) AS part, CAST(NULL AS VARCHAR) AS none FROM lines GROUP BY l_orderkey, o_orderstatus", order_docs, ("status", "{s: status, p: lines[0].part, n: none} | s", "string"), ("part", "{s: status, p: lines[0].part, n: none}.p", "bigint"), ("none", "{s: status, n: none}.n", "string"))
_of("jmes_list", "SELECT p_partkey AS id, p_name AS title, CAST(p_size AS BIGINT) AS size, CAST(3 AS BIGINT) AS n FROM part", part_docs, ("title", "[title, meta.size, none] | [0]", "string"), ("size", "[title, meta.size, none][1]", "bigint"), ("n", "length([title, meta.size, none])", "bigint"))
_of("jmes_pipe", G + ", max(CASE WHEN l_returnflag = 'R' AND r = 1 THEN l_partkey END) AS first FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY rn) AS r FROM lines) GROUP BY l_orderkey", order_docs, ("first", "lines[?flag == 'R'] | [0].part", "bigint"))
_of("jmes_compare", "SELECT p_partkey AS id, p_size >= 25 AS big, p_name < 'm' AS early, p_brand <> 'Brand#1' AS other, false AS mixed, p_name = p_name AS same, CAST(NULL AS BOOLEAN) AS undefined FROM part", part_docs, ("big", "meta.size >= `25`", "boolean"), ("early", "title < 'm'", "boolean"), ("other", "meta.brand != 'Brand#1'", "boolean"), ("mixed", "title == id", "boolean"), ("same", "[meta, tags] == [meta, tags]", "boolean"), ("undefined", "title > id", "boolean"))
_of("jmes_logic", "SELECT event_id AS id, CASE WHEN event_id % 7 > 1 THEN event_type ELSE 'none' END AS chosen, event_id % 7 <= 1 AS lacks, event_type = 'view' OR event_type = 'click' AS shown, event_id % 7 > 1 AND event_type = 'error' AS wrong FROM events", event_docs, ("chosen", "value && type || 'none'", "string"), ("lacks", "!value", "boolean"), ("shown", "type == 'view' || type == 'click'", "boolean"), ("wrong", "!(!value) && type == 'error'", "boolean"))
_of("jmes_literals", "SELECT p_partkey AS id, 7 AS seven, 'it''s' AS raw, true AS yes, CAST(2 AS BIGINT) AS n FROM part", part_docs, ("seven", "`7`", "int"), ("raw", "'it\\'s'", "string"), ("yes", "true", "boolean"), ("n", "length(`[1, {\"a\": null}]`)", "bigint"))
_of("jmes_parens", G + ", CAST(NULL AS BIGINT) AS still, count(*) AS n FROM lines GROUP BY l_orderkey", order_docs, ("still", "(lines[*].part)[0].x | [0]", "bigint"), ("n", "length((lines)[*])", "bigint"))

_of("fn_length", "SELECT p_partkey AS id, CAST(length(p_name) AS BIGINT) AS text, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS list, CAST(2 AS BIGINT) AS object FROM part", part_docs, ("text", "length(title)", "bigint"), ("list", "length(tags)", "bigint"), ("object", "length(meta)", "bigint"))
_of("fn_keys_values", "SELECT p_partkey AS id, 'brand,size' AS keys, CAST(p_size AS DOUBLE) AS total, CAST(2 AS BIGINT) AS n FROM part", part_docs, ("keys", "join(',', sort(keys(meta)))", "string"), ("total", "sum(values({a: meta.size}))", "double"), ("n", "length(values(meta))", "bigint"))
_of("fn_type", "SELECT p_partkey AS id, 'object,array,string,number,boolean,null' AS types FROM part", part_docs, ("types", "join(',', [type(@), type(tags), type(title), type(id), type(`true`), type(none)])", "string"))
_of("fn_to_string", "SELECT p_partkey AS id, p_name AS text, CAST(p_size AS VARCHAR) AS number, '[true,null]' AS list FROM part", part_docs, ("text", "to_string(title)", "string"), ("number", "to_string(meta.size)", "string"), ("list", "to_string(`[true, null]`)", "string"))
_of("fn_to_number", "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS number, CAST(p_size AS DOUBLE) AS text, CAST(NULL AS DOUBLE) AS none FROM part", part_docs, ("number", "to_number(meta.size)", "double"), ("text", "to_number(to_string(meta.size))", "double"), ("none", "to_number(title)", "double"))
_of("fn_text_tests", "SELECT p_partkey AS id, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'ring') AS ends, contains(p_name, 'l w') AS has, list_contains(string_split(p_name, ' '), 'red') AS holds FROM part", part_docs, ("starts", "starts_with(title, 'red')", "boolean"), ("ends", "ends_with(title, 'ring')", "boolean"), ("has", "contains(title, 'l w')", "boolean"), ("holds", "contains(tags, 'red')", "boolean"))
_of("fn_not_null", "SELECT event_id AS id, CASE WHEN event_id % 7 > 1 THEN value ELSE CAST(event_id AS DOUBLE) END AS amount FROM events", event_docs, ("amount", "not_null(value, nothing, id)", "double"))
_of("fn_reverse", "SELECT p_partkey AS id, reverse(p_name) AS text, string_split(p_name, ' ')[-1] AS last FROM part", part_docs, ("text", "reverse(title)", "string"), ("last", "reverse(tags)[0]", "string"))
_of("fn_sort", G + ", min(l_partkey) AS least, 'ring' AS word FROM lines GROUP BY l_orderkey", order_docs, ("least", "sort(lines[*].part)[0]", "bigint"), ("word", "sort(`[\"small\", \"ring\"]`)[0]", "string"))
_of("fn_join", "SELECT p_partkey AS id, replace(p_name, ' ', '-') AS text FROM part", part_docs, ("text", "join('-', tags)", "string"))
_of("fn_extremes", G + ", max(l_partkey) AS most, min(l_partkey) AS least, max(l_returnflag) AS flag, CAST(NULL AS DOUBLE) AS none FROM lines GROUP BY l_orderkey", order_docs, ("most", "max(lines[*].part)", "bigint"), ("least", "min(lines[*].part)", "bigint"), ("flag", "max(lines[*].flag)", "string"), ("none", "max(`[]`)", "double"))
_of("fn_sum_avg", G + ", CAST(sum(l_quantity) AS DOUBLE) AS total, CAST(sum(l_quantity) AS DOUBLE) / count(*) AS mean, CAST(0 AS DOUBLE) AS zero, CAST(NULL AS DOUBLE) AS none FROM lines GROUP BY l_orderkey", order_docs, ("total", "sum(lines[*].qty)", "double"), ("mean", "avg(lines[*].qty)", "double"), ("zero", "sum(`[]`)", "double"), ("none", "avg(`[]`)", "double"))
_of("fn_rounding", "SELECT event_id AS id, CASE WHEN event_id % 7 > 1 THEN CAST(ceil(value) AS BIGINT) END AS up, CASE WHEN event_id % 7 > 1 THEN CAST(floor(value) AS BIGINT) END AS down, CAST(3 AS BIGINT) AS size FROM events", event_docs, ("up", "ceil(value)", "bigint"), ("down", "floor(value)", "bigint"), ("size", "abs(`-3`)", "bigint"))
_of("fn_to_array", "SELECT p_partkey AS id, CAST(1 AS BIGINT) AS one, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS tags FROM part", part_docs, ("one", "length(to_array(title))", "bigint"), ("tags", "length(to_array(tags))", "bigint"))
_of("fn_merge", "SELECT p_partkey AS id, 'x' AS brand, CAST(p_size AS BIGINT) AS size, CAST(3 AS BIGINT) AS n FROM part", part_docs, ("brand", "merge(meta, `{\"brand\": \"x\", \"new\": 1}`).brand", "string"), ("size", "merge(meta, `{\"brand\": \"x\", \"new\": 1}`).size", "bigint"), ("n", "length(merge(meta, `{\"brand\": \"x\", \"new\": 1}`))", "bigint"))
_of("fn_map", G + ", count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS notes FROM lines GROUP BY l_orderkey", order_docs, ("n", "length(map(&note, lines))", "bigint"), ("notes", "length(map(&note, lines)[?@])", "bigint"))
_of("fn_sort_by", G + ", arg_min(l_partkey, (l_quantity, rn)) AS least, arg_max(l_partkey, (l_quantity, rn)) AS most, min(l_returnflag) AS flag FROM lines GROUP BY l_orderkey", order_docs, ("least", "sort_by(lines, &qty)[0].part", "bigint"), ("most", "sort_by(lines, &qty)[-1].part", "bigint"), ("flag", "sort_by(lines, &flag)[0].flag", "string"))
_of("fn_group_by", G + ", count(DISTINCT l_returnflag) AS groups, count(CASE WHEN l_returnflag = f THEN 1 END) AS first FROM (SELECT *, first_value(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY rn) AS f FROM lines) GROUP BY l_orderkey", order_docs, ("groups", "length(group_by(lines, &flag))", "bigint"), ("first", "length(group_by(lines, &flag)[0])", "bigint"))
_of("fn_max_by", G + ", arg_min(l_partkey, (-l_price, rn)) AS dearest, arg_min(l_partkey, (l_price, rn)) AS cheapest FROM (SELECT *, l_extendedprice AS l_price FROM lines) GROUP BY l_orderkey", order_docs, ("dearest", "max_by(lines, &price).part", "bigint"), ("cheapest", "min_by(lines, &price).part", "bigint"))


@query("fn_type_errors", "SELECT event_id AS id, CAST(NULL AS DOUBLE) AS wrong, true AS failed FROM events")
def fn_type_errors(spark, d):
    """A function that gets the wrong kind gives NULL, or an error in a column beside."""
    docs = event_docs(spark, d)
    error = C.jmes_exact(F.col("value"), "abs(type)", on_error="column")
    return docs.select(F.col("key").alias("id"), C.jmes_as(C.parsed("value"), "abs(type)", "double").alias("wrong"), error["error"].isNotNull().alias("failed"))


@query("typed_tier", f"WITH {LINES} SELECT l_orderkey AS id, l_partkey AS p, l_quantity AS q FROM lines WHERE l_returnflag = 'R'")
def typed_tier(spark, d):
    """The same language over a declared schema: one pruned from_json."""
    docs = typed(order_docs(spark, d), "value", "lines[?flag == 'R'].{p: part, q: qty}", ORDER, "r")
    return docs.select(F.col("key").alias("id"), F.explode("r").alias("r")).select("id", "r.p", "r.q")


@query("typed_functions", G + ", CAST(sum(l_partkey) AS BIGINT) AS total, arg_max(l_partkey, (l_quantity, -rn)) AS most, max(l_returnflag) AS flag, string_agg(l_returnflag, ',' ORDER BY rn) AS flags FROM lines GROUP BY l_orderkey")
def typed_functions(spark, d):
    docs = order_docs(spark, d)
    for name, e in (("total", "sum(lines[*].part)"), ("most", "max_by(lines, &qty).part"), ("flag", "max(lines[*].flag)"), ("flags", "join(',', lines[*].flag)")):
        docs = typed(docs, "value", e, ORDER, name)
    return docs.select(F.col("key").alias("id"), "total", "most", "flag", "flags")


@query("exact_tier", G + ", '[' || string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rn) || ']' AS parts FROM lines GROUP BY l_orderkey")
def exact_tier(spark, d):
    return order_docs(spark, d).select(F.col("key").alias("id"), C.jmes_exact(F.col("value"), "lines[*].part").alias("parts"))


@query("exact_values", "SELECT p_partkey AS id, '1' AS spaced, 'true' AS same, 'true' AS held, true AS variant, 'true' AS decoded, '[[' || p_size || ',' || p_size || '.0]]' AS groups, CAST(NULL AS VARCHAR) AS deep, CAST(NULL AS VARCHAR) AS lone FROM part")
def exact_values(spark, d):
    """Values count, not how they are written: white space in empty containers, lexemes of numbers, escapes. Hostile rows give NULL."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit('{"e":[ ],"n":[1.0],"a":["\\u0062"],"k":['), size, F.lit(","), size, F.lit(".0]}"))
    deep = F.concat(F.repeat(F.lit("["), F.lit(3000)), F.repeat(F.lit("]"), F.lit(3000)))
    return dealt(table(spark, d, "part")).select(
        F.col("p_partkey").alias("id"), C.jmes_exact(text, "e || `1`").alias("spaced"), C.jmes_exact(text, "n == `[1]`").alias("same"), C.jmes_exact(text, "contains(n, `1`)").alias("held"),
        C.jmes_as(C.parsed(text), "contains(n, `1`)", "boolean").alias("variant"), C.jmes_exact(text, "contains(a, 'b')").alias("decoded"), C.jmes_exact(text, "group_by(k, &@)").alias("groups"),
        C.jmes_exact(deep, "@ == `[[1]]` && contains(@, @)").alias("deep"), C.pretty(F.when(F.col("p_partkey") > 0, '{"a":"\\ud800"}')).alias("lone"),
    )


@query("exact_keys", "SELECT p_partkey AS id, '[\"id\",\"title\",\"price\",\"meta\",\"tags\"]' AS keys, '{\"s\":' || p_size || ',\"n\":null}' AS cut FROM part")
def exact_keys(spark, d):
    docs, text = part_docs(spark, d), F.col("value")
    return docs.select(F.col("key").alias("id"), C.jmes_exact(text, "keys(@)").alias("keys"), C.jmes_exact(text, "{s: meta.size, n: none}").alias("cut"))


@query("exact_strict", "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'PathNotFound: no key ''value''' END AS error FROM events")
def exact_strict(spark, d):
    return event_docs(spark, d).select(F.col("key").alias("id"), C.jmes_exact(F.col("value"), "{v: value}", strict=True, on_error="column")["error"].alias("error"))


@query("cards_joined", "SELECT p_brand AS brand, o_orderstatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL")
def cards_joined(spark, d):
    """Cards are rows: joins and aggregates on them are Spark's own."""
    lines = cards(order_docs(spark, d).withColumn("status", F.from_json("value", "status string")["status"]), "value", "lines", "part bigint, qty double, flag string", keep=["status"]).where("flag = 'R'")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return lines.join(parts, F.col("part") == F.col("p_partkey")).groupBy("brand", "status").agg(F.count("*").alias("n"), F.round(F.sum("qty"), 2).alias("qty"))
