"""Point reads, presence, types, elements, entries, JSON lines, checks and limits."""

from pyspark.sql import functions as F

from docweave.functions import checks
from docweave.functions.edit import Edits
from docweave.operators import columns as C
from docweave.operators.frames import JsonFrame
from docweave.operators.index import Indexed
from docweave.plans.keep import keep_arrays, keep_tree
from docweave.plans.paths import array_prefixes, parse_path, path_text
from docweave.queries.base import LINES, customer_docs, event_docs, order_docs, part_docs, pack_docs, query, scratch, table
from docweave.sources import jsonl

EVENT = "event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 7 = 1 THEN 'null' ELSE 'value' END AS found"


@query("find_scalar", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def find_scalar(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), C.find(C.parsed("props"), "k", "bigint").alias("k"))


@query("find_typed", "SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 7 > 1 THEN value END AS amount, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS none, CAST(NULL AS BIGINT) AS wrong FROM events")
def find_typed(spark, d):
    v = F.col("v")
    docs = event_docs(spark, d).select("key", C.parsed("value").alias("v"))
    return docs.select(
        F.col("key").alias("id"), C.find(v, "type", "string").alias("kind"), C.find(v, "value", "double").alias("amount"), C.find(v, "props.k", "bigint").alias("k"),
        C.find(v, "nothing[0].here", "bigint").alias("none"), C.find(v, "type", "bigint").alias("wrong"),
    )


@query("find_strict", "SELECT event_id AS id, event_type AS kind FROM events")
def find_strict(spark, d):
    return event_docs(spark, d).select(F.col("key").alias("id"), C.find(C.parsed("value"), "type", "string", strict=True).alias("kind"))


@query("find_pointer", f"WITH {LINES} SELECT l_orderkey AS id, l_partkey AS part FROM lines WHERE rn = 1")
def find_pointer(spark, d):
    return order_docs(spark, d).select(F.col("key").alias("id"), C.find_pointer(C.parsed("value"), "/lines/0/part", "bigint").alias("part"))


@query("raw_value", "SELECT event_id AS id, props AS raw FROM events")
def raw_value(spark, d):
    return event_docs(spark, d).select(F.col("key").alias("id"), C.raw(F.col("value"), "props").alias("raw"))


@query("presence", f"SELECT {EVENT}, event_id % 7 <> 0 AS there, event_id % 7 = 1 AS nil, CASE WHEN event_id % 7 > 1 THEN value END AS amount FROM events")
def presence(spark, d):
    docs, v = event_docs(spark, d).select("key", C.parsed("value").alias("v")), F.col("v")
    return docs.select(F.col("key").alias("id"), C.presence(v, "value").alias("found"), C.contains(v, "value").alias("there"), C.is_null(v, "value").alias("nil"), C.find(v, "value", "double").alias("amount"))


@query("type_sniff", "SELECT p_partkey AS id, 'object' AS root, 'string' AS title, 'number' AS price, 'object' AS meta, 'array' AS tags, CAST(NULL AS VARCHAR) AS none FROM part")
def type_sniff(spark, d):
    docs, v = part_docs(spark, d).select("key", C.parsed("value").alias("v")), F.col("v")
    return docs.select(F.col("key").alias("id"), C.type_at(v).alias("root"), *(C.type_at(v, p).alias(n) for n, p in (("title", "title"), ("price", "price"), ("meta", "meta"), ("tags", "tags"), ("none", "none"))))


@query("array_len", f"WITH {LINES} SELECT DISTINCT l_orderkey AS id, n AS size, CAST(NULL AS BIGINT) AS of_object FROM lines")
def array_len(spark, d):
    docs, v = order_docs(spark, d).select("key", C.parsed("value").alias("v")), F.col("v")
    return docs.select(F.col("key").alias("id"), C.array_len(v, "lines").cast("long").alias("size"), C.array_len(v).cast("long").alias("of_object"))


@query("elements", f"WITH {LINES} SELECT l_orderkey AS id, rn - 1 AS i, l_partkey AS part FROM lines")
def elements(spark, d):
    """Elements streamed as rows, and one field of each collected."""
    docs = order_docs(spark, d).select("key", C.parsed("value").alias("v"))
    rows = docs.select("key", F.posexplode(C.elements(F.col("v"), "lines")).alias("i", "x"))
    return rows.select(F.col("key").alias("id"), F.col("i").cast("long").alias("i"), C.find(F.col("x"), "part", "bigint").alias("part"))


@query("elements_get", f"WITH {LINES} SELECT l_orderkey AS id, n AS size, CAST(sum(l_partkey) AS BIGINT) AS total FROM lines GROUP BY l_orderkey, n")
def elements_get(spark, d):
    docs = order_docs(spark, d).select("key", C.elements_get(C.parsed("value"), "lines", "part", "bigint").alias("parts"))
    return docs.select(F.col("key").alias("id"), F.size("parts").cast("long").alias("size"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("object_entries", "SELECT o_custkey AS id, CAST(o_orderkey AS VARCHAR) AS key, round(o_totalprice, 4) AS price FROM orders JOIN customer ON c_custkey = o_custkey")
def object_entries(spark, d):
    docs = customer_docs(spark, d).select(F.col("key").alias("id"), F.explode(C.entries(C.parsed("value"), "prices", "double")).alias("e"))
    return docs.select("id", "e.key", F.round("e.value", 4).alias("price"))


@query("ordered_keys", "SELECT p_partkey AS id, 'id,title,price,meta,tags' AS keys FROM part")
def ordered_keys(spark, d):
    return part_docs(spark, d).select(F.col("key").alias("id"), F.array_join(C.ordered_keys(F.col("value")), ",").alias("keys"))


@query("indexed_reads", f"WITH {LINES} SELECT l_orderkey AS id, max(CASE WHEN rn = 1 THEN l_partkey END) AS first, max(CASE WHEN rn = 2 THEN l_partkey END) AS second, max(n) AS size FROM lines GROUP BY l_orderkey")
def indexed_reads(spark, d):
    """Several reads of documents that were parsed once."""
    docs = JsonFrame(order_docs(spark, d).withColumn("value", C.parsed("value")))
    docs = docs.get("first", "lines[0].part", "bigint").get("second", "lines[1].part", "bigint")
    return docs.df.select(F.col("key").alias("id"), "first", "second", C.array_len(F.col("value"), "lines").cast("long").alias("size"))


@query("index_elements", f"WITH {LINES} SELECT l_orderkey AS id, n AS size, max(CASE WHEN rn = 1 THEN CAST(l_partkey AS VARCHAR) END) AS first, max(CASE WHEN rn = n THEN CAST(l_partkey AS VARCHAR) END) AS last, CAST(NULL AS VARCHAR) AS past, '\"' || o_orderstatus || '\"' AS status, 4 AS members, CAST(NULL AS VARCHAR) AS stale, CAST(n + 1 AS BIGINT) AS rebuilt FROM lines GROUP BY l_orderkey, n, o_orderstatus")
def index_elements(spark, d):
    """Reads by position through an index of an array and of the root; after an edit it is stale until it is built anew."""
    docs = Indexed(order_docs(spark, d), "value", arrays=["lines"], objects=[""])
    part = lambda text: F.get_json_object(text, "$.part")
    reads = docs.df.select(
        F.col("key").alias("id"), docs.size("lines").cast("long").alias("size"), part(docs.element("lines", 0)).alias("first"), part(docs.element("lines", -1)).alias("last"),
        docs.element("lines", 999).alias("past"), docs.member("", "status").alias("status"), F.size(docs.keys()).alias("members"), F.col("value"), F.col("index_"),
    )
    changed = docs._of(reads).edited(C.edited(F.col("value"), Edits().append("lines", {"part": 0})))
    anew = changed.rebuilt()
    both = changed.df.withColumn("stale", changed.element("lines", 0)).drop("index_")
    return anew._of(anew._built(both)).df.select("id", "size", "first", "last", "past", "status", "members", "stale", anew.size("lines").cast("long").alias("rebuilt"))


@query("index_plan", "SELECT * FROM (VALUES ('a[0].b[1].c', 'a,a[0].b', 'a[0].b[1].c', 'a'), ('x.y', '', 'x.y', ''), ('lines[2].part', 'lines', 'lines[2].part', 'lines')) t(path, prefixes, parsed, arrays)")
def index_plan(spark, d):
    """What an index for a path must cover, told from the path alone: array prefixes, its steps, arrays of its keep list."""
    rows = [(p, ",".join(array_prefixes(p)), path_text(parse_path(p)), ",".join(keep_arrays(keep_tree([p])))) for p in ("a[0].b[1].c", "x.y", "lines[2].part")]
    return spark.createDataFrame(rows, "path string, prefixes string, parsed string, arrays string").select("path", "prefixes", "parsed", F.split("arrays", ",")[0].alias("arrays"))


@query("jsonl_callbacks", "SELECT count(*) AS n FROM events")
def jsonl_callbacks(spark, d):
    """A function called for every document, where it lies; it counts them in an accumulator."""
    docs, seen = event_docs(spark, d), spark.sparkContext.accumulator(0)
    jsonl.for_each_document(docs, lambda text: seen.add(1 if text.startswith("{") else 0))
    return spark.createDataFrame([(seen.value,)], "n long")


@query("jsonl_round_trip", f"WITH {LINES} SELECT count(DISTINCT l_orderkey) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lines")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "jsonl")
    jsonl.write_jsonl(order_docs(spark, d), path)
    docs = jsonl.read_jsonl_as(spark, path, "lines array<struct<part: bigint>>")
    return docs.agg(F.count("*").alias("n"), F.sum(F.aggregate(F.transform("lines", lambda x: x["part"]), F.lit(0).cast("long"), lambda a, x: a + x)).alias("parts"))


@query("jsonl_views", "SELECT p_partkey AS id, p_name AS title, p_brand AS brand FROM part")
def jsonl_views(spark, d):
    path = scratch(spark, "views")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("brand")).alias("meta"))
    jsonl.write_jsonl_views(rows, path)
    return jsonl.read_jsonl_as(spark, path, "id bigint, title string, meta struct<brand: string>").select("id", "title", "meta.brand")


@query("jsonl_framing", "SELECT event_id AS id, event_type || chr(9) AS text FROM events WHERE event_id % 3 <> 0")
def jsonl_framing(spark, d):
    """Carriage returns go from line ends, empty lines go, white space stays."""
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, "\r").otherwise("")).otherwise(F.concat("event_type", F.lit("\t\r"))).alias("line"))
    kept = raw.select("event_id", F.regexp_replace("line", "\r$", "").alias("text")).where("length(text) > 0")
    both = jsonl.lines(raw.select("line"), "line").groupBy("line").count()
    return kept.join(both, kept["text"] == both["line"], "left_semi").select(F.col("event_id").alias("id"), "text")


@query("written_bytes", "SELECT CAST(sum(strlen(props) + 1) AS BIGINT) AS n_bytes, count(*) AS n_lines FROM events")
def written_bytes(spark, d):
    return jsonl.written_bytes(table(spark, d, "events"), "props")


@query("required_paths", "SELECT event_id AS id, event_id % 7 = 0 AS lacks, event_id % 7 < 2 AS empty, CASE WHEN event_id % 7 = 0 THEN 'MissingField: value' END AS error FROM events")
def required_paths(spark, d):
    docs, v = event_docs(spark, d).select("key", "value", C.parsed("value").alias("v")), F.col("v")
    error = C.violation(F.col("value"), lambda t: checks.require_paths(t, ["id", "value", "props.k"]))
    return docs.select(F.col("key").alias("id"), (F.size(C.missing_paths(v, ["id", "value", "props.k"])) > 0).alias("lacks"), (F.size(C.missing_paths(v, ["id", "value"], non_null=True)) > 0).alias("empty"), error.alias("error"))


@query("closed_objects", "SELECT event_id AS id, event_id % 7 <> 0 AS open, CASE WHEN event_id % 7 <> 0 THEN 'UnknownField: value' END AS error FROM events")
def closed_objects(spark, d):
    allowed = ["id", "user", "type", "props"]
    error = C.violation(F.col("value"), lambda t: checks.validate_closed(t, allowed))
    return event_docs(spark, d).select(F.col("key").alias("id"), (F.size(C.unknown_keys(C.parsed("value"), "", allowed)) > 0).alias("open"), error.alias("error"))


@query("required_types", "SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'PathNotFound: no key ''value''' WHEN event_id % 7 = 1 THEN 'TypeMismatch: ''value'' is no number' END AS error FROM events")
def required_types(spark, d):
    return event_docs(spark, d).select(F.col("key").alias("id"), C.violation(F.col("value"), lambda t: checks.require_type(t, "value", "number")).alias("error"))


@query("depth", "SELECT p_partkey AS id, CAST(2 AS INTEGER) AS depth FROM part")
def depth(spark, d):
    return part_docs(spark, d).select(F.col("key").alias("id"), C.depth(F.col("value")).alias("depth"))


@query("limits", "SELECT DISTINCT l_orderkey AS id, true AS deep, false AS broken FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def limits(spark, d):
    docs = order_docs(spark, d)
    return docs.select(F.col("key").alias("id"), C.over_limits(F.col("value"), checks.Limits(max_depth=2)).isNotNull().alias("deep"), C.over_limits(F.col("value"), checks.Limits.strict()).isNotNull().alias("broken"))


@query("nested_arrays", "WITH g AS (SELECT l_orderkey AS id, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT id, count(*) AS packs, CAST(sum(n) AS BIGINT) AS parts FROM g GROUP BY id")
def nested_arrays(spark, d):
    docs = pack_docs(spark, d).select("key", C.elements(C.parsed("value"), "nested").alias("a"))
    sizes = F.transform("a", lambda x: F.size(F.try_variant_get(x, "$", "array<variant>")).cast("long"))
    return docs.select(F.col("key").alias("id"), F.size("a").cast("long").alias("packs"), F.aggregate(sizes, F.lit(0).cast("long"), lambda s, n: s + n).alias("parts"))
