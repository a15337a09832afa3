"""The same operators over a stream of JSON lines."""

from pyspark.sql import functions as F

from docweave.operators import columns as C
from docweave.operators.frames import cards
from docweave.queries.base import order_docs, query, scratch, table
from docweave.sources import jsonl
from docweave.streaming.jsonl import stream_jsonl, write_stream


@query("stream_cards", "SELECT l_partkey AS part, l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def stream_cards(spark, d):
    source, out, log = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-log"))
    jsonl.write_jsonl(order_docs(spark, d), source)
    found = cards(stream_jsonl(spark, source), "value", "lines", "part bigint, qty double, flag string").where("flag = 'R'")
    write_stream(found.select(F.to_json(F.struct("part", "qty")).alias("value")), out, log).awaitTermination()
    return jsonl.read_jsonl_as(spark, out, "part bigint, qty double")


@query("stream_edits", "SELECT event_id AS id, 'seen' AS mark FROM events")
def stream_edits(spark, d):
    from docweave.functions.edit import Edits

    source, out, log = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-log"))
    docs = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"))).alias("value"))
    jsonl.write_jsonl(docs, source)
    write_stream(stream_jsonl(spark, source).select(C.edited(F.col("value"), Edits().upsert("mark", "seen")).alias("value")), out, log).awaitTermination()
    return jsonl.read_jsonl_as(spark, out, "id bigint, mark string")
