import json
import random

from pyspark.sql import functions as F

from docweave.functions.edit import Edits
from docweave.operators import columns as C
from docweave.operators.index import Indexed, array_index, key_index, spanned
from tests.test_tiers import value, written


def test_spans_are_the_values(spark):
    rng = random.Random(3)
    docs = [{"a": [value(rng, 1) for _ in range(rng.randrange(4))], "é": value(rng), "o": {"x": value(rng, 2)}} for _ in range(80)]
    rows = [(i, written(rng, d), json.dumps(d)) for i, d in enumerate(docs)] + [(90, None, "{}"), (91, "[1", "{}"), (92, '{"a":[],"o":{}}', "{}"), (93, '{"a":1,"a":2,"\\u0061":3,"o":1}', "{}")]
    df = spark.createDataFrame(rows, "id int, t string, plain string")
    t = F.col("t")
    out = df.select("id", F.transform(array_index(t, "a"), lambda s: spanned(t, s)).alias("a"), F.transform_values(key_index(t), lambda k, s: spanned(t, s)).alias("k"), key_index(t, "o").alias("o")).collect()
    for r in out:
        if r["id"] < 80:
            d = docs[r["id"]]
            assert [json.loads(x) for x in r["a"]] == d["a"] and {k: json.loads(v) for k, v in r["k"].items()} == d and set(r["o"]) == {"x"}
    odd = {r["id"]: r for r in out if r["id"] >= 90}
    assert odd[90]["a"] is None and odd[91]["a"] is None and odd[92]["a"] == [] and odd[92]["o"] == {} and odd[93]["a"] is None and odd[93]["k"] == {"a": "1", "o": "1"} and odd[93]["o"] is None


def test_staleness_counts_and_release(spark):
    df = spark.createDataFrame([(1, '{"l":[1,22,3],"m":{"k":true}}', "x"), (2, '{"l":{}}', "x"), (3, None, "x")], "id int, value string, index string")
    own = Indexed(df.drop("index"), arrays=["l"], objects=["", "m"]).kept()
    got = own.df.orderBy("id").select(own.size("l").alias("n"), own.element("l", -2).alias("e"), own.element("l", 7).alias("none"), own.member("m", "k").alias("k"), own.keys().alias("keys"), own.counts().alias("counts"), own.fresh().alias("fresh")).collect()
    assert tuple(got[0])[:5] == (3, "22", None, "true", ["l", "m"]) and got[0]["counts"] == {"l": 3, "@": 2, "m": 1} and got[1]["n"] is None and got[2]["fresh"]
    changed = own.edited(C.edited(F.col("value"), Edits().append("l", 4)))
    rows = changed.df.orderBy("id").select(changed.fresh(), changed.element("l", 0), changed.size("l")).collect()
    assert tuple(rows[0]) == (False, None, None) and rows[1][0]  # an edit that fails changes nothing
    anew = changed.rebuilt()
    assert tuple(anew.df.orderBy("id").select(anew.size("l"), anew.element("l", -1)).first()) == (4, "4")
    own.release()
    assert not own.df.storageLevel.useMemory
