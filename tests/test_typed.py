"""The typed tier against the exact evaluator, over documents of a declared schema."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.evaluate import evaluate
from docweave.operators.collections import ListView, MapView, Nested, Policy
from docweave.plans.parser import parse
from docweave.plans.planner import choose_tier
from docweave.plans.typed import Unsupported, compile_typed

DDL = "id bigint, name string, ok boolean, tags array<string>, rows array<struct<k: bigint, w: double, t: string, sub: struct<n: bigint>>>, nested array<array<bigint>>, by map<string, bigint>"
TEXTS = [
    "id", "name", "rows[0].k", "rows[-1].sub.n", "rows[9].k", "rows[*].k", "rows[*].sub.n", "rows[?k > `2`].t", "rows[?t == 'a' || k == `1`].{x: k, y: sub.n}", "rows[1:3].k", "rows[::-1].k", "rows[:-1].w", "rows[?!t].k", "nested[]", "nested[*][0]", "by.*",
    "by.a", "keys(by) | length(@)", "length(rows)", "length(name)", "length(tags)", "sum(rows[*].k)", "avg(rows[*].k)", "max(rows[*].w)", "min(tags)", "sort(tags)", "reverse(tags)", "join('+', tags)", "contains(tags, 'x')", "starts_with(name, 'n')", "ends_with(name, 'e')",
    "sort_by(rows, &k)[*].t", "max_by(rows, &w).k", "min_by(rows, &k).k", "map(&k, rows)", "not_null(name, 'z')", "abs(id)", "ceil(rows[0].w)", "floor(rows[0].w)", "to_array(id)", "ok && !name", "name || 'none'", "rows[?w >= `0.5` && k != `3`] | [0].k", "[id, rows[0].k]", "(rows[*].k)",
    "rows[?sub.n == `null`].k", "rows[*].t | sort(@) | [0]",
]


@pytest.fixture(scope="module")
def schema(spark):
    return T._parse_datatype_string(DDL)


def documents(n=60):
    rng = random.Random(5)
    out = []
    for i in range(n):
        rows = [{"k": rng.randrange(5), "w": rng.choice([0.25, 0.5, 1.75]), "t": rng.choice(["a", "b", "ç"]), "sub": {"n": rng.randrange(9)}} for _ in range(rng.randrange(1, 5))]
        out.append({"id": i - 30, "name": rng.choice(["n", "née", "x"]), "ok": rng.random() < 0.5, "tags": [rng.choice("xyz") for _ in range(rng.randrange(1, 4))], "rows": rows, "nested": [[rng.randrange(9) for _ in range(rng.randrange(1, 3))] for _ in range(2)], "by": {k: rng.randrange(9) for k in "ab"}})
    return out


def plain(x):
    if isinstance(x, T.Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [plain(y) for y in x]
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def jsoned(x):
    if isinstance(x, dict):
        return {k: jsoned(v) for k, v in x.items()}
    return [jsoned(y) for y in x] if isinstance(x, list) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def test_typed_equals_exact(spark, schema):
    docs = [json.dumps(d, ensure_ascii=False) for d in documents()]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, value string").withColumn("d", F.from_json("value", schema))
    for at in range(0, len(TEXTS), 16):
        part = TEXTS[at : at + 16]
        made = [compile_typed(parse(t), F.col("d"), schema) for t in part]
        out = df.select("i", *(c.alias(f"c{k}") for k, (c, _) in enumerate(made)))
        for k, (_, kind) in enumerate(made):
            assert out.schema[f"c{k}"].dataType.simpleString() == kind.simpleString(), part[k]
        for r in out.collect():
            for k, t in enumerate(part):
                assert plain(r[f"c{k}"]) == jsoned(json.loads(evaluate(parse(t), docs[r["i"]]))), (t, docs[r["i"]])


def test_what_depends_on_the_data_goes_to_variant(schema):
    for t in ("rows.k", "nothing", "[id, name]", "name == id", "sum(tags)", "to_number(name)", "group_by(rows, &k)", "type(id)", "by == by", "join('-', rows)"):
        with pytest.raises(Unsupported):
            compile_typed(parse(t), F.col("d"), schema)
        assert choose_tier(parse(t), schema) == "variant"
    assert choose_tier(parse("rows[?k > `2`].t"), schema) == "typed"


def test_collections_of_odd_documents(spark):
    rows = [(1, '{"l":[{"n":1},{"n":2}],"m":{"b":1,"a":2},"s":{"x":5}}'), (2, "{}"), (3, None), (4, "no"), (5, '{"l":[],"m":{},"s":null}'), (6, '{"l":[{"n":1},{}]}')]
    df, text = spark.createDataFrame(rows, "id int, value string"), F.col("value")
    items, values, nested = ListView(text, "l", "struct<n: bigint>"), MapView(text, "m", "bigint"), Nested(text, "s", "struct<x: int>")
    out = df.select("id", items.size().alias("n"), items.sum_field("n").alias("t"), items.get(1)["n"].alias("g"), values.size().alias("m"), F.to_json(values.entries()).alias("e"), values.get("a").alias("a"), nested.get("x").alias("x")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in out] == [(2, 3, 2, 2, '[{"key":"b","value":1},{"key":"a","value":2}]', 2, 5)] + [(None,) * 7] * 3 + [(0, 0, None, 0, "[]", None, None), (2, None, None, None, None, None, None)]
    assert df.select(items.collect(Policy.STREAM)).count() == 4 and [r[0] for r in df.select(items.collect(Policy.PROJECTED)).where("id = 1").collect()] == [['{"n":1}', '{"n":2}']]


def test_workers_import_the_package_from_anywhere(tmp_path):
    """Python functions run although the workers' path does not hold the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\nspark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nfrom docweave.operators.columns import raw\nfrom pyspark.sql import functions as F\nprint('GOT', spark.range(1).select(raw(F.lit('{{\"a\":1.50}}'), 'a')).first()[0])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "GOT 1.50" in out.stdout, out.stderr[-2000:]
