"""Paths, keep lists, edits, checks, builders, views and sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docweave.errors import DecodeError, IndexOutOfBounds, InvalidPath, InvalidSyntax, JsonError, LimitExceeded, MissingField, PathNotFound, TypeMismatch, UnknownField
from docweave.functions import checks, edit, keeping, rawjson
from docweave.functions.build import ArrayBuilder, JsonWriter, ObjectBuilder
from docweave.functions.edit import Edits
from docweave.functions.evaluate import deep_equal
from docweave.operators import columns as C
from docweave.operators.frames import JsonFrame, cards, each
from docweave.operators.plan import Plan
from docweave.operators.transform import TransformPipeline
from docweave.operators.views import View, ViewField
from docweave.plans.keep import keep_arrays, keep_tree
from docweave.plans.paths import Cut, Every, array_prefixes, parse_keep_path, parse_path, parse_pointer, path_text
from docweave.sources import jsonl


def test_paths():
    assert parse_path("a.b[0][2].c") == ("a", "b", 0, 2, "c") and parse_path("") == () and parse_path("a..b") == ("a", "b") and parse_path("[1]") == (1,)
    assert parse_path("a[x].b", strict=False) == ("a", "b") and parse_path("a[-1].b", strict=False) == ("a", "b")
    for bad in ("a[x]", "a[-1]", "a[", "a]", "a[0]b", "a[]"):
        with pytest.raises(InvalidPath):
            parse_path(bad)
    assert parse_pointer("/a~1b/0/~0c") == ("a/b", 0, "~c") and parse_pointer("") == ()
    for bad in ("a", "/~2"):
        with pytest.raises(InvalidPath):
            parse_pointer(bad)
    assert path_text(("a", 0, "b")) == "a[0].b" and array_prefixes("a[0].b[1]") == ["a", "a[0].b"]
    assert parse_keep_path("a[].b[-1][1:2]") == ("a", Every(), "b", -1, Cut(1, 2, None)) and parse_keep_path("[*]") == (Every(),)
    for bad in ("", "a.", ".a", "a[x]", "a[0", "a[::0]", "a]b"):
        with pytest.raises(InvalidPath):
            parse_keep_path(bad)


def test_find():
    doc = ' {"a": {"b": [10, "x", null]}, "a": 2, "e\\u0041": 1} '
    assert rawjson.find(doc, parse_path("a.b[1]")) == '"x"' and rawjson.find(doc, ("eA",)) == "1" and rawjson.find(doc, ()) == doc.strip()
    for path, error in (("a.c", PathNotFound), ("a.b[3]", IndexOutOfBounds), ("a.b.c", TypeMismatch), ("[0]", InvalidSyntax), ("a.b[1].c", TypeMismatch)):
        with pytest.raises(error):
            rawjson.find(doc, parse_path(path))
    for bad in ("", "{", '{"a" 1}', '{"a":1 "b":2}', '"open'):
        with pytest.raises(JsonError):
            rawjson.find(bad, ("zz",))


KEPT = [
    ('{"b":1,"a":{"x":1,"y":2},"c":3}', ["a.y", "b"], '{"b":1,"a":{"y":2}}'), ('{"a":1}', [], "{}"), ('{"a":1}', ["b"], "{}"), ('{"a":1}', ["a.b"], '{"a":null}'), ('{"p":[{"id":1,"t":2},{"t":3},null]}', ["p[].id"], '{"p":[{"id":1},{}]}'),
    ('{"p":[{"id":1,"t":2},{"id":3}]}', ["p[0].id"], '{"p":{"id":1}}'), ('{"p":[1,2,3]}', ["p[0]", "p[-1]"], '{"p":[3,1]}'), ('{"p":[1,2,3]}', ["p[5]"], '{"p":null}'), ('{"p":[1,2,3]}', ["p[5]", "p[1]"], '{"p":[2]}'),
    ('{"p":[1,2,3,4]}', ["p[1:3]"], '{"p":[2,3]}'), ('{"p":[{"a":1,"b":2}]}', ["p[0].a", "p[*].b"], '{"p":[{"a":1,"b":2}]}'), ('{"a":{"b":1,"c":2}}', ["a", "a.b"], '{"a":{"b":1,"c":2}}'), ('{"a":{"b":1,"c":2}}', ["a.b", "a"], '{"a":{"b":1,"c":2}}'),
    ('{"a": [1 , 2 ] ,"b":0}', ["a"], '{"a":[1 , 2 ]}'), ('[{"a":1,"b":2}]', ["[].a"], '[{"a":1}]'), ('{"p":{"x":1}}', ["p[]"], '{"p":null}'),
]


@pytest.mark.parametrize("doc, paths, want", KEPT)
def test_keep_lists(doc, paths, want):
    assert keeping.kept(keep_tree(paths), doc) == want


def test_keep_styles_and_policies():
    assert keeping.kept(keep_tree(["a", "b[].c"]), '{"a":1,"b":[{"c":2,"d":3}]}', style=2) == '{\n  "a": 1,\n  "b": [\n    {\n      "c": 2\n    }\n  ]\n}'
    assert keeping.kept(keep_tree(["k"]), '{  "k" :7 ,"z" : 0 }', style="preserve") == '{  "k" :7 }'
    assert keeping.kept(keep_tree(["p[].a"]), '{"p": [ {"a": 1, "b": 2} , {"a" :3} ]}', style="preserve") == '{"p": [ {"a": 1} , {"a" :3} ]}'
    for doc, paths, error in (('{"a":1}', ["b"], PathNotFound), ('{"a":1}', ["a.b"], TypeMismatch), ('{"a":[]}', ["a[0]"], PathNotFound)):
        with pytest.raises(error):
            keeping.kept(keep_tree(paths), doc, strict=True)
    for paths in (["a.b", "a[0]"], ["a[0]", "a.b"], ["a.b", "a[]"]):
        with pytest.raises(InvalidPath):
            keep_tree(paths)
    assert keep_arrays(keep_tree(["a.b[0].c", "d[].e[1:2]"])) == ["a.b", "d", "d.e"]


EDITS = [
    (Edits().set("a.b", 2), '{"a": {"b" : 1}}', '{"a": {"b" : 2}}'), (Edits().upsert("x.y", "z"), "{ }", '{ "x":{"y":"z"}}'), (Edits().upsert("a[1]", 5), '{"a":[1]}', '{"a":[1,5]}'), (Edits().delete("a"), '{ "a" : 1 , "b" : 2 }', '{"b" : 2 }'),
    (Edits().delete("b"), '{"a":1, "b":2 }', '{"a":1}'), (Edits().delete("a"), '{ "a":1 }', "{}"), (Edits().delete("a[1]"), '{"a":[1, 2, 3]}', '{"a":[1, 3]}'), (Edits().append("a", [1]), '{"a":[]}', '{"a":[[1]]}'), (Edits().prepend("a", None), '{"a":[1]}', '{"a":[null,1]}'),
    (Edits().insert("a", 1, "x"), '{"a":[1,2]}', '{"a":[1,"x",2]}'), (Edits().insert("a", 2, "x"), '{"a":[1,2]}', '{"a":[1,2,"x"]}'), (Edits().rename("", "a", "é"), '{"a": 1,"b":2}', '{"é": 1,"b":2}'), (Edits().rename("", "a", "a"), '{"a":1}', '{"a":1}'),
    (Edits().merge_shallow("", {"a": {"x": 1}, "c": 3}), '{"a":{"y":2},"b":1.50}', '{"a":{"x":1},"b":1.50,"c":3}'), (Edits().merge_patch("", {"m": {"on": False, "old": None}, "new": [0]}), '{"k":7,"m":{"old":"o","on":true}}', '{"k":7,"m":{"on":false},"new":[0]}'),
]


@pytest.mark.parametrize("edits, doc, want", EDITS)
def test_edits(edits, doc, want):
    assert edits.apply(doc) == want


def test_edit_errors():
    doc = '{"a":{"b":[1]},"c":1}'
    for edits, error in (
        (Edits().set("x", 1), PathNotFound), (Edits().delete("a.x"), PathNotFound), (Edits().delete("a.b[1]"), IndexOutOfBounds), (Edits().append("c", 1), TypeMismatch), (Edits().insert("a.b", 5, 1), PathNotFound), (Edits().rename("", "a", "c"), InvalidPath),
        (Edits().rename("", "x", "y"), PathNotFound), (Edits().upsert("a.b[3]", 1), IndexOutOfBounds), (Edits().upsert("n[0]", 1), InvalidPath), (Edits().upsert("c.d", 1), TypeMismatch), (Edits().merge_shallow("c", {"x": 1}), TypeMismatch), (Edits().delete(""), InvalidPath),
    ):
        with pytest.raises(error):
            edits.apply(doc)
        assert (Edits().set("c", 2) + edits).attempt(doc)[0] == doc
    with pytest.raises(InvalidSyntax):
        Edits().set("a", "{", raw=True)
    with pytest.raises(DecodeError):
        Edits().set("a", float("nan"))


def model_patch(target, patch):
    if not isinstance(patch, dict):
        return patch
    target = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            target.pop(k, None)
        else:
            target[k] = model_patch(target.get(k), v)
    return target


def random_value(rng, depth=3):
    kind = rng.randrange(8 if depth else 4)
    if kind >= 6:
        return {rng.choice(["a", "b", "c\"", "é"]): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind >= 4:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.randrange(100), rng.choice(["", "x{", "]\\", "\n"])][kind]


@pytest.mark.parametrize("seed", range(300))
def test_edits_match_a_model(seed):
    rng = random.Random(seed)
    doc = {"a": random_value(rng), "b": random_value(rng), "l": [random_value(rng, 1) for _ in range(rng.randrange(4))]}
    text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    patch = random_value(rng)
    assert json.loads(edit.merge_patch(text, (), json.dumps(patch))) == model_patch(doc, patch)
    value = random_value(rng)
    at = rng.randrange(len(doc["l"]) + 1)
    want = json.loads(json.dumps(doc))
    want["l"].insert(at, value)
    out = edit.insert(text, ("l",), at, edit.encoded(value))
    assert json.loads(out) == want
    del want["l"][at]
    assert json.loads(edit.delete(out, ("l", at))) == want
    want["n"] = {"m": value}
    out = edit.upsert(out, ("n", "m"), edit.encoded(value))
    out = edit.delete(edit.rename(out, (), "a", "z"), ("l", at))
    want["z"] = want.pop("a")
    assert json.loads(out) == want


def test_checks():
    doc = '{"a":1,"b":null,"c":{"x":[]}}'
    assert [checks.presence(doc, p) for p in ("a", "b", "z", "c.x[0]")] == ["value", "null", "missing", "missing"]
    checks.require_paths(doc, ["a", "b"]), checks.validate_closed(doc, ["a", "b", "c"]), checks.require_type(doc, "c.x", "array"), checks.validate_open(doc, ["a"])
    for error, check in ((MissingField, lambda: checks.require_paths(doc, ["z"])), (DecodeError, lambda: checks.require_paths(doc, ["b"], True)), (UnknownField, lambda: checks.deny_unknown_keys(doc, "c", ["y"])), (TypeMismatch, lambda: checks.require_type(doc, "a", "string")), (TypeMismatch, lambda: checks.deny_unknown_keys(doc, "a", []))):
        with pytest.raises(error):
            check()
    assert [rawjson.depth_of(x) for x in ('{"a":1}', "[[[1]]]", "{}", '{"a":{}}', '"[["', '{"a":[{"b":"]"}]}', "[[]]")] == [1, 3, 0, 1, 0, 3, 1]
    checks.Limits.unlimited().check("[" * 300 + "1" + "]" * 300)
    for limits, text in ((checks.Limits(), "[" * 129 + "1" + "]" * 129), (checks.Limits(max_bytes=3), '"é12"')):
        with pytest.raises(LimitExceeded):
            limits.check(text)


def test_deeper_is_what_depth_of_says():
    rng = random.Random(5)

    def said(function):
        try:
            return function()
        except InvalidSyntax as e:
            return str(e)

    texts = ["", "1", "[", "]", "][", "[[]]", "[[1]]", '["]"]', '{"[":{}}', '{"a":[{"b":"]\\""}]}', '["[', "[\\\"[]", "é[\ud800[]]"]
    texts += ["[" * n + x + "]" * n for n in (2, 3, 4) for x in ("", "1", "[],[2]", '"["')]
    texts += ["".join(rng.choice('[]{}",\\1 é') for _ in range(rng.randrange(12))) for _ in range(5000)]
    for text in texts:
        for most in (0, 1, 2, 3):
            assert said(lambda: rawjson.deeper(text, most)) == said(lambda: rawjson.depth_of(text) > most), (text, most)


def test_deep_texts_are_not_walked_by_value(monkeypatch):
    monkeypatch.setattr(rawjson, "depth_of", lambda text: pytest.fail("walked"))
    with pytest.raises(LimitExceeded):
        deep_equal("[" * 3000 + "]" * 3000, "[[1]]")
    assert deep_equal("[" + "1," * 3000 + "1]", "[" + "1," * 3000 + "1.0]")


def test_builders():
    made = ObjectBuilder().field("a", 1).null_field("n").field_opt("x", None).field_if(True, "y", [1]).object_field("o", lambda o: o.raw_field("r", " 1.50 ")).array_field("l", lambda b: b.item("q\"").array(lambda c: c.null_item()))
    assert made.finish() == '{"a":1,"n":null,"y":[1],"o":{"r":1.50},"l":["q\\"",[null]]}' and len(made) == 5
    assert ArrayBuilder().extend(range(2)).item_opt(None).raw_item("[ ]").finish() == "[0,1,[ ]]"
    w = JsonWriter(indent=2).begin_object().field("a", 1).key("b").begin_array().value(2).null()
    assert w.depth == 2 and w.finish() == '{\n  "a": 1,\n  "b": [\n    2,\n    null\n  ]\n}'
    for wrong in (lambda: JsonWriter().key("a"), lambda: JsonWriter().begin_object().value(1), lambda: JsonWriter().value(1).value(2), lambda: JsonWriter().begin_array().end_object(), lambda: JsonWriter().finish(), lambda: JsonWriter().begin_object().key("a").end_object()):
        with pytest.raises(InvalidSyntax):
            wrong()


def test_transform_order_and_styles():
    doc = '{"a":{"x":1,"y":2},"b":1,"c":2}'
    assert TransformPipeline().keep(["a.x", "b"]).rename("b", "a").run(doc) == '{"a":{"x":1},"a":1}'  # a taken name is not looked for
    assert TransformPipeline().inject("b", 9).drop("zz").rename("zz", "q").run(doc) == '{"a":{"x":1,"y":2},"c":2,"b":9}'
    assert TransformPipeline().keep(["b"]).style(1).run(doc) == '{\n "b": 1\n}'
    assert TransformPipeline().jmes("a").drop("x").plan(Plan.of_paths(["y"]).run).run(doc) == '{"y":2}'
    with pytest.raises(TypeMismatch):
        TransformPipeline().jmes("b").drop("x").run(doc)


def test_odd_rows(spark):
    rows = [(1, '{"l":[{"p":1},null,{"p":"x"}]}'), (2, None), (3, ""), (4, "broken{"), (5, "[1,2]"), (6, '{"l":{"p":1}}'), (7, '{"l":[]}')]
    df = spark.createDataFrame(rows, "id int, value string")
    assert sorted(map(tuple, cards(df, "value", "l", "p bigint").collect()), key=str)[:2] == [(1, 1), (1, None)]
    got = each(df, "value", "l[*].p", keep=["id"]).select("id", "i", F.to_json("card")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "1"), (1, 1, '"x"')]
    out = df.select("id", C.find(C.parsed("value"), "l[0].p", "bigint").alias("p"), C.presence(C.parsed("value"), "l").alias("there"), C.keep(F.col("value"), ["l[0].p"]).alias("k"), C.edited(F.col("value"), Edits().upsert("x", 1)).alias("e"), C.depth(F.col("value")).alias("d")).orderBy("id").collect()
    assert [r["p"] for r in out] == [1] + [None] * 6 and [r["there"] for r in out] == ["value", None, None, None, "missing", "value", "value"]
    assert [r["k"] for r in out] == ['{"l":{"p":1}}', None, None, None, "null", '{"l":null}', '{"l":null}']
    assert [r["e"] for r in out][1:5] == [None, "", "broken{", "[1,2]"] and out[0]["e"].endswith(',"x":1}')
    with pytest.raises(Exception, match="TypeMismatch"):
        each(df, "value", "l[*].p", strict=True).collect()
    assert each(df.limit(0), "value", "l[*]").count() == 0


def test_views(spark):
    view = View(ViewField("id", "bigint"), ViewField("rank", "int", path="meta.rank", default=0), ViewField("note", "string", optional=True), ViewField("n", "bigint", jmes="length(l)", optional=True))
    docs = ['{"id":1,"meta":{"rank":5},"note":"x","l":[1,2]}', '{"id":2}', '{"id":3,"meta":{"rank":null}}', '{"id":1.5}', '{"id":"4"}', '{"id":5,"note":null}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, value string")
    got = [r["r"] for r in df.select("i", view.read(C.parsed("value")).alias("r")).orderBy("i").collect()]
    assert [tuple(r) if r else None for r in got] == [(1, 5, "x", 2), (2, 0, None, None), None, None, None, (5, 0, None, None)]
    assert view.expression() == "{id: id, rank: meta.rank, note: note, n: length(l)}" and View(ViewField("a", "int", path="p[0].q[1]")).array_paths == ["p", "p[0].q"]
    with pytest.raises(Exception, match="MissingField"):
        df.select(view.read(C.parsed("value"), on_error="raise")).collect()


def test_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_bytes(b'{"a":1}\r\n\n \t\n{"a":2}\r{"b":1}\n{"a":3}')
    got = [r["value"] for r in jsonl.read_jsonl(spark, str(tmp_path / "in.jsonl")).collect()]
    assert got == ['{"a":1}', " \t", '{"a":2}\r{"b":1}', '{"a":3}']
    df = spark.createDataFrame([('{"a":1}',), (None,), ('{"a":2}',)], "value string")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(r["a"] for r in jsonl.read_jsonl_as(spark, str(tmp_path / "out"), "a int").collect()) == [1, 2]
    assert tuple(jsonl.written_bytes(df).first()) == (16, 2)
    with pytest.raises(Exception, match="stop"):
        jsonl.for_each_document(df.where("value IS NOT NULL"), lambda text: (_ for _ in ()).throw(ValueError("stop")))


def test_plans_prune_and_parse_once(spark):
    """One parse a source column; only the fields asked for are read."""
    df = spark.createDataFrame([('{"l":[{"p":1,"q":2,"r":3}]}',)], "value string")
    plan = cards(df, "value", "l", "p bigint, q double, r string").select("p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1
    frame = JsonFrame(df.withColumn("value", C.parsed("value"))).get("a", "l[0].p", "bigint").get("b", "l[0].q", "double")
    plan = frame.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json") <= 2
