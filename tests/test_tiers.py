"""The exact and the VARIANT tier agree as values, however documents are written; hostile rows give NULL, not a failed job."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docweave.functions.edit import Edits
from docweave.functions.evaluate import canonical, deep_equal, evaluate, truthy
from docweave.operators import columns as C
from docweave.operators.transform import TransformPipeline
from docweave.plans.parser import parse

KEYS = ["a", "b", "c", "list", "e"]
STRINGS = ["", "b", "x y", "é", 'q"', "back\\slash", "[]"]


def value(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.3:
        return {k: value(rng, depth + 1) for k in rng.sample(KEYS, rng.randrange(4))}
    if depth < 3 and kind < 0.6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, 1, 2, 1.5, -3, 10, *STRINGS])


def written(rng, v):
    """A value as JSON text, with random white space, lexemes and escapes."""
    gap = lambda: rng.choice(["", "", " ", "\n", "\t  "])
    if isinstance(v, dict):
        return "{" + gap() + (gap() + "," + gap()).join(f"{written(rng, k)}{gap()}:{gap()}{written(rng, x)}" for k, x in v.items()) + gap() + "}"
    if isinstance(v, list):
        return "[" + gap() + (gap() + "," + gap()).join(written(rng, x) for x in v) + gap() + "]"
    if isinstance(v, str):
        return "".join(f"\\u{ord(c):04x}" if rng.random() < 0.3 and c not in '"\\' else json.dumps(c, ensure_ascii=False)[1:-1] for c in v).join('""')
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return rng.choice([json.dumps(v), json.dumps(float(v)), f"{float(v) * 10:.1f}e-1", f"{v}E0"])
    return json.dumps(v)


def expression(rng, depth=0):
    if depth > 2 or rng.random() < 0.3:
        return rng.choice(["@", "a", "b", "list", "e", "list[0]", "list[-1]", "a.b", "`1`", "`[1]`", "'b'", "`{}`", "`null`"])
    e = lambda: expression(rng, depth + 1)
    return rng.choice([
        lambda: f"({e()} || {e()})", lambda: f"({e()} && {e()})", lambda: f"!({e()})", lambda: f"({e()} {rng.choice(['==', '!='])} {e()})",
        lambda: f"list[?{e()}]", lambda: f"list[*].{rng.choice(KEYS)}", lambda: f"[{e()}, {e()}]", lambda: f"{{p: {e()}, q: {e()}}}", lambda: f"({e()}) | {e()}",
        lambda: f"to_array({e()})", lambda: f"type({e()})", lambda: f"not_null({e()}, {e()})", lambda: f"contains(to_array({e()}), {e()})",
        lambda: f"group_by(to_array({e()}), &type(@))", lambda: f"length(to_array({e()}))", lambda: f"reverse(to_array({e()}))", lambda: "list[]", lambda: "list[1:]",
    ])()


def plain(v):
    """Without members that are null: projections and hashes keep or drop them alike in both tiers only as values."""
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def test_random_expressions_agree(spark):
    rng = random.Random(11)
    docs = [{k: value(rng, 1) for k in KEYS if rng.random() < 0.9} for _ in range(30)]
    rows = [(i, json.dumps(d), written(rng, d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id int, plain string, odd string")
    expressions = sorted({expression(rng) for _ in range(60)})
    got = {}
    for at in range(0, len(expressions), 12):
        part = expressions[at : at + 12]
        both = df.select("id", *(F.to_json(C.jmes(C.parsed("odd"), e)).alias(f"v{k}") for k, e in enumerate(part)))
        for r in both.collect():
            for k, e in enumerate(part):
                got[e, r["id"]] = json.loads(r[f"v{k}"] or "null")
    for e in expressions:
        tree = parse(e)
        for i, a, b in rows:
            found, odd = (json.loads(evaluate(tree, t)) for t in (a, b))
            assert plain(found) == plain(odd), (e, a, b)
            assert plain(found) == plain(got[e, i]), (e, b)


def test_one_value_in_many_forms():
    rng = random.Random(12)
    for _ in range(300):
        v, w = value(rng), value(rng)
        a, b, c = written(rng, v), written(rng, v), written(rng, w)
        same = plain(v) == plain(w) and type(plain(v)) is type(plain(w))
        assert deep_equal(a, b) and canonical(a) == canonical(b)
        assert deep_equal(a, c) == (canonical(a) == canonical(c)) == (json.dumps(plain(v)) == json.dumps(plain(w))), (a, c, same)
        assert truthy(a) == truthy(json.dumps(v)) == (isinstance(v, (int, float)) and v is not False or bool(v))


@pytest.mark.parametrize("text, e, out", [('{"e":[ ]}', "e || `1`", "1"), ('{"e":{\n}}', "!e", "true"), ('{"n":[1.0]}', "contains(n, `1`)", "true"), ('{"n":[1.0]}', "n == `[1]`", "true"), ('{"a":["\\u0062"]}', "contains(a, 'b')", "true"), ('{"a":[{"k":1},{"k":1.0},{"k":2}]}', "length(group_by(a, &k))", "2")])
def test_values_not_lexemes(text, e, out):
    assert evaluate(parse(e), text) == out


def test_hostile_rows_give_null(spark):
    deep = "[" * 50_000 + "]" * 50_000
    nested = '{"a":' * 30_000 + "1" + "}" * 30_000
    rows = ['{"a":"\\ud800"}', deep, nested, "{", "", None, '{"a":', '["', "nul", '{"a" 1}', "\x00", '{"a":1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string")
    t = F.col("t")
    columns = [
        C.pretty(t), C.keep(t, ["a.b", "a"]), C.jmes_exact(t, "a == `[[1]]`"), C.jmes_exact(t, "group_by(@, &@)"), C.jmes_exact(t, "contains(@, @)"), C.jmes_exact(t, "reverse(a)"),
        C.edited(t, Edits().merge_patch("", {"a": {"a": {"a": 1}}}), on_error="null"), C.merge_patched(t, t), C.merge_patched(F.lit(nested), t), C.violation(t, lambda x: None), C.depth(t), C.raw(t, "a"),
        TransformPipeline().keep(["a"]).style(2).jmes("@").rename("a", "b").apply(t), C.edited(t, Edits().set("a", 2)),
    ]
    out = df.select("id", *(c.alias(f"c{k}") for k, c in enumerate(columns))).orderBy("id").collect()
    assert len(out) == len(rows)
    assert out[-1]["c0"] == '{\n  "a": 1\n}' and out[-1]["c13"] == '{"a":2}' and out[-1]["c10"] == 1
    assert out[0]["c0"] is None and out[1]["c0"] is None and out[1]["c10"] == 49_999 and out[5]["c0"] is None


def typed_expression(rng):
    """An expression over orders that the typed tier provides."""
    test = lambda: rng.choice(["flag == 'R'", "part > `3`", "qty <= `2.5`", "!(flag == 'A')", "note", "part == `2` || flag != 'N'", "part >= `1` && qty < `9`"])
    rows = rng.choice(["lines[*]", "lines[1:]", f"lines[?{test()}]", f"lines[?{test()} && {test()}]"])
    return rng.choice([
        lambda: f"{rows}.part", lambda: f"{rows}.{{p: part, q: qty, f: flag}}", lambda: f"length({rows})", lambda: f"sum({rows}.part)", lambda: f"max({rows}.qty)",
        lambda: f"{rows} | [0].part", lambda: f"{rows}.[part, part]", lambda: f"join('-', {rows}.flag)", lambda: "status", lambda: "lines[-1].flag", lambda: f"sort({rows}.part)",
    ])()


def test_three_tiers_agree(spark):
    from docweave.operators.frames import typed
    from docweave.plans.typed import Unsupported

    rng = random.Random(21)
    schema = "id bigint, status string, lines array<struct<part: bigint, qty: double, flag: string, note: string>>"
    docs = []
    for i in range(25):
        lines = [{"part": rng.randrange(6), "qty": rng.choice([0.5, 2.5, 4.0]), "flag": rng.choice("RAN")} | ({"note": "x"} if rng.random() < 0.4 else {}) for _ in range(1 + rng.randrange(5))]
        docs.append({"id": i, "status": rng.choice(["F", "O"]), "lines": lines})
    df = spark.createDataFrame([(d["id"], json.dumps(d)) for d in docs], "id int, t string").cache()
    met = 0
    for e in sorted({typed_expression(rng) for _ in range(40)}):
        try:
            out = typed(df, "t", e, schema, "r")
        except Unsupported:
            continue
        met += 1
        made = F.to_json(F.struct(F.col("r").alias("r")))
        for r in out.select("id", made.alias("typed"), F.to_json(C.jmes(C.parsed("t"), e)).alias("variant")).collect():
            got = json.loads(r["typed"]).get("r")
            exact = plain(json.loads(evaluate(parse(e), json.dumps(docs[r["id"]]))))
            assert plain(json.loads(r["variant"] or "null")) == exact, e
            assert plain(got) == exact or got is None and exact is None, (e, got, exact)
    assert met >= 15
