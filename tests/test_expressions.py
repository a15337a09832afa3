"""Cases of the language; each runs through the exact evaluator and the VARIANT compiler."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docweave.errors import ExpressionError, PathNotFound
from docweave.functions.evaluate import evaluate
from docweave.operators import columns as C
from docweave.plans.parser import parse
from docweave.plans.planner import array_paths, card_expression, choose_tier, peeled, prefers_rows
from docweave.plans.variant import VariantCompiler, compile_variant

DOC = {
    "a": {"b": {"c": [1, 2, {"d": "x"}]}, "k v": 1.5, "quo'te": 7},
    "people": [{"n": "Ann", "age": 30, "tags": ["x", "y"]}, {"n": "bob", "age": 25, "tags": []}, {"n": "Cy", "age": 30, "nick": "see", "tags": ["z"]}, {"n": None, "age": 41}],
    "deep": [[1, [2]], [3], 4, None, [None]],
    "ops": {"one": {"v": 1}, "two": {"v": 2}, "three": {"w": 3}},
    "num": [3, 1.5, -2, 10], "str": ["b", "é", "a", "B"], "mixed": [1, "a"], "none": None, "empty": [], "zero": 0, "yes": True, "text": "héllo 😀",
}
CASES = {
    "a.b.c[0]": 1, "a.b.c[-1].d": "x", 'a."k v"': 1.5, '"a"."quo\'te"': 7, "a.b.c[9]": None, "a.x.y": None, "zero.x": None, "@.zero": 0, "none": None,
    "people[*].n": ["Ann", "bob", "Cy"], "people[*].nick": ["see"], "people[?age == `30`].n": ["Ann", "Cy"], "people[?nick].age": [30], "people[?!nick].n": ["Ann", "bob"],
    "people[?age > `25` && n != 'Cy'].age": [30, 41], "people[?age < `26` || nick == 'see'] | [1].n": "Cy", "people[0:2].n": ["Ann", "bob"], "people[::-1].age": [41, 30, 25, 30], "people[-2:].age": [30, 41],
    "num[::2]": [3, -2], "num[3:0:-2]": [10, 1.5], "num[5:]": [], "num[:-3]": [3], "a[*]": None, "a[?x]": None, "a[0:1]": None,
    "deep[]": [1, [2], 3, 4, None, None], "deep[][]": [1, 2, 3, 4, None, None], "people[].tags[]": ["x", "y", "z"], "people[*].tags | []": ["x", "y", "z"], "people[*].tags[0]": ["x", "z"], "people[*].tags[*]": [["x", "y"], [], ["z"]],
    "ops.*.v": [1, 2], "sort(keys(ops))": ["one", "three", "two"], "ops.* | length(@)": 3, "zero.*": None, "people[*].{n: n, a: age} | [0]": {"n": "Ann", "a": 30}, "people[1].{nick: nick, n: n}": {"nick": None, "n": "bob"},
    "people[1].[n, nick, age]": ["bob", None, 25], "none.{a: b}": None, "none.[a]": None, "{x: zero, y: a.b.c[1]}": {"x": 0, "y": 2}, "[zero, yes]": [0, True], "(people[*].n)[0]": [], "people[*].n | [0]": "Ann",
    "zero && yes": True, "empty || zero": 0, "none || text": "héllo 😀", "!zero": False, "!empty": True, "!none && yes": True, "empty && x": [], "zero == `0.0`": True, "text == 'héllo 😀'": True, "num[0] >= `3`": True,
    "'a' < 'b'": True, "zero < yes": None, "none == `null`": True, "none < zero": None, "text != zero": True, "[zero] == [`0`]": True, "{a: zero, b: yes} == {b: yes, a: zero}": True, "yes == `true`": True, "yes > `false`": None,
    "`{\"a\": [1, null]}`": {"a": [1, None]}, "'it\\'s'": "it's", "`\"q\"`": "q", "true": True, "5": 5, "`-1.5`": -1.5,
    "length(text)": 7, "length(people)": 4, "length(ops)": 3, "LENGTH(text)": 7, "type(a)": "object", "type(none)": "null", "type(num)": "array", "type(yes)": "boolean", "type(zero)": "number", "type(text)": "string", "type(missing)": "null",
    "to_string(zero)": "0", "to_string(text)": "héllo 😀", "to_string(`[1, \"a\"]`)": '[1,"a"]', "to_number('12.5')": 12.5, "to_number('x')": None, "to_number(yes)": None, "to_number('1e3')": 1000, "to_number('nan')": None,
    "starts_with(text, 'hé')": True, "ends_with(text, '😀')": True, "contains(text, 'llo')": True, "contains(num, `1.5`)": True, "contains(str, 'z')": False, "contains(text, '')": True, "not_null(none, missing, zero, yes)": 0, "not_null(none)": None,
    "reverse(text)": "😀 olléh", "reverse(num)": [10, -2, 1.5, 3], "sort(num)": [-2, 1.5, 3, 10], "sort(str)": ["B", "a", "b", "é"], "sort(empty)": [], "join('-', str)": "b-é-a-B", "join('', empty)": "", "max(num)": 10, "min(str)": "B",
    "max(empty)": None, "sum(num)": 12.5, "sum(empty)": 0, "avg(num)": 3.125, "avg(empty)": None, "abs(num[2])": 2, "ceil(`1.2`)": 2, "floor(`-1.2`)": -2, "to_array(zero)": [0], "to_array(num)": [3, 1.5, -2, 10], "to_array(none)": [None],
    "merge(ops.one, ops.three, `{\"v\": 9}`)": {"v": 9, "w": 3}, "map(&nick, people)": [None, None, "see", None], "map(&age, people)[1:]": [25, 30, 41], "sort_by(people, &age)[*].age": [25, 30, 30, 41], "sort_by(people, &age)[1].n": "Ann",
    "sort_by(none, &x)": None, "group_by(people, &age)[*][*].n": [["Ann", "Cy"], ["bob"], []], "max_by(people, &age).age": 41, "min_by(people, &age).n": "bob", "max_by(people[:3], &age).n": "Ann", "max_by(empty, &x)": None, "values(ops.one)": [1],
    "people[?contains(tags || `[]`, 'z')].n": ["Cy"], "people[?length(tags || `[]`) > `0`].n | length(@)": 2, "people[:3].tags.length(@)": [2, 0, 1], "{n: length(num), m: max(num)}": {"n": 4, "m": 10}, "[]": None, "people[].n | sort(@)": ["Ann", "Cy", "bob"],
}
ERRORS = [
    "", " ", "a.", ".a", "a..b", "a[", "a]", "a[]]", "a.[0]", "a.[b, 1]", "a[b", "a[?b", "a[1:2:0]", "[a", "{a}", "{a: }", "a.{}", "{a: b", "a b", "a ||", "a | ", "&& a", "a == b == c", "nope(a)", "length()", "length(a, b)", "sort_by(a, b)",
    "map(a, b)", "length(&a)", "'open", "`open", "``", "\"open", "a.1", "a.'b'", "a[-]", "foo-bar", "\"f\"(a)", "a[1.5]", "#", "a[*", "(a", "a)", "a[0,1]",
]
WRONG_KINDS = ["length(zero)", "keys(text)", "values(num)", "abs(text)", "sort(mixed)", "max(mixed)", "sum(str)", "join('-', num)", "join(zero, str)", "starts_with(zero, text)", "sort_by(people, &nick)", "reverse(zero)", "map(&a, zero)", "group_by(zero, &a)", "contains(zero, text)", "max_by(people, &tags)", "ceil(none)"]


def same(a, b):
    return json.dumps(a, sort_keys=True, default=float) == json.dumps(b, sort_keys=True) or floats(a) == floats(b)


def floats(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return float(x)
    return [floats(y) for y in x] if isinstance(x, list) else {k: floats(v) for k, v in x.items()}


@pytest.mark.parametrize("text", CASES)
def test_exact(text):
    for separators in ((",", ":"), (", ", ": ")):
        got = json.loads(evaluate(parse(text), json.dumps(DOC, ensure_ascii=False, separators=separators)))
        assert same(got, CASES[text]), got


def test_variant(spark):
    df = spark.createDataFrame([(json.dumps(DOC),)], "value string").select(C.parsed("value").alias("v"))
    texts = list(CASES)
    for at in range(0, len(texts), 25):
        part = texts[at : at + 25]
        row = df.select(*(VariantCompiler().text(compile_variant(parse(t), F.col("v"))).alias(f"c{i}") for i, t in enumerate(part))).first()
        for t, got in zip(part, row):
            assert same(json.loads(got), CASES[t]), (t, got)


@pytest.mark.parametrize("text", ERRORS)
def test_syntax_errors(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_wrong_kinds_are_errors_or_null(spark):
    doc = json.dumps(DOC)
    for t in WRONG_KINDS:
        with pytest.raises(ExpressionError):
            evaluate(parse(t), doc)
    df = spark.createDataFrame([(doc,)], "value string").select(C.parsed("value").alias("v"))
    row = df.select(*(C.jmes(F.col("v"), t).alias(f"c{i}") for i, t in enumerate(WRONG_KINDS))).select(*(F.to_json(f"c{i}").alias(f"c{i}") for i in range(len(WRONG_KINDS)))).first()
    assert [t for t, x in zip(WRONG_KINDS, row) if x not in (None, "null")] == []
    with pytest.raises(Exception, match="can't take"):
        df.select(F.to_json(C.jmes(F.col("v"), "abs(text)", on_error="raise"))).collect()


def test_exact_keeps_order_digits_and_spacing():
    doc = '{ "z" : 1.50 , "a" : [ 1e2 , {"y":1 , "x":2} ], "z": 3 }'
    assert evaluate(parse("z"), doc) == "1.50"
    assert evaluate(parse("a[1]"), doc) == '{"y":1 , "x":2}'
    assert evaluate(parse("keys(a[1])"), doc) == '["y","x"]'
    assert evaluate(parse("{q: a[0], p: z}"), doc) == '{"q":1e2,"p":1.50}'
    assert evaluate(parse("a"), '{"a":1,"broken": [}') == "1"  # what is not asked for is not read
    with pytest.raises(PathNotFound):
        evaluate(parse("{q: nothing}"), doc, strict=True)


def random_value(rng, depth=3):
    kind = rng.randrange(7 if depth else 5)
    if kind == 5:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice("abc"): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [None, rng.choice([True, False]), rng.randrange(-3, 4), rng.choice(["", "a", "é\"", "b c"]), rng.choice([0.5, -1.25])][kind]


def test_tiers_agree_on_random_documents(spark):
    rng = random.Random(7)
    docs = [json.dumps(random_value(rng)) for _ in range(120)]
    texts = ["a", "a.b", "a[0]", "[*]", "[*].a", "a[*].b", "a[]", "[].a", "*", "a.*", "a[?b]", "[?a == b].c", "[?a > `0`]", "a || b", "a && b", "!a", "{x: a, y: b[0]}", "[a, b.c]", "[::-1]", "a[1:]", "type(@)", "to_array(a)", "not_null(a, b, c)", "a == b", "a != `null`", "to_string(a)", "merge(a, b)"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, value string").select("i", C.parsed("value").alias("v"))
    rows = df.select("i", *(VariantCompiler().text(compile_variant(parse(t), F.col("v"))).alias(f"c{k}") for k, t in enumerate(texts))).collect()
    for r in rows:
        for k, t in enumerate(texts):
            if t == "merge(a, b)" and not all(isinstance(json.loads(docs[r["i"]]).get(x) if isinstance(json.loads(docs[r["i"]]), dict) else None, dict) for x in "ab"):
                continue
            want = json.loads(evaluate(parse(t), docs[r["i"]]))
            got = json.loads(r[f"c{k}"])
            if t in ("*", "a.*"):  # VARIANT sorts keys
                want, got = (sorted(json.dumps(y, sort_keys=True) for y in floats(x)) if x is not None else None for x in (want, got))
            assert same(got, want) or t == "to_string(a)" and same(json.loads(got) if got[:1] in "[{" and got else got, json.loads(want) if want[:1] in "[{" and want else want), (t, docs[r["i"]], got, want)


def test_planner():
    assert prefers_rows(parse("items[?n].{id: id}")) and prefers_rows(parse("items[*].{n: length(t)}")) and not prefers_rows(parse("items[*].{id: id, t: t}"))
    assert array_paths(parse("products[*].{id: id}")) == ["products"] and array_paths(parse("a.b[0].c")) == ["a.b"] and array_paths(parse("x.y")) == []
    assert card_expression("a.b", ["id", "t"]) == "a.b[*].{id: id, t: t}" and card_expression("", ["id"]) == "[*].{id: id}"
    peeled(parse("a.b[?x].c")), peeled(parse("[*]"))
    for t in ("a", "a[]", "a[0]", "a[*] | [0]", "length(a)"):
        with pytest.raises(ExpressionError):
            peeled(parse(t))
    assert choose_tier(parse("keys(a)"), ordered=True) == "exact" and choose_tier(parse("a.b")) == "variant"
