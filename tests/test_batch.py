"""Many texts at once give what the functions for single texts give, ill-formed and oddly written ones included."""

import json
import random

import pytest

from docweave.functions import batch, edit, keeping, rawjson
from docweave.functions.checks import Limits
from docweave.functions.evaluate import evaluate
from docweave.operators import columns as C
from docweave.operators.transform import TransformPipeline
from docweave.plans.keep import keep_tree
from docweave.plans.parser import parse
from tests.test_tiers import KEYS, value, written


def document(rng):
    v = {k: value(rng, 1) for k in rng.sample(KEYS, rng.randrange(6))} if rng.random() < 0.8 else value(rng)
    text = written(rng, v)
    if rng.random() < 0.3 and text:
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", '"', "{", "}", ",", ":", "\\", "x", " ", "[", "]", "1 2", "\x0b"]) + text[i + rng.randrange(2) :]
    return rng.choice([" ", "\n"]) + text + " " if rng.random() < 0.1 else text


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [document(rng) for _ in range(1500)] + ["", " ", "{}", "[]", "1", '"x"', '{"a":{"a":1},"a":2}', "[[],{}]"]


def agree(texts, many, single, least):
    """What many gives is what single gives; of at least so many texts."""
    met = 0
    for t, got in zip(texts, batch.chunked([t.encode() for t in texts], many, 1 << 12)):
        if got is not None:
            met += 1
            assert single(t) == (got.decode() if isinstance(got, bytes) else got), t
    assert met >= least, met


def test_only_well_formed_texts_are_taken(texts):
    found = batch.Batch([t.encode() for t in texts])
    for t, ok in zip(texts, found.ok):
        try:
            json.loads(t)
            assert ok, t
        except ValueError:
            pass  # what ok says of these is tested by what is made of them


@pytest.mark.parametrize("path", [(), ("a",), ("a", "b"), ("list", 0), ("list", 2, "a"), ("e", "c", "b"), (1,)])
def test_paths_and_edits(texts, path):
    agree(texts, lambda b: batch.values(b, path), lambda t: rawjson.find(t, path), 5 if len(path) < 3 else 0)
    agree(texts, lambda b: batch.lengths(b, [path, ("a",)]), lambda t: len(rawjson.find(t, path).encode()) + len(rawjson.find(t, ("a",)).encode()), 0)
    agree(texts, lambda b: batch.set_value(b, {"path": path, "value": "[9]"}), lambda t: edit.set_value(t, path, "[9]"), 0)
    agree(texts, lambda b: batch.append(b, {"path": path, "value": "9"}), lambda t: edit.append(t, path, "9"), 0)
    for index in (0, 1, 2):
        agree(texts, lambda b: batch.insert(b, path, index, "9"), lambda t: edit.insert(t, path, index, "9"), 0)
        agree(texts, lambda b: batch.delete_index(b, path, index), lambda t: edit.delete_index(t, path, index), 5 if path == () and index < 2 else 0)
    if path and isinstance(path[-1], str):
        agree(texts, lambda b: batch.upsert(b, {"path": path, "value": "[9]"}), lambda t: edit.upsert(t, path, "[9]"), 0)
        agree(texts, lambda b: batch.delete(b, {"path": path}), lambda t: edit.delete(t, path), 0)
    for new in ("zz", "b", "a"):
        agree(texts, lambda b: batch.rename(b, path, "a", new), lambda t: edit.rename(t, path, "a", new), 0)
    for patch in ('{"a":null,"b":{"c":1,"x":null},"e":[1]}', '{"a":{"b":{"c":null,"d":{}}}}', "{}"):
        agree(texts, lambda b: batch.merge_patch(b, path, patch), lambda t: edit.merge_patch(t, path, patch), 0)
        if patch != "{}":
            agree(texts, lambda b: batch.merge_shallow(b, {"path": path, "value": patch}), lambda t: edit.merge_shallow(t, path, patch), 0)


@pytest.mark.parametrize("paths", [["a"], ["a.b", "e", "list"], ["a.b.c", "b.a", "zz"], []])
def test_keep_lists(texts, paths):
    tree = keep_tree(paths)
    agree(texts, lambda b: batch.kept(tree, b), lambda t: keeping.kept(tree, t), 500)


def test_depth_projections_pipelines(texts):
    agree(texts, batch.depths, rawjson.depth_of, 800)
    for e, path, steps in (("list[*]", ["list"], []), ("list[*].a", ["list"], ["a"]), ("a.list[*].b.c", ["a", "list"], ["b", "c"])):
        assert C._simple(parse(e)) == (path, steps)
        agree(texts, lambda b: batch.projected(b, path, steps), lambda t: evaluate(parse(e), t), 8 if path == ["list"] else 0)
    assert C._simple(parse("list[0]")) is None and C._simple(parse("list[*].a | [0]")) is None
    for p in (TransformPipeline().keep(["a.b", "e"]).rename("e", "f").inject("g", [1]), TransformPipeline().drop("a").rename("b", "a").drop("zz")):
        agree(texts, lambda b: batch.transformed(b, p.steps, p.chosen), p.run, 300)
    ops = edit.Edits().upsert("n", 1).merge_patch("", {"a": {"x": None, "y": 2}}).merge_shallow("", {"e": {}}).delete("n").upsert("l", [1]).prepend("l", 0).insert("l", 1, 5).delete("l[2]")
    agree(texts, lambda b: batch.edited(b, ops.ops), ops.apply, 300)


def test_columns(spark, texts):
    """The same through Spark, nulls and errors included."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, t string")

    def single(function):
        def run(t):
            try:
                return None if t is None else function(t)
            except Exception:  # noqa: BLE001
                return None

        return run

    ops = edit.Edits().set("a", 1).upsert("b.c", 2)
    limits = Limits(2, 60)
    t = df["t"]
    want = {
        "raw": (C.raw(t, "a.b"), single(lambda x: rawjson.find(x, ("a", "b")))), "depth": (C.depth(t), single(rawjson.depth_of)),
        "keep": (C.keep(t, ["a.b", "e"]), single(lambda x: keeping.kept(keep_tree(["a.b", "e"]), x))), "edited": (C.edited(t, ops), single(lambda x: ops.attempt(x)[0])),
        "null": (C.edited(t, ops, on_error="null"), single(ops.apply)), "error": (C.edited(t, ops, on_error="column")["error"], single(lambda x: ops.attempt(x)[1])),
        "length": (C.values_len(t, ["a", "b"]), single(lambda x: sum(len(rawjson.find(x, (k,)).encode()) for k in "ab"))),
        "over": (C.over_limits(t, limits), single(lambda x: C._error_of(limits.check, x))), "parts": (C.jmes_exact(t, "list[*].a"), single(lambda x: evaluate(parse("list[*].a"), x))),
    }
    for r in df.select("id", "t", *(c.alias(k) for k, (c, _) in want.items())).collect():
        for k, (_, function) in want.items():
            assert r[k] == function(r["t"]), (k, r["t"])
