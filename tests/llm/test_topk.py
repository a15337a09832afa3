import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm.topk import exact_top_k, search_cell


def slow(rows, k=5, scale=256):
    clean = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(clean):
        if q % 50 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), c) for other, (c, b) in enumerate(clean) if other != at and len(b) == len(a))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(hits)]
    return sorted(out)


def rows_of(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dims)], "x") for i in range(n)]
    for i in range(60, 80):  # ties
        rows[i] = (i, rows[60][1], "tie")
    rows += [(None, [1.0] * dims, "x"), (1000, None, "x"), (1050, [float("nan")] * dims, "x"), (1100, [float("inf")] + [0.0] * (dims - 1), "x")]
    rows += [(1150, [None] + [0.0] * (dims - 1), "x"), (1200, [1.0, 2.0], "short"), (1201, [2.0, 1.0], "short"), (1250, [], "none"), (60, rows[60][1], "again"), (100, rows[60][1], "again"), (100, rows[60][1], "again"), (150, rows[3][1], "again")]
    return rows


@pytest.mark.parametrize("dims", [1, 16, 40])
def test_matches_brute_force(spark, dims):
    rows = rows_of(300, dims, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, Score string")
    for cells in ((16384, 2048), (37, 3), (10, 1000), (100, 4)):
        got = exact_top_k(df, F.col("vec_id") % 50 == 0, cell_candidates=cells[0], block_queries=cells[1])
        assert sorted(map(tuple, got.collect())) == slow(rows)


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    cands = np.floor(rng.normal(size=(3, 40)) * 2.0**40)
    got = search_cell(np.arange(40), np.arange(40), cands, np.array([7]), cands[:, 7:8].T.copy(), 5)
    exact = sorted((-sum(int(x) * int(y) for x, y in zip(cands[:, 7], c)), j) for j, c in enumerate(cands.T) if j != 7)[:5]
    assert [c for _, c, _ in got] == [j for _, j in exact]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(df, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("dims", [0, 5, 70])
def test_floors_leave_nothing_out(dims):
    """A floor that k candidates reach, ties included, changes nothing; a cell without any returns nothing."""
    rng = np.random.default_rng(dims)
    cands, queries = np.floor(rng.normal(size=(dims, 500)) * 9), np.floor(rng.normal(size=(40, dims)) * 9)
    cands[:, 100:160] = cands[:, 100:101]
    none = np.full(40, -1)
    want = search_cell(np.arange(500), np.arange(500), cands, none, queries, 5)
    worst = np.array([min(s for q, _, s in want if q == i) for i in range(40)], dtype=float)
    assert sorted(search_cell(np.arange(500), np.arange(500), cands, none, queries, 5, worst)) == sorted(want)
    exact = queries @ cands
    assert all(s == exact[q, c] for q, c, s in want) and (worst == np.sort(exact, axis=1)[:, -5]).all()
    assert search_cell(np.arange(500), np.arange(500), cands, none, queries, 5, exact.max(axis=1) + 1) == []
