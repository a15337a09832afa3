import random
import zlib

import numpy as np
import pytest

from docweave.llm.packing import CapacityTree, best_fit_decreasing, best_fit_pack, default_vocabulary, encoder


def slow_bins(lengths, capacity):
    """Remaining capacities after best fit decreasing, piece by piece."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            best = min(fits, key=lambda b: bins[b])
            bins[best] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 64, 100])
    lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.choice([0, 1, 30, 700]))]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    plan = best_fit_decreasing(histogram, capacity)
    placed = {}
    for length, n in histogram.items():
        own = sorted(p[1:] for p in plan if p[0] == length)
        for rank in range(n):
            first_rank, first_bin, each, offset = [p for p in own if p[0] <= rank][-1]
            placed.setdefault(first_bin + (rank - first_rank) // each, []).append((offset + (rank - first_rank) % each * length, length))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in p) for p in placed.values()) == slow_bins(lengths, capacity)


def test_tree_finds_the_tightest():
    rng, tree, have = random.Random(1), CapacityTree(100), set()
    for _ in range(2000):
        r = rng.randrange(101)
        have.symmetric_difference_update({r})
        tree.set(r, r in have)
        need = rng.randrange(101)
        assert tree.tightest(need) == min((x for x in have if x >= need), default=None)


def test_encoders_agree():
    vocabulary, ranks = default_vocabulary()
    slow, fast = encoder(vocabulary, None), encoder(vocabulary, ranks)
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(0x250)] + list("   \n\n\t''sdt") * 20 + ["<|endoftext|>", "日本", "😀", " ", "ไทย"]
    batch = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(800)] + ["", " ", "a" * 3000]
    assert [list(x) for x in slow(batch)] == [list(x) for x in fast(batch)]


def test_pieces_are_whole_and_gapless(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "β", "gamma!"]) for _ in range(int(rng.expovariate(1 / 40)))), "x") for i in range(150)]
    rows += [(900, None, "x"), (901, "", "x"), (None, "no id", "x"), (902, "word " * 3000, "x"), (0, rows[0][1], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Length string")
    out = best_fit_pack(df, capacity=128, keep_ids=True, buckets=8).toPandas()
    encode = encoder(*default_vocabulary())
    want = []
    for (i, _, _), ids in zip(rows, encode([t or "" for _, t, _ in rows])):
        ids = list(ids) + [2]
        cuts = [0, *range(len(ids) % 128 or 128, len(ids) + 1, 128)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want.append((-1 if i is None else i, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())))
    got = out.assign(doc_id=out.doc_id.fillna(-1).astype(int))
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    for _, bin_ in out.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]] and bin_.length.sum() <= 128
    assert out.sequence_id.nunique() == len(slow_bins([w[3] for w in want], 128))


def test_empty_table(spark):
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
