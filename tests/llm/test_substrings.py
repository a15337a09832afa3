import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm.substrings import _equal_stretches, _spans_of, _stretches, cut_repeats, equal_classes, merged, remove_repeats, repeated_windows, runs_of, sliding_minimum
from docweave.llm.suffix_array import suffix_array


@pytest.mark.parametrize("alphabet", [1, 2, 3, 30])
def test_suffix_array_matches_sorting(alphabet):
    rng = random.Random(alphabet)
    for _ in range(300):
        s = [rng.randrange(alphabet) * 7 - 3 for _ in range(rng.randrange(60))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def slow(texts, length):
    """Kept bytes and removed runs of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone), runs))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrst é") for _ in range(rng.randrange(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randrange(20, 90)) for _ in range(6)]
    texts = [None, "", "short", "a" * 450, "ab" * 300, "x" * 199, "y" * 200, "y" * 200, "z" * 201]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.3:
            texts.append(prose(rng.randrange(5, 150)))
        elif kind < 0.6:
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            texts.append(prose(rng.randrange(40)) + p[cut : len(p) - rng.randrange(20)] + prose(rng.randrange(40)))
        elif kind < 0.8:
            texts.append(rng.choice(texts))
        else:
            base = list(rng.choice(texts) or "q")
            for _ in range(rng.randrange(1, 4)):
                base[rng.randrange(len(base))] = rng.choice("#é")
            texts.append("".join(base))
    return texts


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(1)
    parts = [rng.integers(97, 101, n, dtype=np.uint8) for n in (0, 10, 199, 200, 201, 900, 5000)]
    data, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    anchor, first, last, _ = runs_of(data, ends, 200)
    windows = [w for a, b in zip(first, last) for w in range(a, b + 1)]
    assert windows == [i for p, e in zip(parts, ends) for i in range(e - len(p), e - 199)]
    assert ((anchor >= last) & (anchor + 40 <= first + 200)).all()
    assert sliding_minimum(np.array([5, 3, 4, 1, 2, 9]), 3).tolist() == [3, 1, 1, 1]


def test_repeated_windows_match_brute_force():
    rng = random.Random(9)
    gram = bytes(rng.randrange(97, 99) for _ in range(40))
    rows = []
    for _ in range(80):
        high, low = sorted((rng.randrange(161), rng.randrange(161)), reverse=True)
        left, right = b"abab" * 40, b"bbab" * 40
        cut = lambda s: bytes(c if rng.random() > 0.01 else 99 for c in s)
        rows.append(((cut(left)[160 - high :] if high else b"") + gram + cut(right)[: 160 - low], low, high))
    got = repeated_windows([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), 200)
    seen = Counter((b, t[h - b : h - b + 200]) for t, lo, h in rows for b in range(lo, h + 1))
    for i, (t, lo, h) in enumerate(rows):
        for b in range(161):
            assert got[i, b] == (lo <= b <= h and seen[b, t[h - b : h - b + 200]] > 1)


@pytest.mark.parametrize("cap", [1024, 2, 1])
def test_removal_matches_brute_force(spark, cap):
    texts = corpus(3)
    rows = [(None if i in (12, 13) else i, t, i, "x") for i, t in enumerate(texts)] + [(20, texts[20], 100, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed int, g string")
    out = remove_repeats(df, cap=cap)
    assert out.columns == ["doc_id", "text", "removed", "g", "kept_bytes", "_removed"]
    got = {r["removed"]: (bytes(r["kept_bytes"]), sum(x["e"] - x["s"] for x in r["_removed"]), len(r["_removed"])) for r in out.collect()}
    want = slow([(r[1] or "").encode() for r in rows], 200)
    assert len(got) == len(rows)
    for r, w in zip(rows, want):
        assert got[r[2]] == w, r[2]


def test_spans_merge():
    assert merged([{"s": 5, "e": 9}, {"s": 0, "e": 3}, {"s": 9, "e": 10}, {"s": 1, "e": 2}]) == [(0, 3), (5, 10)]
    assert merged(None) == []


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_hashes_of_different_bytes_remove_nothing():
    """Rows of one class whose bytes differ: the sorter finds no repeat, and the class is not said to be equal as a whole."""

    def batch(covered):
        n = len(covered)
        ints = lambda v, t=pa.int64(): pa.array([v] * n, t)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(n)), ints(7), ints(50), ints(0, pa.int16()), ints(20, pa.int16()), ints(1), ints(2), ints(3), ints(5), ints(1), pa.array(range(n), pa.int32()), pa.array(covered, pa.binary())],
            names=["doc_id", "th", "at", "low", "high", "g", "f", "h", "n", "crowd", "k", "covered"],
        )

    rng = np.random.default_rng(2)
    one = rng.integers(97, 123, 220, dtype=np.uint8)
    other = one.copy()
    other[100] ^= 1
    assert not sum(b.num_rows for b in _spans_of([batch([one.tobytes(), other.tobytes()])], 200, 10))
    (found,) = _spans_of([batch([one.tobytes(), one.tobytes()])], 200, 10)
    assert found.to_pylist()[0] == {"doc_id": 0, "th": 7, "s": 30, "e": 250, "f": 2, "h": 3, "whole": True}
    other[100], other[215] = one[100], one[215] ^ 1
    (found,) = _spans_of([batch([one.tobytes(), other.tobytes()])], 200, 10)
    assert [(r["s"], r["e"], r["whole"]) for r in found.to_pylist()] == [(30, 245, False)] * 2


def test_many_copies_and_repeated_rows(spark):
    """A class of hundreds of rows, most of them repeats of one row: all lose the passage."""
    rng = random.Random(4)
    prose = lambda: "".join(rng.choice("aeiounrst ") for _ in range(300))
    shared = prose()
    rows = [(i, prose() + shared) for i in range(40)] + [(77, shared)] * 300 + [(None, shared)] * 5 + [(500 + i, shared) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for cap in (1024, 4):
        out = remove_repeats(df, cap=cap).collect()
        want = Counter((i, kept) for (i, _), (kept, _, _) in zip(rows, slow([t.encode() for _, t in rows], 200)))
        assert Counter((r["doc_id"], bytes(r["kept_bytes"])) for r in out) == want


def test_cut_characters_go(spark):
    """A repeat that ends within a character: what is left of the character goes too; null texts stay null."""
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdef") for _ in range(220))
    texts = ["é" + shared + "é tail one", "è" + shared + "è tail two", None, ""]  # é and è share their first byte
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    out = {r["doc_id"]: r["text"] for r in cut_repeats(df).collect()}
    kept = [k.decode(errors="ignore") for k, _, _ in slow([(t or "").encode() for t in texts], 200)]
    assert out == {0: kept[0], 1: kept[1], 2: None, 3: ""} and kept[0].endswith(" tail one") and "é" not in kept[0][1:]


def test_equal_classes_match_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        base = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([1, 99, 100, 101, 250]))) for _ in range(6)]
        strings = [rng.choice(base) for _ in range(rng.randrange(1, 25))]
        strings = [s[: len(s) - rng.randrange(2)] or b"x" for s in strings]
        number = equal_classes(strings)
        assert all((number[i] == number[j]) == (a == b) for i, a in enumerate(strings) for j, b in enumerate(strings))


def test_stretches_join_runs_and_differing_ones_are_looked_into():
    """Runs of two texts, 80 bytes apart, become one stretch, or several of bounded size; a stretch that differs in one byte gives what its runs still share."""
    text = bytes(np.random.default_rng(5).integers(97, 123, 2000, dtype=np.uint8))
    runs = [{"at": 100 + 80 * k, "low": 20, "high": 99, "f": k, "h": -k, "n": 2 + k % 2} for k in range(15)] + [{"at": 1790, "low": 0, "high": 9, "f": 99, "h": 99, "n": 5}]
    pair = pa.table({"d1": [1], "t1": [11], "d2": [2], "t2": [22], "delta": [7], "key": [5], "runs": [runs[::-1]]}).to_batches()
    (whole,) = _stretches(pair, 200)
    assert [(r["doc_id"], r["k"], r["s"], r["e"], r["runs"] and len(r["runs"])) for r in whole.to_pylist()] == [(1, 0, 1, 1400, 15), (2, 1, 8, 1407, None), (1, 0, 1781, 1990, 1), (2, 1, 1788, 1997, None)]
    (cut,) = _stretches(pair, 200, 500)
    pieces = cut.to_pylist()
    assert max(r["e"] - r["s"] for r in pieces) < 800 and {x["f"] for r in pieces for x in r["runs"] or ()} == {r["f"] for r in runs}
    other = bytearray(b"-" * 7 + text)
    other[7 + 700] ^= 1

    def fetched(second):
        rows = [{k: r[k] for k in ("doc_id", "th", "g", "k", "s", "e", "runs")} | {"covered": (text if r["k"] == 0 else bytes(second))[r["s"] : r["e"]]} for r in pieces]
        return [r for b in _equal_stretches(pa.Table.from_pylist(sorted(rows, key=lambda r: (r["g"], r["k"]))).to_batches(), 200) for r in b.to_pylist()]

    covered = lambda rows, doc: {i for r in rows if r["doc_id"] == doc for i in range(r["s"], r["e"])}
    same = fetched(b"-" * 7 + text)
    assert covered(same, 1) == set(range(1, 1400)) | set(range(1781, 1990)) and covered(same, 2) == {i + 7 for i in covered(same, 1)}
    assert {r["f"] for r in same if r["whole"]} == {r["f"] for r in runs if r["n"] > 2}
    differ = fetched(other)
    assert 700 not in covered(differ, 1) and 707 not in covered(differ, 2) and set(range(1, 700)) <= covered(differ, 1)
    assert {r["f"] for r in differ if r["whole"]} == {r["f"] for r in runs if r["n"] > 2 and not r["at"] - r["high"] <= 700 < r["at"] - r["low"] + 200}
