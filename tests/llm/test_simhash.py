import random
import re

import xxhash

from docweave.llm import simhash
from docweave.llm.common import stored
from docweave.llm.simhash import fingerprints, links, components, near_dedup, simhash_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    out = {}
    for i in range(len(ids)):
        out.setdefault(root(i), []).append(i)
    least = {r: min((ids[i] for i in m if ids[i] is not None), default=None) for r, m in out.items()}
    return [least[root(i)] for i in range(len(ids))]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Gämma", "DELTA", "eps", "zeta", "éta", "theta\t", "iota\n", "kappa"]
    texts = [None, "", " \n\t", "one", "One two", "one two three", "x" * 5000]
    while len(texts) < n:
        if rng.random() < 0.5:
            base = rng.choice(texts) or "a b c d e f"
            parts = base.split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))))
    return texts


def test_fingerprints_match_brute_force_also_in_slices():
    texts = corpus()
    want = [slow_fingerprint(t) for t in texts]
    raw = [None if t is None else t.encode() for t in texts]
    assert fingerprints(raw).tolist() == want
    assert fingerprints(raw, slice_of=7).tolist() == want


def test_components_match_brute_force(spark):
    texts = corpus()
    ids = [None if i == 20 else i * 3 % 301 for i in range(len(texts))]
    rows = [(i, t, "en", 1) for i, t in zip(ids, texts)] + [(ids[9], texts[9], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, F string, root long")
    got = [tuple(r) for r in simhash_components(df).collect()]
    prints = [slow_fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, slow_components([r[0] for r in rows], prints))]
    key = lambda r: (r[1], r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_crowded_buckets_connect_the_same(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(150)}
    prints = sorted({(p ^ (1 << 63)) - (1 << 63) for p in (x & (2**64 - 1) for x in prints)})
    df = spark.createDataFrame([(p,) for p in prints], "f long")
    want = slow_components(prints, [p & (2**64 - 1) for p in prints])
    for hot in (1, 5, 10_000):
        root = {r["node"]: r["root"] for r in components(links(df, hot)).collect()}
        assert [root.get(p, p) for p in prints] == want


def test_near_dedup_keeps_one_row_of_each_component(spark):
    texts = corpus(120, 5)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "a text of its own that nobody else has here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint_ string")
    kept = near_dedup(df)
    assert kept.columns == df.columns
    prints = [slow_fingerprint(r[1]) for r in rows]
    want = slow_components([r[0] for r in rows], prints)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted({(c is None, c or 0) for c in want})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).count() == 0 and near_dedup(df).count() == 0


def broadcasts(spark, monkeypatch, function):
    """The plans in which function broadcasts a table to join it, of those that it writes and the one that it returns."""
    plans = []

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "stored", lambda df, name: stored(plan(df), name))
    docs = spark.createDataFrame(list(enumerate(corpus(200, seed=7))), "doc_id long, text string")
    plan(function(docs)).collect()
    assert any("SortMergeJoin" in p for p in plans)
    return [p for p in plans if "Broadcast" in p]


def test_near_dedup_broadcasts_nothing_that_grows_with_the_corpus(spark, monkeypatch):
    assert not broadcasts(spark, monkeypatch, near_dedup)


def test_components_broadcast_nothing_that_grows_with_the_corpus(spark, monkeypatch):
    assert not broadcasts(spark, monkeypatch, simhash_components)
