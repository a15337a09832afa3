import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm.labelled import joined
from docweave.llm.neighbours import TERMS, Neighbours, keep_by_quality, quality_scores, term_weights, truncated_svd, unit


def test_pieces_hold_every_gram_once():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(60))) for _ in range(40)] + [b"", b"q" * 500]
    for most, rows in ((1 << 20, 256), (50, 3), (7, 256)):
        got = []
        for first, n, data, row, own in joined(texts, 4, most, rows):
            assert len(data) == len(row) == len(own) and row.max() < n
            got += [(first + row[i], bytes(data[i : i + 4])) for i in np.flatnonzero(own)]
        want = [(r, (t + bytes(4))[i : i + 4]) for r, t in enumerate(texts) for i in range(len(t))]
        assert sorted(got) == sorted(want)


def test_svd_spans_the_largest_directions():
    rng = np.random.default_rng(1)
    matrix = (rng.normal(size=(200, 10)) * 2.0 ** -np.arange(10)) @ rng.normal(size=(10, 60))
    matrix = matrix.astype(np.float32)
    got = truncated_svd(matrix, 4, 10)
    _, _, want = np.linalg.svd(matrix)
    assert np.allclose(np.abs(np.sum(got.T * want[:4], axis=1)), 1, atol=1e-2)


def test_votes_match_brute_force():
    rng = random.Random(5)
    texts = [(" ".join(rng.choice(["aa", "bb", "CC!", "d1"]) for _ in range(rng.randrange(1, 30)))).encode() for _ in range(120)]
    y = np.array([rng.randrange(2) for _ in texts[:80]])
    terms = term_weights(texts[:80])
    model = Neighbours.fit(terms, y, 16, 5, 8.0)
    got = model.scores(texts + [None, b""], block=7)
    for i, t in enumerate(texts):
        latent = unit((term_weights([t]) * model.idf) @ model.space)[0]
        near = sorted(((float(latent @ v), int(a)) for v, a in zip(model.vectors, y)), reverse=True)
        if near[4][0] - near[5][0] > 1e-4:
            weights = [max(c, 0) ** 8 for c, _ in near[:5]]
            assert got[i] == pytest.approx(sum(w * a for w, (_, a) in zip(weights, near)) / sum(weights), abs=1e-3)
    assert got[-1] == got[-2] == model.prior
    assert term_weights([b"x y"]).shape == (1, TERMS)


def corpus(spark, n=800):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        words = [rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr".split()) for _ in range(30)]
        if bad:
            words = rng.choice([lambda: [w.upper() + "!!" for w in words], lambda: [w + "$%#"[k % 3] * 3 for k, w in enumerate(words)], lambda: [w for w in words[:5] for _ in range(6)]])()
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(not bad)))
    rows += [(None, rows[0][1], "x"), (n, None, "x"), (n + 1, "", "x"), (5, rows[5][1], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, Score string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, quality int"), dict(labels), rows


def test_held_out_accuracy_and_contract(spark):
    df, labels, truth, rows = corpus(spark)
    out = quality_scores(df, labels).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.7)).all()
    held = [i is not None and i == i and zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in out.doc_id]
    assert (out.held_out == held).all()
    own = out[out.held_out & out.doc_id.isin(truth)]
    assert (own.predicted == own.doc_id.map(truth)).mean() > 0.97
    kept = keep_by_quality(df, labels)
    assert kept.columns == df.columns and kept.count() == out.predicted.sum()


def test_scores_ignore_held_out_labels(spark):
    df, labels, _, _ = corpus(spark, 200)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_scores(df, x).orderBy("doc_id", "score").toPandas() for x in (labels, flipped))
    assert np.allclose(a.score, b.score)


def test_without_labels_or_rows(spark):
    df, labels, _, _ = corpus(spark, 20)
    assert set(quality_scores(df, labels.limit(0)).toPandas().score) == {0.5}
    assert quality_scores(df.limit(0), labels).count() == 0 and keep_by_quality(df.limit(0), labels).count() == 0


def test_ties_with_the_last_neighbour_vote():
    """Ten copies of one text with both labels, three neighbours: all ten vote, in whatever order they were learnt."""
    rng = np.random.default_rng(2)
    copy = b"the same words over and over again"
    others = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"], 12)).encode() for _ in range(30)]
    texts, y = [copy] * 10 + others, np.array([1, 1, 1, 0, 0, 0, 0, 0, 0, 0] + [1, 0] * 15)
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(texts))
        model = Neighbours.fit(term_weights([texts[i] for i in order]), y[order], 16, 3, 8.0)
        assert abs(model.scores([copy])[0] - 0.3) < 1e-3


def test_long_and_null_texts():
    texts = [b"short text of some words " * 3, b"lorem ipsum dolor " * 200_000, None, b"", b" \n"]
    model = Neighbours.fit(term_weights(texts[:2] * 5), np.array([1, 0] * 5), 8, 3, 8.0)
    scores = model.scores(texts)
    assert scores[0] > 0.9 and scores[1] < 0.1 and (scores[2:] == model.prior).all()
