import random
import zlib

import numpy as np

from docweave.llm.labelled import fold
from docweave.llm.toxicity import ORDERS, Toxicity, distinct_codes, fit_toxicity, gram_codes, logistic_regression, present, toxicity_scores


def test_features_are_the_distinct_grams_also_of_long_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab É") for _ in range(rng.randrange(50))) for _ in range(30)] + [None, "", "Ab" * 300_000]
    seen = np.zeros(1 << 20, dtype=bool)
    table = np.arange(1 << 20, dtype=np.int32)
    row, code = present(texts, table)
    assert (np.diff(row) >= 0).all()
    for i, t in enumerate(texts):
        data = b" " + t.lower().encode() + b" " if t else b""
        padded = data + bytes(6)
        want = len({(n, padded[k : k + n]) for n in ORDERS for k in range(len(data))})
        found = distinct_codes(t, seen)
        assert not seen.any() and code[row == i].tolist() == found.tolist()
        assert len(found) <= want and (len(found) == want or want > 20)  # codes of 20 bits seldom meet


def test_regression_separates_and_weighs():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400).astype(float)
    sets = [np.unique(np.append(rng.integers(2, 50, 6), 0 if a else 1)) for a in y]
    row = np.repeat(np.arange(400), [len(s) for s in sets])
    w, b = logistic_regression(row, np.concatenate(sets), np.ones(50), y, np.ones(400), 50)
    z = np.array([w[s].sum() + b for s in sets])
    assert ((z > 0) == (y == 1)).all() and w[0] > 0 > w[1]


def corpus(spark, n=900):
    rng = random.Random(2)
    syllables = "on re ti al er in st or".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [word() for _ in range(rng.randrange(5, 120))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Gronkhead", "vilework", "DRUZZLE,"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(None, "a gronkhead", "x"), (n, None, "x"), (n + 1, "", "x"), (5, rows[5][1], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, Score string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int"), dict(labels), rows


def test_held_out_accuracy_and_contract(spark):
    df, labels, truth, rows = corpus(spark)
    out = toxicity_scores(df, labels).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    held = [i is not None and i == i and zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in out.doc_id]
    assert (out.held_out == held).all()
    own = out[out.held_out & out.doc_id.isin(truth)]
    assert (own.predicted == own.doc_id.map(truth)).mean() > 0.97


def test_without_labels_or_rows(spark):
    df, labels, _, _ = corpus(spark, 20)
    assert set(toxicity_scores(df, labels.limit(0)).toPandas().score) == {0.5}
    assert toxicity_scores(df, labels.where("toxic = 0")).toPandas().score.max() < 0.01
    assert toxicity_scores(df.limit(0), labels).count() == 0


def test_scores_match_brute_force():
    """A score is the sigmoid of the intercept and of the weights of the distinct grams, whatever texts come together and however long they are."""
    rng = np.random.default_rng(4)
    table = np.where(rng.random(1 << 20) < 0.3, np.arange(1 << 20), -1)
    weights = rng.normal(size=1 << 20) * 0.01
    model = Toxicity(table, weights, -0.25)
    own = random.Random(6)
    texts = ["".join(own.choice("abcd É") for _ in range(own.randrange(200))) for _ in range(60)] + [None, "", "abcd É" * 30_000, "x"]
    for t, score in zip(texts, model.scores(texts)):
        data = np.frombuffer(b" " + t.lower().encode() + b" " if t else b"", np.uint8)
        codes = {int(c) for code in gram_codes(np.concatenate([data, np.zeros(6, np.uint8)])) for c in code[: len(data)]} if len(data) else set()
        z = -0.25 + sum(weights[table[c]] for c in codes if table[c] >= 0)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_copies_count_once(spark):
    """A text under many ids is one text: the model is that of the table without its copies."""
    df, labels, truth, rows = corpus(spark, 300)
    known = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    copies = [(10_000 + k, rows[known[0]][1], "x") for k in range(400)]
    more = df.union(spark.createDataFrame(copies, df.schema))
    more_labels = labels.union(spark.createDataFrame([(c[0], truth[known[0]]) for c in copies], labels.schema))
    train = fold("doc_id", 5) != 0
    a, b = fit_toxicity(df, labels, train), fit_toxicity(more, more_labels, train)
    assert (a.table == b.table).all() and len(a.weights)
