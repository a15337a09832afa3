"""Toxicity scores: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

After Wang and Manning (2012): a feature is present or absent; its value is the log of how much likelier it is in toxic texts.
Counts come from a bounded labelled sample, distributed; features whose ratio is beyond chance are kept, and a logistic regression on
their scaled values is fitted on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import discard, mapped, stored
from docweave.llm.labelled import fold, joined, labelled_sample

ORDERS = (4, 5, 6)
_BITS = 20
_PAD = max(ORDERS)


def gram_codes(data: np.ndarray):
    """For each of ORDERS the hashes, below 2**_BITS, of as many bytes from each position on (zeros past the end)."""
    out, done = np.full(len(data), np.uint32(0x811C9DC5), dtype=np.uint32), 0
    with np.errstate(over="ignore"):
        for order in ORDERS:
            for k in range(done, order):
                out *= np.uint32(0x01000193)
                out[: len(data) - k] ^= data[k:]
            done = order
            yield (out * np.uint32(2654435761)) >> np.uint32(32 - _BITS)


def _bytes(documents: list[str | None]) -> list[bytes]:
    return [b" " + t.lower().encode(errors="replace") + b" " if t else b"" for t in documents]


def distinct_codes(document: str | None, seen: np.ndarray) -> np.ndarray:
    """The codes of a text, each once. seen: 2**_BITS false values, which it leaves so."""
    for _, _, data, _, own in joined(_bytes([document]), _PAD, 1 << 18):
        for code in gram_codes(data):
            seen[code[own]] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def present(documents: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every feature that a text has, each once, in order of row; table gives the feature of a code, -1 for none."""
    pairs = [np.zeros(0, np.int64)]
    for first, _, data, row, own in joined(_bytes(documents), _PAD, 1 << 18):
        for code in gram_codes(data):
            number = table[code]
            hit = np.flatnonzero((number >= 0) & own)
            pairs.append(((row[hit] + first) << _BITS) | number[hit])
    both = np.unique(np.concatenate(pairs))
    return both >> _BITS, both & ((1 << _BITS) - 1)


def present_in_parts(documents: list[str | None], table: np.ndarray, most: int = 1 << 17):
    """present, for texts of about `most` characters together: (first row, rows, row, feature). A longer text is looked at by its codes alone, so that
    memory does not follow it, nor how many features there are."""
    at, size, scratch = 0, 0, None
    for i, text in enumerate([*documents, None]):
        n = len(text or "")
        if i == len(documents) or size + n > most:
            if i > at:
                yield at, i - at, *present(documents[at:i], table)
            at, size = i, 0
        if n > most:
            scratch = np.zeros(1 << _BITS, dtype=bool) if scratch is None else scratch
            found = table[distinct_codes(text, scratch)]
            found = np.sort(found[found >= 0]).astype(np.int64)
            yield i, 1, np.zeros(len(found), np.int64), found
            at = i + 1
        else:
            size += n


def logistic_regression(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, ridge: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept; sparse rows as (row, feature) pairs, `value` by feature. Adam on the full data, from zero."""
    w, b = np.zeros(size), 0.0
    x = value[feature]
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    total = weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[feature] * x, minlength=len(y)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / total
        g = np.append(np.bincount(feature, weights=error[row] * x, minlength=size) + ridge * w, error.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, b


@dataclass
class Toxicity:
    table: np.ndarray  # feature number of each code
    weights: np.ndarray  # regression weight times log-count ratio
    intercept: float

    def scores(self, documents: list[str | None]) -> np.ndarray:
        z = np.full(len(documents), self.intercept)
        if len(self.weights):
            for first, rows, row, feature in present_in_parts(documents, self.table):
                z[first : first + rows] += np.bincount(row, weights=self.weights[feature], minlength=rows)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit_toxicity(documents: DataFrame, labels: DataFrame, train, id_col="doc_id", text_col="text", label_col="toxic", limit=16000, least_z=3.0, least_ratio=1.0) -> Toxicity:
    """Fits on at most `limit` labelled ids, half of them toxic; texts of one label that are alike count once.

    The features, of 2**20 codes, are those whose log-count ratio is at least least_ratio and least_z standard errors away from zero;
    grams that merely follow a text's language are not.
    """
    marks = labels.select(F.col(id_col), F.col(label_col))
    sample = labelled_sample(documents, marks, id_col, text_col, label_col, train, {0: limit // 2, 1: limit // 2})
    sample = stored(sample.groupBy("text", "y").agg(F.max("whole").alias("whole")), "toxic-sample")
    sizes = {r["y"]: (r["n"], r["whole"]) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).collect()}
    if len(sizes) < 2:
        return Toxicity(np.full(1 << _BITS, -1, np.int32), np.zeros(0), {(): 0.0, (0,): -20.0, (1,): 20.0}[tuple(sizes)])

    def count(batches):
        seen = np.zeros((2, 1 << _BITS), dtype=np.int64)
        scratch = np.zeros(1 << _BITS, dtype=bool)
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y, distinct_codes(text, scratch)] += 1
        met = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[0, met]), pa.array(seen[1, met])], names=["code", "q", "p"])

    n0, n1 = sizes[0][0], sizes[1][0]
    counts = mapped(sample.select("text", "y"), count, "code long, q long, p long").groupBy("code").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    ratio = F.log(((F.col("p") + 1) / (n1 + 2)) / ((F.col("q") + 1) / (n0 + 2)))
    z = F.abs(ratio) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    top = counts.select("code", ratio.alias("r"), z.alias("z")).where((F.col("z") >= least_z) & (F.abs("r") >= least_ratio)).orderBy("code").toPandas()
    table = np.full(1 << _BITS, -1, np.int32)
    table[top.code.to_numpy()] = np.arange(len(top), dtype=np.int32)
    if not len(top):
        return Toxicity(table, np.zeros(0), float(np.log(sizes[1][1] / sizes[0][1])))

    def pick(batches):
        for b in batches:
            found = []
            for _, rows, row, feature in present_in_parts(b.column(0).to_pylist(), table):
                edges = np.searchsorted(row, np.arange(rows + 1))
                found += [feature[a:z].astype(np.int32).tobytes() for a, z in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], names=["features", "y"])

    rows = mapped(sample.select("text", "y"), pick, "features binary, y int").toPandas().sort_values(["y", "features"])
    discard(sample)
    sets = [np.frombuffer(x, np.int32) for x in rows.features]
    y = rows.y.to_numpy().astype(float)
    weight = np.where(y == 1, sizes[1][1] / n1, sizes[0][1] / n0)  # as many as there are of each label
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ratios = top.r.to_numpy()
    w, b = logistic_regression(row, np.concatenate(sets).astype(np.int64), ratios, y, weight, len(top))
    return Toxicity(table, w * ratios, b)


def toxicity_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of documents.

    held_out rows (crc32 of the id as text, modulo 5, is 0) never give labels. predicted is 1 from threshold on.

    Defined cases: null and empty texts have no features and get the intercept's score. Without labels every score is 0.5; with labels of one
    kind it is next to that label. Null ids are not held out. Repeated rows are returned each. An empty table gives no rows. Other columns are
    ignored.
    """
    model = fit_toxicity(documents, labels, fold(id_col, 5) != 0, id_col, text_col, **fit)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**20 numbers, and at most as many weights

    def add(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            scores = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], names=["doc_id", "score"])

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = mapped(docs, add, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir):
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
