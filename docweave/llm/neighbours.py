"""Quality scores by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents is described by hashed term weights: character-class 4-grams (shape), character 3-grams, and how
many words repeat the word before. A truncated SVD of the sample gives the latent space; its labelled vectors are
broadcast. Every document is projected, its cosine with every labelled vector is computed exactly, in blocks, and the most
similar ones vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import fresh, mapped, raw
from docweave.llm.labelled import fold, joined, labelled_sample

_SHAPES, _GRAMS, _ECHOES = 1024, 1024, 2
TERMS = _SHAPES + _GRAMS + _ECHOES
#: Cosines this close are equal: copies of one text differ by rounding.
TIE = 1e-6
_GROUPS = [(0, _SHAPES, 1.0), (_SHAPES, _SHAPES + _GRAMS, 0.5), (_SHAPES + _GRAMS, TERMS, 1.0)]


def _classes() -> np.ndarray:
    """A class for each byte: lower, upper, digit, blank, line end, or the sign itself; bytes beyond ASCII count as lower."""
    out = np.arange(256, dtype=np.uint32)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[128:] = ord("a")
    return out


_CLASS = _classes()


def term_weights(documents: list[bytes | None]) -> np.ndarray:
    """A row of TERMS for each text: roots of relative frequencies within each kind of term. An empty text's row is zero."""
    counts = np.zeros((len(documents), TERMS), dtype=np.float32)
    texts = [t or b"" for t in documents]
    for first, rows, data, row, own in joined(texts, 4):
        at = np.flatnonzero(own)
        base = row[at] * TERMS
        c = _CLASS[data]
        with np.errstate(over="ignore"):
            shape = ((c[at] * np.uint32(31) + c[at + 1]) * np.uint32(31) + c[at + 2]) * np.uint32(31) + c[at + 3]
            low = data | ((c == ord("A")).astype(np.uint8) << 5)
            low = low.astype(np.uint32)
            gram = (low[at] << np.uint32(16)) | (low[at + 1] << np.uint32(8)) | low[at + 2]
            shape, gram = ((x * np.uint32(2654435761)) >> np.uint32(22) for x in (shape, gram))
        seen = np.bincount(base + shape, minlength=rows * TERMS) + np.bincount(base + _SHAPES + gram, minlength=rows * TERMS)
        counts[first : first + rows] += seen.reshape(rows, TERMS)
    for i, text in enumerate(texts):
        words = text.split()
        if len(words) > 1:
            echo = sum(map(bytes.__eq__, words[1:], words))
            counts[i, -2:] = echo, len(words) - 1 - echo
    for lo, hi, weight in _GROUPS:
        part = counts[:, lo:hi]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1)
        np.sqrt(part, out=part)
        part *= weight
    return counts


def truncated_svd(matrix: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    rank = min(rank, *matrix.shape)
    basis = np.random.default_rng(7).normal(size=(matrix.shape[1], min(rank + 8, matrix.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(matrix.T @ (matrix @ np.linalg.qr(basis)[0]))[0]
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ right.T)[:, :rank].astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Neighbours:
    """The labelled vectors of the latent space and how to get into it."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float
    k: int
    power: float

    @classmethod
    def fit(cls, terms: np.ndarray, y: np.ndarray, rank: int, k: int, power: float) -> Neighbours:
        if not len(y):
            return cls(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y.astype(np.float32), 0.5, k, power)
        idf = (np.log((1 + len(y)) / (1 + (terms > 0).sum(axis=0))) + 1).astype(np.float32)
        weighted = unit(terms * idf)
        space = truncated_svd(weighted, rank)
        return cls(idf, space, unit(weighted @ space).astype(np.float32), y.astype(np.float32), float(y.mean()), k, power)

    def scores(self, documents: list[bytes | None], block: int = 256) -> np.ndarray:
        """For each text the share of label 1 among its neighbours' weights; the prior where no neighbour is similar at all.

        The neighbours are the k most similar vectors and all that tie with the last of them.
        """
        out = np.full(len(documents), self.prior)
        if not len(self.votes):
            return out
        for at in range(0, len(documents), block):
            latent = unit((term_weights(documents[at : at + block]) * self.idf) @ self.space).astype(np.float32)
            cosine = latent @ self.vectors.T
            k = min(self.k, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            nearest = np.take_along_axis(cosine, near, axis=1)
            weight = np.maximum(nearest, 0).astype(np.float64) ** self.power
            total = weight.sum(axis=1)
            share = (weight * self.votes[near]).sum(axis=1) / np.maximum(total, 1e-300)
            level = nearest.min(axis=1) - TIE
            for i in np.flatnonzero((cosine >= level[:, None]).sum(axis=1) > k):  # more than k: all of the last ones vote
                tied = np.flatnonzero(cosine[i] >= level[i])
                weight = np.maximum(cosine[i, tied], 0).astype(np.float64) ** self.power
                total[i] = weight.sum()
                share[i] = (weight * self.votes[tied]).sum() / max(total[i], 1e-300)
            out[at : at + len(latent)] = np.where(total > 0, share, self.prior)
        return np.clip(out, 0, 1)


def fit_neighbours(documents: DataFrame, labels: DataFrame, train, id_col="doc_id", text_col="text", label_col="quality", limit=4096, rank=64, k=15, power=8.0) -> Neighbours:
    """Fits on at most `limit` labelled ids, as they come by a hash of the id; their term weights reach the driver."""
    marks = labels.select(F.col(id_col), F.col(label_col))
    both = labelled_sample(documents, marks, id_col, text_col, label_col, train, {0: limit // 2, 1: limit // 2})

    def describe(batches):
        for b in batches:
            terms = term_weights(raw(b.column(0))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in terms], pa.binary()), b.column(1), b.column(2)], names=["terms", "y", "whole"])

    rows = mapped(both.select("text", "y", "whole"), describe, "terms binary, y int, whole long").toPandas()
    rows = rows.sort_values(["y", "terms"], kind="stable")
    terms = np.array([np.frombuffer(t, np.float16) for t in rows.terms], dtype=np.float32).reshape(len(rows), TERMS)
    y = rows.y.to_numpy()
    model = Neighbours.fit(terms, y, rank, k, power)
    if len(y):
        whole = rows.groupby("y").whole.max()
        model.prior = float(whole.get(1, 0) / whole.sum())
    return model


def with_quality(documents: DataFrame, model: Neighbours, text_col: str, name: str, keep: list[str] | None = None, at_least: float | None = None) -> DataFrame:
    """documents (or its columns keep) with a score; with at_least only the rows whose score reaches it."""
    keep = documents.columns if keep is None else keep
    at, places = documents.columns.index(text_col), [documents.columns.index(c) for c in keep]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # `limit` vectors of `rank` numbers

    def add(batches):
        for b in batches:
            scores = shared.value.scores(raw(b.column(at)))
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in places), pa.array(scores)], names=[*keep, name])
            yield out if at_least is None else out.filter(pa.array(scores >= at_least))

    return mapped(documents, add, T.StructType([documents.schema.fields[i] for i in places] + [T.StructField(name, T.DoubleType())]))


def quality_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of documents.

    held_out rows (crc32 of the id as text, modulo 4, is 2) never give labels. predicted is 1 from threshold on.

    Defined cases: null, empty and blank texts are like nothing and get the share of label 1 among the labelled rows; so does every row if
    there are no labels (0.5). Null ids are not held out. Repeated rows are returned each. An empty table gives no rows. Other columns are
    ignored.
    """
    model = fit_neighbours(documents, labels, fold(id_col, 4) != 2, id_col, text_col, **fit)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = with_quality(docs, model, "text", "score", ["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_by_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of documents whose score reaches the threshold, with all their columns.

    Defined cases are those of quality_scores: null, empty and blank texts get the share of label 1 among the labelled rows, without
    labels every score is 0.5; null ids and repeated rows are judged like any, an empty table gives no rows, and columns may have any names.
    """
    model = fit_neighbours(documents, labels, fold(id_col, 4) != 2, id_col, text_col, **fit)
    (score,) = fresh(documents, "quality_score")
    return with_quality(documents, model, text_col, score, at_least=threshold).select(*documents.columns)


def op2_quality_classifier(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
