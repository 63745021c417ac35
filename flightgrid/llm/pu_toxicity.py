"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier of word presence is trained with numpy from confirmed toxic
documents (positives) and from documents whose labels are not looked at (unlabelled).
With the class prior p, the risk is p * R(positives as 1) plus the part of the
unlabelled risk that negatives cause, R(unlabelled as 0) - p * R(positives as 0);
where that estimate falls below zero, only it is descended, so the model cannot win
by memorising the positives.

Training takes at most ``positives`` and ``unlabelled`` documents, those with the
smallest hash of their id: the bound of the sample is a parameter.  Its documents come
to the driver as hashed words, not as text.  The weights, at most ``features`` of
them, are sent to the executors; every whole text is scored.

Defined cases: null and empty texts have no words and get the score of the bias
alone; extra columns pass through ``score``; repeated rows are scored alike; without
a positive or unlabelled document every score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightgrid.llm._words import ALNUM, LOWER, chunks, hash_spans, split, text_bytes


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def score(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts; ``doc`` is ascending."""
        z = np.full(n, self.bias)
        if len(self.words) and len(hashes):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            hit = self.words[at] == hashes
            pair = np.unique(doc[hit] * len(self.words) + at[hit])
            z += np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], n)
        return sigmoid(z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and the number of their text."""
    data, offsets = text_bytes(col)
    data = LOWER[data]
    starts, ends, doc = split(data, offsets, ALNUM)
    return hash_spans(data, starts, ends), doc


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = 4_096, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """From the distinct word hashes of each document."""
    if not positive or not unlabelled:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(p / (1 - p))))
    words, inverse = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    sizes = np.array([len(x) for x in [*positive, *unlabelled]])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(inverse[doc < n_p], minlength=len(words))
    in_u = np.bincount(inverse[doc >= n_p], minlength=len(words))
    # Words whose share of documents is surely not the same in both samples.
    a, b = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    both = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = np.abs(a - b) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    kept = np.sort(np.argsort(-z, kind="stable")[:features])
    kept = kept[z[kept] > 3.0]
    column = np.full(len(words), -1)
    column[kept] = np.arange(len(kept))
    live = column[inverse] >= 0
    row, col = doc[live], column[inverse[live]]
    weights, bias = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    share = np.where(np.arange(n_p + n_u) < n_p, 1 / n_p, 1 / n_u)
    is_p = np.arange(n_p + n_u) < n_p
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, rounds + 1):
        f = bias + np.bincount(row, weights[col], n_p + n_u)
        s = sigmoid(f)
        softplus = np.logaddexp(0.0, f)  # the loss as 0; as 1 it is softplus - f
        negative = softplus[~is_p].mean() - prior * softplus[is_p].mean()
        # Derivatives of the parts by f.
        d_pos = np.where(is_p, prior * (s - 1), 0.0)
        d_neg = np.where(is_p, -prior * s, s)
        d = (d_pos + d_neg if negative >= 0 else -d_neg) * share
        g = np.append(np.bincount(col, d[row], len(kept)) + ridge * weights, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        weights, bias = weights - step[:-1], bias - step[-1]
    return Model(words[kept], weights, float(bias))


def is_held_out(key: Column, modulus: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(modulus)) == held, F.lit(False))


def _hashed(docs: DataFrame, ids: DataFrame) -> list[np.ndarray]:
    """Distinct word hashes of the documents of a bounded list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, doc = words_of(part.column(0))
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array([np.unique(h[cuts[i] : cuts[i + 1]]).tobytes() for i in range(part.num_rows)], pa.binary())], ["h"])

    got = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(run, "h binary")
    return [np.frombuffer(r.h, np.uint64) for r in got.toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, positives: int = 3_000, unlabelled: int = 9_000, features: int = 4_096) -> Model:
    """Train on rows that ``held_out`` (a column of doc_id) does not name.  The prior
    is the share of toxic rows among the labels read."""
    known = labels.where(~held_out & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    share = known.agg(F.avg("toxic")).first()[0]
    prior = min(max(share or 0.0, 1e-3), 0.999)
    first = lambda df, n: df.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    p = _hashed(docs, first(known.where("toxic = 1"), positives))
    u = _hashed(docs, first(docs.where(~held_out), unlabelled))
    return train(p, u, prior, features)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability that a text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                h, doc = words_of(part.column(part.schema.get_field_index(text)))
                s = sent.value.score(h, doc, part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(s)], [*kept, out])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    held = is_held_out(F.col("doc_id"))
    got = score(docs.select("doc_id", "text"), fit(docs, labels, held))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those scored at ``threshold`` or more."""
    model = fit(docs, labels, is_held_out(F.col("doc_id")))
    return score(docs, model, out="__score").where(F.col("__score") < threshold).drop("__score")
