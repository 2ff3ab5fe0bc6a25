"""Quality classifier learnt from trusted positives and unlabelled text.

Each text is described by a few measures of its words, characters and lines. Their values are
cut into bins at quantiles of all documents, and a text's logit is the sum of one weight per
measure and bin. The weights minimise the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with logistic loss, over all trusted positives P and all documents U. Negative labels are used
for one number only: the class prior is the share of positives among the labels that may be
learnt from. Where these are all positive it is estimated from the bins: no part of U can
hold more positives than documents, so the smallest ratio of U's share to P's share over
bins that hold enough of P bounds it. Gradients are sums over all rows, taken by the executors; the weights are a
few hundred numbers.

Defined results: NULL and empty texts get the score of their bins; a row without id is
scored, and learnt from as unlabelled; an id with several labels is trusted if all of them
are positive; rows that repeat an id count each; without trusted positives all scores are
the prior's default; texts of any length are described whole, and an empty table gives an empty one.
Extra columns pass through, whatever their names; the score takes the place of a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.columns import given_back, number_of, numbered
from assayline.llm.shingles import windows, word_hashes
from assayline.session import write_through

QUANTILES = (0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.7, 0.85, 0.93, 0.97, 0.99)
STEPS, RATE, DECAY = 60, 0.25, 1e-4
LEAST_SHARE = 0.02  # share of the positives that a bin must hold to bound the prior
DEFAULT_PRIOR = 0.5
LIMIT = 0.7
CHUNK = 256

MEASURES = (
    "log_words", "word_chars", "distinct", "repeated", "same_next", "symbols", "signs", "digits", "capitals", "line_words", "repeated_lines", "sentence_ends",
    "short_words", "long_words", "most_common", "wide_chars",
)
_SYMBOLS, _SIGNS, _DIGITS, _ENDS = b"#*$%&|<>", b"=+_~^{}[]\\/@`", b"0123456789", b".!?"
_CAPITALS = bytes(range(65, 91))


def measures(text: str | None) -> list[float]:
    """The measures of a whole text, in order of ``MEASURES``; all 0 without words."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    hashes = word_hashes(words)
    distinct, counts = np.unique(hashes, return_counts=True)
    runs = windows(hashes, 3)
    repeated = 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    size = int(lengths.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]

    def share(characters: bytes) -> float:
        return (len(data) - len(data.translate(None, characters))) / size

    return [
        float(np.log1p(n)), size / n, len(distinct) / n, repeated, float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0,
        share(_SYMBOLS), share(_SIGNS), share(_DIGITS), share(_CAPITALS), n / len(lines), 1 - len(set(lines)) / len(lines), share(_ENDS) * size / n,
        float((lengths <= 2).mean()), float((lengths > 14).mean()), float(counts.max()) / n, (len(data) - len(text)) / size,
    ]


def describe(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, x): measures of every row, as an array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                found = [measures(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], names=["id", "x"])

    return docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id long, x array<double>")


def held_out(id: str = "doc_id"):
    """Rows whose labels must not be learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """Bin edges per measure, weights per measure and bin, and the estimated prior."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Position in the weights of each row's bin of each measure."""
        width = len(QUANTILES) + 1
        return np.stack([np.searchsorted(e, x[:, i], side="left") + i * width for i, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.weights[self.bins(x)].sum(axis=1) + self.bias)))

    def score_described(self, rows: DataFrame) -> DataFrame:
        """(id, score) of described rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(self.scores(_matrix(batch.column(1))))], names=["id", "score"])

        return rows.select("id", "x").mapInArrow(run, "id long, score double")

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """Add column ``out``; one pass, no shuffle."""
        source = numbered(docs)
        position = docs.columns.index(text)
        schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(start, CHUNK)
                    found = self.scores(np.array([measures(t) for t in part.column(position).to_pylist()]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=schema.fieldNames())

        return given_back(source.mapInArrow(run, schema), docs.columns, {out: "score"})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(MEASURES))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", allowed=None) -> tuple[Model, DataFrame]:
    """Model, and the written measures (id, x) it was learnt from.

    ``allowed``: condition over the labels; others are not learnt from (default: not held out).
    """
    described = write_through(describe(docs, id, text), "measures")
    trusted = labels.where(~held_out(id) if allowed is None else allowed).groupBy(F.col(f"`{id}`").cast("long").alias("id")).agg(F.min(label).alias("label"))
    trusted = write_through(trusted, "labels")
    known, good = trusted.agg(F.count("label"), F.count_if(F.col("label") == 1)).first()
    trusted = trusted.where("label = 1").select("id", F.lit(True).alias("positive"))
    rows = described.join(trusted, "id", "left").select(F.coalesce("positive", F.lit(False)).alias("positive"), "x")
    cuts = rows.agg(*[F.percentile_approx(F.col("x")[i], list(QUANTILES), 20_000).alias(f"e{i}") for i in range(len(MEASURES))]).first()
    if cuts["e0"] is None:
        return Model([np.zeros(len(QUANTILES))] * len(MEASURES), np.zeros(len(MEASURES) * (len(QUANTILES) + 1)), 0.0, DEFAULT_PRIOR), described
    edges = [np.array(cuts[f"e{i}"]) for i in range(len(MEASURES))]
    model = Model(edges, np.zeros(len(MEASURES) * (len(QUANTILES) + 1)), 0.0, DEFAULT_PRIOR)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.bins(_matrix(batch.column(1))).astype(np.uint8 if len(model.weights) <= 256 else np.uint16)
            rows_of = codes.tobytes()
            size = codes.shape[1] * codes.itemsize
            values = pa.array([rows_of[i * size : (i + 1) * size] for i in range(len(codes))], pa.binary())
            yield pa.RecordBatch.from_arrays([values, batch.column(0)], names=["codes", "positive"])

    # Rows with the same bins are alike to the model: they are counted before the first step.
    cells = rows.mapInArrow(binned, "codes binary, positive boolean").groupBy("codes").agg(F.count("*").alias("u"), F.count_if("positive").alias("p"))
    cells = write_through(cells, "cells")
    return minimise(model, cells, good / known if good < known else None), described


def minimise(model: Model, cells: DataFrame, prior: float | None) -> Model:
    """Full-batch descent (Adam) on the non-negative risk; every step sums over all rows."""
    size = len(model.weights)
    kind = np.uint8 if size <= 256 else np.uint16

    def summed(weights: np.ndarray, bias: float) -> np.ndarray:
        """Per bin and for the bias, of P and of U: sums of 1, sigmoid; and of both losses."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((4, size + 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind).reshape(batch.num_rows, -1)
                z = weights[codes].sum(axis=1) + bias
                s = 1 / (1 + np.exp(-z))
                for k, n in enumerate((batch.column(2).to_numpy(), batch.column(1).to_numpy())):
                    for j, w in enumerate((n.astype(float), n * s)):
                        total[2 * k + j, :size] += np.bincount(codes.ravel(), np.repeat(w, codes.shape[1]), minlength=size)
                        total[2 * k + j, size] += w.sum()
                    total[2 * k, size + 1] += (n * np.logaddexp(0, z)).sum()
                    total[2 * k + 1, size + 1] += (n * np.logaddexp(0, -z)).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = cells.select("codes", "u", "p").mapInArrow(run, "total binary").toArrow()["total"].to_pylist()
        return sum((np.frombuffer(p).reshape(4, size + 2) for p in parts), np.zeros((4, size + 2)))

    weights, bias = np.zeros(size), 0.0
    total = summed(weights, bias)
    n_p, n_u = total[0, size], total[2, size]
    if not n_p:
        return model
    if prior is None:
        share_p, share_u = total[0, :size] / n_p, total[2, :size] / n_u
        enough = share_p >= LEAST_SHARE
        ratio = share_u[enough] / share_p[enough] * (1 + 1 / np.sqrt(total[0, :size][enough]))
        prior = ratio.min(initial=1.0)
    prior = float(np.clip(prior, 0.05, 0.99))
    bias = float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        total = summed(weights, bias)
        # Mean gradients of the losses for + on P, for - on P and for - on U.
        plus_p = (total[1, : size + 1] - total[0, : size + 1]) / n_p
        minus_p, minus_u = total[1, : size + 1] / n_p, total[3, : size + 1] / n_u
        negative_risk = total[2, size + 1] / n_u - prior * total[0, size + 1] / n_p
        part = minus_u - prior * minus_p
        gradient = prior * plus_p + part if negative_risk >= 0 else -part
        gradient = gradient + DECAY * np.append(weights, 0.0)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
        weights, bias = weights - move[:size], bias - float(move[size])
    return Model(model.edges, weights, bias, prior)


def filter_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose score reaches ``limit``; columns as given."""
    model, _ = fit(docs, labels, id, text)
    scored = model.score(numbered(docs), number_of(docs, text), "score")
    return given_back(scored.where(F.col("score") >= limit), docs.columns)
