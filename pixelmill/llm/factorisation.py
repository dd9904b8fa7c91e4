"""A quality classifier: a factorisation machine on hashed words, text structure and length.

score = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pair term is taken in linear
time as half the sum over factors of (sum v_if x_i)**2 - sum (v_if x_i)**2.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.arrays import Words, lists, texts
from pixelmill.llm.line_frequency import Lines, repeated_words

BUCKETS = 1 << 15
BINS = 16
_STATS = 14
N_FEATURES = BUCKETS + _STATS * BINS


class Features(NamedTuple):
    """Sparse rows: feature numbers and values, and each text's range in them."""

    index: np.ndarray
    value: np.ndarray
    range: np.ndarray


def _share(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in spans:
        out[a:b] = True
    return out


_UPPER, _LOWER, _DIGIT = _class((65, 91)), _class((97, 123)), _class((48, 58))
_PUNCT = _class((33, 48), (58, 65), (91, 97), (123, 127))
_HIGH, _PIPE, _BANG = _class((128, 256)), _class((124, 125)), _class((33, 34))


def featurise(data: np.ndarray, offsets: np.ndarray) -> Features:
    """Of each text: its words, weighted to length 1 together, and its statistics in bins."""
    w = Words(data, offsets, lower=True)
    n_docs, n = len(offsets) - 1, w.counts
    code = w.doc() * BUCKETS + (w.hashes % np.uint64(BUCKETS)).astype(np.int64)
    pair, tf = np.unique(code, return_counts=True)
    doc, bucket = pair // BUCKETS, pair % BUCKETS
    x = np.log1p(tf)
    norm = np.sqrt(np.bincount(doc, x * x, n_docs))
    x = x / np.maximum(norm[doc], 1e-9)

    size = np.diff(offsets)
    lines = Lines(w)
    n_lines = np.diff(lines.range)
    length = w.ends - w.starts
    distinct = np.bincount(doc, minlength=n_docs)

    def per_byte(flags: np.ndarray) -> np.ndarray:
        return _share(flags[data], offsets) / np.maximum(size, 1)

    stats = [
        np.log1p(n) / 10,
        np.log1p(size) / 12,
        _share(length, w.range) / np.maximum(n, 1) / 20,
        per_byte(_UPPER) * 4,
        per_byte(_LOWER),
        per_byte(_DIGIT) * 10,
        per_byte(_PUNCT) * 4,
        per_byte(_HIGH) * 3,
        per_byte(_PIPE) * 10,
        per_byte(_BANG) * 10,
        repeated_words(w) / np.maximum(n, 1),
        lines.repeated() / np.maximum(n_lines, 1),
        distinct / np.maximum(n, 1),
        np.log1p(n_lines) / 8,
    ]
    binned = [BUCKETS + k * BINS + np.clip(s * BINS, 0, BINS - 1).astype(np.int64) for k, s in enumerate(stats)]
    index = np.concatenate([bucket, np.stack(binned, axis=1).ravel()])
    value = np.concatenate([x, np.full(n_docs * _STATS, 0.5)])
    doc = np.concatenate([doc, np.repeat(np.arange(n_docs), _STATS)])
    order = np.argsort(doc, kind="stable")
    return Features(index[order], value[order], np.searchsorted(doc[order], np.arange(n_docs + 1)))


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and each text's sums over factors."""
        starts = f.range[:-1]  # every text has its statistics, so no range is empty
        vx = self.factors[f.index] * f.value[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx * vx, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[f.index] * f.value, starts) + pairs, sums

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(f)[0], -30, 30)))


def _some(f: Features, rows: np.ndarray) -> Features:
    counts = np.diff(f.range)[rows]
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1])) + np.repeat(f.range[rows] - ends + counts, counts)
    return Features(f.index[at], f.value[at], np.concatenate([[0], ends]))


def fit(f: Features, y: np.ndarray, factors: int, steps: int, rate: float, decay: float, batch: int = 256) -> Model:
    """Logistic loss by Adam on mini-batches in a fixed pseudo-random order."""
    rng = np.random.RandomState(7)
    p = np.zeros((N_FEATURES, 1 + factors))
    p[:, 1:] = rng.normal(0, 0.05, (N_FEATURES, factors))
    m, v = np.zeros_like(p), np.zeros_like(p)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    step = 0
    while step < steps:
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            rows = order[a : a + batch]
            b, step = _some(f, rows), step + 1
            raw, sums = Model(bias, p[:, 0], p[:, 1:]).raw(b)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            counts = np.diff(b.range)
            e = np.repeat(err, counts) * b.value
            own = p[b.index, 1:] * b.value[:, None]
            grad = decay * p
            np.add.at(grad, b.index, e[:, None] * np.hstack([np.ones((len(e), 1)), np.repeat(sums, counts, axis=0) - own]))
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            bias -= rate * float(err.sum())
    return Model(bias, p[:, 0].copy(), p[:, 1:].copy())


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in texts(batch, "text"):
            f = featurise(data, offsets)
            cols = [lists(f.index, f.range, pa.int32()), lists(f.value, f.range, pa.float64())]
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *cols], ["label", "place", "index", "value"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    most: int = 20_000,
    factors: int = 8,
    steps: int = 600,
    rate: float = 0.02,
    decay: float = 1e-5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Model:
    """A model of ``label`` from the labelled documents, at most ``most`` of them.

    The bound is on what the one training task holds; the documents are those whose ids have
    the smallest hashes. A document of several labels has their mean, rounded; null labels
    and labels without a document are left out. Without any label all scores are even.
    """
    # by hash of the id, so that the choice does not depend on order; ids only
    ids = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.round(F.avg(label)).cast("double").alias("label")
    )
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")
    rows = rows.dropDuplicates(["_id"]).select("label", F.xxhash64("_id").alias("place"), "text")
    kinds = "label double, place long, index array<int>, value array<double>"
    found = rows.mapInArrow(_featurised, kinds).withColumn("_all", F.lit(0))

    def learn(part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        values = [np.concatenate([np.asarray(x) for x in part.column(c).to_pylist()]) for c in ("index", "value")]
        sizes = [len(x) for x in part.column("index").to_pylist()]
        f = Features(values[0].astype(np.int64), values[1], np.concatenate([[0], np.cumsum(sizes)]))
        model = fit(f, part.column("label").to_numpy(), factors, steps, rate, decay)
        raw = [np.concatenate([[model.bias], model.linear, model.factors.ravel()]).astype("<f4").tobytes()]
        return pa.table({"model": pa.array(raw, pa.binary())})

    got = found.groupBy("_all").applyInArrow(learn, "model binary").collect()
    if not got:
        return Model(0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, factors)))
    p = np.frombuffer(got[0]["model"], dtype="<f4").astype(np.float64)
    return Model(float(p[0]), p[1 : 1 + N_FEATURES], p[1 + N_FEATURES :].reshape(N_FEATURES, factors))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from the whole text alone; null is as empty.

    Empty texts are scored by their statistics. Repeated rows and null ids get a row each.
    The model, of fixed size, is broadcast. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts(batch, "text"):
                s = shared.value.score(featurise(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s)], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")
