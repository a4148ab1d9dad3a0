"""Operator 9: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or absent: words, their first letters (which
unite inflected forms), neighbouring words and pairs with one word between.
Per-coordinate rates and an L1 term leave few weights other than 0; they are
sorted into a compact table that goes out with the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textvec import U, Words, mix, slices

#: Buckets of the hashed features, bytes of a word's beginning, most labelled rows that are learnt from, and longest text among them, so that they fit a task.
BITS, STEM, MAX_LABELLED, MAX_CHARS = 22, 5, 6000, 50_000


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence."""
    same = lambda k: w.doc[k:] == w.doc[:-k] if len(w.doc) > k else np.zeros(0, bool)
    docs, keys = [w.doc, w.doc], [w.hash, mix(w.part(w.start, np.minimum(w.end, w.start + STEM)), 3)]
    for k, seed in ((1, 5), (2, 7)):
        both = same(k)
        docs.append(w.doc[k:][both])
        keys.append(mix(w.hash[:-k][both] * U(0x9E3779B97F4A7C15) + w.hash[k:][both], seed))
    return np.concatenate(docs), (np.concatenate(keys) >> U(64 - BITS)).astype(np.int64)


@dataclass
class Weights:
    """Buckets with a weight other than 0, and the bias."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -30.0

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.values
        return out


def train(rows: list[tuple[int, np.ndarray]], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.05) -> Weights:
    """FTRL-proximal over (label, distinct buckets), in the order given.

    alpha and l1 were chosen with choose, by folds within the learning rows.

    The bias isn't learnt: it is the log-odds of the share of label 1, taken as 0.2 at most, so that
    a text without features isn't rejected. Without rows of both labels only the bias is set.
    """
    labels = {y for y, _ in rows}
    if len(labels) < 2:
        return Weights(bias=5.0 if labels == {1} else -5.0)
    share = min(0.2, sum(y for y, _ in rows) / len(rows))
    bias = float(np.log(share / (1 - share)))
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for _ in range(epochs):
        for y, x in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0, -(zx - np.sign(zx) * l1) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
    # Only where there is a weight: whole arrays of each step would be the driver's largest objects.
    at = np.flatnonzero((z > l1) | (z < -l1))
    z, n = z[at], n[at]
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    return Weights(at.astype(np.int32), w.astype(np.float32), bias)


def choose(rows: list[tuple[int, np.ndarray]], grid: list[dict], folds: int = 3, threshold: float = 0.3) -> list[tuple[float, float, dict]]:
    """(F1 at threshold, log loss, settings of train) of each entry of grid, best first, by folds within rows.

    Row i belongs to fold i mod folds. Pass learning rows only: held-out rows must not choose the settings.
    F1 decides, log loss breaks ties.
    """
    out = []
    for settings in grid:
        y, p = [], []
        for k in range(folds):
            w = train([r for i, r in enumerate(rows) if i % folds != k], **settings)
            table = w.dense()
            y += [r[0] for r in rows[k::folds]]
            p += [1 / (1 + np.exp(-np.clip(table[x].sum() + w.bias, -30, 30))) for _, x in rows[k::folds]]
        label, score = np.array(y), np.array(p)
        hit = int(((score >= threshold) & (label == 1)).sum())
        f1 = 2 * hit / max(1, int((score >= threshold).sum() + (label == 1).sum()))
        loss = float(-np.log(np.where(label == 1, score, 1 - score).clip(1e-9)).mean()) if y else 0.0
        out.append((f1, loss, settings))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, w in slices(batch.column(2)):
            doc, bucket = features(w)
            both = np.unique((doc.astype(np.int64) << BITS) | bucket)
            cuts = np.searchsorted(both >> BITS, np.arange(to - at + 1))
            ids = (both & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["k", "y", "x"])


def learning_rows(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", docs: DataFrame | None = None) -> list[tuple[int, np.ndarray]]:
    """(label, distinct buckets) of at most MAX_LABELLED rows, those with the smallest hash of the key, in a fixed mixed order.

    docs: a table with key and text, if labelled has none. Rows without a label
    and texts of over MAX_CHARS are passed over; of rows that share a key, the
    largest label and the smallest text count. Empty tables give none.
    """
    return _in_order(_features(labelled, key, text, label, docs).toArrow())


def _features(labelled: DataFrame, key: str, text: str, label: str, docs: DataFrame | None) -> DataFrame:
    """(k, y, x) of learning_rows: key, label and distinct buckets as bytes."""
    small_batches(labelled.sparkSession)
    y = F.col(f"`{label}`").cast("int").alias("y")
    own = [] if docs is not None else [F.col(f"`{text}`").alias("x")]
    rows = labelled.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("k"), y, *own)
    rows = rows.groupBy("k").agg(F.max("y").alias("y"), *([] if docs is not None else [F.min("x").alias("x")])).orderBy(F.xxhash64("k"), "k").limit(MAX_LABELLED)
    if docs is not None:  # at most MAX_LABELLED rows of two numbers
        rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("x")).join(F.broadcast(rows), "k").groupBy("k").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    rows = rows.where(F.coalesce(F.length("x"), F.lit(0)) <= MAX_CHARS)
    return rows.select("k", "y", "x").mapInArrow(_collect, "k long, y int, x binary")


def _in_order(got: pa.Table) -> list[tuple[int, np.ndarray]]:
    """(label, distinct buckets) of rows (k, y, x), in the fixed mixed order."""
    order = np.argsort(mix(got["k"].to_numpy().view(U), 11), kind="stable") if len(got) else []
    label, buckets = got["y"].to_numpy(), got["x"].combine_chunks()
    return [(int(label[i]), np.frombuffer(buckets[i].as_buffer(), np.int32)) for i in order]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = pa.Table.from_batches(batches, pa.schema({"k": pa.int64(), "y": pa.int32(), "x": pa.binary()}))
    w = train(_in_order(got))
    yield pa.RecordBatch.from_arrays([pa.array([w.buckets.tobytes()], pa.binary()), pa.array([w.values.tobytes()], pa.binary()), pa.array([w.bias])], ["buckets", "vals", "bias"])


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", docs: DataFrame | None = None) -> Weights:
    """Weights from learning_rows. One task trains on these (at most MAX_LABELLED); only the weights reach the driver."""
    rows = _features(labelled, key, text, label, docs).repartition(1)
    got = rows.mapInArrow(_train, "buckets binary, vals binary, bias double").first()
    if got is None:
        return train([])
    return Weights(np.frombuffer(got["buckets"], np.int32), np.frombuffer(got["vals"], np.float32), got["bias"])


def scored(df: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, repeated ones too; null and empty texts get the score of the bias. Texts are read whole; other columns are not read. An empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.dense()
        for batch in batches:
            for at, to, w in slices(batch.column(1)):
                doc, bucket = features(w)
                hit = np.flatnonzero(table[bucket])
                both = np.unique((doc[hit].astype(np.int64) << BITS) | bucket[hit])
                total = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], minlength=to - at) + weights.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], [key, "score"])

    small_batches(df.sparkSession)
    return df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("x")).mapInArrow(run, f"{key} long, score double")


def drop_toxic(df: DataFrame, weights: Weights, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without rows scored threshold or more; columns stay, repeated keys and rows included; each row is judged by its own text, a null or empty one by the bias. An empty table stays empty."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, column = weights.dense(), names.index(text)
        for batch in batches:
            for at, to, w in slices(batch.column(column)):
                doc, bucket = features(w)
                hit = np.flatnonzero(table[bucket])
                both = np.unique((doc[hit].astype(np.int64) << BITS) | bucket[hit])
                total = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], minlength=to - at) + weights.bias
                yield batch.slice(at, to - at).filter(pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))) < threshold))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
