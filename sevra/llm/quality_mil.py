"""Operator 4: quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Every passage is measured
(shape of words, symbols, capitals, repetition) and encoded by a learnt tanh
layer; gated attention weights the encodings, and a logistic unit scores the
weighted sum. Encoder, attention and unit are learnt together from the
labels of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textvec import U, Words, slices

#: Words of a passage, most labelled rows that are learnt from, width of encoding and attention.
PASSAGE, MAX_LABELLED, MAX_CHARS, WIDTH, GATE = 64, 4000, 200_000, 16, 8
N_FEATURES = 13


def passages(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, measures) of every passage in order; a text without words has one passage of zeros."""
    n = np.diff(w.first)
    per = np.maximum(1, -(-n // PASSAGE))
    doc = np.repeat(np.arange(w.n_docs), per)
    out = np.zeros((len(doc), N_FEATURES))
    if not len(w.start):
        return doc, out
    first_passage = np.concatenate(([0], np.cumsum(per)))
    of_word = first_passage[w.doc] + (np.arange(len(w.doc)) - w.first[w.doc]) // PASSAGE
    count = lambda x: np.bincount(of_word, x, minlength=len(doc))

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return count(total[w.end] - total[w.start])

    raw = w.raw
    words = np.maximum(1, np.bincount(of_word, minlength=len(doc)))
    size = np.maximum(1.0, count(w.end - w.start))
    capital = (raw >= 65) & (raw <= 90)
    accent = np.zeros(len(raw), bool)
    accent[1:] = (raw[:-1] == 0xC3) & (raw[1:] < 0x9F)
    punct = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))
    symbol = np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8))
    same1, same2 = np.zeros(len(w.hash)), np.zeros(len(w.hash))
    same1[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
    same2[2:] = (w.hash[2:] == w.hash[:-2]) & (of_word[2:] == of_word[:-2])
    keys = np.sort((of_word.astype(U) << U(40)) | (w.hash >> U(24)))
    fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
    distinct = np.bincount((keys[fresh] >> U(40)).astype(np.int64), minlength=len(doc))
    end = raw[w.end - 1]
    out[:, 0] = np.log1p(np.bincount(of_word, minlength=len(doc)))
    out[:, 1] = size / words
    out[:, 2] = per_word(capital | accent) / size
    out[:, 3] = per_word(symbol) / size
    out[:, 4] = per_word((raw >= 48) & (raw <= 57)) / size
    out[:, 5] = per_word(punct & ~symbol) / size
    out[:, 6] = per_word(raw == 33) / words
    out[:, 7] = count(same1) / words
    out[:, 8] = count(same2) / words
    out[:, 9] = distinct / words
    out[:, 10] = count(np.isin(end, np.frombuffer(b".!?", np.uint8)).astype(float)) / words
    out[:, 11] = count(np.isin(raw[w.start], np.frombuffer(b"|#*$%&<>", np.uint8)).astype(float)) / words
    out[:, 12] = per_word(raw >= 128) / size
    return doc, out


class Model:
    """Parameters, and the score of bags."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {"W": g.normal(0, 0.3, (N_FEATURES, WIDTH)), "b": np.zeros(WIDTH), "V": g.normal(0, 0.3, (WIDTH, GATE)), "G": g.normal(0, 0.3, (WIDTH, GATE)), "a": g.normal(0, 0.3, GATE), "c": g.normal(0, 0.3, WIDTH), "d": np.zeros(1)}

    def forward(self, doc: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        """doc: sorted bag numbers from 0 without gaps."""
        p, starts = self.p, np.searchsorted(doc, np.arange(doc[-1] + 1))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["G"]))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        w = e / np.add.reduceat(e, starts)[doc]
        z = np.add.reduceat(w[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "w": w, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.forward(doc, self.normal(x))["y"]


def train(doc: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the mean cross-entropy of bags. Without bags of both labels, the bias alone says which there are."""
    m = Model()
    if len(set(y.tolist())) < 2:
        m.p["c"][:] = 0
        m.p["d"][:] = 3.0 if len(y) and y[0] == 1 else (-3.0 if len(y) else 0.0)
        return m
    m.mean, m.scale = x.mean(0), x.std(0) + 1e-6
    x, p = m.normal(x), m.p
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    starts = np.searchsorted(doc, np.arange(doc[-1] + 1))
    for step in range(1, epochs + 1):
        f = m.forward(doc, x)
        dy = (f["y"] - y) / len(y)
        dz = dy[:, None] * p["c"]
        dzp = dz[doc]
        dw = (dzp * f["h"]).sum(1)
        de = f["w"] * (dw - np.add.reduceat(f["w"] * dw, starts)[doc])
        dts = de[:, None] * p["a"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["w"][:, None] * dzp + dt @ p["V"].T + ds @ p["G"].T) * (1 - f["h"] ** 2)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "G": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}
        for k in p:
            g = grad[k] + decay * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, w in slices(batch.column(2)):
            doc, x = passages(w)
            cuts = np.searchsorted(doc, np.arange(to - at + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["k", "y", "x"])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from at most MAX_LABELLED labelled keys, those with the smallest hash. Rows without a label and texts of over MAX_CHARS are passed over; of repeated keys the largest label and the smallest text count. Empty tables give a model of the bias alone."""
    small_batches(docs.sparkSession)
    rows = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("k")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("y")).orderBy(F.xxhash64("k"), "k").limit(MAX_LABELLED)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("x")).join(F.broadcast(rows), "k").groupBy("k").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    got = rows.where(F.coalesce(F.length("x"), F.lit(0)) <= MAX_CHARS).select("k", "y", "x").mapInArrow(_collect, "k long, y int, x binary").toPandas()
    got = got.sort_values("k", kind="stable")
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"]]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags]) if bags else np.zeros(0, int)
    return train(doc, np.concatenate(bags).astype(float) if bags else np.zeros((0, N_FEATURES)), got["y"].to_numpy(int))


def scored(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, repeated ones too; null and empty texts are one passage of zeros. Texts are read whole; other columns are not read. An empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(model.score(*passages(w)))], [key, "score"])

    small_batches(df.sparkSession)
    return df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("x")).mapInArrow(run, f"{key} long, score double")
