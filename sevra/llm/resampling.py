"""Operator 13: importance resampling towards a target distribution.

Runs of words are hashed into buckets. A bucket's gain is the logarithm of how
much likelier the target is to use it than the raw rows are; gains are one
array, and a row's weight is the mean over its features. A Gumbel draw, made
from the key, turns weights into scores, so that the highest scores are a
sample without replacement. The draw needs no global sort: a histogram of the
integer scores, summed from above, says how many rows lie above each score,
hence where the cutoff is and at which rank each score begins; within a score
row_number by key does the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, small_batches

#: Buckets, shortest and longest run of words, percent drawn, fewest words of a drawn row, seed of the draw.
BUCKETS, RUNS, PERCENT, LEAST_WORDS, SEED = 10_000, (1, 1), 10, 20, 2024
#: Words [0-9a-z] and all beyond ASCII, A-Z lowered; everything else separates. On UTF-8 this is byte by byte.
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words whose gain a task remembers.
_KNOWN = 1 << 19


def features(text: bytes | None, runs: tuple[int, int] = RUNS) -> tuple[int, list[bytes]]:
    """(number of words, features): the runs of so many words of a text in UTF-8; none for null."""
    words = (text or b"").translate(_LOWERED).split()
    if runs == (1, 1):
        return len(words), words
    return len(words), [b" ".join(words[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(words) - n + 1)]


class _Known(dict):
    """Gains by feature, looked up in the array once per feature."""

    def __init__(self, gains: list[int]):
        self.gains = gains

    def __missing__(self, feature: bytes) -> int:
        self[feature] = gain = self.gains[crc32(feature) % len(self.gains)]
        return gain


def bucket_counts(df: DataFrame, text: str = "text", runs: tuple[int, int] = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows. At most a row per bucket and task is shuffled, and a row per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for t in batch.column(0).cast(pa.large_binary()).to_pylist():
                counts.update(features(t, runs)[1])
            for feature, n in counts.items():
                total[crc32(feature) % buckets] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    small_batches(df.sparkSession)
    out = np.zeros(buckets, np.int64)
    for r in df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """Per bucket 1000 times the logarithm of the smoothed shares' ratio, floored."""
    s, t = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return [floor(1000 * log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)]


def _weighed(gain: list[int], runs: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(gain)
        for batch in batches:
            out = []
            for t in batch.column(1).cast(pa.large_binary()).to_pylist():
                n, found = features(t, runs)
                out.append((n, len(found), sum(map(known.__getitem__, found)) // len(found) if found else 0))
                if len(known) > _KNOWN:
                    known.clear()
            n, m, w = (pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, m, w], ["k", "n_words", "n_features", "weight"])

    return run


def gumbel(key: Column, seed: int = SEED) -> Column:
    """The draw of a key in thousandths: -ln(-ln(u)), u from the first 32 bits of a digest of seed and key. A null key counts as the empty text."""
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """One row per row of df: key, n_features, weight, score, rank (1 for the highest score; null for those not drawn).

    Of the rows with at least least_words words, floor(percent / 100) of their
    number are drawn: the highest scores, ties to the smaller key. A null text
    has no words; a null key counts as the empty text in the draw and as larger
    than all others in ties. Rows that repeat a key are drawn each by itself,
    ties among them by weight and number of features. An empty table gives
    none; an empty target is a target that prefers no bucket. Other columns
    are not read.
    """
    gain = gains(bucket_counts(df, text, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    steps = Steps()
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(_weighed(gain, runs), f"k {df.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long")
    rows = steps.staged(rows.withColumn("score", F.col("weight") + gumbel(F.col("k"), seed)))
    able = F.col("n_words") >= least_words
    # Scores are whole numbers: a gain is within 1000 * ln(2^126), a draw between -3,200 and 23,000, so the histogram has under 210,000 rows at any size.
    bars = sorted(((r["score"], r["n"]) for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = percent * sum(n for _, n in bars) // 100
    above, offsets = 0, []
    for score, n in bars:
        if above >= left:
            break
        offsets.append((score, above))
        above += n
    cutoff = offsets[-1][0] if offsets else None
    survives = able & (F.col("score") >= F.lit(cutoff).cast("long")) if offsets else F.lit(False)
    begins = F.broadcast(rows.sparkSession.createDataFrame(offsets, "score long, above long"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("k").asc_nulls_last(), "weight", "n_features"))
    drawn = rows.where(survives).withColumn("place", place).join(begins, "score").withColumn("rank", F.col("above") + F.col("place"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= left, F.col("rank")))
    names = [F.col("k").alias(key), "n_features", "weight", "score", "rank"]
    out = drawn.select(*names).unionByName(rows.where(~F.coalesce(survives, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).select(*names))
    steps.drop_but(rows)
    return out
