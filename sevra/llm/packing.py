"""Operator 2: conflict-constrained best-fit packing of documents into bins of CAPACITY words.

Rows are dealt over shards by a hash of the key, so a hot source or a large
group of copies spreads evenly. Within a shard, pieces are placed from the
largest: bins are ordered by residual, and each carries a bitmap of its
sources and one of its duplicate clusters. The search starts at the tightest
bin that has room and goes on to its successors until one is compatible: it
holds no member of the piece's cluster and, with the piece, at most
MAX_SOURCES sources.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, staged

#: Words per bin, sources per bin, and rows per shard (about).
CAPACITY, MAX_SOURCES, SHARD_ROWS = 2048, 8, 4000


class _Bins:
    """Bins ordered by (residual, number); bitmaps by number."""

    def __init__(self, most_sources: int):
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.most = most_sources

    def place(self, size: int, source: int, cluster: int, capacity: int) -> int:
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, b = self.order[at]
            if not self.clusters[b] & cluster and (self.sources[b] | source).bit_count() <= self.most:
                del self.order[at]
                break
            at += 1
        else:
            room, b = capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if room > size:
            insort(self.order, (room - size, b))
        return b


def pack_rows(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, most_sources: int = MAX_SOURCES) -> list[int]:
    """Bin numbers of the rows of one shard, placed from the largest; ties go by position. Clusters: None has no conflicts; only repeated ones need a bit."""
    bits: dict = {}
    names: dict = {}
    count: dict = {}
    for c in clusters:
        if c is not None:
            count[c] = count.get(c, 0) + 1
    bins, out = _Bins(most_sources), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        c = clusters[i]
        cluster = 1 << bits.setdefault(c, len(bits)) if c is not None and count[c] > 1 else 0
        out[i] = bins.place(sizes[i], 1 << names.setdefault(sources[i], len(names)), cluster, capacity)
    return out


def packed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, most_sources: int = MAX_SOURCES) -> DataFrame:
    """One row per piece: key, copy, piece, first_word, n_words, bin_id, bin_words.

    A text of more than capacity words is cut into full pieces, which fill a
    bin each, and a last one that is packed. Null and blank texts have one
    piece of no words, bin_id null. A null source is a source like any other.
    cluster: column with the duplicate cluster (null: none); by default equal
    texts are one. Rows that repeat key, text and source are copies 0, 1, 2 ...
    and conflict like other copies. A null key is a key like any other, and
    rows that share a key otherwise are packed each by itself. An empty table gives none.
    """
    c = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if cluster is None else F.xxhash64(F.col(cluster).cast("string"))
    if cluster is not None:
        c = F.when(F.col(cluster).isNotNull(), c)
    rows = df.select(F.col(key).cast("long").alias("k"), n_words(F.col(text)).alias("n"), F.xxhash64(F.coalesce(F.col(source).cast("string"), F.lit("\u0000"))).alias("s"), c.alias("c"))
    # Equal rows become one with a count, so that numbering copies needs no window over a group.
    rows = rows.groupBy("k", "n", "s", "c").agg(F.count("*").alias("copies"))
    rows = staged(rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).drop("copies"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("k", "copy", "n", "s", "c"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        # Nulls stay in Arrow: pandas would turn their columns into floats, which lose digits.
        no_cluster, keys = t.column("c").is_null().to_numpy(), t.column("k").combine_chunks()
        t = pa.table([*(pc.fill_null(t.column(x), 0) for x in t.column_names), pa.array(np.arange(len(t)))], [*t.column_names, "at"]).to_pandas()
        for shard, part in t.groupby("shard"):
            part = part.sort_values(["n", "k", "copy", "c", "s"], ascending=[False, True, True, True, True], kind="stable")
            full = part["n"].to_numpy() // capacity
            tail = part["n"].to_numpy() - full * capacity
            clusters = [None if none else c for c, none in zip(part["c"].tolist(), no_cluster[part["at"]], strict=True)]
            some = np.flatnonzero(tail)
            bins = np.full(len(part), -1, np.int64)
            n_full = int(full.sum())
            if len(some):
                bins[some] = np.array(pack_rows(tail[some].tolist(), part["s"].to_numpy()[some].tolist(), [clusters[i] for i in some], capacity, most_sources)) + n_full
            filled = np.bincount(bins[some] - n_full, tail[some]).astype(np.int64) if len(some) else np.zeros(0, np.int64)
            k, copy = keys.take(pa.array(part["at"].to_numpy())), part["copy"].to_numpy()
            pieces = []  # (row, piece, words, bin, words of the bin)
            at = 0
            for i in range(len(part)):
                for p in range(full[i]):
                    pieces.append((i, p, capacity, at, capacity))
                    at += 1
                if bins[i] >= 0:
                    pieces.append((i, int(full[i]), int(tail[i]), int(bins[i]), int(filled[bins[i] - n_full])))
                elif not full[i]:
                    pieces.append((i, 0, 0, None, None))
            row = [x[0] for x in pieces]
            base = int(shard) << 32
            columns = [k.take(pa.array(row, pa.int64())), pa.array(copy[row], pa.int32()), pa.array([x[1] for x in pieces], pa.int32()), pa.array([x[1] * capacity for x in pieces], pa.int64()), pa.array([x[2] for x in pieces], pa.int64()), pa.array([None if x[3] is None else base + x[3] for x in pieces], pa.int64()), pa.array([x[4] for x in pieces], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "copy", "piece", "first_word", "n_words", "bin_id", "bin_words"])

    schema = f"{key} long, copy int, piece int, first_word long, n_words long, bin_id long, bin_words long"
    return rows.repartition(shards, "shard").mapInArrow(run, schema)
