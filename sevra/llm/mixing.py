"""Operator 10: mixing sources to target weights.

The words of each source are packed into blocks of BLOCK words, documents in
the order of a hash of key and text. The mix is SHARDS output shards of slots,
a block each. Each shard draws from a multinomial how many of its slots every
source gets, with the targets as probabilities, and takes so many of its own
stretch of the source's places (see _slots, which also says how the source
meets its target). Place k is block (step * k + shift) mod blocks, a
pseudorandom permutation of the source's blocks. So the draws decide how many
blocks of each stretch are taken, the permutation which ones these are. Blocks
join their documents by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, n_words

#: Words per block, output shards, most times that a word is taken, seed of order, draws and permutations, most sources (one row each on the driver), slots made by a task at once.
BLOCK, SHARDS, MOST, SEED, MAX_SOURCES, RUN = 64, 256, 3, 20240229, 100_000, 1 << 16


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; a target stops at most times its size, the excess goes to the others by weight."""
    left, open_ = float(sum(sizes)), {i for i, w in enumerate(weights) if w > 0}
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * float(sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def permutation(source: str | None, blocks: int, seed: int) -> tuple[int, int]:
    """(step, shift) of a source's permutation of its blocks; step has no factor in common with blocks, and step * blocks fits 62 bits."""
    g = np.random.default_rng([seed, crc32(b"\x00" if source is None else b"s" + source.encode())])
    most = max(2, min(blocks, (1 << 62) // max(1, blocks)))
    step = int(g.integers(1, most))
    while gcd(step, blocks) > 1:
        step = step % most + 1
    return step, int(g.integers(0, max(1, blocks)))


def plan(totals: list[tuple[str | None, int]], weights, whole: bool = False, seed: int = SEED) -> list[dict]:
    """Per source: source_size, target, blocks, slots (those that meet the target), step and shift. One row per source only."""
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in order], [float(weights(s, i)) for i, (s, _) in enumerate(order)])
    out = []
    for (source, size), t in zip(order, goal, strict=True):
        blocks = -(-size // BLOCK)
        slots = min(MOST * blocks, round(t / (size / blocks))) if size else 0
        step, shift = (1, 0) if whole else permutation(source, blocks, seed)
        out.append({"source": source, "source_size": size, "target": t, "blocks": blocks, "slots": slots, "step": step, "shift": shift})
    return out


def draw(shard: int, slots: list[int], seed: int, shards: int = SHARDS) -> np.ndarray:
    """Slots of each source in a shard."""
    total = sum(slots)
    return np.random.default_rng([seed, shard]).multinomial(total // shards + (shard < total % shards), np.array(slots) / max(1, total))


def _slots(spark: SparkSession, sources: list[dict], seed: int, shards: int) -> DataFrame:
    """(source number, shard, slot), drawn shard by shard.

    The places of a source's permutation are dealt over the shards, each a
    stretch of its own. A shard takes its stretch from the front: as many
    places as it drew slots, passing through it again where it drew more. So
    that the source meets its target to a block and none is taken more than
    once beyond another, a shard's number is held between the whole passes
    that all make and one more; of what is then too much the last shards give
    up, and what is missing the first shards with room take.
    """
    goal = [x["slots"] for x in sources]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = draw(shard, goal, seed, shards)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(np.full(len(n), shard)), pa.array(n)], ["i", "shard", "n"])

    drawn = spark.range(shards if sum(goal) else 0).mapInArrow(run, "i long, shard long, n long")
    goals = F.broadcast(spark.createDataFrame([(i, x["slots"], x["blocks"], x["slots"] // x["blocks"]) for i, x in enumerate(sources) if x["slots"]], "i long, goal long, blocks long, passes long"))  # one row per source
    edge = lambda k: F.floor(k * F.col("blocks") / F.lit(shards)).cast("long")
    per = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(per), F.lit(0))
    rows = drawn.join(goals, "i").withColumn("at", edge(F.col("shard"))).withColumn("len", edge(F.col("shard") + 1) - F.col("at")).withColumn("left", F.col("goal") - F.col("passes") * F.col("blocks"))
    rows = rows.withColumn("want", F.least("len", F.greatest(F.lit(0), F.col("n") - F.col("passes") * F.col("len"))))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least("want", F.col("left") - before("want")))).withColumn("room", F.col("len") - F.col("part"))
    rows = rows.withColumn("lacking", F.col("left") - F.sum("part").over(Window.partitionBy("i"))).withColumn("part", F.col("part") + F.greatest(F.lit(0), F.least("room", F.col("lacking") - before("room"))))
    # A pass over the whole stretch each, then the part.
    passes = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda p: F.struct((p * F.col("blocks") + F.col("at")).alias("first"), F.when(p < F.col("passes"), F.col("len")).otherwise(F.col("part")).alias("n")))
    runs = rows.select("i", "shard", F.explode(passes).alias("r")).select("i", "shard", "r.*").where("n > 0")
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN)))).repartition("i", "shard", "run")
    from_ = F.col("first") + F.col("run") * RUN
    return runs.select("i", F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(from_, F.least(F.col("first") + F.col("n"), from_ + RUN) - 1)).alias("slot"))


def default_weights(source: str | None, place: int) -> float:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    return place % 3 + 1


def _placed(df: DataFrame, key: str, text: str, source: str, weights, whole: bool, seed: int, steps: Steps, row=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their words' places in the source, slots with their blocks, sources)."""
    spark = df.sparkSession
    s, t = F.col(f"`{source}`").cast("string"), F.col(f"`{text}`")
    rows = df.select(F.col(f"`{key}`").alias("k"), s.alias("s"), n_words(t).alias("size"), F.xxhash64(F.col(f"`{key}`"), t, F.lit(seed)).alias("h"), (F.lit(None).cast("long") if row is None else row).alias("id"))
    parts = max(256, df.count() // 50_000)
    rows = steps.staged(rows.withColumn("part", F.pmod("h", F.lit(parts))))
    sums = steps.staged(rows.groupBy("s", "part").agg(F.sum("size").alias("n")))
    # One row per source; plan() checks their number.
    totals = sums.groupBy("s").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    planned = plan([(r["s"], r["n"]) for r in totals], weights, whole, seed)
    schema = "i long, src string, source_size long, target double, blocks long, step long, shift long"
    sources = F.broadcast(spark.createDataFrame([(i, x["source"], x["source_size"], x["target"], x["blocks"], x["step"], x["shift"]) for i, x in enumerate(planned)], schema))
    # Places of words within a source: sums of parts first, then rows within a part, so that no source is one group.
    before = sums.select(F.col("s").alias("s2"), F.col("part").alias("p2"), (F.sum("n").over(Window.partitionBy("s").orderBy("part")) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("s", "part").orderBy("h", "k", "size", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("size").over(inside)).join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2"))).join(sources, F.col("s").eqNullSafe(F.col("src")))
    placed = placed.select("k", "s", "i", "size", "id", "source_size", "target", (F.col("offset") + F.col("end") - F.col("size")).alias("a"), (F.col("offset") + F.col("end")).alias("b"), F.monotonically_increasing_id().alias("row"))
    slots = _slots(spark, planned, seed, 1 if whole else SHARDS).join(sources.select("i", "blocks", "step", "shift"), "i")
    slots = slots.select("i", "shard", "slot", F.pmod(F.pmod("slot", "blocks") * F.col("step") + F.col("shift"), "blocks").alias("block"))
    return steps.staged(placed), slots, sources


def _spans(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots joined by index with the documents that their blocks hold words of."""
    touched = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("b") - 1) / BLOCK))))
    begin, end = F.greatest(F.col("a"), F.col("block") * BLOCK), F.least(F.col("b"), (F.col("block") + 1) * BLOCK)
    return touched.join(slots, ["i", "block"]).select("row", "k", "s", "shard", "slot", "block", (begin - F.col("a")).alias("first_word"), (end - begin).alias("n_words"))


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=default_weights, seed: int = SEED) -> DataFrame:
    """The mix: one row per slot and document in it, with shard, source, slot, block, key, first_word and n_words of the document.

    Null and blank texts are in no slot; a null source is a source of its own,
    last in order. Rows that repeat a key are told apart by nothing here. An
    empty table gives none.
    """
    placed, slots, _ = _placed(df, key, text, source, weights, False, seed, Steps())
    return _spans(placed, slots).select("shard", F.col("s").alias("source"), "slot", "block", F.col("k").alias(key), "first_word", "n_words")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=default_weights, seed: int = SEED) -> DataFrame:
    """One row per row of df: key, size, source_size, target, taken (words that the mix takes, repeats counted), n_shards (output shards it is in).

    Null and blank texts have size 0 and are never taken; a null source is a
    source of its own, last in order. Rows that repeat a key count each by
    itself. A source's taken words differ from its target by less than a
    block, plus what its last, shorter block lacks; no row exceeds MOST times
    its size. Other columns of df are not read. An empty table gives none.
    """
    return _mixed(df, key, text, source, weights, False, seed).select(F.col("k").alias(key), "size", "source_size", "target", "taken", "n_shards")


def _mixed(df: DataFrame, key: str, text: str, source: str, weights, whole: bool, seed: int, row=None) -> DataFrame:
    steps = Steps()
    placed, slots, _ = _placed(df, key, text, source, weights, whole, seed, steps, row)
    # At most SHARDS shards per row.
    taken = _spans(placed, slots).groupBy("row").agg(F.sum("n_words").alias("taken"), F.size(F.collect_set("shard")).alias("n_shards"))
    steps.drop_but(placed)
    return placed.join(taken, "row", "left").na.fill(0, ["taken", "n_shards"])


def resampled(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=default_weights, seed: int = SEED) -> DataFrame:
    """df as the mix takes it, in whole rows: each row as often as its words are taken, rounded; columns stay.

    Here blocks keep their order, which is that of a hash of the documents: the
    permutation acts on documents, and there is one shard, so that a pass over
    part of a source takes whole ones, all but the one at its end. A source's words differ from its
    target by at most half of that row and a block. Rows are told apart by
    their place, not by key: null and repeated keys stay, each row by itself.
    Columns of any name stay as they are. An empty table gives none.
    """
    steps = Steps()
    rows = steps.staged(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("r"), F.monotonically_increasing_id().alias("id")))
    flat = rows.select(F.col(f"r.`{key}`").alias("k"), F.col(f"r.`{text}`").alias("t"), F.col(f"r.`{source}`").alias("s"), "id")
    copies = _mixed(flat, "k", "t", "s", weights, True, seed, F.col("id")).where("taken > 0").select("id", F.round(F.col("taken") / F.col("size")).cast("int").alias("n")).where("n > 0")
    return rows.join(copies, "id").withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).select("r.*")
