"""Operator 7: exact dedup by skew-safe combining, with DataFrame functions only.

Texts are deduplicated locally, digest groups are merged per salt, and salt
winners are combined by digest; every stage groups by the whole text, the
digest only places the rows. Membership is joined by digest, which is exact
wherever a digest has one text; digests shared by different texts are joined
by text as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Salts per digest in the middle stage, and the share of all rows from which a group is joined by broadcast (at most so many groups).
SALTS, HEAVY_GROUPS = 16, 20_000


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text; equal means identical. The largest key of
    a group stays; a repeated key counts as often as it occurs. A null key is
    below all others; a group of null keys only keeps null. An empty table
    gives none.
    """
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_d", F.unhex(F.sha2("_t", 256)))
    # Local and salted: the salt is the input partition, so each task has combined its copies before the shuffle.
    salted = rows.withColumn("_s", F.spark_partition_id() % SALTS).groupBy("_d", "_s", "_t").agg(F.max("_k").alias("_k"), F.count("*").alias("_n"))
    # Salt winners meet by digest and are compared by text.
    winners = salted.repartition("_d").groupBy("_d", "_t").agg(F.max("_k").alias("_k"), F.sum("_n").alias("_n"))
    groups = staged(winners.groupBy("_d").agg(F.max("_k").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_texts")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    clean = groups.where("_texts = 1").drop("_texts")
    heavy_from = max(1000, total // HEAVY_GROUPS)
    # At most HEAVY_GROUPS groups can hold that many rows, so this side's size is bounded.
    heavy = F.broadcast(clean.where(F.col("group_size") >= heavy_from).withColumnsRenamed({"keep_id": "_hk", "group_size": "_hn"}))
    light = clean.where(F.col("group_size") < heavy_from)
    named = rows.select("_k", "_d").join(heavy, "_d", "left")
    out = named.where("_hn is not null").select("_k", F.col("_hk").alias("keep_id"), F.col("_hn").alias("group_size"), "_d")
    out = out.unionByName(named.where("_hn is null").select("_k", "_d").join(light, "_d").select("_k", "keep_id", "group_size", "_d"))
    if groups.where("_texts > 1").limit(1).count():
        shared = groups.where("_texts > 1").select("_d")
        by_text = rows.join(shared, "_d", "left_semi").groupBy("_d", "_t").agg(F.max("_k").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(rows.join(by_text, ["_d", "_t"]).select("_k", "keep_id", "group_size", "_d"))
    return out.select(F.col("_k").alias(key), "keep_id", "group_size", F.col("_k").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_d")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, the one with the largest key; columns stay.

    Null counts as the empty text and stays null in the row that is kept. Of
    rows that share text and key, the one with the largest other columns
    stays; these must be of types that Spark can order. Winners carry their
    columns along, so whole texts move twice and no join follows.
    """
    others = [c for c in df.columns if c not in (key, text)]
    row = F.struct(F.col(key).alias("_k"), F.col(text).isNull().alias("_null"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)))
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("_t"), row.alias("_r")).withColumn("_d", F.unhex(F.sha2("_t", 256)))
    salted = rows.withColumn("_s", F.spark_partition_id() % SALTS).groupBy("_d", "_s", "_t").agg(F.max("_r").alias("_r"))
    won = salted.repartition("_d").groupBy("_d", "_t").agg(F.max("_r").alias("_r"))
    columns = {key: F.col("_r._k"), text: F.when(~F.col("_r._null"), F.col("_t"))} | {c: F.col(f"_r._{i}") for i, c in enumerate(others)}
    return won.select(*(columns[c].alias(c) for c in df.columns))
