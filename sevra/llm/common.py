"""Shared helpers: tables, staging in the shared folder, bound expressions, ASCII words."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only in local mode, as in tests, a temporary one is set where there is none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sevra")
        spark.sparkContext.setCheckpointDir(at)
    return at


def small_batches(spark: SparkSession, mb: int = 8, rows: int = 2000) -> None:
    """Lower the session's Arrow batches to so many MB and rows, so that workers hold little text at a time."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def prefiltered_joins(spark: SparkSession) -> None:
    """Let Spark put a Bloom filter of the smaller side (a megabyte, however many keys) before the shuffle of the larger one, where that is a table of over 1 MB. The smaller side needs a filter of its own."""
    for key, value in (("enabled", "true"), ("applicationSideScanSizeThreshold", "1MB"), ("creationSideThreshold", "10GB")):
        spark.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{key}", value)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage: Spark then deletes the shuffle files of results that nothing refers to, and the heap shrinks."""
    spark.sparkContext._jvm.System.gc()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"


def staged(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder (at: a folder of its own there) and read it back: cuts the lineage and outlives lost executors."""
    at = at or _folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Steps:
    """Staged tables of one run. drop_but deletes those that the result doesn't read; what it reads stays, as checkpoints do."""

    def __init__(self):
        self.tables: list[tuple[DataFrame, str]] = []

    def staged(self, df: DataFrame) -> DataFrame:
        at = _folder(df.sparkSession)
        self.tables.append((staged(df, at), at))
        return self.tables[-1][0]

    def drop_but(self, *kept: DataFrame) -> None:
        keep = {id(x) for x in kept}
        for df, at in self.tables:
            if id(df) not in keep:
                path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = [x for x in self.tables if id(x[0]) in keep]


def let(value: Column, body) -> Column:
    """Evaluate value once per row and bind it, so that the lambdas in body don't evaluate it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def n_words(text: Column) -> Column:
    """The number of words, without building them: runs of other characters become one mark."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ \\t-\\r]+", "\u0001"), "[ \\t-\\r]+", "")).cast("long")


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo mod."""
    return F.crc32(key.cast("string")) % mod


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int | None = None, most: int = 20_000) -> DataFrame:
    """rows inner join groups (one short row per key) without a hot key in any shuffle.

    Groups with over 1/most of all members, and 1000 at least, are at most
    `most` in number, so broadcasting them is bounded; all others meet in a
    shuffle. Both must be cheap to read twice. total: the members of all groups, where it is known.
    """
    total = (groups.agg(F.sum(size)).first()[0] or 0) if total is None else total
    least = max(1000, total // most)
    heavy = F.broadcast(groups.where(F.col(size) >= least))
    tagged = rows.join(F.broadcast(groups.where(F.col(size) >= least).select(*on, F.lit(True).alias("_hot"))), on, "left")
    return rows.join(heavy, on).unionByName(tagged.where("_hot is null").drop("_hot").join(groups.where(F.col(size) < least), on))


def components(links: DataFrame, outer: Steps | None = None) -> DataFrame:
    """(node, label) of all nodes in links (a, b): label is the smallest node reachable.

    Minimum labels flow along links and jump to their label's label, so the number of rounds
    is logarithmic for chains; each round is written to the shared folder. The hub of a
    star and the label of a large component are joined as heavy groups. outer:
    the steps that the result's own table belongs to.
    """
    steps = Steps()
    links = steps.staged(links.select(F.col("a"), F.col("b")).union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = steps.staged(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("links")).select("node", F.least("node", "m").alias("label"), "links"))
    n_links, n_nodes = links.count(), labels.count()
    while True:
        around = join_groups(links, labels.select(F.col("node").alias("b"), F.col("label").alias("m"), "links"), ["b"], "links", n_links)
        low = labels.join(around.groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m")), "node")
        low = steps.staged(low.select("node", "label", "links", F.least("label", "m").alias("low")))
        if not low.where("low < label").limit(1).count():
            steps.drop_but(low)
            if outer is not None:
                outer.tables += steps.tables
            return low.select("node", "label")
        # Every label is a node, so the label that a label has now is found among the nodes.
        ups = steps.staged(low.groupBy("low").agg(F.count("*").alias("members")).join(low.select(F.col("node").alias("low"), F.col("low").alias("up")), "low"))
        labels = steps.staged(join_groups(low, ups, ["low"], "members", n_nodes).select("node", F.least("low", "up").alias("label"), "links"))
