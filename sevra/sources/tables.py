"""Cases in files of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rubric import OUTCOMES

#: Bytes per core under which an input is spread.
SMALL = 4 << 20
CASE = "case_id long, patient_id long, stage string, outcome string, gold_grade int, note_text string"


def read_cases(spark: SparkSession, path: str, schema: str = CASE) -> DataFrame:
    """Cases from CSV with a header; notes may hold line breaks and quotes. A row that doesn't fit the schema is an error, not a null."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")


#: Why a row of the raw area is set aside, in this order: SQL that holds for it.
REASONS = (
    ("does not fit the schema", "_bad IS NOT NULL"), ("no case_id", "case_id IS NULL"), ("no such outcome", "outcome IS NULL OR NOT array_contains(_outcomes, outcome)"), ("no note", "note_text IS NULL OR trim(note_text) = ''"),
    ("grade outside of -1 to 5", "gold_grade IS NOT NULL AND NOT gold_grade BETWEEN -1 AND 5"),
)


def read_raw(spark: SparkSession, path: str, outcomes: tuple[str, ...] = tuple(OUTCOMES), lines: bool = False, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cases, set aside) of the CSV files of a raw area: every row is in one of them, and no row ends the job.

    set aside: file, row (as written, or as JSON where it could be read), reason (see REASONS). lines: notes
    may hold line breaks; a file is then read by one task. Files are only read.
    """
    names = [c.split()[0] for c in CASE.split(", ")]
    raw = spark.read.csv(path, schema=f"{CASE}, _bad string", header=header, multiLine=lines, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    rows = raw.select(*names, "_bad", F.col("_metadata.file_path").alias("file"), F.array(*map(F.lit, outcomes)).alias("_outcomes"))
    reason = F.coalesce(*(F.when(F.expr(sql), F.lit(name)) for name, sql in REASONS))
    judged = rows.select(*names, "file", F.coalesce("_bad", F.to_json(F.struct(*names))).alias("row"), reason.alias("reason"))
    return judged.where("reason is null").select(*names), judged.where("reason is not null").select("file", "row", "reason")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input, of which the plan knows that it is under a task's share for each core, over all cores; any other input as it is."""
    spark, plan = df.sparkSession, getattr(df, "_jdf", None)
    if plan is None:  # a remote session, where the plan's size is not at hand
        return df
    cores = int(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
