"""Rubric files: one JSON or YAML mapping keyed by outcome name, with some keys that aren't outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rubric import Rubric, parsed
from .yaml_subset import as_json

ENTRY = "outcome string, booklet_page int, definition string, diagnostic_criteria string, validation string, grades map<string,string>"


def _as_json(frames):
    for pdf in frames:
        yield pdf.assign(value=[as_json(v, f) for v, f in zip(pdf["value"], pdf["file"], strict=True)])


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """One row per outcome and grade of a file, a folder or a glob, with the file it came from. Keys that start with _ are left out.

    Read as whole text, each file by one task, and parsed in two steps, since
    the keys are data and one value is a plain string. YAML (see yaml_subset)
    becomes JSON first; bad indentation and the like is an error with file and line.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(_as_json, "file string, value string")
    entries = text.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("key", "body")).where(~F.startswith("key", F.lit("_")))
    e = entries.select("file", F.from_json("body", ENTRY).alias("e")).select("file", "e.*")
    return e.select("outcome", "booklet_page", "definition", "diagnostic_criteria", "validation", "file", F.explode("grades").alias("g", "criterion")).withColumn("g", F.col("g").cast("int")).withColumnRenamed("g", "grade")


#: Most files of rules; their text goes to the driver.
MAX_FILES = 100


def read_rules(spark: SparkSession, path: str) -> Rubric:
    """The rubric with its conditions from a file, a folder or a glob, to grade by (see functions.rubric.parsed).

    Files are taken in order of their names. More than MAX_FILES of them, and whatever a condition must not hold, are errors.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").limit(MAX_FILES + 1).collect()
    if len(files) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files")
    return parsed(*(as_json(r["value"], r["file"]) for r in sorted(files, key=lambda r: r["file"])))
