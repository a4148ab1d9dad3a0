"""Where results go: predictions by run, metrics by name, endpoints by outcome, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(predictions: DataFrame, path: str, run_id: str) -> None:
    """Predictions of a run, in a folder of its own; writing a run again replaces it and leaves the others."""
    predictions.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_metrics(metrics: DataFrame, path: str, name: str) -> None:
    """A metric table by its name; written again, it replaces the former one."""
    metrics.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def write_answers(df: DataFrame, path: str, column: str = "answer_json") -> None:
    """Predictions in JSON, one on a line (see structured.serialised)."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_endpoints(graded: DataFrame, path: str) -> None:
    """Grades as a dataset partitioned by outcome."""
    graded.write.mode("overwrite").partitionBy("outcome").parquet(path)


def add_cells(cells: DataFrame, path: str, run_id: str) -> None:
    """Metric cells of a run (see metrics.cells) beside those of others; writing a run again replaces its cells, so none counts twice."""
    write_predictions(cells, path, run_id)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all runs, with run_id; metrics of any grouping add them up."""
    return spark.read.parquet(path)
