"""Grade notes as they arrive: the same projections over a stream, which need no state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.grading import graded


def grade_stream(spark: SparkSession, source: str, schema: StructType, sink: str, state: str) -> StreamingQuery:
    """Read Parquet files of cases from a folder, grade all that are there, and append the grades to another."""
    rows = graded(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
