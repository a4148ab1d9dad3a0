"""Episodes of patients as their encounters arrive, as sessions with state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.metrics import episode_totals

#: How much later than newer ones an encounter may arrive.
LATE = "30 minutes"


def episode_stream(spark: SparkSession, source: str, schema: StructType, sink: str, state: str, late: str = LATE, files: int = 1) -> StreamingQuery:
    """Read Parquet files of graded encounters (patient_id, ts, predicted_grade) from a folder and append each episode once the watermark has passed its end.

    Encounters that come later than `late` behind the newest are left out. Rows without ts are in no episode. files: files read at once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return episode_totals(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
