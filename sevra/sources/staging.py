"""Tables that are computed once and read several times, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path in spark.checkpoint.dir. Only in local mode, as in tests, one is made where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sevra")
    return f"{at.rstrip('/')}/table-{uuid.uuid4().hex}"


def staged(df: DataFrame, *by: str) -> DataFrame:
    """df written as a table, in folders by some columns, and read back: what follows neither repeats its work nor depends on its lineage."""
    at = folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
