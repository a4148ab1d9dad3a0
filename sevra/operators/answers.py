"""A store of models' answers, keyed by case, model and prompt version, that is asked only for what it lacks.

The store is a Parquet folder by model and prompt version; a row is one
attempt at a case: the answer, or the error that came instead. Asking goes
batch by batch, each one append: a run that breaks off keeps the batches it has
committed, and the next run asks for the rest. Only a case that was in flight
when its task was lost is asked again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged

ROW = "case_id long, payload string, error string, run string"
STORED = f"{ROW}, model string, prompt_version string"
#: Batches of a run, and failed attempts at a case after which it is left alone.
BATCHES, ATTEMPTS = 8, 3
#: Letters kept of an error's text.
ERROR_LENGTH = 500


def attempts(spark: SparkSession, store: str) -> DataFrame:
    """All rows of a store; none where nothing has been stored yet."""
    spark.createDataFrame([], STORED).write.mode("append").partitionBy("model", "prompt_version").parquet(store)
    return spark.read.schema(STORED).parquet(store)


def answers(spark: SparkSession, store: str) -> DataFrame:
    """One row per case, model and prompt version: payload (null as long as every attempt failed), the last error, n_failed.

    Where a case has been answered more than once, the answer of the smallest run id counts, then the smallest.
    """
    rows = attempts(spark, store)
    answer = F.min(F.when(F.col("payload").isNotNull(), F.struct("run", "payload")))["payload"]
    return rows.groupBy("case_id", "model", "prompt_version").agg(answer.alias("payload"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("run"))).alias("error"), F.count("error").alias("n_failed"))


def lacking(prompts: DataFrame, store: str, model: str, prompt_version: str, most: int = ATTEMPTS) -> DataFrame:
    """The prompts (case_id, prompt) that this model and prompt version have no answer to, without those that failed `most` times."""
    done = answers(prompts.sparkSession, store).where((F.col("model") == model) & (F.col("prompt_version") == prompt_version))
    return prompts.join(done.where(F.col("payload").isNotNull() | (F.col("n_failed") >= most)).select("case_id"), "case_id", "left_anti")


def _asking(client, run: str):
    def of(frames):
        ask = client()
        for pdf in frames:
            out = []
            for case, prompt in zip(pdf["case_id"], pdf["prompt"], strict=True):
                try:
                    out.append((case, str(ask([prompt])[0]), None, run))
                except Exception as e:  # any failure of a model is a row of its own
                    out.append((case, None, f"{type(e).__name__}: {e}"[:ERROR_LENGTH], run))
            yield pd.DataFrame(out, columns=["case_id", "payload", "error", "run"])

    return of


def ask(prompts: DataFrame, client, store: str, model: str, prompt_version: str, run: str, batches: int = BATCHES, most: int = ATTEMPTS) -> int:
    """Ask for what the store lacks, and append it; returns how many cases were asked.

    prompts: case_id, prompt; one prompt per case (of repeated ones the
    smallest is asked), null prompts are not asked. client: makes, once per
    task, a function from a list of prompts to a list of answers. A failed
    attempt is stored with its error and tried again by the next run, until
    there are `most` of them. An empty table asks nothing.
    """
    one = prompts.where("case_id is not null and prompt is not null").groupBy("case_id").agg(F.min("prompt").alias("prompt"))
    todo = staged(lacking(one, store, model, prompt_version, most).withColumn("batch", F.pmod(F.xxhash64("case_id"), F.lit(batches)).cast("int")), "batch")
    sizes = {r["batch"]: r["n"] for r in todo.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a row per batch
    for batch in sorted(sizes):
        rows = todo.where(F.col("batch") == batch).select("case_id", "prompt").repartition(prompts.sparkSession.sparkContext.defaultParallelism).mapInPandas(_asking(client, run), ROW)
        rows.withColumns({"model": F.lit(model), "prompt_version": F.lit(prompt_version)}).write.mode("append").partitionBy("model", "prompt_version").parquet(store)
    return sum(sizes.values())
