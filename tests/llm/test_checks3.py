"""What the checks of round 3 found: texts that no bucket holds were shuffled, and the driver kept more than it needed."""

from pyspark.sql import DataFrame

from sevra.llm import minhash, toxicity
from sevra.llm.common import table

SF = "/root/testdata/sf0.01"


def test_texts_are_filtered_before_their_shuffle_and_shuffles_are_released(spark, monkeypatch):
    plans, released, staged = [], [], minhash.Steps.staged
    monkeypatch.setattr(minhash.Steps, "staged", lambda self, df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), staged(self, df))[1])
    monkeypatch.setattr(minhash, "release", released.append, raising=False)
    monkeypatch.setattr(minhash, "TURNS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        minhash.near_duplicates(table(spark, SF, "documents"), size=3, percent=85)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("might_contain" in p and "LeftSemi" in p for p in plans)
    assert released


def test_learning_rows_come_without_pandas(spark, monkeypatch):
    def refuse(self):
        raise AssertionError("rows go through pandas")

    monkeypatch.setattr(type(spark.range(0)), "toPandas", refuse)
    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    rows = toxicity.learning_rows(table(spark, SF, "labels"), docs=table(spark, SF, "documents"))
    assert rows and all(y in (0, 1) and x.dtype == "int32" for y, x in rows)
    assert toxicity.learning_rows(table(spark, SF, "labels").limit(0), docs=table(spark, SF, "documents")) == []
