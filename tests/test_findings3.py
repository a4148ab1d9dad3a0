"""What a review of round 3 found in the grader."""

import hashlib

from pyspark.sql import functions as F

from sevra.functions.rubric import CORE, parsed
from sevra.operators import grading, raters
from sevra.plans import queries
from sevra.sources import synthetic


def test_weights_digest_a_case_once_for_eight_draws(spark):
    df = spark.range(50).select(F.col("id").alias("case_id"), raters.weights(F.col("id")).alias("w"), raters.weights(F.col("id"), 11).alias("few"))
    assert spark.range(1).select(raters.weights(F.col("id")).alias("w"))._jdf.queryExecution().analyzed().toString().count("md5(") == -(-raters.REPLICATES // 8)
    for r in df.collect():
        digits = "".join(hashlib.md5(f"{r['case_id']}:{k}".encode()).hexdigest() for k in range(5))
        assert r["w"] == [sum(int(digits[4 * i : 4 * i + 4], 16) >= t for t in raters.WEIGHTS) for i in range(40)]
        assert r["few"] == r["w"][:11]


def test_notes_are_read_once_for_several_rubrics(spark):
    cases = synthetic.cases(spark.range(400).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp_seconds(id) AS ts"))
    other = parsed(queries._changed_text())
    both = grading.predicted_by(cases, {"before": CORE, "after": other})
    assert both._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    one, two = (grading.predicted(cases, rubric=r).select("case_id", F.col("predicted_grade").alias(n)) for r, n in ((CORE, "before"), (other, "after")))
    got = sorted(map(tuple, both.select("case_id", "before", "after").collect()))
    assert got == sorted(map(tuple, one.join(two, "case_id").select("case_id", "before", "after").collect())) and any(b != a for _, b, a in got)


def test_rules_from_file_reads_notes_once(spark):
    plan = queries.q_rules_from_file(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
