"""Agreement of any number of raters, with missing ratings: Krippendorff's alpha and intervals by a bootstrap over cases.

A case is a vector: how many raters gave each grade. Cases with the same vector
are counted together, once as they are and once per replicate with weights
drawn from Poisson(1), which stand for drawing cases with replacement. A draw
is made of digits of a digest of case and number, so it needs no state, and a
case has the same draws wherever it is worked out. Alpha needs sums over vectors only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import GRADES

#: Replicates, and the percentages of them below and above the interval.
REPLICATES, TAIL = 40, 2.5
#: Of 65536 equally likely draws, those up to the k-th of these have weight k: the distribution of Poisson(1), rounded.
WEIGHTS = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)
_PER_DIGEST = 8
METRICS = {"nominal": lambda a, b: float(a != b), "interval": lambda a, b: float((a - b) ** 2)}


def weights(case: Column, replicates: int = REPLICATES) -> Column:
    """Array of a case's weights, one per replicate: eight from each digest of the case and a number."""
    digests = F.array(*(F.md5(F.concat_ws(":", case.cast("string"), F.lit(str(k)))) for k in range(-(-replicates // _PER_DIGEST))))
    # Digits of one length and case compare as their numbers do, and a digest is bound, so that it is worked out once for all of its draws.
    of = lambda h: reduce(lambda low, t: low.when(h < f"{t[1]:04x}", t[0]), enumerate(WEIGHTS[1:], 1), F.when(h < f"{WEIGHTS[0]:04x}", 0)).otherwise(len(WEIGHTS)).cast("long")
    drawn = F.flatten(F.transform(digests, lambda d: F.transform(F.array(*(F.substr(d, F.lit(4 * j + 1), F.lit(4)) for j in range(_PER_DIGEST))), of)))
    return drawn if replicates % _PER_DIGEST == 0 else F.slice(drawn, 1, replicates)


def alpha(ratings: DataFrame, *by: str, grades: tuple[int, ...] = GRADES, metric: str = "nominal", replicates: int = REPLICATES) -> DataFrame:
    """One row per group: cases (those with two ratings or more), ratings (theirs), alpha, low, high.

    ratings: case_id, rater, grade and the columns of by; a null grade is a
    missing rating. Two ratings of a case by one rater count as two. Grades
    outside of `grades` are an error. Alpha is null where all ratings are one
    grade or no case has two. low and high: the TAIL and 100 - TAIL percent
    points, by rank, of the replicates that have an alpha. An empty table gives
    none. Two shuffles: by case, then of few vectors.
    """
    distance = METRICS[metric]
    d = F.array(*(F.array(*(F.lit(distance(a, b)) for b in grades)) for a in grades))
    known = F.when(F.col("grade").isin(*grades), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such grade: "), F.col("grade").cast("string"))).cast("boolean"))
    given = ratings.where("grade is not null and case_id is not null").where(known)
    vectors = given.groupBy(*by, "case_id").agg(F.array(*(F.count(F.when(F.col("grade") == g, 1)) for g in grades)).alias("v"), F.count("*").alias("m")).where("m >= 2")
    places = F.array(*(F.lit(i) for i in range(len(grades))))
    all_ = F.concat(F.array(F.lit(1).cast("long")), weights(F.col("case_id"), replicates))
    # One sum per replicate and vector; the first is the plain count.
    sums = vectors.select(*by, "v", "m", all_.alias("w")).groupBy(*by, "v", "m").agg(F.array(*(F.sum(F.col("w")[r]) for r in range(replicates + 1))).alias("w"))
    cross = lambda v: F.aggregate(places, F.lit(0.0), lambda s, i: s + F.aggregate(places, F.lit(0.0), lambda t, j: t + v[i] * v[j] * d[i][j]))
    rows = sums.withColumn("apart", cross(F.col("v")) / (F.col("m") - 1)).select(*by, "v", "m", "apart", F.posexplode("w").alias("r", "n"))
    per = rows.groupBy(*by, "r").agg(F.sum("n").alias("cases"), F.sum(F.col("n") * F.col("m")).alias("ratings"), F.sum(F.col("n") * F.col("apart")).alias("apart"), F.array(*(F.sum(F.col("n") * F.col("v")[i]) for i in range(len(grades)))).alias("v"))
    per = per.withColumn("alpha", 1 - (F.col("ratings") - 1) * F.col("apart") / F.nullif(cross(F.col("v")), F.lit(0.0)))
    drawn = F.sort_array(F.collect_list(F.when(F.col("r") > 0, F.col("alpha"))))  # a row per replicate
    plain = lambda c: F.max(F.when(F.col("r") == 0, F.col(c))).alias(c)
    out = per.groupBy(*by).agg(plain("cases"), plain("ratings"), plain("alpha"), drawn.alias("drawn"))
    n = F.size("drawn")
    at = lambda share: F.try_element_at("drawn", F.greatest(F.lit(1), F.ceil(n * share / 100).cast("int")))
    return out.select(*by, "cases", "ratings", "alpha", at(TAIL).alias("low"), at(100 - TAIL).alias("high"))
