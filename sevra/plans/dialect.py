"""The few places where Spark's and the checking engine's SQL differ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    div: str


SPARK, DUCK = Dialect("div"), Dialect("//")


def computed(df: DataFrame, steps: list[list[tuple[str, str]]]) -> DataFrame:
    """Add the columns of steps of (name, SQL); each step sees the one before.

    A step is the single row of an inlined struct. Filters and projections
    above it aren't rewritten in terms of what it computes from, which would
    repeat its expressions once for every use, and again at the next step.
    """
    for step in steps:
        names = [n for n, _ in step]
        df = df.select(*(c for c in df.columns if c not in names), F.inline(F.array(F.struct(*(F.expr(s).alias(n) for n, s in step)))))
    return df
