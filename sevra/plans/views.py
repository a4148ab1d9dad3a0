"""The dashboard's tables as temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rubric import CHEST, PAIN, PRIAPISM, SPLEEN
from ..operators import metrics
from ..sources.staging import staged

PROFILE = {"pain": PAIN, "chest": CHEST, "spleen": SPLEEN, "priapism": PRIAPISM}


def patient_view(df: DataFrame) -> DataFrame:
    """One row per case: patient, note, outcome, both grades, evidence, rationale, confidence, review flag. df: parsed answers with needs_review."""
    return df.select(
        "case_id", "patient_id", "note_text", "outcome", "gold_grade", "predicted_grade", F.array_join("answered_evidence", "; ").alias("evidence"), F.col("answered_rationale").alias("rationale"),
        "confidence", F.col("needs_review").alias("human_review"), F.abs(F.col("predicted_grade") - F.col("gold_grade")).alias("distance"),
    )


#: What stands before the names of registered views.
PREFIX = "sevra_"


def publish(graded: DataFrame, answers: DataFrame, prefix: str = PREFIX) -> list[str]:
    """Register the views of graded cases (with human_review) and reviewed answers; returns their names, prefix included. A view of that name is replaced.

    Graded cases are worked out once and written to the shared folder, as are
    the cells that all counts derive from; answers are computed when their view is read.
    """
    rows = staged(graded.drop("note_text"))
    cells = staged(metrics.cells(rows, "outcome"))
    views = {
        "patient_view": patient_view(answers), "severity_profile": metrics.severity_profile(rows, list(PROFILE.values()), list(PROFILE)), "severity_trajectory": metrics.trajectory(rows.where("predicted_grade >= 1")),
        "grade_distribution": metrics.distribution_of_cells(cells, "predicted_grade", "outcome"), "outcome_distribution": metrics.distribution_of_cells(cells, "outcome"), "truth_vs_predicted": metrics.confusion_of_cells(cells, "outcome"),
        "accuracy_by_outcome": metrics.accuracy_of_cells(cells, "outcome"), "confusion_matrix": metrics.confusion_matrix_of_cells(cells), "flagged_cases": rows.where("human_review"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in views]
