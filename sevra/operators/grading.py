"""Rule grader: note -> facts -> gate -> grade, evidence, rationale and review flags, in one projection chain without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import reading
from ..functions.rubric import CORE, OUTCOMES, REQUIRED, Rubric, quoted
from ..plans.dialect import computed

#: Review triggers: no rule matches; a phrase denied and asserted; several rules; criteria missing; ambiguous; a grade that the rubric leaves unsaid.
TRIGGERS = ("q1", "q2", "q3", "q4", "q5", "guard")
#: What graded() adds.
ADDED = ("predicted_grade", "evidence", "rationale", *TRIGGERS, "human_review")


def grade_columns(rubric: Rubric = CORE, facts: str = "", prefix: str = "") -> list[list[tuple[str, str]]]:
    """Steps of (name, SQL) from facts to predicted_grade; facts: what stands before a fact's name; prefix: what the names added begin with."""
    return [[(f"{prefix}present", rubric.present_sql(facts)), (f"{prefix}criteria", rubric.criteria_sql(facts)), (f"{prefix}rule_grade", rubric.rule_grade_sql(facts))], [(f"{prefix}predicted_grade", rubric.grade_sql(prefix))]]


def reason_columns(rubric: Rubric = CORE, facts: str = "", contains: str = "array_contains({}, {})") -> list[list[tuple[str, str]]]:
    """Steps of (name, SQL) after the grade: rationale and the review triggers."""
    named = " OR ".join(f"(outcome = {quoted(o)} AND (" + " OR ".join(contains.format(f"{facts}unread", quoted(q)) for q in qs) + "))" for o, qs in REQUIRED.items())
    return [
        [("rationale", rubric.rationale_sql()), ("doubtful", rubric.doubtful_sql(facts))],
        [
            ("q1", "present AND criteria AND rule_grade = 0"), ("q2", f"{facts}conflict"), ("q3", "present AND criteria AND doubtful > 1"), ("q4", "present AND NOT criteria"),
            ("q5", f"{facts}doubt OR coalesce({named}, false)"), ("guard", f"present AND criteria AND ({rubric.guard_sql(facts)})"),
        ],
        [("human_review", " OR ".join(TRIGGERS))],
    ]


def _inlined(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column as the single row of an inlined array: what stands above is not rewritten in terms of what it is computed from, which would repeat that for every use."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def read(df: DataFrame, note: str = "note_text", name: str = "facts", lexicon=lx.DEFAULT, evidence: bool = True) -> DataFrame:
    """Add the facts of the note as one struct (see functions.reading.read)."""
    return _inlined(df, name, reading.read(note, lexicon, evidence))


def _worked(df: DataFrame, note: str, steps: list[list[tuple[str, str]]], added: dict[str, str], lexicon, evidence: bool = True) -> DataFrame:
    """df with the columns added (name to SQL). While the steps are worked out, df's columns have other names, so none is mistaken for a fact; those named like an added one are replaced."""
    carried = {f"_{i}": c for i, c in enumerate(df.columns)}
    rows = df.select(*(F.col(f"`{c}`").alias(k) for k, c in carried.items()), F.col("outcome").cast("string").alias("outcome"), F.col(f"`{note}`").alias("note"))
    rows = computed(read(rows, "note", "f", lexicon, evidence), steps)
    names = {c.lower() for c in added}
    return rows.select(*(F.col(k).alias(c) for k, c in carried.items() if c.lower() not in names), *(F.expr(sql).alias(c) for c, sql in added.items()))


def predicted(df: DataFrame, note: str = "note_text", rubric: Rubric = CORE, lexicon=lx.DEFAULT) -> DataFrame:
    """Add predicted_grade only: metrics need no evidence."""
    return _worked(df, note, grade_columns(rubric, "f."), {"predicted_grade": "predicted_grade"}, lexicon, evidence=False)


def predicted_by(df: DataFrame, rubrics: dict[str, Rubric], note: str = "note_text", lexicon=lx.DEFAULT) -> DataFrame:
    """Add one grade per rubric, in a column of the name given: the note is read once for all of them."""
    each = [grade_columns(rubric, "f.", f"r{i}_") for i, rubric in enumerate(rubrics.values())]
    steps = [[column for one in each for column in one[k]] for k in (0, 1)]
    return _worked(df, note, steps, {name: f"r{i}_predicted_grade" for i, name in enumerate(rubrics)}, lexicon, evidence=False)


def graded(df: DataFrame, note: str = "note_text", facts: bool = False, rubric: Rubric = CORE, lexicon=lx.DEFAULT) -> DataFrame:
    """Add ADDED to rows with outcome and a note.

    An outcome without a rubric, a null or an empty note get -1. Columns of df
    stay as they are, whatever they are called, but for those named like one
    of ADDED, which are replaced. facts: keep the struct of facts as well.
    """
    added = {c: "f.evidence" if c == "evidence" else c for c in ADDED} | ({"facts": "f"} if facts else {})
    return _worked(df, note, grade_columns(rubric, "f.") + reason_columns(rubric, "f."), added, lexicon)


def misreads(df: DataFrame, note: str = "note_text", rubric: Rubric = CORE, lexicon=lx.DEFAULT) -> DataFrame:
    """Add rule_predicted, the grade, and misreads, an array of (threshold, grade): what the grade would be, had one threshold been taken for the opposite.

    Only thresholds of the row's outcome whose quantity the note gives are there, in the rubric's order.
    """
    one = [f"named_struct('threshold', {quoted(t)}, 'grade', CASE WHEN outcome = {quoted(o)} THEN {rubric.misread_sql(t, 'f.')} END)" for t, o, _ in rubric.thresholds]
    every = f"filter(array({', '.join(one)}), x -> x.grade IS NOT NULL)" if one else "cast(array() AS array<struct<threshold: string, grade: int>>)"
    first, *rest = grade_columns(rubric, "f.")
    return _worked(df, note, [[*first, ("wrong", every)], *rest], {"rule_predicted": "predicted_grade", "misreads": "wrong"}, lexicon, evidence=False)


def graded_by(df: DataFrame, rubric: DataFrame, note: str = "note_text") -> DataFrame:
    """graded() with the criteria of a table (outcome, grade, criterion; see sources.rubric_file.read_rubric) in place of the rationale.

    An outcome that the table lacks gets -1. A grade that it lacks stays, with
    its review flag set. The conditions stay those of the package; to grade by
    those of a file, pass graded() what sources.rubric_file.read_rules gives.
    """
    per = F.broadcast(rubric.groupBy("outcome").agg(F.map_from_entries(F.collect_list(F.struct("grade", "criterion"))).alias("_criteria")).where(F.col("outcome").isin(*OUTCOMES)))  # four rows at most
    out = graded(df, note).join(per, "outcome", "left")
    known, at = F.col("_criteria").isNotNull(), F.try_element_at("_criteria", F.col("predicted_grade"))
    grade = F.when(known, F.col("predicted_grade")).otherwise(-1)
    missing = known & (F.col("predicted_grade") >= 1) & at.isNull()
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ADDED]
    return out.select(*kept, grade.alias("predicted_grade"), "evidence", F.when(known, F.coalesce(at, "rationale")).otherwise("outcome not present").alias("rationale"), (known & (F.col("human_review") | missing)).alias("human_review"))


def every_outcome(df: DataFrame, note: str = "note_text", rubric: Rubric = CORE) -> DataFrame:
    """Grade a note for each outcome of the rubric: a row per outcome that the note describes, whatever its outcome column says."""
    rows = df.withColumn("outcome", F.explode(F.array(*map(F.lit, rubric.outcomes))))
    return predicted(rows, note, rubric).where("predicted_grade >= 0")
