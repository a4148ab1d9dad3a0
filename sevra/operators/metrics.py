"""Agreement of predictions with the truth. All take rows with gold_grade and predicted_grade; a missing prediction counts as wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alignment import let
from ..functions.lexicon import DEFAULT, TRIGGERS
from ..functions.reading import mentions
from ..sources.synthetic import STAGES

GRADES = (-1, 0, 1, 2, 3, 4, 5)
#: Hours without an encounter after which an episode is over, and how notes name stages.
GAP_HOURS = 6
STAGE_PHRASES = {
    "Presentation": ("presents", "presented", "presentation", "seen in the emergency department", "seen in the day hospital"), "Admission": ("admitted", "admission"), "Hospital Course": ("hospital course", "hospital day"),
    "Discharge": ("discharged", "discharge"), "Death": ("died", "death", "deceased", "passed away"),
}


def cells(df: DataFrame, *by: str) -> DataFrame:
    """Counts by gold and predicted grade, and by other columns: all that the metrics of agreement need. Cells of several runs add up, so a new run needs no second look at old rows."""
    return df.groupBy(*by, "gold_grade", "predicted_grade").agg(F.count("*").alias("n"))


confusion = cells


def confusion_of_cells(cells_: DataFrame, *by: str) -> DataFrame:
    return cells_.groupBy(*by, "gold_grade", "predicted_grade").agg(F.sum("n").alias("n"))


def accuracy_of_cells(cells_: DataFrame, *by: str) -> DataFrame:
    """n, exact_pct, within_one_pct (literal, sentinels included), within_one_graded_pct (both from 1 to 5) per group."""
    near = F.coalesce(F.abs(F.col("predicted_grade") - F.col("gold_grade")) <= 1, F.lit(False))
    both = (F.col("gold_grade") >= 1) & F.coalesce(F.col("predicted_grade") >= 1, F.lit(False))
    n_of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    pct = lambda c: 100.0 * n_of(c) / F.sum("n")
    return cells_.groupBy(*by).agg(
        F.sum("n").alias("n"), pct(F.col("predicted_grade").eqNullSafe(F.col("gold_grade"))).alias("exact_pct"), pct(near).alias("within_one_pct"), (100.0 * n_of(near & both) / F.nullif(n_of(both), F.lit(0))).alias("within_one_graded_pct"),
    )


def accuracy(df: DataFrame, *by: str) -> DataFrame:
    """accuracy_of_cells of rows."""
    return accuracy_of_cells(cells(df, *by), *by)


def confusion_matrix_of_cells(cells_: DataFrame) -> DataFrame:
    """A row per gold grade, a column per predicted one (p_missing: none), zeros filled in; every grade has a row."""
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    wide = cells_.groupBy("gold_grade").agg(*(count(F.col("predicted_grade") == g, f"p_{g}".replace("-", "m")) for g in GRADES), count(F.col("predicted_grade").isNull(), "p_missing"))
    # Seven rows.
    return F.broadcast(cells_.sparkSession.createDataFrame([(g,) for g in GRADES], "gold_grade int")).join(wide, "gold_grade", "left").na.fill(0)


def confusion_matrix(df: DataFrame) -> DataFrame:
    """confusion_matrix_of_cells of rows."""
    return confusion_matrix_of_cells(cells(df))


def kappa_of_cells(cells_: DataFrame, *by: str) -> DataFrame:
    """Cohen's kappa per group; a missing prediction is a class of its own; null where chance agreement is complete."""
    class_ = F.coalesce("predicted_grade", F.lit(-9))
    margin = lambda k, g, q, a: F.struct(k.alias("k"), g.alias("g"), q.alias("q"), a.alias("a"))
    none, n = F.lit(0).cast("long"), F.col("n")
    sides = F.array(margin(F.col("gold_grade"), n, none, F.when(class_ == F.col("gold_grade"), n).otherwise(none)), margin(class_, none, n, none))
    per = cells_.select(*by, F.explode(sides).alias("m")).groupBy(*by, "m.k").agg(F.sum("m.g").alias("g"), F.sum("m.q").alias("q"), F.sum("m.a").alias("a"))
    one = per.groupBy(*by).agg(F.sum("g").alias("n"), F.sum("a").alias("agree"), F.sum(F.col("g") * F.col("q")).alias("chance"))
    n = F.col("n").cast("double")
    po, pe = F.col("agree") / n, F.col("chance") / (n * n)
    return one.select(*by, "n", ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def kappa(df: DataFrame, *by: str) -> DataFrame:
    """kappa_of_cells of rows."""
    return kappa_of_cells(cells(df, *by), *by)


def distribution_of_cells(cells_: DataFrame, column: str, *by: str) -> DataFrame:
    """Counts of a column with their share of the group."""
    counts = cells_.groupBy(*by, column).agg(F.sum("n").alias("n"))
    return counts.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))))


def distribution(df: DataFrame, column: str, *by: str) -> DataFrame:
    """distribution_of_cells of rows."""
    return distribution_of_cells(df.groupBy(*by, column).agg(F.count("*").alias("n")), column, *by)


def most_confused(df: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent pairs of different grades, ties in order of the grades."""
    return confusion(df).where("predicted_grade is not null and predicted_grade <> gold_grade").orderBy(F.desc("n"), "gold_grade", "predicted_grade").limit(k)


def trajectory(df: DataFrame, grade: str = "predicted_grade") -> DataFrame:
    """Encounters of a patient in order of time, then of the stages: encounter_seq, stage, stage_ordinal (from 1), change since the one before, worst so far."""
    ordinal = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")
    rows = df.withColumn("stage_ordinal", ordinal)
    w = Window.partitionBy("patient_id").orderBy("ts", "stage_ordinal", "case_id")
    return rows.select("patient_id", "case_id", grade, F.row_number().over(w).alias("encounter_seq"), "stage", "stage_ordinal", (F.col(grade) - F.lag(grade).over(w)).alias("change"), F.max(grade).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("worst"))


def stage_of(note: str = "note_text") -> Column:
    """The furthest stage that a note asserts (see STAGE_PHRASES); null where it names none."""
    entries = [("fact", stage, p) for stage, ps in STAGE_PHRASES.items() for p in ps] + [e for e in DEFAULT if e[0] == "pseudo" or e[0] in TRIGGERS]
    said = F.transform(F.filter(mentions(note, entries), lambda m: m["status"] == "asserted"), lambda m: m["name"])
    return let(said, lambda names: F.coalesce(*(F.when(F.array_contains(names, s), s) for s in reversed(STAGES))))


def episodes(df: DataFrame, grade: str = "predicted_grade", note: str = "note_text", hours: float = GAP_HOURS) -> DataFrame:
    """Encounters by episode: patient_id, case_id, grade, episode (from 1), encounter_seq within it, stage in the note's own words, change, worst so far, in_order.

    An episode ends where the next encounter is `hours` or more away. in_order:
    no stage earlier in the episode is further than this one; a note without a
    stage is in order. Encounters of one time follow in order of stage, then of
    case_id. Nulls in grade stay null in change; rows without ts come first, as
    an episode of their own if others follow. One shuffle, by patient.
    """
    ordinal = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")
    rows = df.select("patient_id", "case_id", "ts", F.col(grade).alias(grade), stage_of(note).alias("stage")).withColumn("stage_ordinal", ordinal)
    of_patient = Window.partitionBy("patient_id").orderBy("ts", "stage_ordinal", "case_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    begins = F.coalesce(seconds - F.lag(seconds).over(of_patient) >= hours * 3600, F.lit(True)).cast("int")
    rows = rows.withColumn("begins", begins).withColumn("episode", F.sum("begins").over(of_patient).cast("int"))
    w = Window.partitionBy("patient_id", "episode").orderBy("ts", "stage_ordinal", "case_id")
    before = F.max("stage_ordinal").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("patient_id", "case_id", grade, "episode", F.row_number().over(w).alias("encounter_seq"), "stage", (F.col(grade) - F.lag(grade).over(w)).alias("change"), F.max(grade).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("worst"), F.coalesce(F.col("stage_ordinal") >= before, F.lit(True)).alias("in_order"))


def episode_totals(df: DataFrame, grade: str = "predicted_grade", hours: int = GAP_HOURS) -> DataFrame:
    """Per patient and episode: begun, ended (times of its first and last encounter), encounters, worst grade. Of a table or, with a watermark on ts, of a stream.

    Sessions that touch are one, so their gap is a microsecond less than `hours`: at a gap of just that, an episode is over, as in episodes().
    """
    return df.groupBy("patient_id", F.session_window("ts", f"{hours * 3_600_000_000 - 1} microseconds").alias("w")).agg(F.min("ts").alias("begun"), F.max("ts").alias("ended"), F.count("*").alias("encounters"), F.max(grade).alias("worst")).drop("w")


def severity_profile(df: DataFrame, outcomes: list[str], names: list[str], grade: str = "predicted_grade") -> DataFrame:
    """The highest grade per patient, a column per outcome; null where a patient has no case of it."""
    return df.groupBy("patient_id").agg(*(F.max(F.when(F.col("outcome") == o, F.col(grade))).alias(n) for o, n in zip(outcomes, names, strict=True)))
