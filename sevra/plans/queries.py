"""The grader's queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import alignment
from ..functions.lexicon import DEFAULT, PLURAL
from ..functions.rubric import CHEST, CORE, CORE_TEXT, OUTCOMES, PAIN, PRIAPISM, RULES, SCOPE, SPLEEN, parsed
from ..operators import answers, grading, metrics, raters, structured
from ..sources import sinks, staging, synthetic
from ..sources.rubric_file import read_rules
from ..sources.staging import staged
from ..sources.tables import read_raw, spread
from . import views
from .dialect import DUCK
from .reading_sql import ctes

NAMES = list(views.PROFILE)
#: Thresholds of the changed rubric: outcome, id, condition.
CHANGED = ((PAIN, "T1", "pain_minutes >= 180"), (CHEST, "T2", "temperature >= 38.4"), (CHEST, "T6", "fio2 >= 40"), (SPLEEN, "T9", "spleen_cm - spleen_was >= 3.999999"), (PRIAPISM, "T10", "priapism_minutes > 60"))
_NOTE_FACTS = ("admitted", "complication", "infiltrate", "chest_sign", "oxygen", "unstable", "shunt", "death", "pain_minutes", "temperature", "fio2", "hb", "hb_was", "spleen_cm", "priapism_minutes", "conflict", "doubt")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts"))


def _cases(spark, sf_dir) -> DataFrame:
    return synthetic.cases(_events(spark, sf_dir))


def _graded(spark, sf_dir) -> DataFrame:
    return grading.graded(_cases(spark, sf_dir))


def _predicted(spark, sf_dir) -> DataFrame:
    return grading.predicted(_cases(spark, sf_dir))


def _replayed(spark, sf_dir, strategy: str = "rubric_grounded", cases: DataFrame | None = None) -> DataFrame:
    """Recorded answers joined with the truth from the left, so that unanswered cases stay."""
    cases = _cases(spark, sf_dir) if cases is None else cases
    return cases.join(structured.parsed(synthetic.payloads(cases, strategy)), "case_id", "left")


def _scored(spark, sf_dir) -> DataFrame:
    cols = ["case_id", "patient_id", "outcome", "gold_grade", "predicted_grade"]
    return _predicted(spark, sf_dir).select(*cols, F.lit("rules").alias("model")).unionByName(_replayed(spark, sf_dir).select(*cols, F.lit("replay").alias("model")))


def _rules(spark) -> DataFrame:
    return spark.createDataFrame([(r, o, g, c) for r, o, g, c, _ in RULES], "rule string, outcome string, grade int, criterion string")


#: The first that holds names an error. misread: names of thresholds that turn the true grade into the one predicted.
_PATTERN = """CASE WHEN predicted_grade <=> gold_grade THEN 'none' WHEN answered_outcome <> outcome THEN 'outcome' WHEN NOT grounded THEN 'hallucinated' WHEN predicted_grade IN (-1, 0) AND gold_grade >= 1 THEN 'insufficient'
    WHEN well_formed AND NOT covers THEN 'missing_evidence' WHEN predicted_grade >= 1 AND gold_grade >= 1 AND abs(predicted_grade - gold_grade) = 1 THEN 'neighbour' WHEN misread <> '' THEN 'threshold' ELSE 'other' END"""


def _explained(spark, sf_dir) -> DataFrame:
    ev = F.col("answered_evidence")
    rows = grading.misreads(_replayed(spark, sf_dir))
    wrong = F.filter("misreads", lambda m: (m["grade"] == F.col("predicted_grade")) & (F.col("rule_predicted") == F.col("gold_grade")) & (m["grade"] != F.col("gold_grade")))
    out = rows.withColumns({
        "grounded": structured.grounded(ev, F.col("note_text")), "covers": structured.covers(ev, F.col("gold_evidence")), "in_range": structured.allowed(F.col("outcome"), F.col("predicted_grade")),
        "misread": F.array_join(F.transform(wrong, lambda m: m["threshold"]), ","),
    })
    return out.withColumn("error_pattern", F.expr(_PATTERN))


def q_rubric_grades(spark, sf_dir):
    return _rules(spark)


def q_outcome_scope(spark, sf_dir):
    """Scope left-joined with the rubric: ten outcomes are not encoded."""
    scope = spark.createDataFrame(list(SCOPE), "ordinal int, scope_name string, outcome string")
    pages = spark.createDataFrame([(o, p, len(g)) for o, (p, g) in OUTCOMES.items()], "outcome string, booklet_page int, n_grades int")
    return scope.join(F.broadcast(pages), "outcome", "left").select("ordinal", "scope_name", "outcome", "booklet_page", "n_grades", F.col("outcome").isNotNull().alias("encoded"))


def q_synthetic_cases(spark, sf_dir):
    return _cases(spark, sf_dir).drop("ts")


def q_note_facts(spark, sf_dir):
    return grading.read(_cases(spark, sf_dir), evidence=False).select("case_id", *(f"facts.{c}" for c in _NOTE_FACTS), F.array_join(F.array_sort("facts.unread"), ",").alias("unread"))


def q_threshold_misreads(spark, sf_dir):
    """Answers that are what the grade would be, had one threshold been misread."""
    return _explained(spark, sf_dir).where("misread <> ''").select("case_id", "outcome", "gold_grade", "predicted_grade", "misread", "error_pattern")


def q_rule_grades(spark, sf_dir):
    return _graded(spark, sf_dir).select("case_id", "outcome", "gold_grade", "predicted_grade", F.array_join("evidence", "; ").alias("evidence"), "rationale", "human_review")


def q_flagged_cases(spark, sf_dir):
    return _graded(spark, sf_dir).where("human_review").select("case_id", "patient_id", "outcome", "predicted_grade", *grading.TRIGGERS)


def q_review_rates(spark, sf_dir):
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return _graded(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("cases"), n("human_review"), *map(n, grading.TRIGGERS))


def q_accuracy_overall(spark, sf_dir):
    return metrics.accuracy(_scored(spark, sf_dir), "model")


def q_accuracy_by_outcome(spark, sf_dir):
    return metrics.accuracy(_scored(spark, sf_dir), "model", "outcome")


def q_confusion_long(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), "model", "outcome")


def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_predicted(spark, sf_dir))


def q_kappa(spark, sf_dir):
    return metrics.kappa(_scored(spark, sf_dir), "model", "outcome")


def q_most_confused(spark, sf_dir):
    return metrics.most_confused(_scored(spark, sf_dir), 10)


def q_grade_distribution(spark, sf_dir):
    return metrics.distribution(_predicted(spark, sf_dir), "predicted_grade", "outcome")


def q_outcome_distribution(spark, sf_dir):
    return metrics.distribution(_predicted(spark, sf_dir), "outcome")


def q_structured_answers(spark, sf_dir):
    return _explained(spark, sf_dir).select("case_id", "predicted_grade", "answered_outcome", "confidence", "well_formed", "grounded", "in_range")


def q_answer_reliability(spark, sf_dir):
    return _explained(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.col("well_formed").cast("long")).alias("well_formed"), F.sum((F.col("well_formed") & ~F.col("in_range")).cast("long")).alias("out_of_range"), F.sum(F.coalesce(F.col("confidence") == "low", F.lit(False)).cast("long")).alias("low_confidence"), F.sum((~F.col("grounded")).cast("long")).alias("not_grounded"))


def q_error_patterns(spark, sf_dir):
    return _explained(spark, sf_dir).groupBy("outcome", "error_pattern").agg(F.count("*").alias("n"))


def q_evidence_items(spark, sf_dir):
    """One row per piece of evidence; cases without any keep one row."""
    return _replayed(spark, sf_dir).select("case_id", F.explode_outer("answered_evidence").alias("evidence"))


def q_unanswered_cases(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    answers = synthetic.payloads(cases).where("payload is not null")
    return cases.join(answers, "case_id", "left_anti").select("case_id", "outcome")


def q_invalid_grades(spark, sf_dir):
    """Answers whose grade the rubric doesn't have, by anti join."""
    grades = _rules(spark).select("outcome", F.col("grade").alias("predicted_grade"))
    both = grades.select("outcome").distinct().crossJoin(spark.createDataFrame([(-1,), (0,)], "predicted_grade int")).unionByName(grades)
    return _replayed(spark, sf_dir).where("well_formed").join(F.broadcast(both), ["outcome", "predicted_grade"], "left_anti").select("case_id", "outcome", "predicted_grade")


def q_criterion_lookup(spark, sf_dir):
    """Predictions with the criterion of their grade."""
    rules = _rules(spark).select("outcome", F.col("grade").alias("predicted_grade"), "rule", "criterion")
    return _predicted(spark, sf_dir).join(F.broadcast(rules), ["outcome", "predicted_grade"]).groupBy("rule", "criterion").agg(F.count("*").alias("n"))


def q_severity_profile(spark, sf_dir):
    return metrics.severity_profile(_predicted(spark, sf_dir), [PAIN, CHEST, SPLEEN, PRIAPISM], NAMES)


def q_severity_profile_cohort(spark, sf_dir):
    per = q_severity_profile(spark, sf_dir)
    return per.select(F.expr("stack(4, 'pain', pain, 'chest', chest, 'spleen', spleen, 'priapism', priapism) as (name, grade)")).where("grade is not null").groupBy("name", "grade").agg(F.count("*").alias("patients"))


def q_severity_trajectory(spark, sf_dir):
    return metrics.trajectory(_predicted(spark, sf_dir).where("predicted_grade >= 1"))


def q_model_comparison(spark, sf_dir):
    """Rules against recorded answers on the same cases."""
    a = _predicted(spark, sf_dir).select("case_id", "outcome", F.col("predicted_grade").alias("a"))
    b = _replayed(spark, sf_dir).select("case_id", F.col("predicted_grade").alias("b"))
    return a.join(b, "case_id").groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.col("a").eqNullSafe(F.col("b")).cast("long")).alias("same"), F.sum(F.coalesce(F.col("a") > F.col("b"), F.lit(False)).cast("long")).alias("rules_higher"))


def q_patient_view(spark, sf_dir):
    return views.patient_view(structured.reviewed(_replayed(spark, sf_dir)))


def q_answer_review(spark, sf_dir):
    """Triggers that need the answer: low confidence, unsupported, hallucinated."""
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return structured.reviewed(_replayed(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"), *map(n, ("q6", "q7", "q8", "needs_review")))


def q_incorrect_predictions(spark, sf_dir):
    return _predicted(spark, sf_dir).where("NOT predicted_grade <=> gold_grade").select("case_id", "outcome", "gold_grade", "predicted_grade")


def q_orphan_answers(spark, sf_dir):
    """Answers to cases that don't exist."""
    cases = _cases(spark, sf_dir)
    return synthetic.payloads(cases).join(cases, "case_id", "left_anti").select("case_id", F.col("payload").isNotNull().alias("answered"))


def q_prompt_strategies(spark, sf_dir):
    """Recorded answers with the note alone and with the rubric, on the same cases."""
    cols = ["case_id", "gold_grade", "predicted_grade"]
    each = [_replayed(spark, sf_dir, s).select(*cols, F.lit(s).alias("strategy")) for s in structured.STRATEGIES]
    return metrics.accuracy(each[0].unionByName(each[1]), "strategy")


def q_prompt_texts(spark, sf_dir):
    return structured.prompts(_cases(spark, sf_dir), _rules(spark)).select("case_id", "strategy", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


def q_rubric_file_grades(spark, sf_dir):
    """Cases joined with the rubric as a table: the criterion of the grade in place of the rationale."""
    return grading.graded_by(_cases(spark, sf_dir), _rules(spark)).select("case_id", "outcome", "predicted_grade", "rationale", "human_review")


def q_every_outcome(spark, sf_dir):
    return grading.every_outcome(_cases(spark, sf_dir)).select("case_id", "outcome", "predicted_grade")


def q_patient_encounters(spark, sf_dir):
    """Patients with their encounters, one to many."""
    w = Window.partitionBy("patient_id").orderBy("ts", "case_id")
    met = _cases(spark, sf_dir).select("patient_id", "case_id", "stage", "ts", F.row_number().over(w).alias("encounter_seq"))
    return synthetic.patients(_events(spark, sf_dir)).join(met, "patient_id").select("patient_id", "case_id", "encounter_seq", "stage", (F.col("ts") == F.col("first_ts")).alias("at_first"))


def q_run_provenance(spark, sf_dir):
    """Predictions by the run that made them; versions come from the rubric, the lexicon, the prompt, the schema, the packages and the cases themselves."""
    run = structured.with_provenance(_predicted(spark, sf_dir), {"temperature": "0"}, **structured.recorded_versions(CORE_TEXT, DEFAULT), evaluated_on="2024-02-29")
    names = [c for c in structured.PROVENANCE if c != "case_version"]
    return run.groupBy(*(f"run.{c}" for c in names), F.col("run.generation_params").getItem("temperature").alias("temperature")).agg(F.count("*").alias("n"), structured.case_version().alias("case_version"))


def q_published_views(spark, sf_dir):
    """The dashboard's views, registered and read by SQL."""
    cases = staged(_cases(spark, sf_dir))
    names = views.publish(grading.graded(cases), structured.reviewed(_replayed(spark, sf_dir, cases=cases)))
    return spark.sql(" UNION ALL ".join(f"SELECT '{n.removeprefix(views.PREFIX)}' AS name, count(*) AS n FROM {n}" for n in names))


def q_metric_cells(spark, sf_dir):
    """Accuracy and kappa of two runs from their stored cells: each run adds its own, and no row is read again."""
    at = staging.folder(spark)
    for run, rows in (("rules", _predicted(spark, sf_dir)), ("replay", _replayed(spark, sf_dir))):
        sinks.add_cells(metrics.cells(rows, "outcome"), at, run)
    cells = sinks.read_cells(spark, at)
    return metrics.accuracy_of_cells(cells, "run_id").join(metrics.kappa_of_cells(cells, "run_id").drop("n"), "run_id")


def q_episodes(spark, sf_dir):
    """Encounters by episode of six hours, with the stage in the note's own words."""
    return metrics.episodes(_predicted(spark, sf_dir))


def q_episode_totals(spark, sf_dir):
    return metrics.episode_totals(_predicted(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))).select("patient_id", F.unix_micros("begun").alias("begun"), F.unix_micros("ended").alias("ended"), "encounters", "worst")


def q_rules_from_file(spark, sf_dir):
    """Grades under the package's rubric against those under a file with other thresholds: written, read back, checked and compiled."""
    at = staging.folder(spark)
    spark.createDataFrame([(_changed_text(),)], "value string").write.text(at)
    rules, cases = read_rules(spark, at), _cases(spark, sf_dir)
    both = grading.predicted_by(cases, {"before": CORE, "after": rules})
    return both.groupBy("outcome", "before", "after").agg(F.count("*").alias("n"))


def q_asked_cases(spark, sf_dir):
    """The answer store after two runs over the cases, of which the first could not answer every third: no case is asked twice once it has an answer."""
    prompts = structured.prompts(_cases(spark, sf_dir), _rules(spark)).where("strategy = 'zero_shot'").select("case_id", "prompt")
    store = staging.folder(spark)
    for run, every in (("first", 3), ("second", 0)):
        answers.ask(prompts, _replier(every), store, "replier", "zero_shot", run, batches=2)
    return answers.answers(spark, store).select("case_id", "payload", F.col("n_failed").alias("failed"))


def q_rater_agreement(spark, sf_dir):
    """Krippendorff's alpha of three raters, of which two leave cases out: the rules and both ways of asking."""
    cols = ["case_id", "outcome", F.col("predicted_grade").alias("grade")]
    asked = [_replayed(spark, sf_dir, s).where("predicted_grade BETWEEN -1 AND 5").select(*cols, F.lit(s).alias("rater")) for s in structured.STRATEGIES]
    return raters.alpha(_predicted(spark, sf_dir).select(*cols, F.lit("rules").alias("rater")).unionByName(asked[0]).unionByName(asked[1]), "outcome")


def q_raw_notes(spark, sf_dir):
    """Notes read from files of a raw area and graded; rows that don't fit are set aside with their reason and counted."""
    at = staging.folder(spark)
    key = F.when(F.col("case_id") % 1000 == 7, F.concat(F.lit("x"), F.col("case_id").cast("string"))).otherwise(F.col("case_id").cast("string"))
    note = F.when(F.col("case_id") % 1000 != 8, F.col("note_text"))
    outcome = F.when(F.col("case_id") % 1000 == 9, F.lit("Gout")).otherwise(F.col("outcome"))
    _cases(spark, sf_dir).select(key.alias("case_id"), "patient_id", "stage", outcome.alias("outcome"), "gold_grade", note.alias("note_text")).write.csv(at, header=True, quote='"', escape='"')
    cases, aside = read_raw(spark, at)
    graded = grading.predicted(cases).groupBy("outcome", "predicted_grade").agg(F.count("*").alias("n"))
    return graded.select(F.lit(None).cast("string").alias("reason"), "outcome", "predicted_grade", "n").unionByName(aside.groupBy("reason").agg(F.count("*").alias("n")).select("reason", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("int").alias("predicted_grade"), "n"))


def _replier(refused: int):
    """A stand-in for a model: answers with the length of the prompt, but for lengths that `refused` divides."""

    def make():
        def ask(texts: list[str]) -> list[str]:
            if refused and len(texts[0]) % refused == 0:
                raise TimeoutError("no answer")
            return [str(len(t)) for t in texts]

        return ask

    return make


def q_conversation_order(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select("conv_id", "turn", F.row_number().over(w).alias("seq"), "role", F.lag("role").over(w).alias("role_before"))


def q_label_agreement(spark, sf_dir):
    """A length rule held against the quality labels."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    both = spark.read.parquet(f"{sf_dir}/labels.parquet").join(d, "doc_id").select(F.col("quality").alias("gold_grade"), (F.col("n_chars") >= 500).cast("int").alias("predicted_grade"))
    return metrics.kappa(both)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k[2:]: f for k, f in globals().items() if k.startswith("q_")}


def _steps(source: str, steps, keep: str = "*") -> str:
    sql = source
    for i, step in enumerate(steps):
        cols = ", ".join(f"{s} AS {n}" for n, s in step)
        sql = f"SELECT {cols} FROM ({sql})" if source == "SELECT * FROM events" and i == 0 else f"SELECT *, {cols} FROM ({sql})"
    return f"SELECT {keep} FROM ({sql})"


def _changed_text() -> str:
    doc = json.loads(CORE_TEXT)
    for outcome, threshold, condition in CHANGED:
        doc[outcome]["thresholds"][threshold] = condition
    return json.dumps(doc)


def _supported_sql() -> str:
    """CTEs that end in supported (case_id, grounded, covers): pairs of evidence and text, aligned by a recursion over a sentence's words."""
    empty = ", ".join(f"'{w}'" for w in alignment.EMPTY_WORDS)
    words = lambda t: rf"list_transform(list_filter(regexp_extract_all(regexp_replace(lower({t}), '{PLURAL}', '\1', 'g'), '{alignment.WORD}'), lambda w: w NOT IN ({empty})), lambda w: substr(w, 1, {alignment.STEM}))"
    return rf"""pieces AS (SELECT case_id, note_text, gold_evidence, unnest(ev) AS e FROM replayed),
        asks AS (SELECT e AS what, note_text AS text FROM pieces UNION SELECT gold_evidence, e FROM pieces),
        told_apart AS (SELECT *, contains(lower(text), lower(what)) AS verbatim FROM asks),
        aligning AS (SELECT what, text, {words("what")} AS x, unnest(regexp_split_to_array(lower(text), '{alignment.SENTENCE}')) AS s FROM told_apart WHERE NOT verbatim),
        lines AS (SELECT DISTINCT what, text, x, s, {words("s")} AS y FROM aligning WHERE len(x) > 0),
        lcs AS (SELECT what, text, x, s, y, 0 AS k, list_transform(range(len(x)), lambda i: 0::bigint) AS best FROM lines UNION ALL
            SELECT what, text, x, s, y, k + 1, list_transform(range(1, len(x) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN x[i] = y[k + 1] THEN coalesce(best[i - 1], 0) + 1 ELSE best[i] END))) FROM lcs WHERE k < len(y)),
        aligned AS (SELECT what, text, bool_or(100 * best[len(x)] >= {alignment.SHARE} * len(x)) AS yes FROM lcs WHERE k = len(y) GROUP BY what, text),
        judged AS (SELECT what, text, verbatim OR coalesce(yes, false) AS yes FROM told_apart LEFT JOIN aligned USING (what, text)),
        of_pieces AS (SELECT case_id, bool_and(n.yes) AS grounded, bool_or(g.yes) AS covers FROM pieces p JOIN judged n ON n.what = e AND n.text = note_text JOIN judged g ON g.what = gold_evidence AND g.text = e GROUP BY case_id),
        supported AS (SELECT case_id, coalesce(grounded, true) AS grounded, gold_evidence = '' OR coalesce(covers, false) AS covers FROM replayed LEFT JOIN of_pieces USING (case_id))"""


def oracle_sql() -> dict[str, str]:
    cases = _steps("SELECT * FROM events", synthetic.columns(DUCK), ", ".join(synthetic.KEPT))
    graded = _steps("SELECT * FROM facts", grading.grade_columns() + grading.reason_columns(contains="list_contains({}, {})"))
    pay_of = lambda s: _steps("SELECT case_id, outcome, gold_grade, gold_evidence FROM cases", synthetic.payload_columns(DUCK, s), "answer_id AS case_id, payload")
    pay = pay_of("rubric_grounded")
    ok = "CASE WHEN json_valid(payload) THEN coalesce(json_type(payload, '$.predicted_grade') IN ('UBIGINT', 'BIGINT'), false) ELSE false END"
    replayed_of = lambda p: f"""SELECT c.*, well_formed, json_extract_string(safe, '$.rationale') AS rationale, cast(json_extract(safe, '$.human_review') AS boolean) AS asks_review, cast(json_extract_string(safe, '$.predicted_grade') AS int) AS predicted_grade, json_extract_string(safe, '$.outcome') AS answered_outcome,
        json_extract_string(safe, '$.confidence') AS confidence, cast(json_extract(safe, '$.evidence') AS varchar[]) AS ev
        FROM cases c LEFT JOIN (SELECT *, CASE WHEN well_formed THEN payload ELSE '{{}}' END AS safe FROM (SELECT *, {ok} AS well_formed FROM {p})) p USING (case_id)"""  # noqa: E731
    replayed = replayed_of("pay")
    ranges = " OR ".join(f"(outcome = '{o}' AND predicted_grade IN (-1, 0, {', '.join(map(str, g))}))" for o, (_, g) in OUTCOMES.items())
    flips = ", ".join(f"CASE WHEN outcome = '{o}' AND ({CORE.misread_sql(t)}) = predicted_grade THEN '{t}' END" for t, o, _ in CORE.thresholds)
    rule_grade = _steps("SELECT * FROM facts", grading.grade_columns(), "case_id, predicted_grade AS rule_predicted, " + ", ".join(f for f in ("present", "criteria", "rule_grade")))
    explained = f"""SELECT *, {_PATTERN.replace('<=>', 'IS NOT DISTINCT FROM')} AS error_pattern FROM (SELECT r.*, grounded, covers, coalesce({ranges}, false) AS in_range, coalesce(misread, '') AS misread FROM replayed r JOIN supported USING (case_id)
        LEFT JOIN (SELECT case_id, array_to_string(list_filter([{flips}], lambda x: x IS NOT NULL), ',') AS misread FROM (SELECT f.*, r.predicted_grade, rule_predicted FROM facts f JOIN ({rule_grade}) USING (case_id) JOIN replayed r USING (case_id))
            WHERE rule_predicted = gold_grade AND predicted_grade <> gold_grade) USING (case_id))"""
    scored = "SELECT case_id, patient_id, outcome, gold_grade, predicted_grade, 'rules' AS model FROM graded UNION ALL SELECT case_id, patient_id, outcome, gold_grade, predicted_grade, 'replay' FROM replayed"
    rules = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{o}', {g}, '{c}')" for r, o, g, c, _ in RULES) + ") t(rule, outcome, grade, criterion)"
    scope = ", ".join(f"({i}, '{n}', {'NULL' if o is None else repr(o)}, {'NULL' if o is None else OUTCOMES[o][0]}, {'NULL' if o is None else len(OUTCOMES[o][1])})" for i, n, o in SCOPE)
    acc = """SELECT {by}, count(*) AS n, 100.0::double * count(*) FILTER (predicted_grade IS NOT DISTINCT FROM gold_grade) / count(*) AS exact_pct,
        100.0::double * count(*) FILTER (abs(predicted_grade - gold_grade) <= 1) / count(*) AS within_one_pct,
        100.0::double * count(*) FILTER (abs(predicted_grade - gold_grade) <= 1 AND gold_grade >= 1 AND predicted_grade >= 1) / nullif(count(*) FILTER (gold_grade >= 1 AND predicted_grade >= 1), 0) AS within_one_graded_pct FROM scored GROUP BY {by}"""
    kap = """, s AS ({rows}), g AS (SELECT {by} gold_grade AS k, count(*) AS g FROM s GROUP BY ALL), q AS (SELECT {by} coalesce(predicted_grade, -9) AS k, count(*) AS q FROM s GROUP BY ALL),
        c AS (SELECT {by} sum(g * q)::double AS chance FROM g JOIN q USING ({by} k) GROUP BY ALL), n AS (SELECT {by} count(*) AS n, count(*) FILTER (predicted_grade = gold_grade) AS agree FROM s GROUP BY ALL)
        SELECT {by} n, (agree / n::double - coalesce(chance, 0) / (n::double * n)) / nullif(1 - coalesce(chance, 0) / (n::double * n), 0) AS kappa FROM n LEFT JOIN c {on}"""
    count_if = lambda c: f"count(*) FILTER ({c})"
    grades = ", ".join(f"{count_if(f'g.predicted_grade = {g}')} AS p_{str(g).replace('-', 'm')}" for g in metrics.GRADES)
    stages = "[" + ", ".join(f"'{x}'" for x in synthetic.STAGES) + "]"
    n_of = lambda cs: ", ".join(f"{count_if(c)} AS {c}" for c in cs)
    reviewed = """SELECT *, coalesce(NOT well_formed, true) OR q6 OR q7 OR q8 OR coalesce(asks_review, false) AS needs_review FROM (SELECT *, coalesce(well_formed AND confidence = 'low', false) AS q6,
        coalesce(well_formed AND (NOT in_range OR answered_outcome IS DISTINCT FROM outcome), false) AS q7, coalesce(well_formed AND (NOT grounded OR (predicted_grade >= 1 AND coalesce(len(ev), 0) < 1)), false) AS q8 FROM explained)"""
    asks = "'Answer in JSON with \"outcome\", \"predicted_grade\", \"evidence\", \"rationale\", \"confidence\" and \"human_review\".'"
    text = f"concat('Grade this outcome: ', outcome, chr(10), {{}}'Note:', chr(10), note_text, chr(10), {asks})"
    lines = "(SELECT outcome, string_agg(concat(grade, ': ', criterion), chr(10) ORDER BY grade, criterion) AS lines FROM rules GROUP BY outcome)"
    base = f"WITH RECURSIVE cases AS ({cases}), {ctes()}, graded AS ({graded}), pay AS ({pay}), replayed AS ({replayed}), {_supported_sql()}, explained AS ({explained}), reviewed AS ({reviewed}), scored AS ({scored}), rules AS ({rules}) "
    profile = "SELECT patient_id, " + ", ".join(f"max(predicted_grade) FILTER (outcome = '{o}') AS {n}" for o, n in zip([PAIN, CHEST, SPLEEN, PRIAPISM], NAMES, strict=True)) + " FROM graded GROUP BY patient_id"
    stage = "CASE WHEN contains(note_text, 'died') THEN 5 WHEN contains(note_text, 'discharged') THEN 4 WHEN contains(note_text, 'Admitted') THEN 2 WHEN contains(note_text, 'Seen in the') THEN 1 END"
    begun = f"SELECT *, {stages}[ordinal] AS stage, CASE WHEN ts - lag(ts) OVER (PARTITION BY patient_id ORDER BY ts, ordinal NULLS FIRST, case_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM (SELECT * EXCLUDE (stage), {stage} AS ordinal FROM graded)"
    kap_all = """SELECT model AS run_id, n, exact_pct, within_one_pct, within_one_graded_pct, (agree / n::double - chance / (n::double * n)) / nullif(1 - chance / (n::double * n), 0) AS kappa FROM (""" + acc.format(by="model") + """) JOIN
        (SELECT model, count(*) FILTER (predicted_grade = gold_grade) AS agree FROM scored GROUP BY model) USING (model) JOIN (SELECT model, sum(g * q)::double AS chance FROM (SELECT model, gold_grade AS k, count(*) AS g FROM scored GROUP BY ALL)
        JOIN (SELECT model, coalesce(predicted_grade, -9) AS k, count(*) AS q FROM scored GROUP BY ALL) USING (model, k) GROUP BY model) USING (model)"""
    zero = replayed_of(f"({pay_of('zero_shot')})")
    ones = " + ".join(f"(u >= {t})::int" for t in raters.WEIGHTS)
    alpha = f"""SELECT outcome, max(cases) FILTER (r = 0) AS cases, max(ratings) FILTER (r = 0) AS ratings, max(alpha) FILTER (r = 0) AS alpha, (list(alpha ORDER BY alpha) FILTER (r > 0 AND alpha IS NOT NULL))[{-(-raters.REPLICATES * raters.TAIL // 100):.0f}] AS low,
        (list(alpha ORDER BY alpha) FILTER (r > 0 AND alpha IS NOT NULL))[{-(-raters.REPLICATES * (100 - raters.TAIL) // 100):.0f}] AS high FROM (
        SELECT outcome, r, sum(w) AS cases, sum(w * m)::bigint AS ratings, 1 - (sum(w * m) - 1) * sum(w * apart) / nullif(power(sum(w * m), 2) - any_value(same), 0) AS alpha FROM (
            SELECT u.outcome, u.case_id, r, w, m, (m * m - sq) / (m - 1)::double AS apart, same FROM (
                SELECT outcome, case_id, sum(k)::double AS m, sum(k * k)::double AS sq FROM (SELECT outcome, case_id, grade, count(*) AS k FROM rated GROUP BY ALL) GROUP BY ALL HAVING sum(k) > 1) u
            JOIN drawn USING (case_id) JOIN (SELECT outcome, r, sum(power(n, 2)) AS same FROM (SELECT outcome, r, grade, sum(w)::double AS n FROM (SELECT *, count(*) OVER (PARTITION BY outcome, case_id) AS m FROM rated) JOIN drawn USING (case_id) WHERE m > 1 GROUP BY ALL) GROUP BY ALL) USING (outcome, r))
        GROUP BY outcome, r) GROUP BY outcome"""
    drawn = f"""SELECT case_id, 0 AS r, 1::bigint AS w FROM cases UNION ALL SELECT case_id, 8 * k + j + 1 AS r, ({ones})::bigint AS w FROM (SELECT case_id, k, j, ('0x' || substr(md5(concat(case_id, ':', k)), (4 * j + 1)::int, 4))::int AS u
        FROM cases, (SELECT unnest(range({-(-raters.REPLICATES // 8)})) AS k), (SELECT unnest(range(8)) AS j)) WHERE 8 * k + j < {raters.REPLICATES}"""
    rated = f"SELECT case_id, outcome, predicted_grade AS grade FROM graded UNION ALL SELECT case_id, outcome, predicted_grade FROM replayed WHERE predicted_grade BETWEEN -1 AND 5 UNION ALL SELECT case_id, outcome, predicted_grade FROM ({zero}) WHERE predicted_grade BETWEEN -1 AND 5"
    alpha = f", drawn AS ({drawn}), rated AS ({rated}) {alpha}"
    out = {
        "rubric_grades": "SELECT * FROM rules",
        "synthetic_cases": "SELECT * EXCLUDE (ts) FROM cases",
        "note_facts": f"SELECT case_id, {', '.join(_NOTE_FACTS)}, array_to_string(list_sort(unread), ',') AS unread FROM facts",
        "threshold_misreads": "SELECT case_id, outcome, gold_grade, predicted_grade, misread, error_pattern FROM explained WHERE misread <> ''",
        "rule_grades": "SELECT case_id, outcome, gold_grade, predicted_grade, array_to_string(evidence, '; ') AS evidence, rationale, human_review FROM graded",
        "flagged_cases": "SELECT case_id, patient_id, outcome, predicted_grade, " + ", ".join(grading.TRIGGERS) + " FROM graded WHERE human_review",
        "review_rates": "SELECT outcome, count(*) AS cases, " + n_of(("human_review", *grading.TRIGGERS)) + " FROM graded GROUP BY outcome",
        "accuracy_overall": acc.format(by="model"),
        "accuracy_by_outcome": acc.format(by="model, outcome"),
        "confusion_long": "SELECT model, outcome, gold_grade, predicted_grade, count(*) AS n FROM scored GROUP BY ALL",
        "confusion_matrix": f"SELECT k AS gold_grade, {grades}, {count_if('g.case_id IS NOT NULL AND g.predicted_grade IS NULL')} AS p_missing FROM (VALUES (-1), (0), (1), (2), (3), (4), (5)) t(k) LEFT JOIN graded g ON g.gold_grade = k GROUP BY k",
        "most_confused": "SELECT gold_grade, predicted_grade, count(*) AS n FROM scored WHERE predicted_grade <> gold_grade GROUP BY ALL ORDER BY n DESC, gold_grade, predicted_grade LIMIT 10",
        "grade_distribution": "SELECT outcome, predicted_grade, count(*) AS n, 100.0::double * count(*) / sum(count(*)) OVER (PARTITION BY outcome) AS share_pct FROM graded GROUP BY outcome, predicted_grade",
        "outcome_distribution": "SELECT outcome, count(*) AS n, 100.0::double * count(*) / sum(count(*)) OVER () AS share_pct FROM graded GROUP BY outcome",
        "structured_answers": "SELECT case_id, predicted_grade, answered_outcome, confidence, well_formed, grounded, in_range FROM explained",
        "answer_reliability": f"SELECT outcome, count(*) AS n, {count_if('well_formed')} AS well_formed, {count_if('well_formed AND NOT in_range')} AS out_of_range, {count_if("confidence = 'low'")} AS low_confidence, {count_if('NOT grounded')} AS not_grounded FROM explained GROUP BY outcome",
        "error_patterns": "SELECT outcome, error_pattern, count(*) AS n FROM explained GROUP BY ALL",
        "evidence_items": "SELECT case_id, unnest(CASE WHEN len(ev) > 0 THEN ev ELSE [NULL] END) AS evidence FROM replayed",
        "unanswered_cases": "SELECT case_id, outcome FROM cases WHERE case_id NOT IN (SELECT case_id FROM pay WHERE payload IS NOT NULL)",
        "invalid_grades": "SELECT case_id, outcome, predicted_grade FROM explained WHERE well_formed AND NOT in_range",
        "criterion_lookup": "SELECT rule, criterion, count(*) AS n FROM graded g JOIN rules r ON r.outcome = g.outcome AND r.grade = g.predicted_grade GROUP BY ALL",
        "severity_profile": profile,
        "severity_profile_cohort": f"SELECT name, grade, count(*) AS patients FROM (UNPIVOT ({profile}) ON pain, chest, spleen, priapism INTO NAME name VALUE grade) GROUP BY ALL",
        "severity_trajectory": f"""SELECT patient_id, case_id, predicted_grade, cast(row_number() OVER w AS int) AS encounter_seq, stage, stage_ordinal, predicted_grade - lag(predicted_grade) OVER w AS change,
            max(predicted_grade) OVER (w ROWS UNBOUNDED PRECEDING) AS worst FROM (SELECT *, cast(list_position({stages}, stage) AS int) AS stage_ordinal FROM graded) WHERE predicted_grade >= 1 WINDOW w AS (PARTITION BY patient_id ORDER BY ts, stage_ordinal, case_id)""",
        "model_comparison": f"SELECT g.outcome, count(*) AS n, {count_if('g.predicted_grade IS NOT DISTINCT FROM r.predicted_grade')} AS same, {count_if('g.predicted_grade > r.predicted_grade')} AS rules_higher FROM graded g JOIN replayed r USING (case_id) GROUP BY g.outcome",
        "patient_view": "SELECT case_id, patient_id, note_text, outcome, gold_grade, predicted_grade, array_to_string(ev, '; ') AS evidence, rationale, confidence, needs_review AS human_review, abs(predicted_grade - gold_grade) AS distance FROM reviewed",
        "answer_review": f"SELECT outcome, count(*) AS n, {n_of(('q6', 'q7', 'q8', 'needs_review'))} FROM reviewed GROUP BY outcome",
        "incorrect_predictions": "SELECT case_id, outcome, gold_grade, predicted_grade FROM graded WHERE predicted_grade IS DISTINCT FROM gold_grade",
        "orphan_answers": "SELECT case_id, payload IS NOT NULL AS answered FROM pay WHERE case_id NOT IN (SELECT case_id FROM cases)",
        "prompt_strategies": acc.format(by="strategy").replace("FROM scored", f"FROM (SELECT *, 'rubric_grounded' AS strategy FROM replayed UNION ALL SELECT *, 'zero_shot' FROM ({replayed_of(f'({pay_of("zero_shot")})')}))"),
        "prompt_texts": f"SELECT case_id, strategy, length(prompt) AS n_chars, md5(prompt) AS digest FROM (SELECT case_id, 'zero_shot' AS strategy, {text.format('')} AS prompt FROM cases UNION ALL SELECT case_id, 'rubric_grounded', {text.format("'Criteria:', chr(10), lines, chr(10), ")} FROM cases JOIN {lines} USING (outcome))",
        "rubric_file_grades": "SELECT case_id, g.outcome, predicted_grade, coalesce(criterion, rationale) AS rationale, human_review FROM graded g LEFT JOIN rules r ON r.outcome = g.outcome AND r.grade = g.predicted_grade",
        "every_outcome": "SELECT case_id, outcome, predicted_grade FROM (" + _steps(f"SELECT * EXCLUDE (outcome), unnest([{', '.join(repr(o) for o in OUTCOMES)}]) AS outcome FROM facts", grading.grade_columns()) + ") WHERE predicted_grade >= 0",
        "rater_agreement": alpha,
        "raw_notes": """SELECT CASE case_id % 1000 WHEN 7 THEN 'does not fit the schema' WHEN 8 THEN 'no note' WHEN 9 THEN 'no such outcome' END AS reason, CASE WHEN case_id % 1000 NOT IN (7, 8, 9) THEN outcome END AS outcome,
            CASE WHEN case_id % 1000 NOT IN (7, 8, 9) THEN predicted_grade END AS predicted_grade, count(*) AS n FROM graded GROUP BY ALL""",
        "metric_cells": kap_all,
        "episodes": f"""SELECT patient_id, case_id, predicted_grade, episode, cast(row_number() OVER w AS int) AS encounter_seq, stage, predicted_grade - lag(predicted_grade) OVER w AS change, max(predicted_grade) OVER (w ROWS UNBOUNDED PRECEDING) AS worst,
            coalesce(ordinal >= max(ordinal) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS in_order FROM (SELECT *, cast(sum(begins) OVER (PARTITION BY patient_id ORDER BY ts, ordinal NULLS FIRST, case_id) AS int) AS episode FROM ({begun}))
            WINDOW w AS (PARTITION BY patient_id, episode ORDER BY ts, ordinal NULLS FIRST, case_id)""",
        "episode_totals": f"SELECT patient_id, epoch_us(min(ts)) AS begun, epoch_us(max(ts)) AS ended, count(*) AS encounters, max(predicted_grade) AS worst FROM (SELECT *, sum(begins) OVER (PARTITION BY patient_id ORDER BY ts, case_id) AS e FROM ({begun.replace('ordinal NULLS FIRST, ', '')})) GROUP BY patient_id, e",
        "rules_from_file": f"SELECT outcome, before, predicted_grade AS after, count(*) AS n FROM ({_steps('SELECT * EXCLUDE (present, criteria, rule_grade, predicted_grade, rationale, doubtful, q1, q2, q3, q4, q5, guard, human_review), predicted_grade AS before FROM graded', grading.grade_columns(parsed(_changed_text())))}) GROUP BY ALL",
        "asked_cases": f"SELECT case_id, cast(length(p) AS varchar) AS payload, cast(length(p) % 3 = 0 AS bigint) AS failed FROM (SELECT case_id, {text.format('')} AS p FROM cases)",
        "patient_encounters": "SELECT patient_id, case_id, cast(row_number() OVER (PARTITION BY patient_id ORDER BY ts, case_id) AS int) AS encounter_seq, stage, ts = min(ts) OVER (PARTITION BY patient_id) AS at_first FROM cases",
        "run_provenance": f"""SELECT {", ".join(f"'{v}' AS {k}" for k, v in structured.recorded_versions(CORE_TEXT, DEFAULT).items())}, '2024-02-29' AS evaluated_on, '0' AS temperature, count(*) AS n,
            concat(count(*), '-', sum(('0x' || substr(md5(concat(case_id, ':', note_text)), 1, 8))::bigint)) AS case_version FROM graded""",
        "published_views": "SELECT 'patient_view' AS name, count(*) AS n FROM cases UNION ALL SELECT 'severity_profile', count(DISTINCT patient_id) FROM cases UNION ALL SELECT 'severity_trajectory', count(*) FROM graded WHERE predicted_grade >= 1 UNION ALL "
        "SELECT 'grade_distribution', count(DISTINCT (outcome, predicted_grade)) FROM graded UNION ALL SELECT 'outcome_distribution', count(DISTINCT outcome) FROM cases UNION ALL SELECT 'truth_vs_predicted', count(DISTINCT (outcome, gold_grade, predicted_grade)) FROM graded UNION ALL "
        "SELECT 'accuracy_by_outcome', count(DISTINCT outcome) FROM cases UNION ALL SELECT 'confusion_matrix', 7 UNION ALL SELECT 'flagged_cases', count(*) FROM graded WHERE human_review",
    }
    out = {k: base + v for k, v in out.items()}
    out["outcome_scope"] = f"SELECT *, outcome IS NOT NULL AS encoded FROM (VALUES {scope}) t(ordinal, scope_name, outcome, booklet_page, n_grades)"
    out["kappa"] = base + kap.format(rows="SELECT * FROM scored", by="model, outcome,", on="USING (model, outcome)")
    out["label_agreement"] = "WITH x AS (SELECT 1)" + kap.format(rows="SELECT quality AS gold_grade, cast(n_chars >= 500 AS int) AS predicted_grade FROM labels JOIN documents USING (doc_id)", by="", on="ON true")
    out["conversation_order"] = "SELECT conv_id, turn, cast(row_number() OVER w AS int) AS seq, role, lag(role) OVER w AS role_before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
    return out
