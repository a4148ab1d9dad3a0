"""Rules at their thresholds, gates, metrics by hand, structured answers, rubric files, streams."""

import json

import pytest

from sevra.functions.rubric import CHEST, OUTCOMES, PAIN, PRIAPISM, RULES, SPLEEN
from sevra.operators import metrics, structured
from sevra.operators.grading import TRIGGERS, every_outcome, graded, graded_by
from sevra.sources import sinks
from sevra.sources.rubric_file import read_rubric
from sevra.sources.tables import read_cases
from sevra.streaming.grader import grade_stream

SPLENIC = "Splenic sequestration with hemoglobin {} g/dL from 9.5 g/dL, high reticulocyte count, spleen {} cm from 2 cm. "
NOTES = [
    (PAIN, "Acute pain episode with pain for 2 hours, treated with morphine. Managed at home.", 1),
    (PAIN, "Acute pain episode with pain for 1 hours, treated with morphine. Managed at home.", 0),
    (PAIN, "Acute pain episode with pain for 5 hours, treated with morphine. Admitted to the ward.", 3),
    (PAIN, "Acute pain episode with pain for 5 hours, treated with morphine. Admitted with organ failure.", 4),
    (PAIN, "Acute pain episode with pain for 5 hours, treated with morphine. Admitted with no organ failure.", 3),
    (PAIN, "Acute pain episode with pain for 5 hours, treated with morphine. Admitted and died.", 5),
    (PAIN, "Routine visit.", -1), (PAIN, "", -1), (PAIN, None, -1), ("Stroke", "Stroke. Admitted.", -1),
    (CHEST, "A new lobar infiltrate. Temperature 38.5 C. Given oxygen at FiO2 21%.", 0),
    (CHEST, "A new lobar infiltrate. Temperature 38.5 C. Given oxygen at FiO2 22%.", 2),
    (CHEST, "A new lobar infiltrate. Temperature 38.5 C. Given oxygen at FiO2 49%.", 2),
    (CHEST, "A new lobar infiltrate. Temperature 38.5 C. Given oxygen at FiO2 50%.", 3),
    (CHEST, "A new lobar infiltrate. Temperature 38.4 C. Antibiotics only.", 0),
    (CHEST, "A new lobar infiltrate. SpO2 95% from 98%. Antibiotics only.", 1),
    (CHEST, "A new lobar infiltrate. SpO2 96% from 98%. Antibiotics only.", 0),
    (CHEST, "A new lobar infiltrate. PaO2 59. Antibiotics only.", 1),
    (CHEST, "A new lobar infiltrate. PaO2 60. Antibiotics only.", 0),
    (SPLEEN, SPLENIC.format("7.5", 4) + "Observed.", 1), (SPLEEN, SPLENIC.format("7.7", 4) + "Observed.", 0), (SPLEEN, SPLENIC.format("7.5", 3) + "Observed.", 0),
    (SPLEEN, SPLENIC.format("7.0", 5) + "IV fluids.", 3), (SPLEEN, SPLENIC.format("7.0", 5) + "Splenectomy.", 4),
    (PRIAPISM, "Painful priapism lasting 30 minutes, assessed by a physician. Resolved at home.", 0),
    (PRIAPISM, "Painful priapism lasting 31 minutes, assessed by a physician. Resolved at home.", 1),
    (PRIAPISM, "Painful priapism lasting 90 minutes, assessed by a physician. In the emergency department, aspiration, no shunt.", 3),
    (PRIAPISM, "Painful priapism lasting 90 minutes, assessed by a physician. In the emergency department, shunt. The patient died.", 4),
    # Denials end at a conjunction, units and decimals count.
    (PAIN, "Acute pain episode with pain for 5 hours, treated with morphine. Admitted, did not respond to fluids and died.", 5),
    (PAIN, "Acute pain episode with pain for 5 hours, treated with morphine. Admitted without organ failure but needed vasopressors.", 4),
    (PAIN, "Acute pain episode with pain for 5 hours, treated with morphine. Admitted with no organ failure and no death.", 3),
    (PAIN, "Acute pain episode with pain for 2.5 hours, treated with morphine. Managed at home.", 1),
    (PAIN, "Acute pain episode with pain lasting 119 minutes, treated with morphine. Managed at home.", 0),
    (PAIN, "Acute pain episode with pain lasting 2 days, treated with morphine. Managed at home.", 1),
    (CHEST, "A new lobar infiltrate. Temperature 39 C. Antibiotics only.", 1),
    (CHEST, "A new lobar infiltrate. Temperature 101.3 F. Antibiotics only.", 1),
    (CHEST, "A new lobar infiltrate. Temperature 101.2 F. Antibiotics only.", 0),
    (SPLEEN, "Splenic sequestration with hematocrit 24% from 30%, high reticulocyte count, spleen 4.5 cm from 2.5 cm. Observed.", 1),
    (SPLEEN, "Splenic sequestration with hematocrit 25% from 30%, high reticulocyte count, spleen 4.5 cm from 2.5 cm. Observed.", 0),
    (SPLEEN, SPLENIC.format("7.7", 4).replace("9.5", "9.7") + "Observed.", 1),
    (PRIAPISM, "Painful priapism lasting 4 hours, assessed by a physician. Resolved at home.", 1),
    (PRIAPISM, "Painful priapism lasting 0.5 hours, assessed by a physician. Resolved at home.", 0),
]


def test_rubric():
    assert len(OUTCOMES) == 4 and len(RULES) == 18
    assert {(o, g) for _, o, g, _, _ in RULES} == {(o, g) for o, (_, gs) in OUTCOMES.items() for g in gs}


def test_thresholds_and_gates(spark):
    rows = spark.createDataFrame([(i, o, n) for i, (o, n, _) in enumerate(NOTES)], "case_id long, outcome string, note_text string")
    got = {r["case_id"]: r["predicted_grade"] for r in graded(rows).collect()}
    assert got == {i: g for i, (_, _, g) in enumerate(NOTES)}


def test_review_and_evidence(spark):
    notes = [
        (1, CHEST, "A new lobar infiltrate with cough. Erythropoietin was given."), (2, CHEST, "A new lobar infiltrate with cough. BiPAP."), (3, PRIAPISM, "Painful priapism lasting 90 minutes, assessed by a physician. In the emergency department, shunt. The patient died."),
        (4, CHEST, "A new lobar infiltrate with cough. Given FiO2 30% and intubated."), (5, SPLEEN, SPLENIC.format("7.0", 5) + "IV fluids. No shunt. A shunt was seen."), (6, SPLEEN, SPLENIC.format("7.0", 5) + "IV fluids, spleen size unclear."),
    ]
    got = {r["case_id"]: r for r in graded(spark.createDataFrame(notes, "case_id long, outcome string, note_text string")).collect()}
    assert {k: [t for t in TRIGGERS if r[t]] for k, r in got.items()} == {1: ["q1"], 2: [], 3: ["guard"], 4: ["guard"], 5: ["q2"], 6: ["q5"]}
    assert all(r["human_review"] == (k != 2) for k, r in got.items()) and got[3]["predicted_grade"] == 4 and got[4]["predicted_grade"] == 2
    assert "bipap" in got[2]["evidence"] and "fio2 30 %" in got[4]["evidence"] and "fio2 3" not in got[4]["evidence"]
    assert all(len(set(r["evidence"])) == len(r["evidence"]) for r in got.values()) and "splenic sequestration" in got[5]["evidence"]


def test_every_outcome_and_rubric_table(spark):
    df = spark.createDataFrame([(1, PAIN, NOTES[2][1] + " " + NOTES[11][1]), (2, "Stroke", NOTES[2][1])], "case_id long, outcome string, note_text string")
    assert {(r["case_id"], r["outcome"], r["predicted_grade"]) for r in every_outcome(df).collect()} == {(1, PAIN, 3), (1, CHEST, 2), (2, PAIN, 3)}
    rubric = spark.createDataFrame([(PAIN, 3, "stay in hospital"), (CHEST, 1, "mild")], "outcome string, grade int, criterion string")
    got = {r["case_id"]: r for r in graded_by(spark.createDataFrame([(1, PAIN, NOTES[2][1]), (2, CHEST, NOTES[11][1]), (3, SPLEEN, NOTES[19][1])], "case_id long, outcome string, note_text string"), rubric).collect()}
    assert (got[1]["predicted_grade"], got[1]["rationale"], got[1]["human_review"]) == (3, "stay in hospital", False)
    assert got[2]["predicted_grade"] == 2 and got[2]["human_review"] and got[3]["predicted_grade"] == -1


def test_answers_reviewed_serialised_and_prompts(spark):
    good = {"outcome": PAIN, "predicted_grade": 3, "evidence": ["admitted"], "rationale": "r", "confidence": "high", "human_review": False}
    answers = [good, good | {"confidence": "low"}, good | {"predicted_grade": 7}, good | {"evidence": ["biopsy"]}, good | {"evidence": []}, good | {"human_review": True}, None]
    df = spark.createDataFrame([(i, PAIN, "Admitted.", a and json.dumps(a)) for i, a in enumerate(answers)], "case_id long, outcome string, note_text string, payload string")
    got = {r["case_id"]: r for r in structured.reviewed(structured.parsed(df)).collect()}
    assert [[q for q in ("q6", "q7", "q8") if got[i][q]] for i in range(7)] == [[], ["q6"], ["q7"], ["q8"], ["q8"], [], []]
    assert [got[i]["needs_review"] for i in range(7)] == [False, True, True, True, True, True, True]
    rows = graded(spark.createDataFrame([(1, PAIN, NOTES[2][1])], "case_id long, outcome string, note_text string")).selectExpr("*", "'high' AS confidence")
    back = structured.parsed(structured.serialised(rows).select("case_id", "answer_json"), "answer_json").first()
    assert back["well_formed"] and back["predicted_grade"] == 3 and back["answered_outcome"] == PAIN
    texts = {r["strategy"]: r["prompt"] for r in structured.prompts(df.limit(1), spark.createDataFrame([(PAIN, 2, "b"), (PAIN, 1, "a")], "outcome string, grade int, criterion string")).collect()}
    assert "Criteria:\n1: a\n2: b\nNote:\nAdmitted." in texts["rubric_grounded"] and "Criteria" not in texts["zero_shot"]
    run = structured.with_provenance(df, {"top_p": "1"}, model_name="m").first()["run"]
    assert run["model_name"] == "m" and run["model_version"] is None and run["generation_params"] == {"top_p": "1"}
    with pytest.raises(ValueError):
        structured.with_provenance(df, mood="good")


def test_sinks_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, o, n) for i, (o, n, _) in enumerate(NOTES)], "case_id long, outcome string, note_text string")
    for run, df in (("a", rows), ("b", rows.limit(3)), ("a", rows.limit(5))):
        sinks.write_predictions(df, str(tmp_path / "p"), run)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert {r["run_id"]: r["count"] for r in back.groupBy("run_id").count().collect()} == {"a": 5, "b": 3}
    sinks.write_metrics(metrics.distribution(rows, "outcome"), str(tmp_path / "m"), "outcomes")
    assert spark.read.parquet(str(tmp_path / "m" / "outcomes")).count() == 5
    sinks.write_endpoints(rows, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == len(NOTES)
    (tmp_path / "c.csv").write_text('case_id,patient_id,stage,outcome,gold_grade,note_text\n1,2,Discharge,X,3,"two\nlines, ""quoted"""\n')
    assert read_cases(spark, str(tmp_path / "c.csv")).first()["note_text"] == 'two\nlines, "quoted"'


def test_trajectory_orders_by_time_then_stage(spark):
    rows = [(1, 10, 0, "Death", 5), (1, 11, 0, "Presentation", 1), (1, 12, -1, "Discharge", 2)]
    got = metrics.trajectory(spark.createDataFrame(rows, "patient_id long, case_id long, ts long, stage string, predicted_grade int")).orderBy("encounter_seq").collect()
    assert [(r["case_id"], r["change"], r["worst"], r["stage_ordinal"]) for r in got] == [(12, None, 2, 4), (11, -1, 2, 1), (10, 4, 5, 5)]


@pytest.mark.parametrize("pairs,exact,near,kappa", [([(1, 1), (2, 2)], 100.0, 100.0, 1.0), ([(3, 3), (3, 3)], 100.0, 100.0, None), ([(1, None), (2, None)], 0.0, 0.0, 0.0), ([(-1, 0), (0, 1), (1, 3)], 0.0, 200 / 3, -0.2857142857)])
def test_metrics(spark, pairs, exact, near, kappa):
    df = spark.createDataFrame(pairs, "gold_grade int, predicted_grade int")
    a, k = metrics.accuracy(df).first(), metrics.kappa(df).first()
    assert a["exact_pct"] == exact and a["within_one_pct"] == pytest.approx(near)
    assert k["kappa"] == (None if kappa is None else pytest.approx(kappa))
    assert metrics.confusion_matrix(df).count() == 7


def test_structured(spark):
    ok = {"outcome": PAIN, "predicted_grade": 3, "evidence": ["Admitted"], "confidence": "high"}
    rows = [json.dumps(ok), "```json\n{}\n```", json.dumps(ok | {"predicted_grade": "3"}), json.dumps(ok | {"predicted_grade": 3.5}), json.dumps(ok | {"evidence": "Admitted"}), json.dumps(ok)[:40], json.dumps(ok | {"predicted_grade": 9, "more": 1}), None]
    got = structured.parsed(spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "case_id long, payload string")).orderBy("case_id").collect()
    assert [r["well_formed"] for r in got] == [True, False, False, False, False, False, True, False]
    assert got[6]["predicted_grade"] == 9
    df = spark.createDataFrame([(PAIN, 9), (SPLEEN, 2), (PRIAPISM, 5), (SPLEEN, -1), (PAIN, None)], "o string, g int")
    assert [r[0] for r in df.select(structured.allowed(df.o, df.g)).collect()] == [False, False, False, True, False]


def test_model_seam(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, prompt string")
    assert {tuple(r) for r in structured.asked(df, lambda: lambda prompts: [p.upper() for p in prompts]).collect()} == {(1, "A"), (2, "B")}


def test_rubric_file(spark, tmp_path):
    doc = {"_source": "a booklet", "X": {"outcome": "X", "booklet_page": 7, "definition": "d", "diagnostic_criteria": "c", "validation": "v", "grades": {"1": "one", "3": "three"}}}
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.json").write_text(json.dumps(doc, indent=1).replace("\n", "\r\n"))
    got = read_rubric(spark, str(tmp_path / "one")).orderBy("grade").collect()
    assert len({r["file"] for r in read_rubric(spark, str(tmp_path / "*")).collect()}) == 2
    assert [(r["outcome"], r["booklet_page"], r["grade"], r["criterion"]) for r in got] == [("X", 7, 1, "one"), ("X", 7, 3, "three")]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, o, n) for i, (o, n, _) in enumerate(NOTES)], "case_id long, outcome string, note_text string")
    rows.write.parquet(str(tmp_path / "in"))
    q = grade_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert {r["case_id"]: r["predicted_grade"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {i: g for i, (_, _, g) in enumerate(NOTES)}
