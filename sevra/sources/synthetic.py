"""Synthetic labelled cases, made from a table of events by integer arithmetic, so that every run gives the same rows.

Each event is a case of a patient (the user). Most notes state what their
grade needs; some are damaged on purpose: nothing to grade, a value just
under a threshold, a missing sentence, a denial, a distracting mention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rubric import CHEST, OUTCOMES, PAIN, PRIAPISM, SPLEEN
from ..plans.dialect import SPARK, Dialect, computed

#: What a note says besides its opening, by outcome and grade.
COURSE = {
    (PAIN, 1): "Managed at home with rest.", (PAIN, 2): "Seen in the day hospital and discharged, not admitted.", (PAIN, 3): "Admitted to the ward with no organ failure.", (PAIN, 4): "Admitted; the course was complicated by acute chest syndrome.", (PAIN, 5): "Admitted and died in hospital.",
    (CHEST, 1): "Treated with antibiotics only.", (CHEST, 2): "Given supplemental oxygen at FiO2 {fio2_low}%.", (CHEST, 3): "Escalated to BiPAP at FiO2 {fio2_high}%.", (CHEST, 4): "Exchange transfusion was done and the patient was intubated.", (CHEST, 5): "BiPAP was started and the patient died.",
    (SPLEEN, 1): "Observed only.", (SPLEEN, 3): "Given IV fluids and a transfusion.", (SPLEEN, 4): "Transfusion for hemodynamic instability.", (SPLEEN, 5): "A transfusion was given but the patient died.",
    (PRIAPISM, 1): "Resolved at home.", (PRIAPISM, 2): "Seen in the emergency department and given medication.", (PRIAPISM, 3): "Seen in the emergency department, aspiration performed.", (PRIAPISM, 4): "Seen in the emergency department and taken for a shunt.",
}
OPENING = {
    PAIN: ("Acute pain episode with pain for {hours} hours, treated with morphine.", "Acute pain episode with pain for 1 hours, treated with morphine."),
    CHEST: ("Imaging shows a new lobar infiltrate. Temperature 38.{tenth} C.", "Imaging shows a new lobar infiltrate. Temperature 38.4 C."),
    SPLEEN: ("Splenic sequestration with hemoglobin {hb}.{hb_tenth} g/dL from 9.5 g/dL, high reticulocyte count, spleen {spleen} cm from 2 cm.", "Splenic sequestration with hemoglobin 8.5 g/dL from 9.5 g/dL, high reticulocyte count, spleen 3 cm from 2 cm."),
    PRIAPISM: ("Painful priapism lasting {minutes} minutes, assessed by a physician.", "Painful priapism lasting 30 minutes, assessed by a physician."),
}
NOTHING = "Routine follow-up of sickle cell disease without acute complaints."
#: Stages of an episode in order; the last is terminal.
STAGES = ("Presentation", "Admission", "Hospital Course", "Discharge", "Death")
#: Damage by number: 2 nothing to grade, 3 under the threshold, 4 no course, 5 a denial, 6 a distracting mention, 7 a quantity without its number.
EXTRA = {5: " There was no shunt and no death.", 6: " A cousin had a stroke.", 7: " Prolonged duration was mentioned."}


def _numbers(d: Dialect) -> dict[str, str]:
    k = f"(case_id {d.div} 4)"
    return {"fio2_low": f"(22 + {k} % 28)", "fio2_high": f"(50 + {k} % 30)", "hours": f"(2 + {k} % 5)", "tenth": f"(5 + {k} % 5)", "hb": f"((50 + {k} % 25) {d.div} 10)", "hb_tenth": f"((50 + {k} % 25) % 10)", "spleen": f"(4 + {k} % 4)", "minutes": f"(31 + {k} % 200)"}


def _text(template: str, d: Dialect) -> str:
    """SQL that fills a template."""
    out, numbers = [], _numbers(d)
    for i, part in enumerate(template.replace("}", "{").split("{")):
        out.append(f"cast({numbers[part]} AS string)" if i % 2 else f"'{part}'")
    return "concat(" + ", ".join(x for x in out if x != "''") + ")"


def _true_grade(d: Dialect) -> str:
    """SQL of the grade that the course of a case's note describes."""
    return "CASE outcome " + " ".join(f"WHEN '{o}' THEN CASE (case_id {d.div} 4) % {len(g)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(g)) + " END" for o, (_, g) in OUTCOMES.items()) + " END"


def columns(d: Dialect) -> list[list[tuple[str, str]]]:
    """Steps of (name, SQL) from event_id, user_id and ts to a labelled case; each step sees the one before."""
    names = list(OUTCOMES)
    outcome = "CASE case_id % 4 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(names)) + " END"
    true_grade = _true_grade(d)
    course = "CASE " + " ".join(f"WHEN outcome = '{o}' AND true_grade = {g} THEN {_text(t, d)}" for (o, g), t in COURSE.items()) + " END"
    opening = "CASE " + " ".join(f"WHEN outcome = '{o}' THEN CASE WHEN damage = 3 THEN {_text(b, d)} ELSE {_text(a, d)} END" for o, (a, b) in OPENING.items()) + " END"
    extra = "CASE damage " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EXTRA.items()) + " ELSE '' END"
    return [
        [("case_id", "event_id"), ("patient_id", "user_id"), ("ts", "ts")],
        [("outcome", outcome), ("damage", f"(case_id {d.div} 20) % 16")],
        [("true_grade", true_grade)],
        [("gold_grade", "CASE damage WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE true_grade END"), ("course", course), ("opening", opening), ("extra", extra)],
        [("stage", "CASE WHEN contains(course, 'died') AND damage NOT IN (2, 4) THEN 'Death' ELSE CASE (case_id " + d.div + " 8) % 4 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STAGES[:4])) + " END END"), ("note_text", f"CASE damage WHEN 2 THEN '{NOTHING}' WHEN 4 THEN opening ELSE concat(opening, ' ', course, extra) END"), ("gold_evidence", "CASE WHEN damage IN (2, 3) THEN '' ELSE course END")],
    ]


KEPT = ("case_id", "patient_id", "ts", "stage", "outcome", "gold_grade", "note_text", "gold_evidence")


def cases(events: DataFrame) -> DataFrame:
    """One labelled case per event: case_id, patient_id, ts, stage, outcome, gold_grade, note_text, gold_evidence."""
    first, *rest = columns(SPARK)
    return computed(events.selectExpr(*(f"{s} AS {n}" for n, s in first)), rest).select(*KEPT)


def patients(events: DataFrame) -> DataFrame:
    """One row per patient: patient_id, first_ts."""
    return events.groupBy(F.col("user_id").alias("patient_id")).agg(F.min("ts").alias("first_ts"))


def payloads(cases_: DataFrame, strategy: str = "rubric_grounded") -> DataFrame:
    """Recorded answers of a model in JSON, some of them damaged, some for cases that don't exist: (case_id, payload)."""
    return computed(cases_.select("case_id", "outcome", "gold_grade", "gold_evidence"), payload_columns(SPARK, strategy)).select(F.col("answer_id").alias("case_id"), "payload")


def payload_columns(d: Dialect, strategy: str = "rubric_grounded") -> list[list[tuple[str, str]]]:
    fault = {"rubric_grounded": f"(case_id {d.div} 11) % 13", "zero_shot": f"(case_id {d.div} 7) % 9"}[strategy]
    # 9: a value under a threshold taken for one above; 10: evidence in other words.
    said = f"CASE WHEN fault = 9 AND gold_grade = 0 THEN cast({_true_grade(d)} AS string) ELSE CASE fault WHEN 2 THEN concat('\"', cast(gold_grade AS string), '\"') WHEN 3 THEN '9' WHEN 5 THEN cast(CASE WHEN gold_grade >= 2 THEN gold_grade - 1 ELSE gold_grade + 1 END AS string) ELSE cast(gold_grade AS string) END END"
    evidence = "CASE WHEN fault = 6 THEN '[\"Liver biopsy\"]' WHEN gold_evidence = '' THEN '[]' ELSE concat('[\"', CASE fault WHEN 10 THEN 'Documented: ' ELSE '' END, gold_evidence, '\"]') END"
    body = "concat('{\"outcome\": \"', outcome, '\", \"predicted_grade\": ', said, ', \"evidence\": ', found, ', \"rationale\": \"', CASE WHEN gold_evidence = '' THEN 'criteria not met' ELSE gold_evidence END, '\", \"confidence\": \"', CASE fault WHEN 7 THEN 'low' ELSE 'high' END, '\", \"human_review\": ', CASE WHEN fault = 8 THEN 'true' ELSE 'false' END, '}')"
    return [
        [("fault", fault), ("answer_id", "CASE WHEN case_id % 97 = 5 THEN -1 - case_id ELSE case_id END")],
        [("said", said), ("found", evidence)],
        [("payload", f"CASE fault WHEN 1 THEN substr({body}, 1, 40) WHEN 4 THEN NULL ELSE {body} END")],
    ]
