"""Reading notes: scopes of denial, family and history; quantities in many wordings; the lexicon as a table; grades that depend on it."""

import pytest

from sevra.functions import lexicon as lx
from sevra.functions import reading
from sevra.functions.rubric import CHEST, PAIN, PRIAPISM, SPLEEN
from sevra.operators.grading import graded

A, D, FAM, H = "asserted", "denied", "family", "historical"
#: Sentence and the status of phrases in it, labelled by hand.
SENTENCES = [
    ("A shunt was not needed.", {"shunt": D}), ("Transfusion was not given.", {"transfusion": D}), ("Stroke was ruled out.", {"stroke": D}), ("Father died of stroke.", {"died": FAM, "stroke": FAM}), ("Patient without improvement was admitted.", {"admitted": A}),
    ("No organ failure and no death.", {"organ failure": D, "death": D}), ("Admitted, did not respond to fluids and died.", {"admitted": A, "died": A}), ("Admitted without organ failure but needed vasopressors.", {"admitted": A, "organ failure": D, "vasopressor": A}),
    ("Denies cough, wheezing or rales.", {"cough": D, "wheezing": D, "rale": D}), ("No cough, but wheezing was heard.", {"cough": D, "wheezing": A}), ("Seen in the day hospital and discharged, not admitted.", {"day hospital": A, "admitted": D}),
    ("Stroke and DVT were ruled out.", {"stroke": D, "dvt": D}), ("She was admitted and stroke was ruled out.", {"admitted": A, "stroke": D}), ("Ruled out stroke.", {"stroke": D}), ("Stroke cannot be excluded.", {"stroke": A}),
    ("History of stroke and DVT.", {"stroke": H, "dvt": H}), ("History of stroke, admitted with a pain crisis.", {"stroke": H, "admitted": A, "pain crisis": A}), ("Splenectomy three years ago.", {"splenectomy": H}), ("Previous exchange transfusion, now intubated.", {"exchange transfusion": H, "intubated": A}),
    ("No history of stroke.", {"stroke": D}), ("Family history of stroke.", {"stroke": FAM}), ("A cousin had a stroke and the patient was admitted.", {"stroke": FAM, "admitted": A}), ("Stroke in his mother.", {"stroke": FAM}), ("Her mother reports a pain crisis.", {"pain crisis": A}),
    ("The patient, whose father had a stroke, was admitted.", {"stroke": FAM, "admitted": A}), ("Intubation was never required.", {"intubation": D}), ("He never needed a shunt.", {"shunt": D}), ("Not only cough but wheezing.", {"cough": A, "wheezing": A}), ("Neither cough nor rales.", {"cough": D, "rale": D}),
    ("Negative for pulmonary embolism; DVT was seen.", {"pulmonary embolism": D, "dvt": A}), ("No shunt. A shunt was seen.", {"shunt": {A, D}}), ("The patient did not have cough, wheezing or nasal flaring.", {"cough": D, "wheezing": D, "nasal flaring": D}), ("Free of organ failure.", {"organ failure": D}),
    ("A new lobar infiltrate was not seen.", {"new lobar infiltrate": D}), ("Aspiration and irrigation were not performed.", {"aspiration": D, "irrigation": D}), ("BiPAP was started without delay.", {"bipap": A}), ("Without cough he was intubated.", {"cough": D, "intubated": A}), ("Remote splenectomy.", {"splenectomy": H}),
    ("Had a stroke as a child, died in hospital.", {"stroke": H, "died": A}), ("Splenic sequestration is excluded; hemodynamically unstable.", {"splenic sequestration": D, "hemodynamically unstable": A}), ("Mother died. Patient admitted.", {"died": FAM, "admitted": A}), ("Acute vaso-occlusive crisis.", {"vaso occlusive crisis": A}),
    ("No respiratory distress, required high-flow oxygen.", {"respiratory distress": D, "high flow": A}), ("Erythropoietin was declined.", {"erythropoietin": D}),
]
#: Note and the measures that are read from it: (measure, role) to value.
QUANTITIES = [
    ("Given FiO2 of 60%.", {("fio2", "now"): 60}), ("FiO2 0.6", {("fio2", "now"): 60}), ("FiO2 was raised to 0.6", {("fio2", "now"): 60}), ("FiO2 40 %", {("fio2", "now"): 40}), ("FiO2: 40 percent", {("fio2", "now"): 40}), ("on 50% FiO2", {("fio2", "now"): 50}),
    ("FiO2 raised from 40% to 60%", {("fio2", "now"): 60, ("fio2", "was"): 40}), ("FiO2 was raised on day 3 to 60%", {("fio2", "now"): 60}), ("FiO2 40-60%", {}), ("FiO2 40 to 60%", {}), ("FiO2 7", {}), ("FiO2 raised. SpO2 91%", {("spo2", "now"): 91}),
    ("Hb 5 g/dL", {("hb", "now"): 5}), ("Hb 5", {("hb", "now"): 5}), ("Hgb fell to 6.5 from a baseline of 9", {("hb", "now"): 6.5, ("hb", "was"): 9}), ("haemoglobin 75 g/L (usual 95 g/L)", {("hb", "now"): 7.5, ("hb", "was"): 9.5}), ("Hct 24% from 30%", {("hct", "now"): 24, ("hct", "was"): 30}),
    ("pain for 3 hrs", {("pain_minutes", "now"): 180}), ("pain for three hours", {("pain_minutes", "now"): 180}), ("pain lasting half an hour", {("pain_minutes", "now"): 30}), ("a 3-hour pain crisis", {("pain_minutes", "now"): 180}), ("two days of pain", {("pain_minutes", "now"): 2880}),
    ("pain for the past 2 weeks", {("pain_minutes", "now"): 20160}), ("pain for several hours", {}), ("pain for more than 3 hours", {("pain_minutes", "now"): 180.06}), ("priapism for 45 min", {("priapism_minutes", "now"): 45}), ("an erection lasting over 4 hours", {("priapism_minutes", "now"): 240.06}),
    ("Temperature 38.5 C", {("temperature", "now"): 38.5}), ("temp 39.2", {("temperature", "now"): 39.2}), ("fever of 102 F", {("temperature_f", "now"): 102}), ("temperature 38.5°C", {("temperature", "now"): 38.5}), ("No fever. Father had a fever of 40 C", {}),
    ("PaO2 <60 mmHg", {("pao2", "now"): 59.999}), ("PaO2 60", {("pao2", "now"): 60}), ("oxygen saturation 91% from 98%", {("spo2", "now"): 91, ("spo2", "was"): 98}), ("spleen palpable 60 mm below the margin, baseline 2 cm", {("spleen_cm", "now"): 6, ("spleen_cm", "was"): 2}), ("spleen 4", {}),
    ("hemoglobin 9 g/dL, temperature 38 C, SpO2 97%, FiO2 30%", {("hb", "now"): 9, ("temperature", "now"): 38, ("spo2", "now"): 97, ("fio2", "now"): 30}),
]
PAINFUL = "Acute pain episode with pain for 5 hours, treated with morphine. Admitted. "
LUNG = "A new lobar infiltrate with cough. "
BLOOD = "Splenic sequestration with {}, high reticulocyte count, spleen {}. Observed."
#: Notes of ordinary wording with the grade by hand, and whether a human is asked.
NOTES = [
    (CHEST, LUNG + "Given FiO2 of 60%.", 3, False), (CHEST, LUNG + "FiO2 was raised to 0.6.", 3, False), (CHEST, LUNG + "FiO2 40 %.", 2, False), (CHEST, LUNG + "FiO2 was raised.", 0, True), (CHEST, LUNG + "Antibiotics only, stroke was ruled out.", 1, False), (CHEST, LUNG + "Simple transfusion was not given.", 1, False),
    (PAIN, PAINFUL + "Stroke was ruled out.", 3, False), (PAIN, PAINFUL + "Father died of stroke.", 3, False), (PAIN, PAINFUL + "A stroke was seen.", 4, False), (PAIN, "Vaso-occlusive crisis, pain for three hours, ibuprofen. Managed at home.", 1, False), (PAIN, "Vaso-occlusive crisis, pain for several hours, ibuprofen. Managed at home.", 0, True),
    (PAIN, "Pain crisis, pain for 2 hrs, morphine. Patient without improvement was admitted.", 3, False), (PAIN, "Pain crisis, pain for 1 hr, morphine. Managed at home.", 0, True),
    (PRIAPISM, "Painful priapism for 45 min, seen by a physician in the emergency department, aspiration. A shunt was not needed.", 3, False), (PRIAPISM, "Painful priapism for 30 min, seen by a physician. Resolved at home.", 0, True),
    (SPLEEN, BLOOD.format("Hb 5 g/dL (baseline 9 g/dL)", "6 cm from 2 cm"), 1, False), (SPLEEN, BLOOD.format("Hb 7.3 from 9", "6 cm from 2 cm"), 0, True), (SPLEEN, BLOOD.format("Hb 7.2 from 9", "4 cm from 2 cm"), 1, False), (SPLEEN, BLOOD.format("Hb 7 from 9", "enlarged"), 0, True), (SPLEEN, BLOOD.format("Hb 9 from 11", "4.1 cm from 2.1 cm"), 1, False),
]


def test_scopes(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SENTENCES)], "i int, s string").select("i", reading.mentions("s").alias("m"))
    for r in rows.collect():
        sentence, want = SENTENCES[r["i"]]
        for phrase, status in want.items():
            got = {m["status"] for m in r["m"] if m["phrase"] == phrase and m["kind"] == "fact"}
            assert got == (status if isinstance(status, set) else {status}), (sentence, phrase, got)


def test_quantities(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(QUANTITIES)], "i int, s string").select("i", reading.measures("s").alias("v"))
    for r in rows.collect():
        note, want = QUANTITIES[r["i"]]
        got = {}
        for v in r["v"]:
            got.setdefault((v["measure"], v["role"]), v["value"])
        assert got == pytest.approx(want), (note, got)


def test_grades_of_ordinary_wording(spark):
    rows = spark.createDataFrame([(i, o, n) for i, (o, n, *_) in enumerate(NOTES)], "case_id long, outcome string, note_text string")
    for r in graded(rows).collect():
        outcome, note, grade, review = NOTES[r["case_id"]]
        assert (r["predicted_grade"], r["human_review"]) == (grade, review), (note, r)


def test_unread_quantities_and_oxygen(spark):
    notes = ["FiO2 was raised. Low SpO2.", "Low Hb, Hb 7.", "No fever, pain for hours.", "Pain.", None, ""]
    got = [r["f"] for r in spark.createDataFrame([(n,) for n in notes], "n string").select(reading.read("n").alias("f")).collect()]
    assert [set(f["unread"]) for f in got] == [{"fio2", "spo2"}, set(), {"pain"}, set(), set(), set()]
    assert got[0]["oxygen"] and got[0]["fio2"] is None and not got[4]["pain"] and got[4]["evidence"] == []


def test_evidence_is_as_written(spark):
    note = "Temperature 38.5 C, IV fluids and IV fluids; no shunt. Retractions."
    assert spark.createDataFrame([(note,)], "n string").select(reading.read("n")["evidence"]).first()[0] == ["temperature 38.5 c", "iv fluids", "retractions"]


def test_lexicon_from_a_table(spark, tmp_path):
    (tmp_path / "more.csv").write_text("kind,name,phrase\nfact,pain,sickle attack\nquantity,hb,haemoglobin level\ndeny_noun,deny_noun,nil\n")
    more = lx.lexicon(spark.read.csv(str(tmp_path / "more.csv"), header=True))
    note = "Sickle attacks with pain for 5 hours, morphine. Admitted. Nil organ failure."
    rows = spark.createDataFrame([(1, PAIN, note)], "case_id long, outcome string, note_text string")
    assert graded(rows).first()["predicted_grade"] == -1 and graded(rows, lexicon=more).first()["predicted_grade"] == 3
    for bad in [("fact", "mood", "sad"), ("verb", "x", "y"), ("fact", "pain", "--"), (None, "pain", "x")]:
        with pytest.raises(ValueError):
            lx.lexicon(spark.createDataFrame([bad], "kind string, name string, phrase string"))


def test_columns_named_like_facts_stay(spark):
    df = spark.createDataFrame([(1, PAIN, PAINFUL, "mine", True, "x", "y")], "case_id long, outcome string, note_text string, shunt string, death boolean, f string, evidence string")
    r = graded(df, facts=True).first().asDict()
    assert (r["shunt"], r["death"], r["f"], r["predicted_grade"]) == ("mine", True, "x", 3) and r["evidence"] != "y" and not r["facts"]["death"]


def test_long_note(spark):
    note = PAINFUL + "No cough, wheezing or rales. Hb 7 from 9. " * 400 + "Died."
    assert graded(spark.createDataFrame([(1, PAIN, note)], "case_id long, outcome string, note_text string")).first()["predicted_grade"] == 5
