"""Rules from files, misread thresholds, evidence by alignment, the answer store, metric cells, episodes."""

import json
import random
from collections import Counter

import pytest
from test_grader import NOTES
from test_reading import NOTES as WORDED

from sevra.functions import alignment, lexicon
from sevra.functions.rubric import CHEST, CORE, CORE_TEXT, PAIN, SPLEEN, parsed
from sevra.operators import answers, metrics, raters, structured
from sevra.operators.grading import graded, misreads, predicted
from sevra.sources import sinks, yaml_subset
from sevra.sources.rubric_file import read_rubric, read_rules
from sevra.sources.tables import read_raw
from sevra.streaming.episodes import episode_stream
from pyspark.sql import functions as F

CASES = [(i, o, n) for i, (o, n, *_) in enumerate([*NOTES, *WORDED])]


def cases(spark):
    return spark.createDataFrame(CASES, "case_id long, outcome string, note_text string")


def test_grade_follows_the_file(spark, tmp_path):
    doc = json.loads(CORE_TEXT)
    doc[CHEST]["thresholds"]["T6"] = "fio2 >= 40"
    doc[CHEST]["grades"]["3"] = "FiO2 of 40 % or more"
    (tmp_path / "b.json").write_text(json.dumps({CHEST: doc[CHEST], "_note": "changed"}))
    (tmp_path / "a.json").write_text(json.dumps(doc | {"Stroke": {"grades": {"2": "stroke"}, "present": "complication", "criteria": "admitted or visit", "when": {"2": "not death and (fio2 > 21 or 1 < 2 or admitted)"}}}))
    rules = read_rules(spark, str(tmp_path))
    notes = [(1, CHEST, "A new lobar infiltrate with cough. FiO2 45%."), (2, CHEST, "A new lobar infiltrate with cough. FiO2 39%."), (3, "Stroke", "Stroke. Admitted."), (4, "Stroke", "Admitted.")]
    df = spark.createDataFrame(notes, "case_id long, outcome string, note_text string")
    assert {r["case_id"]: (r["predicted_grade"], r["rationale"]) for r in graded(df, rubric=rules).collect()} == {1: (3, "FiO2 of 40 % or more"), 2: (2, doc[CHEST]["grades"]["2"]), 3: (2, "stroke"), 4: (-1, "outcome not present")}
    assert [r["predicted_grade"] for r in graded(df).orderBy("case_id").collect()] == [2, 2, -1, -1]


@pytest.mark.parametrize(
    "change,says",
    [({"present": "mood"}, "unknown fact 'mood'"), ({"criteria": "pain; drop"}, "can't read"), ({"when": {"1": "pain"}}, "conditions for"), ({"grades": {"9": "x"}, "when": {"9": "pain"}}, "grades"), ({"criteria": "upper(pain)"}, "unknown fact 'upper'"), ({"thresholds": {"T1": "pain"}}, "compares numbers"), ({"criteria": ""}, "no condition")],
)
def test_rules_that_a_file_must_not_hold(change, says):
    entry = {"grades": {"1": "a", "2": "b"}, "present": "pain", "criteria": "T1", "when": {"1": "visit", "2": "admitted"}, "thresholds": {"T1": "pain_minutes > 5"}} | change
    with pytest.raises(ValueError, match=says):
        parsed(json.dumps({"X": entry}))
    with pytest.raises(ValueError, match="without criteria"):
        parsed(json.dumps({"X": {"grades": {}, "present": "pain", "when": {}}}))


def test_misreads_equal_grading_by_the_opposite_threshold(spark):
    got = {r["case_id"]: {m["threshold"]: m["grade"] for m in r["misreads"]} for r in misreads(cases(spark)).collect()}
    base = {r["case_id"]: r["predicted_grade"] for r in predicted(cases(spark)).collect()}
    seen = set()
    for threshold, outcome, condition in CORE.thresholds:
        if " or " in condition:
            continue  # by hand below
        doc = json.loads(CORE_TEXT)
        sign, opposite = next((a, b) for a, b in ((">=", "<"), (">", "<="), ("<", ">=")) if a in condition)
        doc[outcome]["thresholds"][threshold] = condition.replace(sign, opposite)
        want = {r["case_id"]: r["predicted_grade"] for r in predicted(cases(spark), rubric=parsed(json.dumps(doc))).collect()}
        for case, o, _ in CASES:
            if threshold in got[case]:
                assert o == outcome and got[case][threshold] == want[case], (threshold, case)
                seen.add(threshold)
            else:
                assert want[case] == base[case], (threshold, case)
    assert seen == {t for t, _, c in CORE.thresholds if " or " not in c}
    two = spark.createDataFrame([(1, CHEST, "A new lobar infiltrate. Temperature 38.4 C."), (2, CHEST, "A new lobar infiltrate. Temperature 102 F."), (3, SPLEEN, "Splenic sequestration with Hb 7.5 from 9, high reticulocyte count, spleen 6 cm from 2 cm.")], "case_id long, outcome string, note_text string")
    assert {r["case_id"]: {m["threshold"]: m["grade"] for m in r["misreads"]} for r in misreads(two).collect()} == {1: {"T2": 1}, 2: {"T2": 0}, 3: {"T7": 1, "T8": 1, "T9": 0}}


def lcs(a, b):
    row = [0] * (len(a) + 1)
    for w in b:
        out = [0]
        for j, x in enumerate(a):
            out.append(row[j] + 1 if x == w else max(row[j + 1], out[j]))
        row = out
    return row[-1]


def test_alignment_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["infiltrate", "new", "oxygen", "the", "of", "required", "pulmonary", "2.5", "shunt", "shunts"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n))) + rng.choice(["", ".", ". "])
    rows = [(i, text(7), text(12) + " " + text(12) + "\n" + text(5)) for i in range(400)]
    stems = lambda s: [w.removesuffix("s")[:5] for w in s.replace(".", " . ").replace("2 . 5", "2.5").split() if w not in (*alignment.EMPTY_WORDS, ".")]
    got = {r["i"]: r["yes"] for r in spark.createDataFrame(rows, "i int, e string, t string").select("i", alignment.supported(F.col("e"), F.col("t")).alias("yes")).collect()}
    for i, e, t in rows:
        lines = [x for part in t.split("\n") for x in (part + " ").replace("2.5", "2_5").split(". ")]
        a = stems(e)
        want = e in t or bool(a) and any(100 * lcs(a, stems(x.replace("2_5", "2.5"))) >= alignment.SHARE * len(a) for x in lines)
        assert got[i] == want, (e, t)


def test_paraphrases_are_supported_and_foreign_evidence_is_not(spark):
    note = "Chest film with a new lobar infiltrate of the left lung. The patient required oxygen, supplemental, by mask. Respiratory support was then escalated. Hb 7.5."
    pairs = [("New pulmonary infiltrate", True), ("Required supplemental oxygen", True), ("Respiratory support escalation", True), ("Liver biopsy", False), ("Old infiltrate of the right kidney", False), ("Hb 6.5", False), ("hb 7.5", True), ("", True), ("the of", False), (None, False), ("lung left new", False)]
    df = spark.createDataFrame([(e, note) for e, _ in pairs], "e string, t string")
    assert [r[0] for r in df.select(alignment.supported(F.col("e"), F.col("t"))).collect()] == [y for _, y in pairs]
    assert [r[0] for r in df.select(alignment.supported(F.col("e"), F.lit(None).cast("string"))).collect()] == [e == "" for e, _ in pairs]


def test_answer_store_asks_each_case_once(spark, tmp_path):
    store, log = str(tmp_path / "store"), tmp_path / "log"
    log.mkdir()
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(40)] + [(3, "prompt 3"), (None, "x"), (99, None)], "case_id long, prompt string")

    def client(broken=()):
        def make():
            def ask(texts):
                case = int(texts[0].split()[1])
                with open(log / str(case), "a") as f:
                    f.write(".")
                if case in broken:
                    raise TimeoutError(f"no answer to {case}")
                return [f"answer {case}"]

            return ask

        return make

    # A run that breaks off after two of its batches.
    class Stopped(Exception):
        pass

    made = []

    def breaking(*a, **k):
        made.append(1)
        if len(made) > 2:
            raise Stopped
        return original(*a, **k)

    original, answers._asking = answers._asking, breaking
    try:
        with pytest.raises(Stopped):
            answers.ask(prompts, client(), store, "m", "1", "run1", batches=5)
    finally:
        answers._asking = original
    first = answers.answers(spark, store).count()
    assert 0 < first < 40
    assert answers.ask(prompts, client({7, 8}), store, "m", "1", "run2", batches=5) == 40 - first
    calls = {int(p.name): len(p.read_text()) for p in log.iterdir()}
    assert set(calls) == set(range(40)) and set(calls.values()) == {1}
    rows = {r["case_id"]: r for r in answers.answers(spark, store).collect()}
    assert len(rows) == 40 and rows[5]["payload"] == "answer 5" and rows[5]["n_failed"] == 0
    failed = [c for c in (7, 8) if rows[c]["payload"] is None]
    assert failed and all("TimeoutError: no answer" in rows[c]["error"] for c in failed)
    # Failed cases are asked again, up to the limit; answered ones never.
    assert answers.ask(prompts, client({7, 8}), store, "m", "1", "run3") == len(failed)
    assert answers.ask(prompts, client({7, 8}), store, "m", "1", "run4") == len(failed)
    assert answers.ask(prompts, client(), store, "m", "1", "run5") == 0
    # Another model and another prompt version have answers of their own.
    assert answers.ask(prompts.where("case_id < 4"), client(), store, "m", "2", "run6") == 4
    assert answers.ask(prompts.limit(0), client(), store, "n", "1", "run7") == 0
    assert Counter((r["model"], r["prompt_version"]) for r in answers.answers(spark, store).collect()) == {("m", "1"): 40, ("m", "2"): 4}


def test_versions_follow_what_they_stand_for(spark):
    one = structured.recorded_versions(CORE_TEXT, lexicon.DEFAULT)
    assert one == structured.recorded_versions(CORE_TEXT, lexicon.DEFAULT) and "pyspark 4" in one["package_versions"]
    assert one["model_version"] != structured.recorded_versions(CORE_TEXT + " ", lexicon.DEFAULT)["model_version"] != structured.recorded_versions(CORE_TEXT, lexicon.DEFAULT[1:])["model_version"]
    version = lambda rows: spark.createDataFrame(rows, "case_id long, note_text string").agg(structured.case_version()).first()[0]
    rows = [(1, "a"), (2, None), (2, "b")]
    assert version(rows) == version(rows[::-1]) and len({version(rows), version(rows[:2]), version([(1, "b"), (2, None), (2, "a")]), version([])}) == 4


def test_cells_add_up(spark, tmp_path):
    rng = random.Random(4)
    rows = [("ab"[i % 2], PAIN if i % 3 else CHEST, rng.randrange(-1, 6), rng.choice([None, *range(-1, 6)])) for i in range(500)]
    df = spark.createDataFrame(rows, "model string, outcome string, gold_grade int, predicted_grade int")
    path = str(tmp_path / "cells")
    for run, part in (("r1", df.where("model = 'a'")), ("r2", df.where("model = 'b'")), ("r2", df.where("model = 'b'"))):
        sinks.add_cells(metrics.cells(part, "model", "outcome"), path, run)
    stored = sinks.read_cells(spark, path)
    assert stored.select("run_id").distinct().count() == 2 and stored.agg(F.sum("n")).first()[0] == 500
    for by in (("model",), ("outcome",), ("model", "outcome"), ()):
        for of_cells, of_rows in ((metrics.accuracy_of_cells, metrics.accuracy), (metrics.kappa_of_cells, metrics.kappa), (metrics.confusion_of_cells, metrics.confusion)):
            assert Counter(map(tuple, of_cells(stored, *by).collect())) == Counter(map(tuple, of_rows(df, *by).collect()))
    n, agree = len(rows), sum(g == p for *_, g, p in rows)
    chance = sum(sum(x[2] == g for x in rows) * sum((x[3] if x[3] is not None else -9) == g for x in rows) for g in range(-1, 6)) / n / n
    assert metrics.kappa_of_cells(stored).first()["kappa"] == pytest.approx((agree / n - chance) / (1 - chance))
    assert metrics.accuracy_of_cells(stored.limit(0)).collect()[0]["n"] in (0, None)


def test_episodes_and_stages(spark):
    note = {1: "Seen in the emergency department.", 2: "Admitted to the ward.", 3: "Hospital course: transfusion.", 4: "Discharged home."}
    hours = [(1, 0, 1, 2), (1, 2, 2, 3), (1, 7.9, 4, 1), (1, 14, 1, 4), (1, 14, 2, None), (2, 0, 4, 1), (2, 1, 1, 5), (2, 30, 3, 2)]
    rows = [(p, i, float(h), note[s], g) for i, (p, h, s, g) in enumerate(hours)]
    df = spark.createDataFrame(rows, "patient_id long, case_id long, h double, note_text string, predicted_grade int").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    got = {r["case_id"]: r for r in metrics.episodes(df).collect()}
    assert {k: (r["episode"], r["encounter_seq"], r["stage"], r["change"], r["worst"], r["in_order"]) for k, r in got.items()} == {
        0: (1, 1, "Presentation", None, 2, True), 1: (1, 2, "Admission", 1, 3, True), 2: (1, 3, "Discharge", -2, 3, True), 3: (2, 1, "Presentation", None, 4, True), 4: (2, 2, "Admission", None, 4, True),
        5: (1, 1, "Discharge", None, 1, True), 6: (1, 2, "Presentation", 4, 5, False), 7: (2, 1, "Hospital Course", None, 2, True),
    }
    assert metrics.episodes(df.limit(0)).collect() == []


def test_episode_totals_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rng = random.Random(9)
    rows = sorted((rng.randrange(0, 400) * 1800, i % 7, i, rng.choice([None, 0, 1, 3, 5])) for i in range(300))
    df = spark.createDataFrame(rows, "s long, patient_id long, case_id long, predicted_grade int").withColumn("ts", F.timestamp_seconds("s"))
    want = Counter(map(tuple, metrics.episode_totals(df).collect()))
    by_hand, last = Counter(), {}
    for s, p, *_ in rows:
        by_hand[p] += p not in last or s - last[p] >= 6 * 3600
        last[p] = s
    assert Counter({p: sum(1 for k in want if k[0] == p) for p in by_hand}) == by_hand and sum(k[3] for k in want) == 300
    for i in range(3):
        df.where(f"s >= {i * 240000} and s < {(i + 1) * 240000}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "end").mkdir()
    grown = episode_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "state"))
    grown.awaitTermination(120)
    got = Counter(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    # Sessions that the watermark has not passed are still open, all others are out, as in the table.
    assert got and not got - want
    end = max(r[0] for r in rows)
    assert all(k[2].timestamp() > end - 7 * 3600 for k in want - got)


def test_alpha_of_a_worked_example(spark):
    """Three raters of fifteen cases with missing ratings, whose alphas are published: 0.691 by name, 0.811 by distance."""
    a, b, c = "* * * * * 3 4 1 2 1 1 3 3 * 3", "1 * 2 1 3 3 4 3 * * * * * * *", "* * 2 1 3 4 4 * 2 1 1 3 3 * 4"
    rows = [(i, r, None if g == "*" else int(g)) for r, line in zip("abc", (a, b, c), strict=True) for i, g in enumerate(line.split())]
    df = spark.createDataFrame([*rows, (None, "a", 1)], "case_id long, rater string, grade int")
    for metric, want in (("nominal", 0.691), ("interval", 0.811)):
        r = raters.alpha(df, metric=metric).first()
        assert (r["cases"], r["ratings"]) == (12, 26) and r["alpha"] == pytest.approx(want, abs=5e-4) and r["low"] < r["alpha"] < r["high"] <= 1
    assert raters.alpha(df.where("grade = 3")).first()["alpha"] is None
    assert raters.alpha(df.where("rater = 'a'")).count() == 0 or raters.alpha(df.where("rater = 'a'")).first()["alpha"] is None
    with pytest.raises(Exception, match="no such grade"):
        raters.alpha(df.withColumn("grade", F.lit(9))).collect()


def test_alpha_and_its_intervals_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, r, rng.choice([None, 1, 2, 2, 5, -1])) for i in range(60) for r in "abcd"]
    got = raters.alpha(spark.createDataFrame(rows, "case_id long, rater string, grade int"), metric="interval").first()
    draws = {r["case_id"]: r["w"] for r in spark.range(60).select(F.col("id").alias("case_id"), raters.weights(F.col("id")).alias("w")).collect()}
    units = {i: [g for k, _, g in rows if k == i and g is not None] for i in range(60)}
    units = {i: g for i, g in units.items() if len(g) > 1}

    def by_hand(weight):
        pairs = [(weight(i) / (len(g) - 1), x, y) for i, g in units.items() for j, x in enumerate(g) for k, y in enumerate(g) if j != k]
        n = Counter()
        for i, g in units.items():
            for x in g:
                n[x] += weight(i)
        total = n.total()
        return 1 - (total - 1) * sum(w * (x - y) ** 2 for w, x, y in pairs) / sum(n[x] * n[y] * (x - y) ** 2 for x in n for y in n)

    again = sorted(by_hand(lambda i, r=r: draws[i][r]) for r in range(raters.REPLICATES))
    assert got["alpha"] == pytest.approx(by_hand(lambda i: 1)) and got["low"] == pytest.approx(again[0]) and got["high"] == pytest.approx(again[38])
    mean = sum(sum(w) for w in draws.values()) / (60 * raters.REPLICATES)
    assert abs(mean - 1) < 0.06 and len({tuple(w) for w in draws.values()}) == 60


def test_raw_rows_are_graded_or_set_aside(spark, tmp_path):
    good = f'{{}},1,Discharge,{PAIN},3,"Acute pain episode with pain for 5 hours, treated with morphine. Admitted."'
    rows = [good.format(1), good.format("x2"), f"3,1,Discharge,{PAIN},3,", "4,1,Discharge,Gout,3,note", f"5,1,Discharge,{PAIN},9,note", f",1,Discharge,{PAIN},3,note", f"7,1,Discharge,{PAIN}", good.format(8).replace(",3,", ",three,")]
    (tmp_path / "a.csv").write_text("case_id,patient_id,stage,outcome,gold_grade,note_text\n" + "\n".join(rows) + "\n")
    (tmp_path / "b.csv").write_text("case_id,patient_id,stage,outcome,gold_grade,note_text\n" + good.format(9) + "\n")
    cases, aside = read_raw(spark, str(tmp_path))
    assert {r["case_id"]: r["predicted_grade"] for r in graded(cases).collect()} == {1: 3, 9: 3}
    got = Counter((r["reason"], r["file"].split("/")[-1]) for r in aside.collect())
    assert got == {("does not fit the schema", "a.csv"): 3, ("no note", "a.csv"): 1, ("no such outcome", "a.csv"): 1, ("grade outside of -1 to 5", "a.csv"): 1, ("no case_id", "a.csv"): 1}
    assert good.format("x2") in {r["row"] for r in aside.collect()}


YAML = """# a rubric
---
_source: 'a ''booklet'''
"X (one)":
  outcome: X (one)
  booklet_page: 7   # page
  definition: >
    two lines
    of text
  diagnostic_criteria: "c: d # no comment"
  validation: v
  grades:
    1: one
    "3": 'three'
  present: pain
  criteria: T1 and analgesic
  when:
    1: visit
    3: admitted
  thresholds:
    T1: pain_minutes >= 120
  review:
  - death
  overlaps: [1, 3]
"""


def test_yaml_says_what_json_says(spark, tmp_path):
    doc = {"outcome": "X (one)", "booklet_page": 7, "definition": "two lines of text", "diagnostic_criteria": "c: d # no comment", "validation": "v", "grades": {"1": "one", "3": "three"}, "present": "pain", "criteria": "T1 and analgesic"}
    doc = {"_source": "a 'booklet'", "X (one)": doc | {"when": {"1": "visit", "3": "admitted"}, "thresholds": {"T1": "pain_minutes >= 120"}, "review": ["death"], "overlaps": [1, 3]}}
    assert yaml_subset.parsed_yaml(YAML) == doc
    for name, body in (("r.yaml", YAML), ("r.json", json.dumps(doc))):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_text(body)
    one, two = (read_rubric(spark, str(tmp_path / n)).drop("file") for n in ("r.yaml", "r.json"))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect())) and one.count() == 2
    assert read_rules(spark, str(tmp_path / "r.yaml")) == read_rules(spark, str(tmp_path / "r.json"))
    lines = []
    for outcome, entry in json.loads(CORE_TEXT).items():
        lines.append(f"{json.dumps(outcome)}: {json.dumps(entry)}" if isinstance(entry, str) else f"{json.dumps(outcome)}:")
        for key, value in entry.items() if isinstance(entry, dict) else ():
            lines += [f"  {key}:", *(f"    {json.dumps(a)}: {json.dumps(b)}" for a, b in value.items())] if isinstance(value, dict) else [f"  {key}: {json.dumps(value)}"]
    assert yaml_subset.parsed_yaml("\n".join(lines)) == json.loads(CORE_TEXT) and parsed(yaml_subset.as_json("\n".join(lines))) == CORE


@pytest.mark.parametrize(
    "text,line",
    [("a:\n  b: 1\n   c: 2", 3), ("a:\n    b: 1\n  c: 2", 3), ("a: 1\n\tb: 2", 2), ("a: 1\na: 2", 2), ("a:\n  - x\n  y: 1", 3), ("a: 'x", 1), ("a: [1, 2", 1), ("a: {b: 1}", 1), ("just text", 1), ("a: 1\n- b", 2)],
)
def test_yaml_errors_name_the_line(text, line):
    with pytest.raises(yaml_subset.YamlError, match=f"f.yaml, line {line}: "):
        yaml_subset.parsed_yaml(text, "f.yaml")
