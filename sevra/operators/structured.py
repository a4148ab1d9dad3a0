"""Structured answers of models: parse, validate, ground, and build prompts."""

from __future__ import annotations

import hashlib
from importlib import metadata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import supported
from ..functions.rubric import OUTCOMES

ANSWER = "outcome string, predicted_grade int, evidence array<string>, rationale string, confidence string, human_review boolean, bad string"
#: Strategies of asking: the note alone, or with the rubric's criteria.
STRATEGIES = ("zero_shot", "rubric_grounded")
#: The fixed parts of a prompt, in order.
PROMPT = ("Grade this outcome: ", "Criteria:\n", "Note:", 'Answer in JSON with "outcome", "predicted_grade", "evidence", "rationale", "confidence" and "human_review".')
#: What is recorded with every result, besides generation_params (a map).
PROVENANCE = ("model_name", "model_version", "prompt_version", "schema_version", "case_version", "evaluated_on", "package_versions")


def parsed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add predicted_grade, answered_outcome, answered_evidence, answered_rationale, confidence, asks_review and well_formed.

    A truncated text, a grade that isn't a number, or a scalar where a list
    belongs is not well formed and gives no grade; neither does null.
    """
    a = F.from_json(payload, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    out = df.withColumn("_a", a).withColumn("well_formed", F.col(payload).isNotNull() & F.col("_a.bad").isNull() & F.col("_a.predicted_grade").isNotNull())
    take = lambda c: F.when(F.col("well_formed"), F.col(f"_a.{c}"))
    return out.withColumns({"predicted_grade": take("predicted_grade"), "answered_outcome": take("outcome"), "answered_evidence": take("evidence"), "answered_rationale": take("rationale"), "confidence": take("confidence"), "asks_review": take("human_review")}).drop("_a")


def allowed(outcome: Column, grade: Column) -> Column:
    """Whether the grade exists for the outcome, -1 and 0 included."""
    out = F.lit(False)
    for o, (_, grades) in OUTCOMES.items():
        out = out | ((outcome == o) & grade.isin(-1, 0, *grades))
    return F.coalesce(out, F.lit(False))


def grounded(evidence: Column, note: Column) -> Column:
    """The note supports every piece of evidence, verbatim or by its words (see functions.alignment); true without evidence, false for a null piece."""
    return F.coalesce(F.forall(evidence, lambda e: supported(e, note)), F.lit(True))


def covers(evidence: Column, gold: Column) -> Column:
    """Some piece of evidence supports the gold evidence; true without gold evidence."""
    return (F.coalesce(gold, F.lit("")) == "") | F.coalesce(F.exists(evidence, lambda e: supported(gold, e)), F.lit(False))


def reviewed(df: DataFrame, note: str = "note_text") -> DataFrame:
    """Add q6 (low confidence), q7 (a grade that the rubric has no criterion for, or another outcome), q8 (evidence that the note lacks, or none for a grade) and needs_review to parsed answers.

    An answer that is missing or not well formed needs review and sets none of the three.
    """
    ok, grade, ev = F.col("well_formed"), F.col("predicted_grade"), F.col("answered_evidence")
    none = (grade >= 1) & (F.coalesce(F.size(ev), F.lit(0)) < 1)
    flags = {
        "q6": F.col("confidence") == "low", "q7": ~allowed(F.col("outcome"), grade) | ~F.col("answered_outcome").eqNullSafe(F.col("outcome")), "q8": ~grounded(ev, F.col(note)) | none,
    }
    out = df.withColumns({k: F.coalesce(ok & v, F.lit(False)) for k, v in flags.items()})
    return out.withColumn("needs_review", ~F.coalesce(ok, F.lit(False)) | F.col("q6") | F.col("q7") | F.col("q8") | F.coalesce(F.col("asks_review"), F.lit(False)))


def digest(*texts: str) -> str:
    """Twelve digits that stand for a version of something: the same for the same texts only."""
    return hashlib.sha256("\x00".join(texts).encode()).hexdigest()[:12]


def recorded_versions(rubric_text: str, lexicon, packages: tuple[str, ...] = ("pyspark", "pandas", "pyarrow")) -> dict[str, str]:
    """What a run of the rule grader was made with, taken from these things themselves: model, prompt, schema and package versions."""
    return {
        "model_name": "rules", "model_version": digest(rubric_text, *("\t".join(e) for e in lexicon)), "prompt_version": digest(*PROMPT, *STRATEGIES), "schema_version": digest(ANSWER),
        "package_versions": ", ".join(f"{p} {metadata.version(p)}" for p in packages),
    }


def case_version(note: str = "note_text", key: str = "case_id") -> Column:
    """An aggregate that stands for a set of cases, in any order: their number and the sum of numbers made from each case and note."""
    of = F.conv(F.substr(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.coalesce(F.col(note), F.lit("")))), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.concat_ws("-", F.count("*").cast("string"), F.coalesce(F.sum(of), F.lit(0)).cast("string"))


def with_provenance(df: DataFrame, generation_params: dict[str, str] | None = None, **recorded: str) -> DataFrame:
    """Add run, a struct of PROVENANCE and generation_params; what isn't given is null."""
    if unknown := set(recorded) - set(PROVENANCE):
        raise ValueError(f"not part of the provenance: {sorted(unknown)}")
    params = F.create_map(*(F.lit(x) for kv in sorted((generation_params or {}).items()) for x in kv)).cast("map<string,string>")
    return df.withColumn("run", F.struct(*(F.lit(recorded.get(c)).cast("string").alias(c) for c in PROVENANCE), params.alias("generation_params")))


def serialised(df: DataFrame, note: str = "answer_json") -> DataFrame:
    """Add a prediction as the JSON that answers have: outcome, predicted_grade, evidence, rationale, confidence, human_review."""
    return df.withColumn(note, F.to_json(F.struct("outcome", "predicted_grade", "evidence", "rationale", "confidence", "human_review")))


def prompt(note: Column, outcome: Column, criteria: Column | None = None) -> Column:
    """The text that a model is asked with; without criteria (None, or null in a row) the note alone."""
    ask, rules, head, answer = map(F.lit, PROMPT)
    given = [] if criteria is None else [F.when(criteria.isNotNull(), F.concat(rules, criteria))]
    return F.concat_ws("\n", F.concat(ask, outcome), *given, head, note, answer)


def prompts(cases: DataFrame, rubric: DataFrame, note: str = "note_text") -> DataFrame:
    """One row per case and strategy: case_id, strategy, prompt. rubric: outcome, grade, criterion."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grade", "criterion"))), lambda x: F.concat(x["grade"].cast("string"), F.lit(": "), x["criterion"])), "\n")
    per = F.broadcast(rubric.where(F.col("outcome").isin(*OUTCOMES)).groupBy("outcome").agg(lines.alias("_criteria")))  # four rows at most
    both = cases.join(per, "outcome", "left").select("case_id", "outcome", note, "_criteria", F.explode(F.array(*map(F.lit, STRATEGIES))).alias("strategy"))
    return both.select("case_id", "strategy", prompt(F.col(note), F.col("outcome"), F.when(F.col("strategy") == STRATEGIES[1], F.col("_criteria"))).alias("prompt"))


def asked(df: DataFrame, client, prompt_column: str = "prompt", key: str = "case_id") -> DataFrame:
    """(key, payload) from a model. client: makes, once per partition, a function from a list of prompts to a list of answers.

    Models may answer differently each time, so write the result to a table before using it twice.
    """

    def run(frames):
        ask = client()
        for pdf in frames:
            yield pdf[[key]].assign(payload=ask(pdf[prompt_column].tolist()))

    return df.select(key, prompt_column).mapInPandas(run, f"{key} long, payload string")
