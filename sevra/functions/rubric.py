"""The grading rubric: outcomes, allowed grades, criteria, and the conditions that decide them, read from a file.

A condition is an expression over the facts of functions.lexicon and the
file's own thresholds, with and, or, not, comparisons, arithmetic and
parentheses. It is checked against these and then part of the SQL of a Column,
in the part of the language that Spark and other engines share.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from importlib import resources

from .lexicon import NUMBERS, PHRASES

#: Names that conditions may use.
FACTS = (*PHRASES, *NUMBERS, "oxygen")
# The outcomes of the rubric, and the scope: place, scope name, outcome.
PAIN, CHEST, SPLEEN, PRIAPISM = "Acute Sickle Cell Pain Episode", "Acute Chest Syndrome (ACS)", "Acute Splenic Sequestration", "Priapism"
SCOPE = (
    (1, "Acute Pain", PAIN), (2, "Stroke", None), (3, "Splenic Sequestration (SS)", SPLEEN), (4, "Acute Chest Syndrome", CHEST), (5, "Priapism", PRIAPISM), (6, "Chronic Pain", None), (7, "Chronic Kidney Disease (CKD)", None),
    (8, "Retinopathy", None), (9, "CD", None), (10, "Depression", None), (11, "Transcranial Doppler (TCD) Elevation", None), (12, "Asthma", None), (13, "Avascular Necrosis (AVN)", None), (14, "Leg Ulcer", None),
)
#: Grades besides 1 to 5: not in the note; present but not gradable.
ABSENT, NOT_GRADABLE = -1, 0
#: Quantities that an outcome's criteria need: named without a value, they make a note ambiguous.
REQUIRED = {PAIN: ("pain",), CHEST: ("temperature", "spo2", "pao2", "fio2"), SPLEEN: ("hb", "hct", "spleen"), PRIAPISM: ("priapism",)}
#: Most outcomes of a rubric, and characters of its text: it becomes part of the plan of every query.
MAX_OUTCOMES, MAX_TEXT = 100, 1 << 20
_WORD = re.compile(r"\s*(?:([A-Za-z_][A-Za-z_0-9]*)|([0-9]+(?:[.][0-9]+)?)|(<=|>=|<>|[-<>=+*/()]))")


def case_of(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END" if pairs else default


def holds(condition: str) -> str:
    """A condition with unknown counted as false."""
    return f"coalesce({condition}, false)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names_in(condition: str, known, where: str) -> list[str]:
    """The facts and thresholds that a condition uses; an error for anything that isn't part of the language."""
    at, names = 0, []
    while condition[at:].strip():
        m = _WORD.match(condition, at)
        if not m:
            raise ValueError(f"{where}: can't read {condition[at:].strip()[:20]!r} in {condition!r}")
        at = m.end()
        if m[1] and m[1].lower() not in ("and", "or", "not"):
            if m[1] not in known:
                raise ValueError(f"{where}: unknown fact {m[1]!r}")
            names.append(m[1])
    if not names:
        raise ValueError(f"{where}: no condition")
    return names


@dataclass(frozen=True)
class Rubric:
    """rules: (id, outcome, grade, criterion, condition); gates: (outcome, present, criteria); guards: (outcome, condition); thresholds: (id, outcome, condition); overlaps: ids of rules."""

    outcomes: dict[str, tuple[int, tuple[int, ...]]]
    rules: tuple[tuple[str, str, int, str, str], ...]
    gates: tuple[tuple[str, str, str], ...]
    guards: tuple[tuple[str, str], ...]
    thresholds: tuple[tuple[str, str, str], ...]
    overlaps: tuple[str, ...]

    def _open(self, condition: str, outcome: str, facts: str, flipped: str | None = None) -> str:
        """SQL of a condition; facts: what stands before a fact's name; flipped: a threshold that counts as misread where its quantity is known."""
        reads = {t: c for t, o, c in self.thresholds if o == outcome}

        def one(m: re.Match) -> str:
            name = m[0]
            if name in reads:
                c = self._open(reads[name], outcome, facts)
                return f"NOT {holds(c)}" if name == flipped else holds(c)
            return f"{facts}{name}" if name in FACTS else name

        return re.sub(r"[A-Za-z_][A-Za-z_0-9]*", one, condition)

    def present_sql(self, facts: str = "") -> str:
        return case_of([(f"outcome = {quoted(o)}", holds(self._open(p, o, facts))) for o, p, _ in self.gates], "false")

    def criteria_sql(self, facts: str = "") -> str:
        return case_of([(f"outcome = {quoted(o)}", holds(self._open(c, o, facts))) for o, _, c in self.gates], "false")

    def rule_grade_sql(self, facts: str = "") -> str:
        """The highest grade whose rule holds, 0 if none does."""
        ordered = sorted(self.rules, key=lambda r: -r[2])
        return case_of([(f"outcome = {quoted(o)} and {holds(self._open(p, o, facts))}", str(g)) for _, o, g, _, p in ordered], str(NOT_GRADABLE))

    def doubtful_sql(self, facts: str = "") -> str:
        """How many rules hold, without those that overlap others by design."""
        return " + ".join(f"CASE WHEN outcome = {quoted(o)} and {holds(self._open(p, o, facts))} THEN 1 ELSE 0 END" for r, o, _, _, p in self.rules if r not in self.overlaps) or "0"

    def guard_sql(self, facts: str = "") -> str:
        """Whether the note says something that the rubric gives no grade for."""
        return " OR ".join(f"(outcome = {quoted(o)} AND {holds(self._open(p, o, facts))})" for o, p in self.guards) or "false"

    def rationale_sql(self) -> str:
        return case_of([(f"outcome = {quoted(o)} AND predicted_grade = {g}", quoted(c)) for _, o, g, c, _ in self.rules] + [("predicted_grade = 0", "'criteria not met'")], "'outcome not present'")

    def grade_sql(self, prefix: str = "") -> str:
        return f"CASE WHEN NOT {prefix}present THEN {ABSENT} WHEN NOT {prefix}criteria THEN {NOT_GRADABLE} ELSE {prefix}rule_grade END"

    def misread_sql(self, threshold: str, facts: str = "") -> str:
        """The grade of a case of the threshold's outcome, had it been taken for the opposite; null where its quantity is unknown."""
        outcome, reads = next((o, c) for t, o, c in self.thresholds if t == threshold)
        of = lambda c: holds(self._open(c, outcome, facts, threshold))
        grade = case_of([(of(p), str(g)) for _, o, g, _, p in sorted(self.rules, key=lambda r: -r[2]) if o == outcome], str(NOT_GRADABLE))
        present, criteria = next((p, c) for o, p, c in self.gates if o == outcome)
        known = " OR ".join(f"({self._open(part, outcome, facts)}) IS NOT NULL" for part in reads.split(" or "))
        return f"CASE WHEN NOT ({known}) THEN NULL WHEN NOT {of(present)} THEN {ABSENT} WHEN NOT {of(criteria)} THEN {NOT_GRADABLE} ELSE {grade} END"


def parsed(*texts: str) -> Rubric:
    """A rubric from the text of JSON files; outcomes of a later file take the place of those of an earlier one.

    Keys that start with _ are left out. Each outcome has grades (grade to
    criterion), present, criteria, when (grade to condition), and may have
    thresholds, review and overlaps. A missing part, a grade outside 1 to 5, a
    grade without a condition and an unknown fact are errors that say where.
    """
    if sum(map(len, texts)) > MAX_TEXT:
        raise ValueError(f"more than {MAX_TEXT} characters")
    entries = {k: v for t in texts for k, v in json.loads(t).items() if not k.startswith("_")}
    if len(entries) > MAX_OUTCOMES:
        raise ValueError(f"more than {MAX_OUTCOMES} outcomes")
    outcomes, rules, gates, guards, thresholds, overlaps = {}, [], [], [], [], []
    for name, e in entries.items():
        if lacking := [k for k in ("grades", "present", "criteria", "when") if k not in e]:
            raise ValueError(f"{name}: without {', '.join(lacking)}")
        grades = sorted(map(int, e["grades"]))
        if any(not 1 <= g <= 5 for g in grades) or set(e["when"]) != set(e["grades"]):
            raise ValueError(f"{name}: grades {sorted(e['grades'])} with conditions for {sorted(e['when'])}")
        reads = e.get("thresholds", {})
        for t, c in reads.items():
            if t in FACTS or not set(names_in(c, FACTS, f"{name}, {t}")) <= set(NUMBERS):
                raise ValueError(f"{name}, {t}: a threshold has a name of its own and compares numbers")
        for part, c in [("present", e["present"]), ("criteria", e["criteria"]), *((f"grade {g}", e["when"][str(g)]) for g in grades)]:
            names_in(c, {*FACTS, *reads}, f"{name}, {part}")
        for c in e.get("review", []):
            names_in(c, {*FACTS, *reads, "rule_grade"}, f"{name}, review")
        outcomes[name] = (int(e.get("booklet_page", 0)), tuple(grades))
        ids = {g: f"R{len(rules) + i:02d}" for i, g in enumerate(grades, 1)}
        rules += [(ids[g], name, g, e["grades"][str(g)], e["when"][str(g)]) for g in grades]
        gates.append((name, e["present"], e["criteria"]))
        guards += [(name, c) for c in e.get("review", [])]
        thresholds += [(t, name, c) for t, c in reads.items()]
        overlaps += [ids[g] for g in e.get("overlaps", [])]
    return Rubric(outcomes, tuple(rules), tuple(gates), tuple(guards), tuple(thresholds), tuple(overlaps))


#: The text of the rubric of this package, and what it says.
CORE_TEXT = (resources.files("sevra") / "rubrics" / "core.json").read_text()
CORE = parsed(CORE_TEXT)
OUTCOMES, RULES = CORE.outcomes, CORE.rules
