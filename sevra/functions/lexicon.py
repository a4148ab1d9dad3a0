"""Tables that notes are read by: phrases of facts, triggers of scopes, quantities with their units.

Entries are (kind, name, phrase). Phrases and notes are compared token by
token: lower case, hyphens and slashes part tokens, and a plural s is dropped
on both sides (see singular).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: A token: a number, a word that may end in digits, or a mark that parts clauses or belongs to a number.
TOKEN = r"[0-9]+(?:[.][0-9]+)?|[a-z]+[0-9]*|[.;,:?!%()<>=]"
#: The plural s of words of four letters and more, but not of those in -ss, -is and -us.
PLURAL = r"\b([a-z]{2,}[a-hj-rtv-z])s\b"
#: Most entries of a lexicon; it becomes part of the plan of every query.
MAX_ENTRIES = 5000

#: Phrases by fact.
PHRASES = {
    "pain": ("pain episode", "pain crisis", "painful crisis", "vaso-occlusive crisis", "vaso-occlusive pain", "vaso-occlusive episode"), "analgesic": ("analgesic", "morphine", "ibuprofen", "opioid"), "other_cause": ("explained by trauma",),
    "at_home": ("at home",), "visit": ("day hospital", "emergency department", "emergency room", "medical facility"), "admitted": ("admitted", "admission"), "organ_failure": ("organ failure",),
    "life_support": ("mechanical ventilation", "vasopressor", "renal replacement"), "death": ("died", "death", "deceased", "passed away"),
    "complication": ("acute chest syndrome", "respiratory distress", "dvt", "deep vein thrombosis", "pulmonary embolism", "stroke", "splenic sequestration", "hyperhaemolysis", "hyperhemolysis"),
    "infiltrate": ("new lobar infiltrate", "new segmental infiltrate", "new lobar/segmental infiltrate", "new lobar pulmonary infiltrate"),
    "chest_sign": ("tachypnea", "retractions", "nasal flaring", "accessory muscle", "thoracic pain", "cough", "wheezing", "rales"), "oxygen_word": ("supplemental oxygen",),
    "simple_transfusion": ("simple transfusion", "simple erythrocyte transfusion"), "exchange": ("exchange transfusion",), "epo": ("erythropoietin",), "bipap": ("bipap",), "high_flow": ("high-flow",),
    "supportive": ("other supportive treatment",), "critical": ("vasopressor", "vasoactive", "intubated", "intubation", "invasive mechanical ventilation"), "spleen_present": ("splenic sequestration",),
    "reticulocytes": ("reticulocyte", "reticulocytosis"), "spleen_treatment": ("transfusion", "iv fluids", "intravenous fluids"), "unstable": ("hemodynamic instability", "hemodynamically unstable"), "splenectomy": ("splenectomy",),
    "priapism": ("priapism",), "painful": ("painful",), "physician": ("physician",), "medication": ("medication",), "aspiration": ("aspiration", "irrigation"), "shunt": ("shunt",),
}
#: Names of quantities. Those in SOFT are read too, but don't count as named without a value.
QUANTITIES = {
    "pain": ("pain",), "priapism": ("priapism", "erection"), "temperature": ("temperature", "temp"), "spo2": ("spo2", "oxygen saturation", "o2 saturation", "o2 sat"), "pao2": ("pao2",), "fio2": ("fio2", "fraction of inspired oxygen"),
    "hb": ("hemoglobin", "haemoglobin", "hb", "hgb"), "hct": ("hematocrit", "haematocrit", "hct"), "spleen": ("spleen",),
}
SOFT = {"temperature": ("fever",)}
DURATIONS = ("pain", "priapism")
_TIME = {"minute": 1.0, "min": 1.0, "hour": 60.0, "hr": 60.0, "hrs": 60.0, "h": 60.0, "day": 1440.0, "week": 10080.0}
TIME_UNITS = tuple(_TIME)
#: (quantity, unit or '' for none, measure, factor, least and most of the number as written). What no row fits is not read.
READS = (
    ("temperature", "c", "temperature", 1.0, 25.0, 45.0), ("temperature", "celsius", "temperature", 1.0, 25.0, 45.0), ("temperature", "", "temperature", 1.0, 25.0, 45.0),
    ("temperature", "f", "temperature_f", 1.0, 80.0, 115.0), ("temperature", "fahrenheit", "temperature_f", 1.0, 80.0, 115.0), ("temperature", "", "temperature_f", 1.0, 80.0, 115.0),
    *(("spo2", u, "spo2", 1.0, 30.0, 100.0) for u in ("%", "percent", "")), ("pao2", "mmhg", "pao2", 1.0, 10.0, 700.0), ("pao2", "mm", "pao2", 1.0, 10.0, 700.0), ("pao2", "", "pao2", 1.0, 10.0, 700.0), ("pao2", "kpa", "pao2", 7.5, 1.0, 90.0),
    *(("fio2", u, "fio2", 1.0, 21.0, 100.0) for u in ("%", "percent", "")), ("fio2", "", "fio2", 100.0, 0.21, 1.0), ("hb", "g dl", "hb", 1.0, 1.0, 25.0), ("hb", "gm dl", "hb", 1.0, 1.0, 25.0), ("hb", "", "hb", 1.0, 1.0, 25.0), ("hb", "g l", "hb", 0.1, 10.0, 250.0),
    *(("hct", u, "hct", 1.0, 3.0, 75.0) for u in ("%", "percent", "")), ("hct", "", "hct", 100.0, 0.03, 0.75), ("spleen", "cm", "spleen_cm", 1.0, 0.0, 60.0), ("spleen", "mm", "spleen_cm", 0.1, 0.0, 600.0),
    *((q, u, f"{q}_minutes", f, 0.0, 100000.0) for q in DURATIONS for u, f in _TIME.items()),
)
#: Facts that are numbers, null where not read: (fact, measure, role).
NUMBERS = {
    "pain_minutes": ("pain_minutes", "now"), "temperature": ("temperature", "now"), "temperature_f": ("temperature_f", "now"), "spo2": ("spo2", "now"), "spo2_was": ("spo2", "was"), "pao2": ("pao2", "now"), "fio2": ("fio2", "now"),
    "hb": ("hb", "now"), "hb_was": ("hb", "was"), "hct": ("hct", "now"), "hct_was": ("hct", "was"), "spleen_cm": ("spleen_cm", "now"), "spleen_was": ("spleen_cm", "was"), "priapism_minutes": ("priapism_minutes", "now"),
}
#: Words that follow numbers as units, of which some fit no quantity; words between a number and its unit; words whose number is only a name; numbers in letters.
UNITS = tuple(dict.fromkeys([u for _, u, *_ in READS if u] + ["l", "ml", "mg", "kg", "unit", "month", "year", "time", "g"]))
FILLERS = ("a", "an", "degree")
ORDINALS = ("day", "week", "stage", "grade", "bed", "room")
NUMBER_WORDS = {"half": 0.5, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0, "eleven": 11.0, "twelve": 12.0, "fifteen": 15.0, "twenty": 20.0, "thirty": 30.0, "forty": 40.0, "fifty": 50.0, "sixty": 60.0, "ninety": 90.0}
#: Within two tokens before a number: it is the former value. Right before it: the value is below or above it, by MARGIN.
FORMER, BELOW, ABOVE, MARGIN = ("from", "baseline", "usual"), ("<", "below", "under", "less than"), (">", "above", "over", "more than", "greater than", "exceeding"), 0.001
#: Tokens after a quantity's name in which its value may stand, and marks that end this earlier.
WINDOW, STOPS = 12, (".", ";", "?", "!")

_RELATIVES = ("mother", "father", "brother", "sister", "cousin", "uncle", "aunt", "grandmother", "grandfather", "sibling", "parent", "wife", "husband")
_REPORTS = ("reports", "reported", "states", "stated", "says", "said", "noticed", "brought", "called", "describes", "described", "confirms", "gave")
_PARTICIPLES = ("needed", "required", "given", "done", "performed", "seen", "found", "present", "started", "used", "necessary", "observed", "noted", "detected", "indicated", "placed", "attempted", "administered", "identified", "received")
_ABSENT = tuple(f"{n} {b}{p}" for n in ("not", "never") for b in ("", "been ") for p in _PARTICIPLES)
#: Phrases that open a scope, by kind.
TRIGGERS = {
    "deny_noun": ("no", "without", "denies", "denied", "negative for", "absence of", "free of", "lack of", "not have", "not need", "not require", "not show", "not report", "never had", "never needed", "never required", "neither"),
    "deny_verb": ("not", "never", "ruled out", "rules out"),
    "deny_back": (*_ABSENT, "not occur", "never occurred", "ruled out", "excluded", "absent", "declined", "refused", "was negative"),
    "deny_all_back": (*(f"were {x}" for x in _ABSENT if x.startswith("not ") and "been" not in x), "were ruled out", "were excluded", "were absent", "were declined"),
    "family": (*_RELATIVES, "family history"),
    "family_back": tuple(f"{i} {d} {r}" for i in ("in", "of") for d in ("a", "his", "her", "their") for r in _RELATIVES),
    "history": ("history of", "previous", "previously", "prior", "remote", "former", "past"),
    "history_back": ("year ago", "month ago", "last year", "in childhood", "as a child", "in the past", "in infancy"),
}
#: Not triggers although they hold one.
PSEUDO = ("not only", "no doubt", "without delay", "no change", "cannot be excluded", "not be excluded", "not excluded", "cannot be ruled out", "not be ruled out", "not ruled out", "to be ruled out", "prior to", *(f"{r} {v}" for r in _RELATIVES for v in _REPORTS))
#: Doubt: a human decides.
DOUBT = ("unclear", "uncertain", "equivocal", "cannot be excluded", "not be excluded", "cannot be ruled out", "not ruled out", "to be ruled out", "prolonged duration", "high fever", "possible", "suspected")

_HARD = (".", ";", ":", "?", "!", "but", "however", "although", "though", "yet", "then", "except")
_VERBS = ("was", "were", "is", "are", "had", "has", "developed", "needed", "required", "received", "underwent", "died", "presented")
_OTHERS = ("patient", "she", "he", "they", "now", "today", "currently")
#: Kind of trigger: (status, direction, words and marks that end the scope, words that carry a list over commas). A comma ends a forward scope unless one of the last stands between it and the end.
SCOPES = {
    "deny_noun": ("denied", "on", (*_HARD, "and", *_VERBS), ("or", "nor")), "deny_verb": ("denied", "on", (*_HARD, "and"), ()), "deny_back": ("denied", "back", (*_HARD, "and", ","), ()), "deny_all_back": ("denied", "back", _HARD, ()),
    "family": ("family", "on", (*_HARD, *_OTHERS), ()), "family_back": ("family", "back", (*_HARD, "and", ","), ()),
    "history": ("historical", "on", (*_HARD, *_VERBS, *_OTHERS, "admitted", "presenting", "with", "new", "who"), ("and", "or")), "history_back": ("historical", "back", (*_HARD, "and", ","), ()),
}
#: Of the statuses that cover a phrase, the first of these holds.
STATUSES = ("denied", "family", "historical")
KINDS = ("fact", "quantity", "soft", "doubt", "pseudo", *TRIGGERS)


def singular(text: str) -> str:
    return re.sub(PLURAL, r"\1", text.lower())


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, singular(text))


#: The lexicon that is used where none is given.
DEFAULT = tuple(dict.fromkeys(
    [("fact", f, p) for f, ps in PHRASES.items() for p in ps] + [("quantity", q, p) for q, ps in QUANTITIES.items() for p in ps] + [("soft", q, p) for q, ps in SOFT.items() for p in ps]
    + [("doubt", "doubt", p) for p in DOUBT] + [("pseudo", "pseudo", p) for p in PSEUDO] + [(k, k, p) for k, ps in TRIGGERS.items() for p in ps]
))


def checked(entries) -> tuple[tuple[str, str, str], ...]:
    """Entries with known kinds and names, and phrases that hold a token; an error says which don't."""
    out = tuple(dict.fromkeys((k, n, p) for k, n, p in entries))
    names = {"fact": set(PHRASES), "quantity": set(QUANTITIES), "soft": set(QUANTITIES)}
    bad = [e for e in out if e[0] not in KINDS or e[1] not in names.get(e[0], {e[1]}) or not e[2] or not tokens(e[2])]
    if bad:
        raise ValueError(f"not in the lexicon's terms: {bad[:5]}")
    if len(out) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    return out


def lexicon(table: DataFrame, extend: bool = True) -> tuple[tuple[str, str, str], ...]:
    """Entries from a table (kind, name, phrase), such as a CSV file of synonyms, after the default ones or (extend=False) in their place.

    The table is read to the driver; one of more than MAX_ENTRIES rows is an error. Nulls are an error too, repeated rows are not.
    """
    rows = [tuple(r) for r in table.select("kind", "name", "phrase").limit(MAX_ENTRIES + 1).collect()]
    return checked([*(DEFAULT if extend else ()), *rows])
