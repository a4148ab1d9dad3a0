"""SQL that reads notes into facts by joins, for checks of functions.reading, which does it within a row.

Tokens are rows here; phrases join them, scopes are an interval join of
phrases with triggers, and numbers join quantities. Only the tables of
functions.lexicon are shared, no expression is.
"""

from __future__ import annotations

from ..functions import lexicon as lx


def _text(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(_text, values)) + ")"


def _values(rows, columns: str) -> str:
    one = lambda x: _text(x) if isinstance(x, str) else "[" + ", ".join(map(_text, x)) + "]" if isinstance(x, list) else f"{x}::double" if isinstance(x, float) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({columns}))"


def _bound(phrases) -> str:
    one, two = [p for p in phrases if " " not in p], [p.split() for p in phrases if " " in p]
    return f"(coalesce(p1, '') IN {_list(one)}" + "".join(f" OR (p2 = '{a}' AND p1 = '{b}')" for a, b in two) + ")"


def ctes(cases: str = "cases", entries=lx.DEFAULT) -> str:
    """CTEs that end in facts: the columns of cases (case_id, note_text, ...), the facts, and conflict, doubt, unread (a list), evidence (a list)."""
    phrases = [(k, n, " ".join(lx.tokens(p)), lx.tokens(p), len(lx.tokens(p)), lx.tokens(p)[0]) for k, n, p in entries]
    scopes = [(k, s, d, lx.STATUSES.index(s)) for k, (s, d, _, _) in lx.SCOPES.items()]
    ends = [(k, w) for k, (_, _, e, _) in lx.SCOPES.items() for w in e]
    lists = [(k, w) for k, (_, _, _, x) in lx.SCOPES.items() for w in x]
    value = lambda m, role: f"arg_min(value, k) FILTER (measure = '{m}' AND role = '{role}')"
    said = ", ".join(f"coalesce(bool_or(name = '{f}') FILTER (kind = 'fact' AND status = 'asserted'), false) AS {f}" for f in lx.PHRASES)
    at = lambda i: f"coalesce(t[x.i{i:+d}], '')"
    return rf"""
        tk AS (SELECT case_id, regexp_extract_all(regexp_replace(lower(coalesce(note_text, '')), '{lx.PLURAL}', '\1', 'g'), '{lx.TOKEN}') AS t, regexp_extract_all(lower(coalesce(note_text, '')), '{lx.TOKEN}') AS raw FROM {cases}),
        tok AS (SELECT case_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w FROM tk),
        lex AS {_values(phrases, "kind, name, phrase, words, len, first")},
        kinds AS {_values(scopes, "kind, status, direction, place")}, ends AS {_values(ends, "kind, w")}, lists AS {_values(lists, "kind, w")},
        hit AS (SELECT case_id, kind, name, phrase, i AS a, i + len - 1 AS b FROM tok JOIN lex ON w = first JOIN tk USING (case_id) WHERE t[i : i + len - 1] = words),
        trig AS (SELECT h.case_id, h.kind, h.a, h.b, status, direction, place FROM hit h JOIN kinds USING (kind) WHERE NOT EXISTS (SELECT 1 FROM hit p WHERE p.case_id = h.case_id AND p.kind = 'pseudo' AND p.a <= h.a AND h.b <= p.b)),
        stop_at AS (SELECT case_id, kind, i FROM tok JOIN ends USING (w)), list_at AS (SELECT case_id, kind, i FROM tok JOIN lists USING (w)), comma AS (SELECT case_id, i FROM tok WHERE w = ','),
        on1 AS (SELECT g.case_id, g.kind, g.a, g.b, g.status, g.place, coalesce(min(s.i), 1000000) AS h FROM trig g LEFT JOIN stop_at s ON s.case_id = g.case_id AND s.kind = g.kind AND s.i > g.b WHERE direction = 'on' GROUP BY ALL),
        on2 AS (SELECT g.*, coalesce(max(x.i), g.b) AS l FROM on1 g LEFT JOIN list_at x ON x.case_id = g.case_id AND x.kind = g.kind AND x.i > g.b AND x.i < g.h GROUP BY g.case_id, g.kind, g.a, g.b, g.status, g.place, g.h),
        on3 AS (SELECT g.case_id, g.status, g.place, g.b + 1 AS a, least(g.h, coalesce(min(c.i), 1000000)) - 1 AS b FROM on2 g LEFT JOIN comma c ON c.case_id = g.case_id AND c.i > g.l GROUP BY g.case_id, g.status, g.place, g.kind, g.b, g.h, g.a),
        back AS (SELECT g.case_id, g.status, g.place, coalesce(max(s.i), 0) + 1 AS a, g.a - 1 AS b FROM trig g LEFT JOIN stop_at s ON s.case_id = g.case_id AND s.kind = g.kind AND s.i < g.a WHERE direction = 'back' GROUP BY g.case_id, g.status, g.place, g.kind, g.a, g.b),
        scope AS (SELECT * FROM on3 UNION ALL SELECT * FROM back),
        told AS (SELECT h.case_id, h.kind, h.name, h.phrase, h.a, h.b, coalesce(arg_min(s.status, s.place), 'asserted') AS status FROM hit h LEFT JOIN scope s ON s.case_id = h.case_id AND s.a <= h.a AND h.b <= s.b
            WHERE h.kind IN ('fact', 'quantity', 'soft') GROUP BY h.case_id, h.kind, h.name, h.phrase, h.a, h.b),
        spoken AS {_values(list(lx.NUMBER_WORDS.items()), "w, v")},
        num0 AS (SELECT x.case_id, x.i, coalesce(try_cast(x.w AS double), v) AS raw, {at(-1)} AS p1, {at(-2)} AS p2, {at(1)} AS n1, {at(2)} AS n2, {at(3)} AS n3, {at(4)} AS n4 FROM tok x JOIN tk USING (case_id) LEFT JOIN spoken USING (w) WHERE (regexp_matches(x.w, '^[0-9]') OR v IS NOT NULL) AND {at(-1)} NOT IN {_list(lx.ORDINALS)}),
        num1 AS (SELECT *, p1 IN {_list(lx.FORMER)} OR p2 IN {_list(lx.FORMER)} AS was, n1 IN {_list(lx.FILLERS)} AS filled FROM num0),
        opens AS (SELECT x.case_id, x.i, y.i AS closes FROM num1 x JOIN num1 y ON y.case_id = x.case_id WHERE y.i = x.i + 1 OR (NOT x.was AND ((x.n1 = 'to' AND y.i = x.i + 2) OR (x.n2 = 'to' AND y.i = x.i + 3)))),
        num2 AS (SELECT *, CASE WHEN filled THEN n2 ELSE n1 END AS u1, CASE WHEN filled THEN n3 ELSE n2 END AS u2 FROM num1 x WHERE NOT EXISTS (SELECT 1 FROM opens o WHERE o.case_id = x.case_id AND x.i IN (o.i, o.closes))),
        num AS (SELECT *, CASE WHEN u1 IN ('g', 'gm') AND u2 IN ('dl', 'l') THEN concat(u1, ' ', u2) WHEN u1 IN {_list(lx.UNITS)} THEN u1 ELSE '' END AS unit,
            i + CASE WHEN u1 IN ('g', 'gm') AND u2 IN ('dl', 'l') THEN 2 WHEN u1 IN {_list(lx.UNITS)} THEN 1 ELSE 0 END + CASE WHEN filled AND (u1 IN {_list(lx.UNITS)}) THEN 1 ELSE 0 END AS e,
            CASE WHEN {_bound(lx.BELOW)} THEN -{lx.MARGIN} WHEN {_bound(lx.ABOVE)} THEN {lx.MARGIN} ELSE 0 END AS shift FROM num2),
        named AS (SELECT case_id, name, kind, status, a, b FROM told WHERE kind <> 'fact'),
        quant AS (SELECT q.case_id, q.name, q.a, q.b, least(q.b + {lx.WINDOW + 1}, coalesce(min(s.i), 1000000)) AS stop FROM named q LEFT JOIN (SELECT case_id, i FROM tok WHERE w IN {_list(lx.STOPS)} UNION ALL SELECT case_id, a FROM named) s ON s.case_id = q.case_id AND s.i > q.b
            WHERE q.status = 'asserted' GROUP BY q.case_id, q.name, q.a, q.b),
        unit_rules AS (SELECT *, row_number() OVER () AS rank FROM {_values(lx.READS, "name, unit, measure, factor, lo, hi")}),
        fit AS (SELECT q.case_id, q.name, q.a, q.b, x.i AS p, x.e, x.was, arg_min(measure, rank) AS measure, round((any_value(x.raw) + any_value(x.shift)) * arg_min(factor, rank), 6) AS value
            FROM quant q JOIN num x ON x.case_id = q.case_id AND ((x.i > q.b AND x.i < q.stop) OR (x.i < q.a AND x.i >= q.a - 5 AND x.unit <> '')) JOIN tk ON tk.case_id = q.case_id JOIN unit_rules r ON r.name = q.name AND r.unit = x.unit AND x.raw BETWEEN lo AND hi
            WHERE x.i > q.b OR x.e = q.a - 1 OR (x.e = q.a - 2 AND t[q.a - 1] = 'of') GROUP BY q.case_id, q.name, q.a, q.b, x.i, x.e, x.was),
        best AS (SELECT *, CASE WHEN was THEN 'was' ELSE 'now' END AS role FROM fit WHERE NOT (was AND p < a) QUALIFY row_number() OVER (PARTITION BY case_id, name, a, b, was ORDER BY p < a, p) = 1),
        reading AS (SELECT case_id, name, measure, role, value, least(a, p) AS a, greatest(b, e) AS b, a * 1000 + b AS k FROM best),
        timed AS (SELECT DISTINCT q.case_id, q.name, q.a FROM named q JOIN tok ON tok.case_id = q.case_id AND tok.i > q.b AND tok.i <= q.b + {lx.WINDOW} AND tok.w IN {_list((*lx.TIME_UNITS, "duration"))}),
        lacks AS (SELECT q.case_id, list(DISTINCT q.name) AS unread FROM named q WHERE q.kind = 'quantity' AND q.status = 'asserted' AND (q.name NOT IN {_list(lx.DURATIONS)} OR EXISTS (SELECT 1 FROM timed d WHERE d.case_id = q.case_id AND d.name = q.name AND d.a = q.a))
            AND NOT EXISTS (SELECT 1 FROM reading r WHERE r.case_id = q.case_id AND r.name = q.name AND r.role = 'now') GROUP BY q.case_id),
        piece AS (SELECT DISTINCT case_id, a, b FROM told WHERE kind = 'fact' AND status = 'asserted' UNION SELECT case_id, a, b FROM reading WHERE role = 'now'),
        piece_text AS (SELECT case_id, array_to_string(raw[a : b], ' ') AS words, min(a * 1000 + b) AS k FROM piece JOIN tk USING (case_id) GROUP BY ALL),
        proof AS (SELECT case_id, list(words ORDER BY k) AS evidence FROM piece_text GROUP BY case_id),
        clash AS (SELECT DISTINCT case_id FROM told x JOIN told y USING (case_id, kind, phrase) WHERE kind = 'fact' AND x.status = 'asserted' AND y.status = 'denied'),
        yes AS (SELECT case_id, {said}, coalesce(bool_or(name = 'oxygen_word' OR name = 'fio2') FILTER (status = 'asserted'), false) AS oxygen FROM {cases} LEFT JOIN told USING (case_id) GROUP BY case_id),
        measured AS (SELECT case_id, {", ".join(f"{value(m, role)} AS {c}" for c, (m, role) in lx.NUMBERS.items())} FROM reading GROUP BY case_id),
        facts AS (SELECT c.*, y.* EXCLUDE (case_id), m.* EXCLUDE (case_id), clash.case_id IS NOT NULL AS conflict, EXISTS (SELECT 1 FROM hit h WHERE h.case_id = c.case_id AND h.kind = 'doubt') AS doubt, coalesce(unread, []) AS unread, coalesce(evidence, []) AS evidence
            FROM {cases} c JOIN yes y USING (case_id) LEFT JOIN measured m USING (case_id) LEFT JOIN lacks USING (case_id) LEFT JOIN proof USING (case_id) LEFT JOIN clash USING (case_id))"""
