"""Reads notes into facts: tokens with positions, phrases, scopes of denial and of who and when, quantities with value and unit.

All of it is one expression per note, of built-in functions over arrays, so no
row leaves its task. The lexicon (see functions.lexicon) is a literal map by
the first token of a phrase; a note is passed once, and only tokens that begin
a phrase are looked up. Scopes are intervals of positions, and a phrase has the
status of the first interval that covers it. The functions here return SQL
text, as a plan is made from one text far sooner than from thousands of
Columns; read() and mentions() return Columns.
"""

from __future__ import annotations

import json
from collections import defaultdict
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

#: What read() returns besides the facts.
EXTRAS = ("conflict", "doubt", "unread", "evidence")
_SPAN, _READING = "array<struct<status:string,a:int,b:int>>", "array<struct<quantity:string,measure:string,role:string,value:double,a:int,b:int>>"
_names = count()


def _fn(body) -> str:
    """A lambda whose variable has a name of its own."""
    x = f"v{next(_names)}"
    return f"{x} -> {body(x)}"


def let(value: str, body) -> str:
    """Evaluate value once per row and bind it in body."""
    return f"element_at(transform(array({value}), {_fn(body)}), 1)"


def _filter(array: str, body) -> str:
    return f"filter({array}, {_fn(body)})"


def _transform(array: str, body) -> str:
    return f"transform({array}, {_fn(body)})"


def _exists(array: str, body) -> str:
    return f"exists({array}, {_fn(body)})"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(x: str, values) -> str:
    return f"({x} IN ({', '.join(map(_text, values))}))" if values else "false"


def _literal(value, kind: str) -> str:
    """A constant of any type, which the optimizer reads once."""
    return f"from_json({_text(json.dumps(value))}, {_text(kind)})"


def note_tokens(note: str, plural: bool = False) -> str:
    """The tokens of a note in order; with plural as written, otherwise without the plural s. Null gives none."""
    text = f"lower(coalesce({note}, ''))"
    text = text if plural else f"regexp_replace({text}, {_text(lx.PLURAL)}, '$1')"
    return f"regexp_extract_all({text}, {_text(lx.TOKEN)}, 0)"


def _places(t: str, wanted) -> str:
    """Positions of tokens that wanted holds for."""
    return _filter(f"if(size({t}) > 0, sequence(1, size({t})), cast(array() AS array<int>))", lambda i: wanted(f"element_at({t}, {i})"))


def hits(t: str, entries) -> str:
    """Array of (a, b, kind, name, phrase): all phrases that the tokens hold from a to b, in order of a."""
    by_first = defaultdict(list)
    for kind, name, phrase in entries:
        words = lx.tokens(phrase)
        by_first[words[0]].append({"kind": kind, "name": name, "phrase": " ".join(words), "words": words})
    known = _literal(by_first, "map<string,array<struct<kind:string,name:string,phrase:string,words:array<string>>>>")

    def at(i: str) -> str:
        fits = _filter(f"element_at({known}, element_at({t}, {i}))", lambda e: f"slice({t}, {i}, size({e}.words)) = {e}.words")
        return _transform(fits, lambda e: f"named_struct('a', {i}, 'b', {i} + size({e}.words) - 1, 'kind', {e}.kind, 'name', {e}.name, 'phrase', {e}.phrase)")

    return f"flatten({_transform(_places(t, lambda w: _in(w, by_first)), at)})"


def scopes(t: str, found: str) -> str:
    """Array of (status, a, b): the tokens that triggers reach, denials first, then family, then history."""
    end_of_note = f"size({t}) + 1"

    def reach(kind: str, triggers: str) -> str:
        status, direction, ends, lists = lx.SCOPES[kind]
        mine = _filter(triggers, lambda h: f"{h}.kind = '{kind}'")
        span = lambda a, b: f"named_struct('status', '{status}', 'a', {a}, 'b', {b})"

        def back(stops: str) -> str:
            return _transform(mine, lambda h: span(f"coalesce(array_max({_filter(stops, lambda p: f'{p} < {h}.a')}), 0) + 1", f"{h}.a - 1"))

        def on(stops: str) -> str:
            def of(h: str) -> str:
                def upto(end: str) -> str:
                    comma = lambda after: f"coalesce(array_min({_filter(_places(t, lambda w: f'{w} = {_text(",")}'), lambda p: f'{p} > {after}')}), {end_of_note})"
                    if not lists:
                        return f"least({end}, {comma(f'{h}.b')})"
                    last = f"array_max({_filter(_places(t, lambda w: _in(w, lists)), lambda p: f'{p} > {h}.b AND {p} < {end}')})"
                    return let(f"coalesce({last}, {h}.b)", lambda x: f"least({end}, {comma(x)})")

                first = f"coalesce(array_min({_filter(stops, lambda p: f'{p} > {h}.b')}), {end_of_note})"
                return span(f"{h}.b + 1", f"{let(first, upto)} - 1")

            return _transform(mine, of)

        some = _exists(triggers, lambda h: f"{h}.kind = '{kind}'")
        return f"if({some}, {let(_places(t, lambda w: _in(w, ends)), back if direction == 'back' else on)}, cast(array() AS {_SPAN}))"

    within = lambda h: _exists(_filter(found, lambda p: f"{p}.kind = 'pseudo'"), lambda p: f"{p}.a <= {h}.a AND {h}.b <= {p}.b")
    live = _filter(found, lambda h: f"{_in(f'{h}.kind', lx.SCOPES)} AND NOT {within(h)}")
    ordered = sorted(lx.SCOPES, key=lambda k: lx.STATUSES.index(lx.SCOPES[k][0]))
    return let(live, lambda x: f"if(size({x}) > 0, concat({', '.join(reach(k, x) for k in ordered)}), cast(array() AS {_SPAN}))")


def told(t: str, found: str) -> str:
    """The phrases of facts and quantities with status: asserted, or that of the first scope that covers them."""
    covering = lambda h, spans: f"try_element_at({_filter(spans, lambda s: f'{s}.a <= {h}.a AND {h}.b <= {s}.b')}, 1).status"
    mine = _filter(found, lambda h: _in(f"{h}.kind", ("fact", "quantity", "soft")))
    return let(scopes(t, found), lambda spans: _transform(mine, lambda h: f"named_struct('a', {h}.a, 'b', {h}.b, 'kind', {h}.kind, 'name', {h}.name, 'phrase', {h}.phrase, 'status', coalesce({covering(h, spans)}, 'asserted'))"))


def numbers(t: str) -> str:
    """Array of (p, e, raw, shift, unit, was): numbers that are no range and no ordinal, at p; e: end of the unit; shift: by a bound; was: a former value."""
    at = lambda p, d=0: f"coalesce(get({t}, {p} + {d - 1}), '')"
    digits = lambda w: f"(left({w}, 1) BETWEEN '0' AND '9')"
    number = lambda w: f"({digits(w)} OR {_in(w, lx.NUMBER_WORDS)})"

    def candidate(p: str) -> str:
        former = f"({_in(at(p, -1), lx.FORMER)} OR {_in(at(p, -2), lx.FORMER)})"
        return f"named_struct('p', {p}, 'was', {former}, 'opens', {number(at(p, 1))} OR (NOT {former} AND (({at(p, 1)} = 'to' AND {number(at(p, 2))}) OR ({at(p, 2)} = 'to' AND {number(at(p, 3))}))))"

    def before(p: str, phrases) -> str:
        two = "".join(f" OR ({at(p, -2)} = '{x.split()[0]}' AND {at(p, -1)} = '{x.split()[1]}')" for x in phrases if " " in x)
        return f"({_in(at(p, -1), [x for x in phrases if ' ' not in x])}{two})"

    def read(x: str) -> str:
        p = f"{x}.p"

        def with_unit(u: str) -> str:
            grams, known = f"({_in(at(u), ('g', 'gm'))} AND {_in(at(u, 1), ('dl', 'l'))})", _in(at(u), lx.UNITS)
            raw = f"coalesce(CASE WHEN {digits(at(p))} THEN try_cast({at(p)} AS double) END, try_element_at({_literal(lx.NUMBER_WORDS, 'map<string,double>')}, {at(p)}))"
            return (
                f"named_struct('p', {p}, 'e', CASE WHEN {grams} THEN {u} + 1 WHEN {known} THEN {u} ELSE {p} END, 'raw', {raw}, 'shift', CASE WHEN {before(p, lx.BELOW)} THEN -{lx.MARGIN}D WHEN {before(p, lx.ABOVE)} THEN {lx.MARGIN}D ELSE 0D END, "
                f"'unit', CASE WHEN {grams} THEN concat_ws(' ', {at(u)}, {at(u, 1)}) WHEN {known} THEN {at(u)} ELSE '' END, 'was', {x}.was)"
            )

        return let(f"if({_in(at(p, 1), lx.FILLERS)}, {p} + 2, {p} + 1)", with_unit)

    def unranged(all_: str) -> str:
        closed = lambda x: _exists(all_, lambda y: f"{y}.opens AND ({y}.p + 1 = {x}.p OR ({at(f'{x}.p', -1)} = 'to' AND {y}.p BETWEEN {x}.p - 3 AND {x}.p - 2))")
        return _transform(_filter(all_, lambda x: f"NOT {x}.opens AND NOT {closed(x)}"), read)

    values = _filter(_places(t, number), lambda p: f"NOT {_in(at(p, -1), lx.ORDINALS)}")
    return let(_transform(values, candidate), unranged)


def readings(t: str, said: str, nums: str) -> str:
    """Array of (quantity, measure, role, value, a, b): of each asserted quantity its value now and its former one, where there are."""
    rules = defaultdict(list)
    for q, u, m, f, lo, hi in lx.READS:
        rules[f"{q} {u}"].append({"measure": m, "factor": f, "lo": lo, "hi": hi})
    known = _literal(rules, "map<string,array<struct<measure:string,factor:double,lo:double,hi:double>>>")

    def of(q: str, ends: str, named: str) -> str:
        def fits(x: str) -> str:
            fit = _filter(f"try_element_at({known}, concat_ws(' ', {q}.name, {x}.unit))", lambda r: f"{x}.raw BETWEEN {r}.lo AND {r}.hi")
            return let(f"try_element_at({fit}, 1)", lambda r: f"named_struct('measure', {r}.measure, 'value', round(({x}.raw + {x}.shift) * {r}.factor, 6), 'was', {x}.was, 'p', {x}.p, 'e', {x}.e)")

        def within(stop: str) -> str:
            ahead = lambda x: f"({x}.p < {q}.a AND {x}.p >= {q}.a - 5 AND {x}.unit <> '' AND ({x}.e = {q}.a - 1 OR ({x}.e = {q}.a - 2 AND get({t}, {q}.a - 2) = 'of')))"
            near = _filter(nums, lambda x: f"({q}.b < {x}.p AND {x}.p < {stop}) OR {ahead(x)}")

            def chosen(rs: str) -> str:
                pick = lambda array, role: _transform(f"slice({array}, 1, 1)", lambda r: f"named_struct('quantity', {q}.name, 'measure', {r}.measure, 'role', '{role}', 'value', {r}.value, 'a', least({q}.a, {r}.p), 'b', greatest({q}.b, {r}.e))")
                after = lambda was: _filter(rs, lambda r: f"{r}.p > {q}.b AND {was} {r}.was")
                before = _filter(rs, lambda r: f"{r}.p < {q}.a AND NOT {r}.was")
                return f"concat({pick(f'concat({after("NOT")}, {before})', 'now')}, {pick(after(''), 'was')})"

            return let(_filter(_transform(near, fits), lambda r: f"{r}.measure IS NOT NULL"), chosen)

        first = lambda x: f"coalesce(array_min({_filter(x, lambda p: f'{p} > {q}.b')}), {1 << 30})"
        return let(f"least({q}.b + {lx.WINDOW + 1}, {first(ends)}, {first(_transform(named, lambda h: f'{h}.a'))})", within)

    stops = _places(t, lambda w: _in(w, lx.STOPS))
    names = _filter(said, lambda h: f"{h}.kind <> 'fact'")
    asserted = lambda x: _filter(x, lambda h: f"{h}.status = 'asserted'")
    every = let(names, lambda named: let(stops, lambda ends: f"flatten({_transform(asserted(named), lambda q: of(q, ends, named))})"))
    return f"if(size({nums}) > 0, {every}, cast(array() AS {_READING}))"


def unread(t: str, said: str, values: str) -> str:
    """Quantities that are named without a value that can be read, each once. A duration is named where a unit of time or the word duration follows within the window."""
    times = _places(t, lambda w: _in(w, (*lx.TIME_UNITS, "duration")))
    timed = lambda h: _exists(times, lambda p: f"{p} > {h}.b AND {p} <= {h}.b + {lx.WINDOW}")
    has = lambda name: _exists(values, lambda r: f"{r}.quantity = {name} AND {r}.role = 'now'")
    named = _filter(said, lambda h: f"{h}.kind = 'quantity' AND {h}.status = 'asserted' AND (NOT {_in(f'{h}.name', lx.DURATIONS)} OR {timed(h)})")
    return f"array_distinct({_filter(_transform(named, lambda h: f'{h}.name'), lambda name: f'NOT {has(name)}')})"


def _facts(raw: str, t: str, found: str, said: str, values: str, evidence: bool) -> str:
    of = lambda status, field: _transform(_filter(said, lambda h: f"{h}.kind = 'fact' AND {h}.status = '{status}'"), lambda h: f"{h}.{field}")
    value = lambda m, role: f"try_element_at({_filter(values, lambda r: f'{r}.measure = {_text(m)} AND {r}.role = {_text(role)}')}, 1).value"
    oxygen = _exists(said, lambda h: f"{h}.kind <> 'fact' AND {h}.name = 'fio2' AND {h}.status = 'asserted'")
    spans = [_transform(_filter(said, lambda h: f"{h}.kind = 'fact' AND {h}.status = 'asserted'"), lambda h: f"named_struct('a', {h}.a, 'b', {h}.b)"), _transform(_filter(values, lambda r: f"{r}.role = 'now'"), lambda r: f"named_struct('a', {r}.a, 'b', {r}.b)")]
    words = let(raw, lambda w: f"array_distinct({_transform(f'array_sort(concat({", ".join(spans)}))', lambda s: f"array_join(slice({w}, {s}.a, {s}.b - {s}.a + 1), ' ')")})") if evidence else raw
    return let(
        of("asserted", "name"),
        lambda names: "named_struct("
        + ", ".join(
            [f"'{f}', array_contains({names}, '{f}')" for f in lx.PHRASES] + [f"'{c}', {value(*m)}" for c, m in lx.NUMBERS.items()]
            + [f"'oxygen', array_contains({names}, 'oxygen_word') OR {oxygen}", f"'conflict', arrays_overlap({of('asserted', 'phrase')}, {of('denied', 'phrase')})", f"'doubt', {_exists(found, lambda h: f"{h}.kind = 'doubt'")}", f"'unread', {unread(t, said, values)}", f"'evidence', {words}"]
        )
        + ")",
    )


def read(note: str, entries=lx.DEFAULT, evidence: bool = True) -> Column:
    """A struct of all facts of a column of notes: the booleans of lexicon.PHRASES (never null), the numbers of lexicon.NUMBERS (null where not read), oxygen, and EXTRAS.

    conflict: a phrase is asserted in one place and denied in another. doubt:
    a word of doubt. unread: see unread(). evidence: what was asserted, as
    the note's tokens, each once. A null or empty note has no facts.
    """
    raw = note_tokens(f"`{note}`", plural=True) if evidence else "cast(array() AS array<string>)"
    of_found = lambda t, found: let(told(t, found), lambda said: let(numbers(t), lambda nums: let(readings(t, said, nums), lambda values: _facts(raw, t, found, said, values, evidence))))
    return F.expr(let(note_tokens(f"`{note}`"), lambda t: let(hits(t, entries), lambda found: of_found(t, found))))


def mentions(note: str, entries=lx.DEFAULT) -> Column:
    """Array of (a, b, kind, name, phrase, status): the phrases of a column of notes with their places among its tokens."""
    return F.expr(let(note_tokens(f"`{note}`"), lambda t: let(hits(t, entries), lambda found: told(t, found))))


def measures(note: str, entries=lx.DEFAULT) -> Column:
    """Array of (quantity, measure, role, value, a, b): what is read of a column of notes."""
    return F.expr(let(note_tokens(f"`{note}`"), lambda t: let(hits(t, entries), lambda found: let(told(t, found), lambda said: let(numbers(t), lambda nums: readings(t, said, nums))))))
