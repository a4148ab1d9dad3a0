"""Operator 3: license scans as an exact set-similarity join, with DataFrame functions only.

Templates and text blocks are sets of tokens. A block meets a template if it
holds at least THRESHOLD of the template's tokens, with those that tell the
template from others. The scan's blocks are windows over the whole text, line
breaks read as spaces: twice as long as a template or more and half
overlapping, so that a notice lies whole in one however it is wrapped. Texts
without any of the tokens that a match must hold one of are passed over first.
Tokens are ordered by their frequency in all blocks, rarest first; then

- prefix filter: a block and a template that share `need` tokens share one
  within the first |template| - need + 1 of the template and within the first
  |block| - need + 1 of the block,
- length filter: the block has at least `need` tokens of any template,
- positional filter: from a shared token on, enough tokens remain in both,

and candidates are counted exactly. A set says nothing of order, so the scan
then asks for the template's neighbouring words as well (PAIRS): words of a
notice that are strewn over a window are none. Tokens outside all templates can't count
towards any of them and are dropped at the start.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

THRESHOLD = 0.8
#: In scans, the least share of a template's pairs of neighbouring words that the window must hold as neighbours too, and the least number of them (or all), and each token that tells the template apart in one of these pairs.
PAIRS, LEAST_PAIRS = 0.6, 4
#: Most tokens of all templates together; templates are broadcast, so their size is checked.
MAX_TEMPLATE_TOKENS = 100_000
#: Phrases of the base and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Template blocks: (label, text, tokens that a match must hold). Public license notices. A template
#: gives way where the block also holds what another one, with the same tokens and more, must hold.
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    ("apache", "Released under the Apache License.", ("apache",)),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public")),
    ("gpl", "Released under the GNU General Public License.", ("gnu", "general", "public")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ("gnu", "general", "public")),
    ("bsd", "Released under the BSD License.", ("bsd",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",)),
    *((f"cc-{x}", f"Licensed under CC {x.upper()} 4.0.", ("cc", *x.split("-"))) for x in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")),
    *(
        (f"cc-{x}", f"This work is licensed under a Creative Commons {name} 4.0 International License.", ("creative", "commons", *name.lower().split("-")))
        for x, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
    ),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse",)),
    *((label, f"SPDX-License-Identifier: {name}", ("identifier", name.lower().split("-")[0])) for label, name in (("mit", "MIT"), ("apache", "Apache-2.0"), ("bsd", "BSD-3-Clause"), ("mpl", "MPL-2.0"), ("isc", "ISC"), ("epl", "EPL-2.0"), ("unlicense", "Unlicense"), ("cc0", "CC0-1.0"))),
    *(("gpl", f"SPDX-License-Identifier: GPL-{v}-{x}", ("identifier", "gpl")) for v in ("2.0", "3.0") for x in ("only", "or-later")),
)
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaced(text: Column) -> Column:
    """The words of a text, each between two spaces; letters as they are."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _GAP, " ")), F.lit(" "))


def _small(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _python_words(text: str) -> list[str]:
    out = "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in text)
    return out.split()


def _python_tokens(text: str) -> list[str]:
    return sorted(set(_python_words(text)))


def _python_pairs(text: str) -> list[str]:
    w = _python_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _need_pairs(share: float, n: int) -> int:
    return max(math.ceil(round(share * n, 9)), min(n, LEAST_PAIRS))


def _neighbours(words: Column) -> Column:
    """The pairs of neighbouring words."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _phrases(spaced: Column, phrases: dict[str, str]) -> Column:
    """array<struct<label, at>> of all places; only texts that contain a phrase are cut into words."""
    pattern = "(?i) (" + "|".join(sorted(phrases)) + ") "

    def of(w: Column, tokens: list[str], label: str) -> Column:
        def match(i: Column) -> Column:
            return reduce(lambda x, y: x & y, (F.coalesce(F.get(w, i + k) == t, F.lit(False)) for k, t in enumerate(tokens)))

        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), match)
        return F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))

    def places(w: Column) -> Column:
        return F.flatten(F.array(*(of(w, phrase.split(), label) for phrase, label in phrases.items())))

    none = F.array().cast("array<struct<label:string,at:bigint>>")
    return F.when(F.rlike(spaced, F.lit(pattern)), let(F.split(F.trim(_small(spaced)), " "), places)).otherwise(none)


def _span(text: str) -> int:
    """The least power of two, 8 at least, that holds the words of a template; its windows are twice as long and start so far apart."""
    return 1 << max(3, (len("".join(c if c.isalnum() else " " for c in text).split()) - 1).bit_length())


def matches(df: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple, ...] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False, pairs: float = 0.0) -> DataFrame:
    """(key, block, label, template, containment) of every pair of block and template at or above the threshold, and with that share of pairs (see PAIRS).

    A block is a line of a text, numbered from 0, or with windows a window,
    numbered from 0 among those of its length. Null and empty texts have no
    matches, an empty table none; a template without tokens matches nothing.
    Rows that share a key share their blocks' numbers, and each gives its own
    matches.
    """
    spark = df.sparkSession
    tokens = {i: _python_tokens(t[1]) for i, t in enumerate(templates)}
    tokens = {i: t for i, t in tokens.items() if t}
    if sum(map(len, tokens.values())) > MAX_TEMPLATE_TOKENS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_TOKENS} tokens")
    schema = f"{key} {df.schema[key].dataType.simpleString()}, block int, label string, template int, containment double"
    if not tokens:
        return spark.createDataFrame([], schema)
    need = {i: max(1, math.ceil(round(threshold * len(t), 9))) for i, t in tokens.items()}
    vocabulary = sorted({x for t in tokens.values() for x in t})
    known = F.array(*map(F.lit, vocabulary))
    fewest = min(need.values())
    must = {i: tuple(templates[i][2]) if len(templates[i]) > 2 else () for i in tokens}
    spans = {i: _span(templates[i][1]) if windows else 0 for i in tokens}
    blocks = _windows(df, key, text, tokens, need, must, spans) if windows else df.select(F.col(key).alias("k"), F.lit(0).alias("span"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("block", "line"))
    if not windows:
        blocks = blocks.select("k", "span", "block", F.split(F.trim(_small(_spaced(F.col("line")))), " ").alias("words"))
    # Texts are read once for blocks: what they have of the templates' tokens is written, then counted over all blocks, then joined.
    nearby = {i: _python_pairs(templates[i][1]) for i in tokens}
    every_pair = F.array(*map(F.lit, sorted({x for ps in nearby.values() for x in ps}) if pairs else [])).cast("array<string>")
    seen = F.array_intersect(_neighbours(F.col("words")), every_pair) if pairs else every_pair
    blocks = staged(blocks.select("k", "span", "block", F.array_intersect("words", known).alias("tokens"), seen.alias("pairs")).where(F.size("tokens") > 0))
    # One row per token of the templates: a bounded table.
    counted = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()
    often = {r["token"]: r["count"] for r in counted}
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (often.get(t, 0), t)))}
    index, whole = [], []
    for i, t in tokens.items():
        t = sorted(t, key=rank.__getitem__)
        whole.append((i, templates[i][0], t, nearby[i], _need_pairs(pairs, len(nearby[i])), list(must[i]), [sorted(set(m) - set(must[i])) for m in must.values() if must[i] and set(m) > set(must[i])]))
        index += [(x, spans[i], i, at, len(t), need[i]) for at, x in enumerate(t[: len(t) - need[i] + 1])]
    ordered = F.array(*map(F.lit, sorted(vocabulary, key=rank.__getitem__)))
    short = blocks.where(F.size("tokens") >= fewest).select("k", "span", "block", F.array_intersect(ordered, F.col("tokens")).alias("tokens"), "pairs")
    # Block prefix for the least overlap of any template; the join then applies each template's own.
    prefix = short.withColumn("size", F.size("tokens")).select("k", "span", "block", "tokens", "pairs", "size", F.posexplode(F.slice("tokens", 1, F.size("tokens") - fewest + 1)).alias("at", "token"))
    postings = F.broadcast(spark.createDataFrame(index, "token string, span int, template int, t_at int, t_size int, need int"))
    found = prefix.join(postings, ["token", "span"]).where((F.col("size") >= F.col("need")) & (F.col("at") <= F.col("size") - F.col("need")) & (F.least(F.col("size") - F.col("at"), F.col("t_size") - F.col("t_at")) + F.least("at", "t_at") >= F.col("need")))
    found = found.groupBy("k", "span", "block", "template", "tokens", "pairs").agg(F.first("t_size").alias("t_size"), F.first("need").alias("need"))
    sets = F.broadcast(spark.createDataFrame(whole, "template int, label string, t_tokens array<string>, t_pairs array<string>, need_pairs int, must array<string>, others array<array<string>>"))
    shared = F.size(F.array_intersect("tokens", "t_tokens"))
    holds = lambda x: F.size(F.array_except(x, F.col("tokens"))) == 0
    own = holds(F.col("must")) & ~F.exists("others", holds)
    if pairs:
        both = F.array_intersect("pairs", "t_pairs")
        placed = F.forall("must", lambda m: (F.size("t_pairs") == 0) | F.exists(both, lambda p: F.array_contains(F.split(p, " "), m)))
        own = own & (F.size(both) >= F.col("need_pairs")) & placed
    return found.join(sets, "template").withColumn("shared", shared).where((F.col("shared") >= F.col("need")) & own).select(F.col("k").alias(key), "block", "label", "template", (F.col("shared") / F.col("t_size")).alias("containment"))


def _windows(df: DataFrame, key: str, text: str, tokens: dict[int, list[str]], need: dict[int, int], must: dict[int, tuple], spans: dict[int, int]) -> DataFrame:
    """(k, span, block, words): half-overlapping windows of 2 * span words of the texts that can hold a match, for each span of the templates."""
    # A match holds all that it must, the rarest first, else one at least of any |template| - need + 1 tokens; long ones are rare.
    signs = {x for i, t in tokens.items() for x in (must[i][:1] or sorted(t, key=lambda x: (-len(x), x))[: len(t) - need[i] + 1])}
    rows = df.select(F.col(key).alias("k"), _small(_spaced(F.col(text))).alias("w")).where(F.rlike("w", F.lit(" (?:" + "|".join(sorted(signs)) + ") ")))
    rows = rows.select("k", F.split(F.trim("w"), " ").alias("w")).select("k", "w", F.explode(F.array(*map(F.lit, sorted(set(spans.values()))))).alias("span"))
    # A text's last window would lie whole in the one before it.
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - F.col("span") - 1) / F.col("span")).cast("int")))
    rows = rows.select("k", "span", F.posexplode(F.transform(starts, lambda j: F.slice("w", j * F.col("span") + 1, F.col("span") * 2))).alias("block", "words"))
    return rows.where(F.arrays_overlap("words", F.array(*map(F.lit, sorted(signs)))))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple, ...] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per row of df: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels: those of phrases and of templates that a window matches; score: the highest
    containment of a matching template, 1 with a phrase, 0 without either.
    Null and empty texts: counts 0, null places, empty labels. Rows are told
    apart by key and text, so repeated and null keys have each their own
    labels. Other columns are not read; an empty table gives none.
    """
    spaced = F.col("spaced")
    rows = df.select(F.struct(F.col(f"`{key}`").cast("long").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("h")).alias("id"), F.col(f"`{text}`").alias("text"))
    base = rows.select("id", _spaced(F.col("text")).alias("spaced"))
    base = base.select("id", F.when(F.trim(spaced) == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"), _phrases(spaced, phrases).alias("p"))
    by_key = matches(rows, "id", "text", templates, threshold, windows=True, pairs=PAIRS).groupBy("id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    own = F.array_distinct(F.transform("p", lambda x: x["label"]))
    join = lambda x: F.array_join(F.array_sort(x), ",")
    return base.join(by_key, "id", "left").select(
        F.col("id.k").alias(key), "n_words", F.size("p").cast("long").alias("n_base"), F.array_min(F.transform("p", lambda x: x["at"])).alias("first_word"), F.array_max(F.transform("p", lambda x: x["at"])).alias("last_word"),
        join(own).alias("base_labels"), join(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.when(F.size("p") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )
