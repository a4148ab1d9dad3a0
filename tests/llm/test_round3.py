"""Operators 11 to 13 against brute force, and their edges."""

import hashlib
import math
import random
import string
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from sevra.llm import common, filter_audit, html_text, licenses, minhash, mixing, quality_mil, resampling, textvec, token_counts, toxicity, url_filter

SPACED = regex.compile(r"[^\x20\x09-\x0D]+")


def audit_by_hand(rows, labels):
    """Walks every order over every row."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    fails = []
    for key, text, part in rows:
        t = text or ""
        w = SPACED.findall(t)
        copy = key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in rows)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(regex.findall("[A-Z]", t)) > 3 * len(t), "D": bool(regex.search(r"[#$%&*|]", t)), "E": copy}
        fails.append((part or "", {x for x in f if f[x]}, key in good, key in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, shapley = [x[1:] for x in fails if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                failing = sum(f in x[0] for x in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("held", [1 << 26, 300])
def test_filter_audit_equals_a_walk_over_every_order(spark, held):
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma", "delta", "été", "x y", "EPS"]
    pool = [" ".join(rng.choice(words) + (str(rng.randrange(500)) if rng.random() < 0.6 else "") for _ in range(rng.choice([3, 60, 230]))) + rng.choice(["", "", " #", " a|b"]) for _ in range(14)] + ["", None, " \x0b ", "\x1c a\x85b"]
    rows = [(i, rng.choice(pool), rng.choice(["de", "en", None, ""])) for i in range(120)]
    rows += [(None, pool[0], "en"), (None, pool[0], "en"), (5, pool[1], "fr"), (5, pool[1], "fr"), (5, pool[2], "fr"), (900, "hot " * 5, "en")] + [(i, "hot " * 5, "en") for i in range(800, 860)]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, mask int").repartition(5)
    got = filter_audit.audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held=held).collect()
    assert len(got) == 600 * 4
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == audit_by_hand(rows, labels)


def test_filter_audit_without_rows(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(docs, labels).collect() == []
    one = filter_audit.audited(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


def test_collision_chains_compare_whole_texts():
    rows = [(7, (b"one", 4, {"a": 1}, 0)), (7, (b"two", 3, {"a": 1}, 1)), (7, (b"one", 2, {"b": 2}, 0)), (9, (b"one", 1, {"a": 1}, 0))]
    assert sorted(filter_audit._chained(iter(rows), 16)) == [(1, "a", 1, 0), (2, "b", 2, 0), (3, "a", 1, 1), (4, "a", 1, 16)]


TEXTS = ["one two three", "", None, "one two three", "  spaces\tand\n\nlines ", "<s> special </s> <unk>", "naïve 你好 \U0001f642 \x00 end", "long " * 6000, "A" * 5000]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("few", [0, 100])
def test_token_counts_are_the_library_s(spark, name, few, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        fast = Tokenizer.from_file(path)
        count = lambda t: len(fast.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        count = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t, m=count: len(m.encode(t))
    rows = [(i, t, "d", 7) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "d", 7), (2, "other", "d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens int").repartition(3)
    got = token_counts.counted(docs, token_counts.load(path), str(tmp_path / "cache"), limit=5000, few=few).collect()
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 5000) for i, t, *_ in rows]
    assert Counter(map(tuple, got)) == Counter(want) and any(r["over_limit"] for r in got)


def test_token_cache_is_read_and_extended(spark, tmp_path):
    cache, tokenizer = str(tmp_path / "cache"), token_counts.load()
    at = f"{cache}/{tokenizer.version}"
    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(rows(["a b", "c", "a b"]), tokenizer, cache).collect()}
    stored = spark.read.parquet(at)
    assert stored.count() == 2 and first[0] == first[2]
    # A planted count shows that the cache is read; twice in the cache counts once.
    digest = hashlib.sha256(b"planted").digest()
    for _ in range(2):
        spark.createDataFrame([(digest, 77)], token_counts.CACHED).write.mode("append").parquet(at)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(rows(["planted", "a b", "new text"]), tokenizer, cache).collect()}
    assert got[0] == 77 and got[1] == first[0]
    assert spark.read.parquet(at).select("digest").distinct().count() == 4
    assert token_counts.counted(rows(["new text", "a b"]), tokenizer, cache).count() == 2 and spark.read.parquet(at).count() == 5
    # Another tokenizer has a cache of its own.
    import public_tokenizers

    other = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.version != tokenizer.version and {r["n_tokens"] for r in token_counts.counted(rows(["planted"]), other, cache).collect()} != {77}
    assert token_counts.counted(rows([]), tokenizer, cache).collect() == []


def draw_by_hand(docs, target, runs, buckets, percent, least, seed):
    word = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def feats(t):
        w = word.findall(regex.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in feats(x)[1]) for texts in ([d[1] for d in docs], target))
    n_s, n_t = s.total() + buckets, t.total() + buckets
    out = []
    for i, (key, text) in enumerate(docs):
        n, f = feats(text)
        total = sum(math.floor(1000 * math.log((t[bucket(x)] + 1.0) * n_s / ((s[bucket(x)] + 1.0) * n_t))) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = total // len(f) if f else 0
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n, i])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0], x[2], x[1]))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("runs,buckets,percent", [((1, 1), 10_000, 10), ((1, 2), 50, 37), ((2, 3), 7, 100), ((1, 1), 50, 0)])
def test_resampling_equals_a_sort(spark, runs, buckets, percent):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma", "Été", "naïve", "x1", "y-z", "the", "你好"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 20, 60])))
    docs = [(i, text()) for i in range(300)] + [(i, None) for i in range(300, 310)] + [(None, text()) for _ in range(3)] + [(7, "alpha " * 30)] * 3 + [(i, "same " * 25) for i in range(400, 500)]
    target = [text() for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in docs], "doc_id long, text string, score string, rank int").repartition(4)
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, runs=runs, buckets=buckets).collect()
    assert Counter(map(tuple, got)) == draw_by_hand(docs, target, runs, buckets, percent, 20, 2024)


def test_resampling_prefers_the_target(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["law", "court", "judge"] if i % 10 == 0 else ["ball", "goal", "team", "court"]) for _ in range(40))) for i in range(1000)]
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("law judge court " * 50,)], "text string")).where("rank is not null").collect()
    assert len(got) == 100 and sum(r["doc_id"] % 10 == 0 for r in got) > 60


def test_resampling_edges(spark):
    schema = "doc_id long, text string"
    empty, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a b"), (2, None)], schema)
    assert resampling.resampled(empty, some).collect() == []
    got = resampling.resampled(some, empty).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {(1, 2, None), (2, 0, None)} and [r["weight"] for r in got if r["doc_id"] == 2] == [0]
    tied = spark.createDataFrame([(2, "w " * 20), (2, "w " * 20), (3, "v " * 20)], schema)
    assert sorted(r["rank"] for r in resampling.resampled(tied, some, percent=100).collect()) == [1, 2, 3]


def test_other_draws_change_what_is_taken(spark, monkeypatch):
    """The same permutations with other draws: other words are taken, as many of each source."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 5, 30, 130, 700]), rng.choice(["a", "hot", "hot", "hot", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    draw = mixing.draw
    got = []
    for change in (0, 1):
        monkeypatch.setattr(mixing, "draw", lambda shard, slots, seed, shards=mixing.SHARDS, c=change: draw(shard, slots, seed + c, shards))
        got.append({r["doc_id"]: (r["taken"], r["target"]) for r in mixing.mixed(docs).collect()})
    one, other = got
    assert sum(one[i] != other[i] for i in one) > 20
    size = {i: len(t) // 2 for i, t, _ in rows}
    for result in got:
        taken, target = Counter(), {}
        for i, _, s in rows:
            taken[s] += result[i][0]
            target[s] = result[i][1]
            assert result[i][0] <= 3 * size[i]
        assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in target)


@pytest.mark.parametrize("members", [30, 90])
def test_families_just_below_the_threshold_do_not_meet(spark, members, monkeypatch):
    """Three families that differ at two places each, with one changed word per text: alike at 0.78, so no pair may be compared, at any size."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for family in range(3):
        own = list(base)
        own[40 * family + 10] = own[40 * family + 30] = f"family{family}"
        for i in range(members):
            text = list(own)
            text[140] = f"t{family}x{i}"
            rows.append((len(rows), family, " ".join(text)))
    found = []
    real = minhash.prefix_pairs
    monkeypatch.setattr(minhash, "prefix_pairs", lambda *a: found.append(real(*a).count()) or real(*a))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, size=3, percent=85).collect()}
    assert got == {i: family * members for i, family, _ in rows}
    # The last turn by itself, with every row in it.
    steps = common.Steps()
    sets = docs.withColumnRenamed("doc_id", "id").mapInArrow(minhash._sets(3), "id long, shingles array<long>")
    labels = spark.createDataFrame([(i, family) for i, family, _ in rows], "rep long, label long")
    sized = sets.selectExpr("id AS rep", "size(shingles) AS n").selectExpr("rep", "cast(n AS long) AS n").join(labels, "rep")
    assert real(sized, sets, 85, steps).count() == 0 and not any(found)


def test_last_turn_misses_no_link(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(120):
        text = rng.choices(words, k=30) if i % 4 == 0 or not rows else [w if rng.random() > 0.04 else rng.choice(words) for w in rows[-1][1]]
        rows.append((i, text))
    sets = {i: {tuple(t[k : k + 3]) for k in range(len(t) - 2)} for i, t in rows}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "id long, text string")
    hashed = docs.mapInArrow(minhash._sets(3), "id long, shingles array<long>")
    labels = {i: i // 4 * 4 + (i % 4 > 1) * 2 for i, _ in rows}  # halves of families, so that many links are open
    sized = spark.createDataFrame([(i, len(sets[i]), labels[i]) for i, _ in rows], "rep long, n long, label long")
    got = {(r["a"], r["b"]) for r in minhash.prefix_pairs(sized, hashed, 80, common.Steps()).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and labels[a] != labels[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and want <= got and len(got) < 10 * len(want)


def test_mirrored_words_stay_apart(spark):
    """Words that collide in every polynomial modulo 2^64: the first is a Thue-Morse word, the second its mirror."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, other = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    w = next(textvec.slices(pa.array([f"{one} {other} x x"])))[2]
    assert len(set(w.hash.tolist())) < 3 and len(set(w.strong().tolist())) == 3
    rows = [(1, f"{one} one two three"), (2, f"{other} one two three"), (3, one), (4, other)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_strong_hashes_by_hand():
    texts = ["Ab ab  c", "", None, "é é \t ab", "x" * 3000 + " ab"]
    for at, to, w in textvec.slices(pa.array(texts)):
        words = [x.lower() for t in texts[at:to] for x in (t or "").split()]
        by_word = {}
        for word, h in zip(words, w.strong().tolist(), strict=True):
            assert by_word.setdefault(word, h) == h
        assert len(set(by_word.values())) == len(by_word)
    for prime, base in textvec._PRIMES:
        power, inverse = textvec._prime_powers(prime, base, 5000)
        assert all(int(power[i]) == pow(base, i, prime) and int(power[i]) * int(inverse[i]) % prime == 1 for i in (0, 1, 2, 77, 4999))
    assert np.all(textvec.mix(np.arange(9, dtype=np.uint64)) != 0)


NOTICES = [
    ("We met MIT people; the paper was released under the new license.", ""), ("The license was released. Under the bridge the MIT team met.", ""), ("BSD users: the library, released under another license, is old.", ""),
    ("Released under the MIT License.", "mit"), ("This tool is released under the terms of the MIT license, enjoy.", "mit"), ("Released under the BSD\nLicense.", "bsd"), ("// SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
    ("# SPDX-License-Identifier: MIT\nimport os", "mit"), ("SPDX-License-Identifier: ISC", "isc"), ("Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided", "isc"), ("The identifier of the license is SPDX; MIT is a school.", ""),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl"), (None, ""), ("", ""), ("license " * 40 + "mit released under the", ""),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"), ("Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files", "mit"), ("files documentation associated and software this of copy a obtaining person any to charge of free granted hereby is permission", ""),
]


def test_notices_need_their_words_in_place(spark):
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")).collect()}
    for i, (text, want) in enumerate(NOTICES):
        base = {v for k, v in licenses.PHRASES.items() if f" {k} " in f" {' '.join(licenses._python_words(text or ''))} "}
        assert got[i][0] == ",".join(sorted({*base, *filter(None, [want])})), (text, got[i])
        assert (got[i][1] >= licenses.THRESHOLD) == bool(got[i][0])


def test_scan_equals_every_window_against_every_template(spark):
    rng = random.Random(7)
    pool = [w for t in licenses.TEMPLATES for w in licenses._python_words(t[1])] + ["alpha", "beta", "x"]
    texts = []
    for _ in range(60):
        t = licenses._python_words(rng.choice(licenses.TEMPLATES)[1])
        t = [w if rng.random() > 0.12 else rng.choice(pool) for w in t]
        texts.append(" ".join(rng.choices(pool, k=rng.randrange(60)) + t + rng.choices(pool, k=rng.randrange(60))))

    def by_hand(text):
        w = licenses._python_words(text)
        out = set()
        musts = [set(t[2]) if len(t) > 2 else set() for t in licenses.TEMPLATES]
        for (label, t, *_), must in zip(licenses.TEMPLATES, musts, strict=True):
            span, tokens, near = licenses._span(t), set(licenses._python_tokens(t)), set(licenses._python_pairs(t))
            for j in range(max(0, (len(w) - span - 1) // span) + 1):
                window = w[j * span : j * span + 2 * span]
                held, pairs = set(window), {f"{a} {b}" for a, b in zip(window, window[1:], strict=False)} & near
                if len(tokens & held) < math.ceil(round(licenses.THRESHOLD * len(tokens), 9)) or not must <= held or any(must and m > must and (m - must) <= held for m in musts):
                    continue
                if len(pairs) >= max(0.6 * len(near), min(len(near), 4)) and all(any(m in p.split() for p in pairs) for m in must):
                    out.add(label)
        return out | {v for k, v in licenses.PHRASES.items() if f" {k} " in f" {' '.join(w)} "}

    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: ",".join(sorted(by_hand(t))) for i, t in enumerate(texts)}
    assert got == want and len(set(want.values())) > 8


BODY = "Words of the text are here in a row and go on. " * 4
#: Pages of layouts that the tree's table does not have, with their main text, marked by hand.
LAYOUTS = [
    (f"<main><h1>T</h1><p>{BODY}</p><article class='comment'><p>I liked this very much, thank you for it.</p></article></main>", f"T\n{BODY.strip()}"),
    (f"<article><p>{BODY}</p><ol class='commentlist'><li>First reader here.<li>Second reader too.</ol></article>", BODY.strip()),
    (f"<article><p>{BODY}</p><div class='adsbygoogle'>Buy a lamp today, it is cheap.</div><p>End of it.</p></article>", f"{BODY.strip()}\nEnd of it."),
    (f"<div class='cc-window'>This site uses cookies, see the policy.</div><h1>T</h1><p>{BODY}</p><p>{BODY}</p><p>\u00a9 2020 The makers of it</p><p>Log in to leave your thoughts</p>", f"T\n{BODY.strip()}\n{BODY.strip()}"),
    (f"<article class='post sidebar-right'><p>{BODY}</p><p>All rights reserved.</p></article>", f"{BODY.strip()}\nAll rights reserved."),
]


def test_layouts_marked_by_hand():
    assert [html_text.main_text(p) for p, _ in LAYOUTS] == [t for _, t in LAYOUTS]


def test_the_tree_decides():
    """Without it, menus and comments are text; it agrees with its own table."""
    yes = 1.0
    for page, text in LAYOUTS[:4]:
        assert html_text.main_text(page, yes) != text and len(html_text.main_text(page, yes)) > len(text)
    tree = html_text.fit()
    assert all(html_text.is_main(tree, list(r[:-1])) == bool(r[-1]) for r in html_text.LABELLED) and {len(r) for r in html_text.LABELLED} == {len(html_text.FEATURES) + 1}


def _texts():
    rng = random.Random(21)
    words = ["Abc", "abc", "ÉTÉ", "naïve", "12", "x#y", "end.", "what?!", "|row|", "é", "你好", "longerword", "longerwords"]
    return ["", None, "a", " ".join(rng.choice(words) for _ in range(64)), *(" \t".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(12)), "abc abc abc ABC"]


def test_passages_by_brute_force():
    texts = _texts()
    for at, to, w in textvec.slices(pa.array(texts)):
        doc, got = quality_mil.passages(w)
        want = []
        for d, text in enumerate(texts[at:to]):
            words = (text or "").encode().split()
            for part in [words[i : i + 64] for i in range(0, len(words), 64)] or [[]]:
                n, size = max(1, len(part)), max(1, sum(map(len, part)))
                lower = [x.lower() for x in part]
                count = lambda f, p=part: sum(1 for x in p for c in x if f(c))
                symbols = b"#*$%&|<>"
                accents = sum(1 for x in part for a, b in zip(x, x[1:], strict=False) if a == 0xC3 and b < 0x9F)
                row = [math.log1p(len(part)), (sum(map(len, part)) or 1) / n, (count(lambda c: 65 <= c <= 90) + accents) / size, count(lambda c: c in symbols) / size, count(lambda c: 48 <= c <= 57) / size]
                row += [count(lambda c: chr(c) in string.punctuation and c not in symbols) / size, count(lambda c: c == 33) / n, sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n, sum(a == b for a, b in zip(lower, lower[2:], strict=False)) / n]
                row += [len(set(lower)) / n, sum(x[-1:] in (b".", b"!", b"?") for x in part) / n, sum(x[0] in b"|#*$%&<>" for x in part) / n, count(lambda c: c >= 128) / size]
                want.append((d, row))
        assert [d for d, _ in want] == doc.tolist()
        some = [i for i, (d, _) in enumerate(want) if (texts[at + d] or "").split()]
        assert got[some] == pytest.approx(np.array([want[i][1] for i in some]))


def test_toxicity_features_by_brute_force():
    texts = _texts()
    for at, to, w in textvec.slices(pa.array(texts)):
        doc, bucket = toxicity.features(w)
        want = [[], [], [], []]
        for d, text in enumerate(texts[at:to]):
            words = [x.lower() for x in (text or "").encode().split()]
            want[0] += [(d, (x,)) for x in words]
            want[1] += [(d, ("begins", x[:5])) for x in words]
            want[2] += [(d, ("next", a, b)) for a, b in zip(words, words[1:], strict=False)]
            want[3] += [(d, ("skip", a, b)) for a, b in zip(words, words[2:], strict=False)]
        rows = [x for kind in want for x in kind]
        assert [d for d, _ in rows] == doc.tolist()
        of = {}
        assert all(of.setdefault(key, b) == b for (_, key), b in zip(rows, bucket.tolist(), strict=True))
        assert len(set(of.values())) >= len(of) - 1 and max(of.values()) < 1 << toxicity.BITS


def test_ftrl_by_brute_force():
    """Follow the regularised leader coordinate by coordinate, in plain Python."""
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), sorted(rng.sample(range(40), 8))) for _ in range(120)]
    rows = [(y, sorted({*x, 41}) if y else x) for y, x in rows]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.9, 0.05
    got = toxicity.train([(y, np.array(x)) for y, x in rows], epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n, share = Counter(), Counter(), min(0.2, sum(y for y, _ in rows) / len(rows))
    bias = math.log(share / (1 - share))
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(3):
        for y, x in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in x:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(got.buckets.tolist(), got.values.tolist(), strict=True)) == pytest.approx(want, rel=1e-3, abs=1e-4) and got.bias == pytest.approx(bias) and want[41] > 0


def test_url_queries_and_suffixes_by_brute_force(spark):
    urls = ["http://a.org/x?p=1&q=2#f", "http://a.org/?", "http://b.zz/x", "http://a.com?x", "x?y&z&", "", None, "http://c.org/a#b?c=1&d"]
    forest = url_filter.Forest(0.0, [], {"": 0.25, "org": 0.75, "com": 0.5})
    host, path = url_filter.parts(F.col("u"))
    names = ("parameters", "query_length", "suffix_rate")
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", *(url_filter.features(F.col("u"), host, path, forest.suffixes)[k].alias(k) for k in names)).collect()
    for r in rows:
        query = regex.search(r"\?([^#]*)", r["u"] or "")
        query = query[1] if query else ""
        suffix = "org" if ".org" in (r["u"] or "") else "com" if ".com" in (r["u"] or "") else ""
        assert tuple(r)[1:] == (query.count("&") + 1 if query else 0, len(query), forest.suffixes[suffix]), r
