"""Operators against brute force on small fixtures, with nulls, empty and long texts, repeats and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from sevra.llm import exact_dedup, html_text, licenses, minhash, mixing, packing, quality_mil, quality_rules, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [a + b for a in ("ba", "Ce", "di", "FO", "gu", "éa") for b in ("n", "rt", "s.", "m", "x,", "ll")]


def _corpus():
    rng = random.Random(5)
    rows = [(0, None, "en", None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "one", None, "b", 3), (4, "one two", "en", "b", 7), (5, "ONE two", "en", "b", 7)]
    base = [_text(rng, n) for n in (30, 80, 200, 1500, 6000)]
    for t in base:
        for _ in range(8):
            w = t.split()
            for _ in range(rng.randrange(0, max(2, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append((len(rows), " ".join(w), "en", rng.choice(["a", "b", "c", "hot", "hot", None]), 1))
        rows.append((len(rows), t, "en", "hot", 1))
        rows.append((len(rows), t, "en", "hot", 1))
    rows.append((len(rows), "line one of it\n" * 40 + "again and again " * 30, "en", "a", 1))
    return rows


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, corpus, empty):
    got = {r["doc_id"]: r for r in quality_rules.digest(docs).collect()}
    for i, t, *_ in corpus:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        repeat = len({j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)})
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat)
        assert r["base_failed"] == (len(w) < 20 or 100 * repeat > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.digest(empty).count() == 0
    assert set(quality_rules.apply_rules(docs).columns) >= set(docs.columns)


def test_exact_dedup(docs, corpus, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[t or ""].append(i)
    want = {(i, max(v), len(v), i == max(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for i in v}
    assert {tuple(r) for r in exact_dedup.exact_groups(docs).collect()} == want
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {r for r in corpus if r[0] == max(groups[r[1] or ""])}
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.drop_exact_copies(empty).count() == 0


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, corpus, empty, size, percent):
    sets = {}
    for i, t, *_ in corpus:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and label[b] < label[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, size=size, percent=percent).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert minhash.near_duplicates(empty).count() == 0


def test_packing(docs, corpus, empty):
    rows = packing.packed(docs.union(docs.where("doc_id = 10")), capacity=256, most_sources=2).collect()
    per = collections.defaultdict(list)
    for r in rows:
        per[r["doc_id"], r["copy"]].append(r)
    for i, t, *_ in corpus:
        pieces = sorted(per[i, 0], key=lambda r: r["piece"])
        assert [p["first_word"] for p in pieces] == [256 * k for k in range(len(pieces))] and sum(p["n_words"] for p in pieces) == len(WORD.findall(t or ""))
    assert (10, 1) in per and sum(len(v) for v in per.values()) == len(rows)
    source, text = {r[0]: r[3] for r in corpus}, {r[0]: r[1] for r in corpus}
    bins = collections.defaultdict(list)
    for r in rows:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for v in bins.values():
        assert sum(r["n_words"] for r in v) == v[0]["bin_words"] <= 256 and len({source[r["doc_id"]] for r in v}) <= 2
        assert len({text[r["doc_id"]] for r in v}) == len(v)
    assert packing.packed(empty).count() == 0


def test_best_fit_is_tightest():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 40)
        sizes, sources, clusters = [rng.randrange(1, 60) for _ in range(n)], [rng.randrange(5) for _ in range(n)], [rng.choice([None, 1, 2, 3]) for _ in range(n)]
        got = packing.pack_rows(sizes, sources, clusters, 100, 3)
        bins: list = []
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= sizes[i] and (clusters[i] is None or clusters[i] not in b[2]) and len(b[1] | {sources[i]}) <= 3]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([100, set(), set()])
            bins[k][0] -= sizes[i]
            bins[k][1].add(sources[i])
            bins[k][2].add(clusters[i])
            assert got[i] == k


def test_mixing(docs, corpus, empty):
    got = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    sizes, by = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus}, collections.Counter()
    for i, _, _, s, _ in corpus:
        by[s] += sizes[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([by[s] for s in order], [1, 2, 3, 1, 2][: len(order)]), strict=True))
    taken = collections.Counter()
    for i, _, _, s, _ in corpus:
        r = got[i]
        assert (r["size"], r["source_size"]) == (sizes[i], by[s]) and r["target"] == pytest.approx(goal[s]) and 0 <= r["taken"] <= 3 * sizes[i]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK for s in order)
    assert {tuple(r) for r in mixing.mixed(docs).collect()} == {tuple(r) for r in got.values()}
    assert mixing.resampled(docs).columns == docs.columns and mixing.mixed(empty).count() == mixing.resampled(empty).count() == 0


def test_targets_stop_at_three_times():
    assert mixing.targets([10, 1000], [3, 1]) == [30, 980]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 1]) == [0, 5]


def test_licenses(spark, empty):
    rows = [(0, None), (1, ""), (2, "MIT License and the mit-license."), (3, "x Licensed under the Apache License, Version 2.0.\nother"), (4, "commit license"), (5, "Licensed under CC BY-NC 4.0."), (6, "GNU General Public\nLicense"), (7, "licensed under cc")]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == got[1] == (0, 0, None, None, "", "", 0.0)
    assert got[2] == (6, 2, 0, 4, "mit", "mit", 1.0)
    assert got[3][:6] == (10, 1, 4, 4, "apache", "apache") and got[4][1] == 0 and got[5][4:] == ("", "cc-by-nc", 1.0) and got[6][1:5] == (1, 1, 1, "gpl") and got[7][5] == ""
    assert licenses.scan(empty).count() == 0


def test_license_join_is_exact(spark):
    rng = random.Random(9)
    words = "red blue green dark light sea sky sun moon star".split()
    templates = tuple((f"t{k}", " ".join(rng.sample(words, rng.randrange(3, 8)))) for k in range(6))
    texts = [(i, "\n".join(" ".join(rng.choices([*words, "zz"], k=rng.randrange(1, 9))) for _ in range(4))) for i in range(60)]
    want = {(i, b, k) for i, t in texts for b, line in enumerate(t.split("\n")) for k, (_, x) in enumerate(templates) if len(set(line.split()) & set(x.split())) >= 0.7 * len(set(x.split()))}
    got = licenses.matches(spark.createDataFrame(texts, "doc_id long, text string"), templates=templates, threshold=0.7).collect()
    assert {(r["doc_id"], r["block"], r["template"]) for r in got} == want and len(got) == len(want)


def test_html(spark):
    page = "<html><head><title>T</title><script>a<p>b</script></head><body><nav><a href=x>Home</a></nav><main><h1>Real <i>title</i></h1><p>First &amp; last\n line<p>Short.<ul><li>one<li>two</ul><div class='comments'><p>Nice article, thanks.</div></main><form>Name</form><footer>(c)</footer>"
    rows = spark.createDataFrame([(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "<p>cut off here in the tex <b"), (4, "u", "plain words")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(rows).collect()}
    assert got == {0: "Real title\nFirst & last line\nShort.\none\ntwo", 1: "", 2: "", 3: "cut off here in the tex", 4: "plain words"}


def test_url_filter(spark):
    forest = url_filter.train(spark.createDataFrame(url_filter.seed_urls(), "url string, label int"))
    urls = ["https://A.example.ORG/es/1?x=1", "https://example.org/en/12", "http://x.com/fr/", "http://xcom/fr/", "http://com/de/1#t", None, "", "no/scheme", "http://cheap-pills.example.net/buy?a=1&b=2&c=3"]
    got = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), forest).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(8)] == [("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("x.com", "/fr/", "com/fr/"), ("xcom", "/fr/", None), ("com", "/de/1", "com/de/"), ("", "", None), ("", "", None), ("", "", None)]
    assert [got[i]["verdict"] for i in (0, 1, 2, 4, 8)] == ["block", "block", "allow", "block", "block"]


def test_toxicity(spark, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        t = _text(rng, 60).split()
        if bad:
            t[30] = t[10] = "nastyword"
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string")
    weights = toxicity.learn(spark.createDataFrame([*labels, (402, None)], "doc_id long, toxic int"), docs=docs)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, weights).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels) and got[400] == got[401] < 0.3 and len(weights.buckets) < 2000
    kept = toxicity.drop_toxic(docs, weights)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}
    none = toxicity.learn(spark.createDataFrame([], "doc_id long, toxic int"), docs=docs)
    assert toxicity.scored(empty, none).count() == 0


def test_quality_classifier(spark, empty):
    rng = random.Random(2)
    rows = [(i, _text(rng, 150) if i % 3 else " ".join([_text(rng, 40), "$$$ ### *** " * 30])) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string")
    model = quality_mil.learn(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality_mil.scored(docs, model).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in range(200, 300)]) > 0.97 and 0 <= got[300] == got[301] <= 1
    assert quality_mil.scored(empty, model).count() == 0


def test_toxicity_settings_are_chosen_by_folds():
    rows = [(i % 4 == 0, np.array([7 + i % 4, 100 + i], np.int32)) for i in range(120)]
    rows = [(int(y), x) for y, x in rows]
    (f1, loss, best), *others = toxicity.choose(rows, [{"l1": 1e6}, {"l1": 4.0}])
    assert best == {"l1": 4.0} and f1 == 1 and loss < others[0][1]
    assert toxicity.choose([], [{}]) == [(0.0, 0.0, {})]
