"""Operators in earnest: draws of the mix, prefix joins over large groups, pages marked by hand, and odd tables for every operator and stage."""

import collections
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sevra.llm import common, exact_dedup, html_text, licenses, minhash, mixing, packing, quality_mil, quality_rules, queries, toxicity, url_filter


def _sources(spark, n=400):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 5, 30, 130, 700]), rng.choice(["a", "hot", "hot", "hot", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_mix_follows_its_draws(spark):
    """Shard counts, permutations and spans against a mix made row by row."""
    rows, docs = _sources(spark)
    got = mixing.spans(docs).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t) // 2
    planned = mixing.plan(list(sizes.items()), mixing.default_weights)
    goal = [x["slots"] for x in planned]
    drawn = [mixing.draw(k, goal, mixing.SEED) for k in range(mixing.SHARDS)]
    want = {}
    for i, x in enumerate(planned):
        blocks, goal_ = x["blocks"], x["slots"]
        edges = [k * blocks // mixing.SHARDS for k in range(mixing.SHARDS + 1)]
        passes = goal_ // blocks if blocks else 0
        parts, left = [], goal_ - passes * blocks
        for k in range(mixing.SHARDS):
            parts.append(min(max(0, int(drawn[k][i]) - passes * (edges[k + 1] - edges[k])), edges[k + 1] - edges[k], left))
            left -= parts[-1]
        for k in range(mixing.SHARDS):
            more = min(left, edges[k + 1] - edges[k] - parts[k])
            parts[k] += more
            left -= more
        for k in range(mixing.SHARDS):
            slots = [p * blocks + at for p in range(passes) for at in range(edges[k], edges[k + 1])] + [passes * blocks + edges[k] + j for j in range(parts[k])]
            want |= {(x["source"], slot): (k, (slot % blocks * x["step"] + x["shift"]) % blocks) for slot in slots}
        assert sum(s == x["source"] for s, _ in want) == goal_
    assert {(r["source"], r["slot"]): (r["shard"], r["block"]) for r in got} == want
    # A pass takes every block once, and a block's spans are the words of BLOCK places.
    for x in planned:
        for turn in range(3):
            blocks = [b for (s, k), (_, b) in want.items() if s == x["source"] and k // x["blocks"] == turn]
            assert len(set(blocks)) == len(blocks)
    words = collections.Counter()
    for r in got:
        words[r["source"], r["slot"]] += r["n_words"]
    assert all(n == mixing.BLOCK or want[k][1] == next(x["blocks"] for x in planned if x["source"] == k[0]) - 1 for k, n in words.items())
    size, taken = {r[0]: len(r[1]) // 2 for r in rows}, collections.Counter()
    for r in got:
        assert 0 <= r["first_word"] and r["first_word"] + r["n_words"] <= size[r["doc_id"]]
        taken[r["doc_id"]] += r["n_words"]
    mixed = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    assert {i: r["taken"] for i, r in mixed.items()} == {i: taken[i] for i in size}
    assert {i: r["n_shards"] for i, r in mixed.items()} == {i: len({r["shard"] for r in got if r["doc_id"] == i}) for i in size}


def test_another_seed_changes_the_mix(spark):
    _, docs = _sources(spark)
    one, other = ({r["doc_id"]: (r["taken"], r["n_shards"]) for r in mixing.mixed(docs, seed=k).collect()} for k in (1, 2))
    assert sum(one[i][0] != other[i][0] for i in one) > 20 and sum(one[i][1] != other[i][1] for i in one) > 20


def test_permutation_is_one():
    for blocks in (1, 2, 3, 12, 97, 1024):
        step, shift = mixing.permutation("x", blocks, 5)
        assert {(k * step + shift) % blocks for k in range(blocks)} == set(range(blocks))
    step, shift = mixing.permutation(None, 10**12, 5)
    assert step * 10**12 < 2**62 and shift < 10**12


@pytest.mark.parametrize("size,percent", [(5, 80), (3, 85)])
def test_large_group_of_near_copies(spark, size, percent, monkeypatch):
    """Two groups whose members are alike at 0.6 to 0.9: components equal brute force, and the last turn does run, with few pairs."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    second = [w if k % 17 else f"v{k}" for k, w in enumerate(base)]
    texts = []
    for i in range(240):
        w = list(base if i % 2 else second)
        for _ in range(rng.choice([1, 2, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + size]) for k in range(121 - size)} for t in texts]
    label = list(range(len(sets)))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(30):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    seen = []
    whole = minhash.prefix_pairs
    monkeypatch.setattr(minhash, "prefix_pairs", lambda rows, *more: seen.append((rows.count(), whole(rows, *more))) or seen[-1][1])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), size=size, percent=percent).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 10 and len(seen) == 1 and seen[0][0] > 50


def test_prefix_pairs_miss_no_link(spark):
    rng = random.Random(12)
    sets = [sorted({rng.randrange(60) ** 2 for _ in range(rng.randrange(1, 40))}) for _ in range(60)]
    sets += [sorted(set(s) - {s[0]} | {9999}) for s in sets]
    rows = spark.createDataFrame([(i, len(s), i % 7) for i, s in enumerate(sets)], "rep long, n long, label long")
    table = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>")
    for percent in (50, 80):
        got = {(r["a"], r["b"]) for r in minhash.prefix_pairs(rows, table, percent, common.Steps()).collect()}
        want = {(a, b) for b in range(len(sets)) for a in range(b) if a % 7 != b % 7 and 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})}
        assert want <= got and len(want) > 5


def test_steps_delete_what_nothing_reads(spark):
    steps = common.Steps()
    one, two = steps.staged(spark.range(3)), steps.staged(spark.range(4))
    at = [Path(x.removeprefix("file:")) for _, x in steps.tables]
    at = [Path("/" + str(x).lstrip("/")) for x in at]
    assert all(x.is_dir() for x in at)
    steps.drop_but(two)
    assert not at[0].exists() and two.count() == 4 and one.columns == ["id"]


def test_components_of_a_star_and_a_chain(spark):
    links = [(5000, i) for i in range(1, 1500)] + [(10000 + i, 10001 + i) for i in range(40)] + [(3, 3)]
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 1500)}, 5000: 1, **{10000 + i: 10000 for i in range(41)}}


PAGES = (
    # (page, its main text), marked by hand; none of these layouts is in the tree's table.
    ("<body><div class='content has-sidebar'><article><header class='entry-header'><h1>On rivers</h1></header><p>Rivers run to the sea and carry sand with them.<p>They bend.</article><div class=sidebar>About me</div></div>", "On rivers\nRivers run to the sea and carry sand with them.\nThey bend."),
    ("<div id=menu><a href=/>Home</a> <a href=/x>News</a></div><div class=post-date>May 1</div><p>" + "Long text without an article element goes on. " * 6 + "</p><p>So short.</p><p>" + "And again it goes on for a while here. " * 6 + "</p><div class=comments><p>Nice text, thank you very much for it.</p></div><div id=footer>All rights reserved</div>",
     "May 1\n" + ("Long text without an article element goes on. " * 6).strip() + "\nSo short.\n" + ("And again it goes on for a while here. " * 6).strip()),
    ("<main><h2>Prices</h2><div class='share-price'>The share stands at 12.</div><section class='comments-policy-essay'><p>We thought about comments.</p></section><ul class=related><li><a href=1>One</a><li><a href=2>Two</a></ul></main>", "Prices\nThe share stands at 12.\nWe thought about comments."),
    ("<form id=aspnet><div class=main><p>A page that lies in a form as a whole, as some do.</p><p>It is still text.</p></div><input type=submit></form>", "A page that lies in a form as a whole, as some do.\nIt is still text."),
    ("<article><p>See <a href=x>the guide</a>.</p><p>Then <a href=y\">the other guide of it</a></p><p class=\"x>Hello there</p></article>", "See the guide.\nThen the other guide of it\nHello there"),
    ("<ul><li><a href=a>Start</a><li><a href=b>Contact us</a></ul><h1>Title of it</h1><p>" + "Words of the text are here in a row. " * 5 + "</p><ul><li><a href=c>More of this</a><li><a href=d>And that</a></ul>", "Title of it\n" + ("Words of the text are here in a row. " * 5).strip()),
    ("<p>1 < 2 &amp; 3 > 2<p title='a > b'>&eacute;t&#233; &lt;p&gt;<script>x<p>y</script><p hidden>no</p><style>p{}</style><p>end</p>", "1 < 2 & 3 > 2\nété <p>\nend"),
)


def test_pages_marked_by_hand():
    assert [html_text.main_text(p) for p, _ in PAGES] == [t for _, t in PAGES]


def test_tree_by_brute_force():
    """The fitted tree agrees with its table, splits on neighbours, and no single split of the root does better."""
    used, todo = set(), [html_text.default_tree()]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            used.add(html_text.FEATURES[node[0]])
            todo += node[2:]
    assert {"link_density", "before_density", "after_density"} <= used and all(html_text.is_main(html_text.default_tree(), list(r[:-1])) == bool(r[-1]) for r in html_text.LABELLED)
    cost = lambda rows: len(rows) * (s := sum(r[-1] for r in rows) / max(1, len(rows))) * (1 - s)
    best = min(cost([r for r in html_text.LABELLED if r[f] <= t[f]]) + cost([r for r in html_text.LABELLED if r[f] > t[f]]) for f in range(len(html_text.FEATURES)) for t in html_text.LABELLED)
    f, t = html_text.default_tree()[:2]
    assert cost([r for r in html_text.LABELLED if r[f] <= t]) + cost([r for r in html_text.LABELLED if r[f] > t]) == pytest.approx(best)


@pytest.mark.parametrize("part", ["<p ", "<div><b>x", '<a href="', "<nav class='ad'><i>", "<li><i>", "<!-- ", "</p", "&amp", "<script>"])
def test_time_of_long_pages(part):
    began = time.time()
    html_text.main_text(part * 20_000)
    assert time.time() - began < 5


def test_toxicity_scores_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aa bb cc dd ee bad worse".split()) for _ in range(rng.randrange(0, 40))) for _ in range(80)] + ["", None, "x" * 40 + " " + "é" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("bad" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, toxic int")
    weights = toxicity.learn(labels, docs=docs)
    table = dict(zip(weights.buckets.tolist(), weights.values.tolist(), strict=True))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, weights).collect()}
    for i, t in enumerate(texts):
        w = toxicity.Words(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
        total = weights.bias + sum(table.get(int(b), 0.0) for b in set(toxicity.features(w)[1].tolist()))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)
    rows = toxicity.learning_rows(labels, docs=docs)
    assert len(rows) == len(texts) and rows[0][0] in (0, 1) and len(toxicity.learning_rows(labels.union(labels), docs=docs.union(docs))) == len(texts)


def test_attention_by_brute_force():
    """Weights and score of a bag, passage by passage."""
    m, g = quality_mil.Model(3), np.random.default_rng(1)
    doc, x = np.array([0, 0, 0, 1, 2, 2]), g.normal(size=(6, quality_mil.N_FEATURES))
    f = m.forward(doc, x)
    for k in range(3):
        h = [np.tanh(r @ m.p["W"] + m.p["b"]) for r in x[doc == k]]
        e = np.exp([(np.tanh(v @ m.p["V"]) / (1 + np.exp(-v @ m.p["G"]))) @ m.p["a"] for v in h])
        z = sum(a / e.sum() * v for a, v in zip(e, h, strict=True))
        assert f["y"][k] == pytest.approx(1 / (1 + np.exp(-(z @ m.p["c"] + m.p["d"][0]))))


def test_url_features_and_trees_by_brute_force(spark):
    urls = ["http://a1.b-c.example.org/x/y.html?q=1&r=2#t", "https://H.com", "no scheme", "", "http://1.2.3.4/%7e_a;b/c?z"]
    forest = url_filter.train(spark.createDataFrame(url_filter.seed_urls(), "url string, label int"))
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    host, path = url_filter.parts(F.col("u"))
    rows = df.select("u", host.alias("_host"), path.alias("_path"), *(c.alias(k) for k, c in url_filter.features(F.col("u"), host, path, forest.suffixes).items())).collect()
    for r in rows:
        u, h, p = r["u"], r["_host"], r["_path"]
        want = {"length": len(u), "host_length": len(h), "depth": p.count("/"), "host_digits": sum(c.isdigit() for c in h), "hyphens": h.count("-"), "labels": h.count("."), "odd_chars": sum(c in "%_~@!$*,;" for c in u)}
        want["digit_ratio"] = sum(c.isdigit() for c in u) / max(1, len(u))
        want["entropy"] = sum(-u.count(c) / len(u) * np.log2(u.count(c) / len(u)) for c in set(u))
        assert {k: pytest.approx(v) for k, v in want.items()} == {k: r[k] for k in want}
    got = {r["page_id"]: r["score"] for r in url_filter.judged(df.select(F.col("u").alias("page_id"), F.col("u").alias("url")), forest, rules=()).collect()}
    for r in rows:
        total = forest.start
        for tree in forest.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if r[url_filter.FEATURES[tree[0]]] <= tree[1] else tree[3]
            total += tree
        assert got[r["u"]] == pytest.approx(1 / (1 + np.exp(-total)))


def test_licenses_of_null_and_repeated_keys(spark):
    mit, gpl = "Released under the MIT License.", "Released under the GNU General Public License."
    got = licenses.scan(spark.createDataFrame([(None, mit), (None, gpl), (None, "x"), (1, mit), (1, gpl), (1, gpl)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in got) == [(0, ""), (0, "gpl"), (0, "mit"), (1, "gpl"), (1, "gpl"), (1, "mit")]


ODD = "doc_id long, text string, lang string, source string, n_chars long, _copies int, _k string, y int, label string, bucket long, score double, t string, s string, r string, id long"


@pytest.fixture(scope="module")
def odd(spark):
    """Clashing names, nulls everywhere, repeated rows, and a long text."""
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    rows = [(None, None), (None, "a b"), (1, ""), (1, ""), (2, "one two three four five six"), (2, "one two three four five six"), (3, "another text"), (3, None), (4, long), (5, long)]
    return spark.createDataFrame([(k, t, None, None, None, 7, "k", 1, "l", 2, 0.5, "t", "s", "r", 9) for k, t in rows], ODD)


def test_odd_tables(spark, odd):
    empty = spark.createDataFrame([], ODD)
    weights, model = toxicity.Weights(bias=-5.0), quality_mil.Model()
    per_row = {
        "rules": lambda d: quality_rules.apply_rules(d), "packing": lambda d: packing.packed(d).where("piece = 0"), "licenses": lambda d: licenses.scan(d), "quality": lambda d: quality_mil.scored(d, model),
        "near": lambda d: minhash.near_duplicates(d), "exact": lambda d: exact_dedup.exact_groups(d), "toxicity": lambda d: toxicity.scored(d, weights), "mixing": lambda d: mixing.mixed(d),
    }
    for name, run in per_row.items():
        assert (run(odd).count(), run(empty).count()) == (10, 0), name
    near = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(odd.where("doc_id is not null")).collect())
    assert near == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3, 3), (4, 4), (5, 4)]
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("source").alias("url"), "text", "n_chars", "score")
    forest = url_filter.Forest(0.0, [], {"": 0.5})
    for run in (lambda d: html_text.extracted(d), lambda d: url_filter.judged(d, forest)):
        assert (run(pages).count(), run(pages.limit(0)).count()) == (10, 0)


def test_odd_tables_through_the_stages(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0), (4, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    counts = {"toxicity": 10, "exact_dedup": 5, "minhash_near_dedup": 5}
    for table in (odd, odd.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = common.staged(stage(spark, docs, str(tmp_path)))
            assert docs.columns == odd.columns
            assert name not in counts or docs.count() == counts[name] * (table is odd), name
        assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).where("piece = 0").count() == docs.count()


def test_exact_groups_over_the_broadcast_bound(spark, monkeypatch):
    """Large groups come by broadcast, the others by shuffle; both at once."""
    rows = [(i, "copy") for i in range(1500)] + [(2000 + i, f"t{i % 300}") for i in range(600)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("keep_id").agg(F.count("*").alias("n"), F.max("group_size").alias("g")).collect()
    assert {r["keep_id"]: (r["n"], r["g"]) for r in got} == {1499: (1500, 1500), **{2300 + i: (2, 2) for i in range(300)}}


def test_registered_queries_hold_out(spark, tmp_path):
    """The split and the threshold of op4 and op9, through the registered queries."""
    from zlib import crc32

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ba ce di fo gu".split()) for _ in range(40)) + (" nastyword" * 3 if i % 5 == 0 else ""), "en", "a", 1) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query, mod, held in ((queries.op4_quality_classifier, 5, 0), (queries.op9_toxicity, 4, 2)):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 200 and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % mod == held) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got)
