"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, html_text, licenses, minhash, mixing, packing, quality_mil, quality_rules, resampling, token_counts, toxicity, url_filter
from .common import crc_mod, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the production rules for every document."""
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt outside of the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_mil.learn(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return _judged(quality_mil.scored(docs, model), 5, 0)


def _judged(scores: DataFrame, mod: int, held: int) -> DataFrame:
    return scores.select("doc_id", (crc_mod(F.col("doc_id"), mod) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies: 3-word shingles, similarity 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or trees' verdict on every page's URL. The trees are trained on url_filter.seed_urls(), made by rules, as no table holds labelled URLs: what their verdicts are worth on real URLs is not known."""
    forest = url_filter.train(spark.createDataFrame(url_filter.seed_urls(), "url string, label int"))
    return url_filter.judged(table(spark, sf_dir, "pages"), forest)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt outside of the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.learn(labels.where(crc_mod(F.col("doc_id"), 4) != 2), docs=docs)
    return _judged(toxicity.scored(docs, weights), 4, 2)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over every document, in all orders, by lang. Nulls, empty texts and repeats as in filter_audit.audited."""
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. The cache is a new one, so that each call counts all distinct texts; nulls and repeats as in token_counts.counted."""
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words. Nulls, ties and repeats as in resampling.resampled."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_license_scan that SQL can express."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_url_filter that SQL can express: host, path, rule, and the verdict where there is one."""
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_mixing that SQL can express, and whether a document keeps to the cap."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", (F.col("taken") <= 3 * F.col("size")).alias("capped"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {f.__name__: f for f in (license_base, url_rules, mix_sizes)}


def _license_sql() -> str:
    at = {p: f"list_filter(range(len(w) - {len(p.split()) - 1}), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{t}'" for k, t in enumerate(p.split())) + ")" for p in licenses.PHRASES}
    labels = ", ".join(f"CASE WHEN len({a}) > 0 THEN '{licenses.PHRASES[p]}' END" for p, a in at.items())
    every = " || ".join(at.values())
    return rf"""
        SELECT doc_id, len(w) AS n_words, len({every}) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word,
            array_to_string(list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))), ',') AS base_labels
        FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)"""


def _url_sql() -> str:
    fits = {r: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')" for r, _ in url_filter.RULES for h, p in [r.split("/", 1)]}
    longest = sorted(url_filter.RULES, key=lambda x: -len(x[0]))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits[r]} THEN '{what(r, v)}'" for r, v in longest) + " END"
    return f"""
        SELECT page_id, host, path, {case(lambda r, v: r)} AS rule, {case(lambda r, v: v)} AS rule_verdict FROM (
            SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM (
                SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)))"""


def _quality_sql() -> str:
    """The counts and the rule table of op1 as SQL."""
    metrics = {"n_words": "n_words", "mean_word_length": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 5.0 END", "symbol_ratio": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END"}
    metrics |= {"capital_ratio": "CASE WHEN n_letters > 0 THEN n_capitals / n_letters ELSE 0.0 END", "stop_word_ratio": "CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 1.0 END"}
    metrics |= {"dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END", "repeat_word_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END"}
    fails = [f"({metrics[r.metric]}) {op} {x}" for r in quality_rules.RULES for op, x in (("<", r.low), (">", r.high)) if x is not None]
    stops = ", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))
    return rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
        l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
        p AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS span FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
        q AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, span) > 1),
        c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM q) GROUP BY r),
        m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
            coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters,
            len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop FROM d JOIN l USING (r) LEFT JOIN c USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {" OR ".join(fails)}) AS kept FROM m"""


def _audit_sql() -> str:
    """op11 by windows and lists: each order is a list of bits, each step looks at the masks that its earlier filters leave."""
    bit = "CASE substr(o, {i}, 1) WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END"
    join = " AND ".join(f"{y} NOT IN ({', '.join('abcde'[:i])})" for i, y in enumerate("abcde") if i)
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
        g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::int
            + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::int AS mask FROM d),
        m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT concat(a, b, c, d, e) AS o FROM {", ".join(f"(SELECT x AS {y} FROM l)" for y in "abcde")} WHERE {join}),
        s AS (SELECT o, step, {bit.format(i="step")} AS bit, list_sum(list_transform(range(1, step), lambda i: {bit.format(i="i")}))::bigint AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
        r AS (SELECT part, o, step, bit, coalesce(before, 0)::int AS before FROM s, (SELECT DISTINCT part FROM m)),
        c AS (SELECT r.part, o, step, bit, coalesce(sum(n) FILTER (mask & (before | bit::int) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit::int > 0 AND mask & before = 0), 0) AS removed,
            coalesce(sum(n) FILTER (mask & bit::int > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & bit::int > 0 AND mask & before = 0), 0) AS good_lost,
            coalesce(sum(toxic) FILTER (mask & bit::int > 0 AND mask & before = 0), 0) AS toxic_lost FROM r JOIN m USING (part) GROUP BY ALL)
        SELECT part, o AS filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost,
            toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM c"""


def _resampling_sql() -> str:
    """op13 with crc32 spelt out, as the checking engine has none, over distinct words."""
    words = lambda t: rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {t}"
    return rf"""
        WITH RECURSIVE k(i, n, c) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM k WHERE n < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM k WHERE n = 8),
        d AS (SELECT doc_id, row_number() OVER () AS r, {words("documents")}),
        fd AS (SELECT r, unnest(w) AS f FROM d), fb AS (SELECT unnest(w) AS f FROM (SELECT {words("benchmark")})),
        v AS (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb)),
        b AS (SELECT f, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
            lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) % 10000 AS b FROM (SELECT f, hex(encode(f)) AS h FROM v), tab),
        s AS (SELECT b, count(*) AS s FROM fd JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM fb JOIN b USING (f) GROUP BY b),
        n AS (SELECT (SELECT count(*) FROM fd) AS s_all, (SELECT count(*) FROM fb) AS t_all),
        g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint AS gain FROM s LEFT JOIN t USING (b), n),
        w AS (SELECT r, floor(sum(gain)::double / count(*))::bigint AS weight FROM fd JOIN b USING (f) JOIN g USING (b) GROUP BY r),
        x AS (SELECT doc_id, len(w)::bigint AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::bigint AS h FROM d LEFT JOIN w USING (r)),
        y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM x),
        z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id, weight, n_features) AS rank, 10 * count(*) OVER () // 100 AS most FROM y WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, rank FROM y LEFT JOIN (SELECT doc_id, rank FROM z WHERE rank <= most) USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_filter_audit": _audit_sql(),
        "op13_importance_resampling": _resampling_sql(),
        "op1_quality_rules": _quality_sql(),
        "op5_minhash_near_dedup": r"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) GROUP BY ALL),
            l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
            r(doc_id, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.doc_id),
            c AS (SELECT doc_id, min(label) AS component_id FROM r GROUP BY doc_id)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
        "license_base": _license_sql(),
        "url_rules": _url_sql(),
        "mix_sizes": r"""
            SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::bigint AS source_size, true AS capped
            FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS size FROM documents)""",
        "op7_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
