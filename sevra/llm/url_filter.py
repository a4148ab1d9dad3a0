"""Operator 8: URL filters. Host rules first, then gradient-boosted trees on lexical features.

The trees are trained on a table of labelled URLs and compiled into one
Column expression, so judging URLs is a projection without a shuffle and
without Python on the executors.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: (host and path prefix, verdict): a rule fits its host and all subdomains, the longest that fits wins (fixed values).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Most labelled URLs that are learnt from.
MAX_LABELLED = 20_000
FEATURES = ("length", "host_length", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "query_length", "labels", "odd_chars", "suffix_rate")
#: Host words of the labelled table: of ordinary sites, and of unwanted ones.
ORDINARY = ("harbor", "lantern", "meadow", "orchid", "quarry", "saddle", "timber", "velvet", "willow", "copper", "falcon", "granite", "juniper", "kettle", "marble", "nectar", "pepper", "ribbon", "summit", "tulip")
UNWANTED = ("bargain", "jackpot", "diet", "instant", "lucky", "miracle", "offer", "prize", "rebate", "slots", "super", "tablet", "top", "ultra", "voucher", "wager", "cash", "hot", "singles", "crack")


def seed_urls(ordinary: tuple[str, ...] = ORDINARY, unwanted: tuple[str, ...] = UNWANTED, n: int = 900, seed: int = 11) -> list[tuple[str, int]]:
    """A labelled table made from rules: n ordinary addresses (0) and n unwanted ones (1).

    The kinds of hosts, paths and queries overlap, so that no single feature
    tells them apart: ordinary hosts have hyphens and digits at times,
    unwanted ones plain names, and one address in four of either has a path
    and query of the common kind.
    """
    g = random.Random(seed)
    pick, noise = g.choice, lambda k: "".join(g.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(k))

    def common() -> str:
        return pick(("/{}", "/{}/", "/{}.html", "/en/{}", "/de/{}#top", "/fr/{}?page=2&ref=x", "/es/{}?utm_source=feed", "/about", "/")).format(g.randrange(1, 9999))

    def good() -> str:
        word, other = pick(ordinary), pick(ordinary)
        host = pick(("", "", "www.", "m.", "blog.", "shop.")) + pick((word,) * 6 + (word + other,) * 2 + (f"{word}-{other}", f"{word}{g.randrange(10, 99)}"))
        slug = "-".join(pick(ordinary) for _ in range(g.randrange(1, 7)))
        tail = pick((common(), f"/{slug}", f"/20{g.randrange(10, 26)}/{g.randrange(1, 13):02}/{slug}.html", f"/search?q={word}+{other}&lang=en&page={g.randrange(9)}", f"/{word}/{other}/{slug}/{g.randrange(99999)}", f"/item?id={g.randrange(10**6)}&size=3&color=red&sort=up"))
        return f"{pick(('https', 'https', 'https', 'http'))}://{host}.{pick(('example.com', 'example.org', 'example.net', 'example.de', 'example.fr', 'example.info'))}{tail}"

    def bad() -> str:
        words = [pick(unwanted) for _ in range(3)]
        host = pick(("", "", "www.", "m.", "blog.", "x1.", "go.")) + pick(("-".join(words), "-".join(words[:2]), "-".join(words[:2]), "-".join(words[:2]), "-".join((words[0], pick(ordinary))), f"{words[0]}-{words[1]}{g.randrange(1, 99)}", words[0] + words[1], noise(g.randrange(8, 16)), f"{words[0]}{g.randrange(100, 9999)}"))
        many = "&".join(f"{noise(2)}={noise(g.randrange(1, 12))}" for _ in range(g.randrange(2, 9)))
        tail = pick((common(), common(), f"/{noise(g.randrange(6, 20))}?{many}", f"/{words[2]}?{many}", "/" + "/".join(noise(3) for _ in range(g.randrange(3, 8))), f"/{words[0]}%20{words[1]}!!{noise(6)}"))
        return f"{pick(('https', 'http'))}://{host}.{pick(('example.com', 'example.org', 'example.net', 'example.info', 'example.top', 'example.xyz'))}{tail}"

    return [(good(), 0) for _ in range(n)] + [(bad(), 1) for _ in range(n)]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ://."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(rest) + 4)
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.when(has, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(none), F.when(has, path).otherwise(none)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null; of equal lengths the first."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def features(url: Column, host: Column, path: Column, suffixes: dict[str, float]) -> dict[str, Column]:
    """Lexical features by name; suffixes: rate of unwanted pages by last host label, "" for others."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    suffix = F.regexp_extract(host, "([^.]*)$", 1)
    rate = F.lit(float(suffixes.get("", 0.5)))
    for k, v in sorted(suffixes.items()):
        if k:
            rate = F.when(suffix == k, F.lit(float(v))).otherwise(rate)
    # Of every distinct character its share p; entropy is the sum of -p log2 p.
    entropy = let(u, lambda t: F.aggregate(F.array_distinct(F.array_remove(F.split(t, ""), "")), F.lit(0.0), lambda s, c: s - let((F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(t), lambda p: p * F.log2(p))))
    return {
        "length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "depth": _count(path, "/"),
        "digit_ratio": _count(u, "[0-9]") / n, "host_digits": _count(host, "[0-9]"), "hyphens": _count(host, "-"), "entropy": entropy,
        "parameters": F.when(query == "", F.lit(0.0)).otherwise(_count(query, "&") + 1), "query_length": F.length(query).cast("double"), "labels": _count(host, "\\."),
        "odd_chars": _count(u, "[%_~@!$*,;]"), "suffix_rate": rate,
    }


@dataclass
class Forest:
    """Start value, trees as (feature, threshold, left, right) or leaf values, and the suffix table."""

    start: float
    trees: list
    suffixes: dict[str, float]

    def expression(self, columns: dict[str, Column]) -> Column:
        """The log-odds of an unwanted page as one Column."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(columns[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        out = F.lit(float(self.start))
        for t in self.trees:
            out = out + of(t)
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 3) -> tuple[float, list]:
    """Second-order boosting of the logistic loss with exact splits."""
    if not len(y):
        return 0.0, []
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start, f, trees = math.log(share / (1 - share)), np.full(len(y), math.log(share / (1 - share))), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        best = None
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        if left and len(rows) >= 2 * least:
            for k in range(x.shape[1]):
                order = rows[np.argsort(x[rows, k], kind="stable")]
                v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
                gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - total
                ok = np.zeros(len(v), bool)
                ok[least - 1 : len(v) - least] = True
                ok[:-1] &= v[1:] > v[:-1]
                ok[-1] = False
                if ok.any():
                    i = int(np.argmax(np.where(ok, gain, -1)))
                    if gain[i] > 1e-6 and (best is None or gain[i] > best[0] + 1e-12):
                        best = (gain[i], k, float((v[i] + v[i + 1]) / 2), order[: i + 1], order[i + 1 :])
        if best is None:
            return float(-rate * g[rows].sum() / (h[rows].sum() + 1))
        return (best[1], best[2], grow(best[3], g, h, left - 1), grow(best[4], g, h, left - 1))

    def value(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        trees.append(tree)
        f = f + np.array([value(tree, r) for r in x])
    return start, trees


def train(labelled: DataFrame, url: str = "url", label: str = "label") -> Forest:
    """Trees from at most MAX_LABELLED labelled URLs (1: unwanted), those with the smallest hash; rows without URL or label are passed over."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("u"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("u"), "u", "y").limit(MAX_LABELLED)
    host, path = parts(F.col("u"))
    got = rows.select("y", F.regexp_extract(host, "([^.]*)$", 1).alias("suffix"), *(c.alias(k) for k, c in features(F.col("u"), host, path, {}).items())).toPandas()
    mean = got["y"].mean() if len(got) else 0.5
    suffixes = {"": float(mean)} | {s: float((y.sum() + 4 * mean) / (len(y) + 4)) for s, y in got.groupby("suffix")["y"] if s}
    got["suffix_rate"] = got["suffix"].map(suffixes).fillna(mean)
    return Forest(*boost(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float)), suffixes)


def judged(df: DataFrame, forest: Forest, key: str = "page_id", url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per row of df: key, host, path, rule, score (of an unwanted page, 0 to 1), verdict (allow or block).

    A rule's verdict goes before the score's. Null, empty and relative URLs
    have an empty host and path, fit no rule, and are judged by the trees.
    Repeated rows and keys give a row each; an empty table gives none. Other
    columns are not read.
    """
    rows = df.select(F.col(key), F.col(url).alias("_u"))
    host, path = parts(F.col("_u"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumns({f"_{k}": c for k, c in features(F.col("_u"), F.col("host"), F.col("path"), forest.suffixes).items()})
    score = 1 / (1 + F.exp(-forest.expression({k: F.col(f"_{k}") for k in FEATURES})))
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule, v in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    return rows.withColumn("score", score).select(key, "host", "path", "rule", verdict.alias("verdict"), "score")
