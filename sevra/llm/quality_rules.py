"""Operator 1: quality rules. A threshold table compiled into one projection; no user functions, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he from are this or an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et en un une du que qui dans est pour pas au par sur avec "
    "el los las y del se por con no para su al lo como más es una"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails when metric is below low or above high; None: no bound."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are of words (symbols, stop words), of lines (repeated lines) or of letters (capitals).
RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("word_length", "mean_word_length", low=1.5, high=15),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("capitals", "capital_ratio", high=0.5),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("repeated_words", "repeat_word_ratio", high=0.3),
)


def _repeat_words(ws: Column, span: int) -> Column:
    """Words that lie in windows of span words found twice or more.

    Equal windows have equal hashes, so a text without equal hashes has none;
    in the others, windows are sorted as strings and neighbours compared.
    """

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (span - 1)), lambda i: F.struct(F.array_join(F.slice(w, i, span), " ").alias("w"), i.alias("i")))

        def covered(s: Column) -> Column:
            n = F.size(s)
            same = lambda i, j: s[i]["w"] == s[j]["w"]
            at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < n - 1) & same(F.least(i + 1, n - 1), i)))
            places = F.array_sort(F.transform(at, lambda i: s[i]["i"]))
            return let(places, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.lit(span) + F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), F.lit(0), lambda t, k: t + F.when(k < F.size(p), F.least(F.lit(span), F.get(p, k) - F.get(p, k - 1))).otherwise(0))))

        return let(F.array_sort(windows), covered)

    def screened(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (span - 1)), lambda i: F.xxhash64(F.slice(w, i, span)))
        return F.when(F.size(w) <= span, F.lit(0)).otherwise(F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)), exact(w)).otherwise(0))

    return screened(ws)


def measures(text: Column, span: int = 8) -> Column:
    """A struct of the counts that rules and digests use; null text counts as empty, without words."""
    t = F.coalesce(text, F.lit(""))
    stops = sorted(set(STOP_WORDS))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop"),
            _repeat_words(w, span).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        let(words(t), counts).alias("w"),
        line_counts.alias("l"),
        F.length(F.regexp_replace(t, "[ \\t-\\r]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, "\\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(t, "\\P{L}+", "")).cast("long").alias("n_letters"),
    )


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add quality_measures (struct), quality_failed (names of failed rules) and quality_kept.

    Null and empty texts have no words and fail few_words; a ratio without a
    denominator is 0, and 1 for stop words, so that it fails nothing by itself.
    Other columns pass through; these three replace namesakes.
    """
    m = F.col("quality_measures")
    flat = {"n_words": m["w"]["n_words"], "n_dup_lines": m["l"]["n_dup_lines"]}
    per = lambda a, b, none=0.0: F.when(b > 0, a / b).otherwise(F.lit(none))
    flat |= {
        "mean_word_length": per(m["word_chars"], flat["n_words"], 5.0),
        "symbol_ratio": per(m["n_symbols"], flat["n_words"]),
        "capital_ratio": per(m["n_capitals"], m["n_letters"]),
        "stop_word_ratio": per(m["w"]["n_stop"], flat["n_words"], 1.0),
        "dup_line_ratio": per(flat["n_dup_lines"], m["l"]["n_lines"]),
        "repeat_word_ratio": per(m["w"]["n_repeat_words"], flat["n_words"]),
    }
    bad = []
    for r in rules:
        v, fails = flat[r.metric], F.lit(False)
        if r.low is not None:
            fails = fails | (v < r.low)
        if r.high is not None:
            fails = fails | (v > r.high)
        bad.append(F.when(fails, F.lit(r.name)))
    out = df.withColumn("quality_measures", measures(F.col(text)))
    out = out.withColumn("quality_failed", F.array_compact(F.array(*bad)))
    return out.withColumn("quality_kept", F.size("quality_failed") == 0)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op1."""
    m = F.col("quality_measures")
    out = apply_rules(docs.select("doc_id", "text")).select(
        "doc_id", m["w"]["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"), "quality_kept",
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).withColumn("kept", F.col("quality_kept") & ~F.col("base_failed")).drop("quality_kept")
