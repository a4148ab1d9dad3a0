"""Whether a text says what a piece of evidence says, word by word in the same order but not verbatim.

Words that carry content, cut to STEM letters, are aligned: the score is the
longest common subsequence of the evidence and one sentence, worked out by a
fold over the sentence's words. Evidence is supported from SHARE percent of
its words on, so of one or two words all must be there, of three two, of
five three.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import PLURAL

STEM, SHARE = 5, 60
#: Words without content, fixed values.
EMPTY_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")
WORD, SENTENCE = "[a-z0-9]+(?:[.][0-9]+)?", r"[.;!?]+(?:\s+|$)|\n+"


def let(value: Column, body) -> Column:
    """Evaluate value once per row and bind it in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def content(text: Column) -> Column:
    """The stems of the words of a text that carry content, in order; none for null."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PLURAL, "$1"), F.lit(WORD), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(*EMPTY_WORDS)), lambda w: F.left(w, F.lit(STEM)))


def common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""

    def row(before: Column, word: Column) -> Column:
        at = lambda x, j: F.element_at(x, j)
        cell = lambda now, j: F.when(at(a, j) == word, at(before, j) + 1).otherwise(F.greatest(at(before, j + 1), at(now, j)))
        return F.aggregate(F.sequence(F.lit(1), F.size(a)), F.array(F.lit(0)), lambda now, j: F.concat(now, F.array(cell(now, j))))

    return F.when(F.size(a) > 0, F.element_at(F.aggregate(b, F.array_repeat(F.lit(0), F.size(a) + 1), row), -1)).otherwise(0)


def supported(evidence: Column, text: Column, share: int = SHARE) -> Column:
    """Whether text holds the evidence, verbatim (in any case) or aligned within one sentence. Null evidence isn't supported, empty evidence is; a null text supports only that."""
    evidence, text = F.lower(evidence), F.lower(F.coalesce(text, F.lit("")))

    def aligned(e: Column) -> Column:
        enough = lambda s: 100 * common(e, content(s)) >= share * F.size(e)
        return (F.size(e) > 0) & F.exists(F.split(text, SENTENCE), enough)

    return F.coalesce(F.when(F.contains(text, evidence), True).otherwise(evidence.isNotNull() & let(content(evidence), aligned)), F.lit(False))
