"""Operator 11: what filters remove alone, after each other, and in every order.

Each text's failures are a bit mask, one bit per filter. The filter for copies
needs the other texts: rows are routed by the xxhash of their text through an
RDD's partitioner and sorted by it, so a task sees the rows of a fingerprint
one after another. They are stored as a collision chain, the full text and the
smallest id of each text; whatever is not smallest leaves as a copy. Before
that, each task keeps the smallest id of every text it meets, so a text that
fills a third of the table is routed once per task and block of texts. Masks
are counted by part with combineByKey into one vector, from which all orders
are worked out: the counts of a mask say what every order would do with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task holds while it looks for copies among its own rows, and that a routed partition gets, about.
HELD, ROUTED = 64 << 20, 64 << 20
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
#: Bytes that continue a code point.
_INNER = bytes(range(128, 192))


class Measures:
    """What the filters ask of a text in UTF-8; words are maximal runs of [^\\x20\\x09-\\x0D], in any case."""

    __slots__ = ("capitals", "distinct", "n_points", "n_words", "symbols")

    def __init__(self, raw: bytes):
        words = raw.split()
        self.n_words, self.distinct = len(words), len(set(words))
        self.n_points = len(raw.translate(None, _INNER))
        self.capitals = len(raw) - len(raw.translate(None, _CAPITALS))
        self.symbols = len(raw) - len(raw.translate(None, _SYMBOLS))


#: Letter of each filter and when a text fails it.
FILTERS: tuple[tuple[str, Callable[[Measures], bool]], ...] = (
    ("A", lambda m: m.n_words < 200), ("B", lambda m: 100 * m.distinct < 50 * m.n_words), ("C", lambda m: 100 * m.capitals > 3 * m.n_points), ("D", lambda m: m.symbols > 0),
)
#: Letter of the filter that rejects what has the text of a smaller id.
COPIES = "E"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _mask(raw: bytes, filters) -> int:
    m = Measures(raw)
    return sum(1 << i for i, (_, fails) in enumerate(filters) if fails(m))


def _screened(rows: Iterator, filters, held: int) -> Iterator[tuple[int, tuple]]:
    """(route, (text, id, parts, mask)) of rows (id, part, text).

    Of equal texts in the task only those with the smallest id go by the text's
    fingerprint, with the text and how many rows each part has of it. All
    others are decided here: they carry no text and are dealt out evenly.
    """
    copy, seen, size, n = 1 << len(filters), {}, 0, 0

    def decided(key, part: str, count: int, mask: int):
        nonlocal n
        n += 1
        return n * 0x9E3779B97F4A7C15 % (1 << 62), (None, key, {part: count}, mask)

    for key, part, text in rows:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if key is None:
            yield decided(key, part, 1, _mask(raw, filters))
            continue
        known = seen.get(raw)
        if known is None:
            if size > held:
                for t, (k, parts, mask) in seen.items():
                    yield xxhash.xxh64_intdigest(t) >> 2, (t, k, parts, mask)
                seen, size = {}, 0
            seen[raw] = (key, {part: 1}, _mask(raw, filters))
            size += len(raw) + 200
        elif key > known[0]:
            yield decided(key, part, 1, known[2] | copy)
        elif key == known[0]:
            known[1][part] = known[1].get(part, 0) + 1
        else:
            for p, count in known[1].items():
                yield decided(known[0], p, count, known[2] | copy)
            seen[raw] = (key, {part: 1}, known[2])
    for t, (k, parts, mask) in seen.items():
        yield xxhash.xxh64_intdigest(t) >> 2, (t, k, parts, mask)


def _chained(rows: Iterator[tuple[int, tuple]], copy: int) -> Iterator[tuple]:
    """(id, part, rows, mask) of routed rows in order of their fingerprint; a chain holds the texts of one fingerprint."""
    chain, at = {}, None

    def ended():
        for key, parts, mask in chain.values():
            for p, count in parts.items():
                yield key, p, count, mask

    for route, (text, key, parts, mask) in rows:
        if text is None:
            for p, count in parts.items():
                yield key, p, count, mask
            continue
        if route != at:
            yield from ended()
            chain, at = {}, route
        known = chain.get(text)
        if known is None:
            chain[text] = (key, parts, mask)
        elif key == known[0]:
            for p, count in parts.items():
                known[1][p] = known[1].get(p, 0) + count
        else:
            small, large = sorted((known, (key, parts, mask)), key=lambda x: x[0])
            for p, count in large[1].items():
                yield large[0], p, count, mask | copy
            chain[text] = small
    yield from ended()


def masks(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", filters=FILTERS, held: int = HELD) -> DataFrame:
    """(id, part, n, mask): rows of df by id, part and mask of failed filters; the bit after those of filters marks copies of a smaller id's text.

    Null text and part count as empty. A null id is no copy of anything, and
    nothing is a copy of it. Rows that share id and text are no copies of each
    other. Columns besides the three are not read. An empty table gives none.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")), F.col(f"`{text}`")).rdd
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROUTED)
    routed = rows.mapPartitions(lambda it: _screened(it, filters, held)).repartitionAndSortWithinPartitions(parts, lambda k: k)
    found = routed.mapPartitions(lambda it: _chained(it, 1 << len(filters)))
    return spark.createDataFrame(found, f"id {df.schema[key].dataType.simpleString()}, part string, n long, mask int", verifySchema=False)


def _add(vector: list[int], row) -> list[int]:
    _, n, mask, good, toxic = row
    for at, count in ((0, n), (1, n * good), (2, n * toxic)):
        vector[3 * mask + at] += count
    return vector


def report(part: str, vector: list[int], letters: str) -> Iterator[tuple]:
    """The rows of a part, all orders of all filters, from its counts (rows, good, toxic) by mask."""
    bits = {f: 1 << i for i, f in enumerate(letters)}
    every = range(1 << len(letters))

    def total(which: int, fails: int, passes: int) -> int:
        """Rows that fail one of fails (0: any row) and none of passes."""
        return sum(vector[3 * m + which] for m in every if (not fails or m & fails) and not m & passes)

    at = {(f, before): [total(k, bits[f], before) for k in (0, 1, 2)] for f in letters for before in every if not before & bits[f]}
    orders, shapley = list(permutations(letters)), dict.fromkeys(letters, 0)
    for order in orders:
        before = 0
        for f in order:
            shapley[f] += at[f, before][0]
            before |= bits[f]
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            removed, good, toxic = at[f, before]
            yield part, "".join(order), step, total(0, 0, before | bits[f]), removed, at[f, 0][0] - removed, vector[3 * bits[f]], good, toxic, shapley[f]
            before |= bits[f]


def audited(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", filters=FILTERS, held: int = HELD) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter does there (see SCHEMA).

    labels: key, quality, toxic; a row of df is good or toxic if any of its
    labels says 1, and neither without a label. Nulls, empty texts, repeated
    rows as in masks(). Repeated labels count once, labels of a null key not
    at all. A part that no row has gives no rows, so an empty table none.
    With n filters, copies included, a part has n! * n rows: keep n small.
    """
    letters = "".join(f for f, _ in filters) + COPIES
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marked = labels.where(f"`{key}` is not null").groupBy(F.col(f"`{key}`").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = masks(df, key, text, part, filters, held)
    # Rows without an id find no label; the salt keeps them from meeting in one task.
    salt = F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(0)
    rows = rows.withColumn("salt", salt).join(marked.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").na.fill(0, ["good", "toxic"]).select("part", "n", "mask", "good", "toxic")
    width = 3 << len(letters)
    vectors = rows.rdd.map(lambda r: (r[0], r)).combineByKey(lambda r: _add([0] * width, r), _add, lambda a, b: [x + y for x, y in zip(a, b, strict=True)], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.sparkSession.createDataFrame(vectors.flatMap(lambda pv: report(pv[0], pv[1], letters)), SCHEMA, verifySchema=False)
