"""Operator 5: near duplicates by circulant MinHash, banding and exact Jaccard verification.

Words: [^\\x20\\x09-\\x0D]+ after lowering A-Z. Set of a text: its distinct
shingles as 64-bit hashes; a text with fewer words than a shingle has its
whole sequence as one; a text without words has an empty set and no links.

One permutation (sigma) scatters the shingles over 2^32 places, a second one
(pi), shifted circularly by k, gives coordinate k of the signature:
min over the set of pi(sigma(x) + k mod 2^32).

Rows with equal sets form a class and only its representative goes on. In
each band bucket, representatives are compared with a centre, never all with
all: first with the one whose buckets are largest, then, where a bucket still
spans several components, with the like of another component. What is still
apart goes through an exact prefix join: shingles are ordered by their
frequency, rarest first, and two sets can only be linked if they share one
among the first of both. Where rows of two components would meet often there,
each is held against the other's whole component first: how many of its
shingles occur there at all bounds what it can have in common with any member. So no link between candidates is
lost, nothing inside a component is repeated, and members of a large group that
have a few shingles of their own meet nobody.

Sets hold hashes of 64 bits, and links are confirmed on whole sets of these:
exact but for chance collisions (see textvec.Words.strong).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, components, join_groups, prefiltered_joins, release, small_batches
from .textvec import U, Words, mix, slices

#: Coordinates per band and bands. At similarity 0.85 a pair is missed with probability 4e-7, at 0.8 with 5e-5.
ROWS, BANDS = 5, 25
#: Turns with another centre, and pairs of one centre that meet under one key, about.
TURNS, PAIRS = 2, 2000
#: In the last turn, meetings of two components for each of their rows, beyond which rows are held against the other component first.
MEETINGS = 4
_SIGMA = 77


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, first): the sorted distinct shingles of each text one after another; first has n_docs + 1 indices."""
    lengths = np.diff(w.first)
    key = mix(w.strong(), 1)
    full = key.copy()
    for k in range(1, min(size, len(key))):
        full[: len(full) - k] = mix(full[: len(full) - k] * U(0x9E3779B97F4A7C15) + key[k:], k + 1)
    out, first = [], np.zeros(w.n_docs + 1, np.int64)
    for d in range(w.n_docs):
        n, a = int(lengths[d]), int(w.first[d])
        if n >= size:
            s = np.sort(full[a : a + n - size + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = key[a : a + 1].copy()
            for k in range(1, n):
                s = mix(s * U(0x9E3779B97F4A7C15) + key[a + k], k + 1)
            s = mix(s, 1000 + n)
        else:
            s = key[:0]
        out.append(s)
        first[d + 1] = first[d] + len(s)
    return (np.concatenate(out) if out else key[:0]), first


def _pi(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _lows(shingles: np.ndarray, starts: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """The first coordinates of the signatures of the sets that begin at starts."""
    place = (mix(shingles, _SIGMA) >> U(32)).astype(np.uint32)
    for k in range(count):
        yield np.minimum.reduceat(_pi(place + np.uint32(k)), starts).astype(U)


def band_keys(shingles: np.ndarray, first: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """(texts, bands) keys of the non-empty sets; a key holds its band's number."""
    out = np.empty((len(first) - 1, bands), np.int64)
    for k, low in enumerate(_lows(shingles, first[:-1], rows * bands)):
        b, r = divmod(k, rows)
        key = mix((key if r else np.full(len(low), b, U)) * U(0x9E3779B97F4A7C15) + low, r)
        out[:, b] = key.view(np.int64)
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in slices(batch.column(1)):
                s, first = shingle_sets(w, size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                sums, bands = np.zeros((2, len(n)), np.int64), np.zeros((len(n), BANDS), np.int64)
                if len(some):
                    starts = np.append(first[:-1][some], first[-1])
                    for k in (0, 1):
                        sums[k, some] = np.add.reduceat(mix(s, 500 + k), starts[:-1]).view(np.int64)
                    bands[some] = band_keys(s, starts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), lists], ["id", "n", "d1", "d2", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in slices(batch.column(1)):
                s, first = shingle_sets(w, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(s.view(np.int64)))], ["id", "shingles"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            one, other = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(2), batch.column(3)))
            for i in range(len(batch)):
                x, y = (v[at[i] : at[i + 1]] for at, v in (one, other))
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that meet the threshold on their full sets. m: a bound of the pairs that share b; where it is large, b's set is dealt over several keys."""
    parts = F.ceil(F.col("m") / PAIRS).cast("int")
    centres = pairs.groupBy("b").agg(F.max("m").alias("m")).join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b").select("b", "y", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    both = pairs.withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).join(centres, ["b", "part"]).join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a")
    return both.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long")


def _centred(rows: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """(rows, centres): rows (bucket, rep, n, label, fame, m) of buckets with several labels, with c: their most famous member, or where they have c_label, the label of a former one, the most famous of another label; and the buckets (bucket, m, c)."""
    better = F.struct("fame", F.xxhash64("rep"), "rep")
    other = F.col("label") != F.col("c_label") if "c_label" in rows.columns else F.lit(True)
    chosen = F.max_by(F.struct("rep", "n", "label"), F.when(other, better)).alias("c")
    open_ = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), chosen).where("lo < hi").select("bucket", "m", "c")
    centres = steps.staged(open_)
    return steps.staged(join_groups(rows.select("bucket", "rep", "n", "label", "fame"), centres, ["bucket"], "m")), centres


def prefix_pairs(rows: DataFrame, sets: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """(a, b, m) of rows (rep, n, label) with different labels that may meet the threshold; none that does is missing.

    A set of n shingles that has o in common with another shares one of its
    first n - o + 1, in any order that holds for all, and so does the other. o
    grows with the other's size, so each of the first shingles has a largest
    size of the other, most. Here shingles of one label come first, which meet
    nobody, then the rarest.
    """
    tokens = rows.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", "n", "label", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token", "f")
    shared = steps.staged(join_groups(tokens, steps.staged(often), ["token"], "f"))
    whole, ordered = Window.partitionBy("rep"), Window.partitionBy("rep").orderBy("f", "token")
    at = F.col("n") - F.count("*").over(whole) + F.row_number().over(ordered) - 1
    left = F.col("n") - F.col("at")
    heads = shared.withColumn("at", at).where(100 * left >= percent * F.col("n")).withColumn("most", F.floor((100 + percent) * left / percent).cast("long") - F.col("n"))
    heads = steps.staged(heads.select("token", "label", "rep", "n", "most"))
    # Of each shingle those stay that may meet the smallest and are met by the widest.
    per = heads.groupBy("token").agg(F.count("*").alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("smallest"), F.max("most").alias("widest")).where("lo < hi").select("token", "f", "smallest", "widest")
    heads = steps.staged(join_groups(heads, steps.staged(per), ["token"], "f").where("most >= smallest and n <= widest").drop("f", "smallest", "widest"))
    side = lambda k: heads.groupBy("token", F.col("label").alias(f"{k}_label")).agg(F.count("*").alias(f"{k}_f"), F.min("n").alias(f"{k}_lo"), F.max("most").alias(f"{k}_hi"))
    x, y = side("x"), side("y").withColumnRenamed("token", "t")
    differ = x.join(y, (F.col("token") == F.col("t")) & (F.col("x_label") < F.col("y_label")) & (F.col("x_lo") <= F.col("y_hi")) & (F.col("y_lo") <= F.col("x_hi"))).drop("t")
    differ = steps.staged(differ.select("token", "x_label", "y_label", (F.col("x_f") * F.col("y_f")).alias("meet")))
    # Two components whose rows would meet more often than a few times each are gone through row by row first; those of few rows can't.
    members = rows.groupBy("label").agg(F.count("*").alias("members"), F.min("n").alias("least_n"))
    of = lambda k: members.select(F.col("label").alias(f"{k}_label"), F.col("members").alias(f"{k}_members"))
    met = differ.groupBy("x_label", "y_label").agg(F.sum("meet").alias("meet")).join(of("x"), "x_label").join(of("y"), "y_label")
    often = steps.staged(met.where(F.least("meet", F.col("x_members") * F.col("y_members")) > MEETINGS * (F.col("x_members") + F.col("y_members"))).select("x_label", "y_label"))
    named = lambda k: heads.select("token", *(F.col(c).alias(f"{k}_{c}") for c in ("label", "rep", "n", "most")))
    sizes = (F.col("x_n") <= F.col("y_most")) & (F.col("y_n") <= F.col("x_most"))
    pair = lambda df: df.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"), F.lit(1).cast("long").alias("m"))
    few = differ if often.isEmpty() else differ.join(often, ["x_label", "y_label"], "left_anti")
    pairs = pair(few.select("token", "x_label", "y_label").join(named("x"), ["token", "x_label"]).join(named("y"), ["token", "y_label"]).where(sizes))
    if not often.isEmpty():
        pairs = pairs.union(pair(_held_against(differ.join(often, ["x_label", "y_label"], "left_semi"), heads, shared, members, percent, steps).where(sizes)))
    return pairs.distinct()


def _held_against(differ: DataFrame, heads: DataFrame, shared: DataFrame, members: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """Rows of two components (token, x_label, y_label) that share a head, each of which has enough in common with the other's component as a whole.

    How many of a row's shingles occur anywhere in the other component bounds
    what it shares with any of its rows: one look-up for each shingle and component.
    """
    sides = differ.select("token", F.col("x_label").alias("label"), F.col("y_label").alias("other")).union(differ.select("token", F.col("y_label").alias("label"), F.col("x_label").alias("other")))
    met = steps.staged(heads.join(sides, ["token", "label"]).select("rep", "n", "label", "other").distinct())
    held = shared.select("token", F.col("label").alias("other")).distinct()
    common = met.join(shared.select("rep", "token"), "rep").join(held, ["token", "other"]).groupBy("rep", "n", "label", "other").agg(F.count("*").alias("c"))
    able = common.join(members.select(F.col("label").alias("other"), "least_n"), "other").where((100 + percent) * F.col("c") >= percent * (F.col("n") + F.col("least_n")))
    rows = steps.staged(heads.join(able.select("rep", "other"), "rep"))
    named = lambda k, o: rows.select("token", F.col("label").alias(f"{k}_label"), F.col("other").alias(f"{o}_label"), *(F.col(c).alias(f"{k}_{c}") for c in ("rep", "n", "most")))
    return named("x", "y").where("x_label < y_label").join(named("y", "x"), ["token", "x_label", "y_label"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id (smallest key reachable over links), kept.

    Link: 100 * intersection >= percent * union of the two sets. Null and
    blank texts have n_shingles 0 and their own component. Rows that share a
    key are one document, whose text is the smallest of theirs, and all get its
    result. Rows with a null key are left out of all groups and kept. Keys are
    whole numbers, or text of such; other text is an error. Columns besides key
    and text are not read. An empty table gives none.
    """
    small_batches(df.sparkSession)
    prefiltered_joins(df.sparkSession)
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    if texts.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
        one = texts.where("id is not null").groupBy("id").agg(F.min("text").alias("text")).unionByName(texts.where("id is null"))
        out = _grouped(one, size, percent)
        out = texts.where("id is not null").select("id").join(out.where("id is not null"), "id").unionByName(out.where("id is null"))
    else:
        out = _grouped(texts, size, percent)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, component_id) of texts (id, text); ids are unique or null."""
    steps = Steps()
    staged = steps.staged
    sigs = staged(texts.mapInArrow(_signatures(size), "id long, n long, d1 long, d2 long, bands array<long>"))
    # What the result reads holds no band keys.
    ids = staged(sigs.select("id", "n", "d1", "d2"))
    some = sigs.where("n > 0 and id is not null")
    own = ["rep", "n"]
    classes = some.groupBy("d1", "d2", "n").agg(F.min(F.struct(F.col("id").alias("rep"), "bands")).alias("r"), F.count("*").alias("members"))
    classes = staged(classes.select("d1", "d2", "n", "members", "r.*"))
    rows = classes.select(*own, F.explode("bands").alias("bucket"))
    buckets = staged(rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    # A set is famous if its buckets are large: it has what its group has in common, so most links of a group meet in it.
    rows = staged(join_groups(rows, buckets, ["bucket"], "m").withColumn("fame", F.sum("m").over(Window.partitionBy("rep"))))
    rows, centres = _centred(rows.withColumn("label", F.col("rep")), steps)

    def with_centre(rows: DataFrame) -> DataFrame:
        possible = 100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")
        return rows.where((F.col("label") != F.col("c.label")) & possible).groupBy(F.col("rep").alias("a"), F.col("c.rep").alias("b")).agg(F.max("m").alias("m"))

    done = staged(with_centre(rows))
    # Full sets of all that share a bucket, once for every turn. All have n > 0: by this filter Spark makes a Bloom filter of them, so that few other texts are shuffled.
    wanted = staged(rows.select(F.col("rep").alias("id"), "n").distinct()).where("n > 0").select("id")
    sets = staged(texts.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(_sets(size), "id long, shingles array<long>"))
    release(texts.sparkSession)
    links = staged(_verified(done, sets, percent))
    labels = components(links, steps).withColumnRenamed("node", "rep")
    for turn in range(TURNS + 1):
        named = rows.select("bucket", *own, "fame").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        former = centres.select("bucket", "m", F.col("c.rep").alias("rep")).join(labels, "rep", "left").select("bucket", "m", F.coalesce("label", "rep").alias("c_label"))
        rows, centres = _centred(join_groups(named, staged(former), ["bucket"], "m"), steps)
        if centres.isEmpty():
            break
        found = with_centre(rows) if turn < TURNS else prefix_pairs(staged(rows.select(*own, "label").distinct()), sets, percent, steps)
        new = staged(found.join(done.select("a", "b").union(done.select("b", "a")), ["a", "b"], "left_anti"))
        more = staged(_verified(new, sets, percent))
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links, steps).withColumnRenamed("node", "rep")
        done = done.union(new)
        release(texts.sparkSession)
    named = classes.select("d1", "d2", "members", "rep").join(labels, "rep", "left")
    named = staged(named.select("d1", "d2", "members", F.coalesce("label", "rep").alias("component_id")))
    out = join_groups(ids.where("n > 0 and id is not null"), named, ["d1", "d2"], "members").select("id", "n", "component_id")
    out = out.unionByName(ids.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    steps.drop_but(ids, named)
    return out


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """df without all but the smallest key of each group; columns stay. Null keys stay, and all rows that share the key that stays, equal ones too. An empty table stays empty."""
    gone = near_duplicates(df, key, text, size, percent).where(~F.col("kept")).select(F.col(key))
    return df.join(gone, key, "left_anti")
