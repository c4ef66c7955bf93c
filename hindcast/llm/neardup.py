"""Operator 6, near duplicates by b-bit MinHash, every link confirmed on full sets.

1. One pass over the texts makes of each document's distinct word shingles 160 minima
   of random hash functions.  Of these it keeps 32 band keys (5 minima each) and the
   low 4 bits of every minimum, packed into ten 64-bit numbers.  Documents with equal
   sets are one class from here on, so copies cost nothing further.
2. Classes with a band key in common are candidates.  Inside such a bucket each class
   is first compared with two others only: the one that shares most bands with other
   classes, as the original of a group of edited copies does, and the least.
   A candidate stays if the sizes allow the threshold and the similarity estimated
   from the packed bits (equal 4-bit values, corrected for those equal by chance) is
   not five standard errors below it.  What stays is confirmed on the full sets.
3. Buckets whose classes are by then in different components are searched again: all
   pairs across components, compared bit by bit in blocks of bounded size, and those
   that pass the estimate confirmed on full sets in the same task.  So no link that
   matters for a component is skipped, and neither a large group of near copies nor
   many classes just below the threshold give more rows than links.

A pair of similarity 0.8 has a band in common but for 3e-6 of cases, and passes the
estimate but for 3e-7.

Rows: null and empty texts have no set and no link, and are components of their own;
repeated rows are exact copies; a row without ``doc_id`` links nothing, has a null
component and is kept; an empty table gives no rows; columns other than ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hindcast.llm.common import WordNumbers, map_texts, stored, texts
from hindcast.llm.graph import components
from hindcast.sources.tables import read_table

BANDS, BAND_ROWS, BITS = 32, 5, 4
HASHES = BANDS * BAND_ROWS
PACKED = HASHES * BITS // 64
#: Classes in one block when a bucket is searched pair by pair.
BLOCK = 512
STANDARD_ERRORS = 5
#: Shingles hashed in one step, so that what it makes stays in a core's cache.
HASHED_AT_A_TIME = 256

BAND_COLUMNS = [f"b{n}" for n in range(BANDS)]
BIT_COLUMNS = [f"s{n}" for n in range(PACKED)]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


class Shingles:
    """Distinct word shingles of a text as sorted 64-bit numbers."""

    def __init__(self, width: int, salt: int):
        self.width, self.words = width, WordNumbers(salt)

    def of(self, text: str) -> np.ndarray:
        h = self.words.of(text.encode("utf-8").lower())  # changes A-Z only
        if not len(h):
            return h
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for n in range(width):
            out = (out ^ h[n:len(h) - width + 1 + n]) * _MIX[0]
            out = (out ^ (out >> np.uint64(29))) * _MIX[1]
        out.sort()
        return out[np.r_[True, out[1:] != out[:-1]]]


class Sketch:
    """Band keys and packed low bits of a set's minima.  The hash functions multiply the
    upper halves of the shingles' numbers modulo 2^32, which a core does eight at a time;
    the bits kept are the ninth and up, as a product's lowest hardly depend on the factor."""

    def __init__(self, salt: int):
        rng = np.random.default_rng(60 + salt)
        self.times = rng.integers(0, 2**32, HASHES, np.uint32)[None, :] | np.uint32(1)
        self.plus = rng.integers(0, 2**32, HASHES, np.uint32)[None, :]
        self.band_times = rng.integers(0, 2**64, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)
        self.band_plus = rng.integers(0, 2**64, BANDS, np.uint64)
        self.shift = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half, low = (shingles >> np.uint64(32)).astype(np.uint32)[:, None], np.full(HASHES, 2**32 - 1, np.uint32)
        for at in range(0, len(half), HASHED_AT_A_TIME):
            made = half[at:at + HASHED_AT_A_TIME] * self.times
            made += self.plus
            np.minimum(low, made.min(axis=0), out=low)
        low = low.astype(np.uint64)
        keys = (low.reshape(BANDS, BAND_ROWS) * self.band_times).sum(axis=1) + self.band_plus
        keys = (keys ^ (keys >> np.uint64(31))) * _MIX[2]
        bits = ((low >> np.uint64(8)) & np.uint64(2**BITS - 1)).reshape(PACKED, -1) << self.shift
        return keys, bits.sum(axis=1, dtype=np.uint64)


def sketches(docs: DataFrame, width: int, salt: int) -> DataFrame:
    """(doc_id, n_shingles, node, check, b*, s*): ``node`` and ``check`` are 128 bits
    of the set's digest, null for an empty set."""
    names = ["n_shingles", "node", "check", *BAND_COLUMNS, *BIT_COLUMNS]

    def make():
        shingles, sketch = Shingles(width, salt), Sketch(salt)

        def work(batch):
            rows = np.zeros((batch.num_rows, len(names)), np.uint64)
            for n, text in enumerate(batch.column("text").to_pylist()):
                found = shingles.of(text)
                rows[n, 0] = len(found)
                if len(found):
                    rows[n, 1:3] = np.frombuffer(blake2b(found.tobytes(), digest_size=16).digest(), np.uint64)
                    keys, bits = sketch.of(found)
                    rows[n, 3:3 + BANDS], rows[n, 3 + BANDS:] = keys, bits
            return {"doc_id": batch.column("doc_id")} | {
                name: np.ascontiguousarray(rows[:, k]).view(np.int64) for k, name in enumerate(names)}
        return work

    return map_texts(texts(docs), make, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def full_sets(docs: DataFrame, width: int, salt: int) -> DataFrame:
    """(node, shingles) of whole texts; rows that a task has met already are left out."""

    def make():
        shingles, seen = Shingles(width, salt), set()

        def work(batch):
            nodes, sets = [], []
            for text in batch.column("text").to_pylist():
                found = shingles.of(text)
                node = int(np.frombuffer(blake2b(found.tobytes(), digest_size=16).digest(), np.int64)[0])
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(found.view(np.int64))
            return {"node": nodes, "shingles": sets}
        return work

    return map_texts(texts(docs), make, "node long, shingles array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from packed bits: the share of equal values beyond that of chance."""
    ones = F.lit(int("1" * 16, 16))
    unequal = F.lit(0)
    for s in BIT_COLUMNS:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftright(x, k))
        unequal = unequal + F.bit_count(any_bit.bitwiseAND(ones))
    chance = 1 / 2**BITS
    return (1 - unequal / F.lit(HASHES) - F.lit(chance)) / F.lit(1 - chance)


def floor_of(threshold: float) -> float:
    """The estimate below which a pair is given up."""
    chance = 1 / 2**BITS
    p = chance + (1 - chance) * threshold
    return threshold - STANDARD_ERRORS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and packed bits allow the threshold."""
    bits = classes.select("node", "n_shingles", *BIT_COLUMNS)
    joined = pairs.join(bits.alias("x"), F.col("a") == F.col("x.node")).join(bits.alias("y"), F.col("b") == F.col("y.node"))
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    return joined.where((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
                        & (estimate("x", "y") >= floor_of(percent / 100))).select("a", "b")


def confirmed(spark: SparkSession, pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, salt: int,
              percent: int) -> DataFrame:
    """Those of the written ``pairs`` whose full sets reach the threshold."""
    nodes = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("least_id").alias("doc_id")).distinct()
    sets = stored(spark, full_sets(docs.join(wanted, "doc_id", "left_semi"), width, salt), "neardup-sets")
    x, y = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(x, "a").join(y, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * percent).select("a", "b").distinct()


def dealt(members: DataFrame) -> DataFrame:
    """Rows of split buckets, dealt to pairs of blocks (i, j) of their bucket: a row's
    block is its node modulo the bucket's number of blocks, so that no pair holds more
    than about two blocks of ``BLOCK`` rows."""
    own = F.pmod("node", "blocks")
    paired = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return paired.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                         "node", "root", "n_shingles", *BAND_COLUMNS, *BIT_COLUMNS)


def _candidates(block: pd.DataFrame, percent: int):
    """(row, rows) numbers of a pair of blocks that may be linked across components:
    each of the rows passes the size and bit tests with the row, and the two agree in
    no band before that of this bucket, where they would meet too."""
    floor, chance, ones = floor_of(percent / 100), 1 / 2**BITS, np.uint64(int("1" * 16, 16))
    i, j = block["i"].iat[0], block["j"].iat[0]
    own, root, size = (block[x].to_numpy(np.int64) for x in ("own", "root", "n_shingles"))
    bits = np.ascontiguousarray(block[BIT_COLUMNS].to_numpy(np.int64).T).view(np.uint64)
    bands = block[BAND_COLUMNS].to_numpy(np.int64)
    before = np.arange(BANDS) < int(np.argmax(bands[0] == block["key"].iat[0]))
    roots, counts = np.unique(root, return_counts=True)
    most = roots[counts.argmax()]
    for k in np.flatnonzero(root != most):
        # rows outside the largest component meet all; among themselves, each pair once
        meets = (root != root[k]) & ((root == most) | (np.arange(len(root)) > k))
        if i != j:
            meets &= own != own[k]
        meets &= np.minimum(size, size[k]) * 100 >= np.maximum(size, size[k]) * percent
        at = np.flatnonzero(meets)
        if not len(at):
            continue
        x = bits[:, at] ^ bits[:, k, None]
        shift = BITS // 2
        while shift:  # a value's bits fall together into its lowest
            x |= x >> np.uint64(shift)
            shift //= 2
        x &= ones
        unequal = np.bitwise_count(x).sum(axis=0, dtype=np.int64)
        at = at[(1 - unequal / HASHES - chance) / (1 - chance) >= floor]
        at = at[~((bands[at] == bands[k]) & before).any(axis=1)]
        if len(at):
            yield int(k), at


def across(spark: SparkSession, members: DataFrame, docs: DataFrame, classes: DataFrame, width: int, salt: int,
           percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket in different components, found block
    against block.  A first pass marks the rows that have a candidate; they get their
    full sets, and a second pass confirms in place, so that no pair but a link leaves a
    task however many come near the threshold."""
    # dealt to all tasks by count: the search is bound by comparisons, not by bytes
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(spark, dealt(members), "neardup-blocks").repartition(n, "key", "i", "j")

    def mark(block: pd.DataFrame) -> pd.DataFrame:
        found: set[int] = set()
        for k, at in _candidates(block, percent):
            found.add(k)
            found.update(at.tolist())
        return block.iloc[sorted(found)][["key", "i", "j", "node"]]

    marked = stored(spark, parts.groupBy("key", "i", "j").applyInPandas(mark, "key long, i long, j long, node long"), "neardup-marked")
    nodes = marked.select("node").distinct()
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("least_id").alias("doc_id")).distinct()
    sets = stored(spark, full_sets(docs.join(wanted, "doc_id", "left_semi"), width, salt), "neardup-sets")
    rows = parts.join(marked, ["key", "i", "j", "node"]).join(sets, "node")

    def confirm(block: pd.DataFrame) -> pd.DataFrame:
        node, sets = block["node"].to_numpy(np.int64), [np.asarray(x) for x in block["shingles"]]
        out = []
        for k, at in _candidates(block, percent):
            for n in at.tolist():
                shared = len(np.intersect1d(sets[k], sets[n], assume_unique=True))
                if shared * 100 >= (len(sets[k]) + len(sets[n]) - shared) * percent:
                    out.append((min(node[k], node[n]), max(node[k], node[n])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(confirm, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``: documents
    whose sets of ``width``-word shingles share ``percent`` of their union are linked,
    a component is named by its smallest ``doc_id``, and that document is kept."""
    salt = 0
    while True:
        made = stored(spark, sketches(docs, width, salt), "neardup-sketches")
        full = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        classes = stored(spark, full.groupBy("node").agg(
            F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles"),
            (F.min("check") != F.max("check")).alias("collided"),
            *(F.max(x).alias(x) for x in [*BAND_COLUMNS, *BIT_COLUMNS])), "neardup-classes")
        if classes.where("collided").isEmpty():
            break
        salt += 1  # two sets with one 64-bit digest: begin again with other hashes

    keys = classes.select("node", F.explode(F.array(*BAND_COLUMNS)).alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(spark, keys.join(sizes, "key"), "neardup-buckets")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    members = stored(spark, members.join(company, "node"), "neardup-members")
    hubs = members.groupBy("key").agg(F.max_by("node", "company").alias("hub"), F.min("node").alias("first"))
    star = members.join(hubs, "key").select("node", F.explode(F.array("hub", "first")).alias("to")).where("node <> to")
    star = star.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
    star = stored(spark, likely(star, classes, percent), "neardup-star")
    links = stored(spark, confirmed(spark, star, docs, classes, width, salt, percent), "neardup-links")
    roots = components(spark, links)

    known = members.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = known.groupBy("key").agg((F.min("root") != F.max("root")).alias("split"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    known = known.join(split.where("split").drop("split"), "key").select("key", "node", "root", "blocks")
    known = known.join(classes.select("node", "n_shingles", *BAND_COLUMNS, *BIT_COLUMNS), "node")
    more = stored(spark, across(spark, known, docs, classes, width, salt, percent), "neardup-links")
    if not more.isEmpty():
        roots = components(spark, links.union(more))

    named = classes.select("node", "least_id").join(roots, "node")
    names = named.groupBy("root").agg(F.min("least_id").alias("first_id"))
    of_class = classes.select("node", "least_id").join(
        named.select("node", "root").join(names, "root").select("node", "first_id"), "node", "left").select(
        "node", F.coalesce("first_id", "least_id").alias("component"))
    rows = made.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(of_class, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those of documents that are not the
    first of their component.  Rows of one ``doc_id`` count as one document, which stays
    if any of them does."""
    found = near_duplicates(spark, docs, width, percent)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents on two-word shingles."""
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"), width=2)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle, counted exactly; null ids aside.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
      '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w
      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.other = p.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
