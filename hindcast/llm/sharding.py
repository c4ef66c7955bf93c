"""Operator 10, sharding by extendible hashing.

A row's hash is the first 60 bits of the md5 of its id and text.  The directory
starts with one bucket; a bucket above the byte limit, and only such a one, is split
on the next bit of the hash, until every bucket fits.  Every number of bits that a
bucket could reach is answered by one histogram: bytes by hash prefix at a depth
that leaves cells far below the limit, rolled up to all shallower prefixes.  Cells
that are still too large there are counted again over deeper bits, and only they.
A row's shard is its shortest prefix whose bytes fit.

Equal rows have equal hashes and no bit can part them.  Such a bucket becomes a
chain of overflow pages, filled in order: each page takes as many of the equal rows
as the limit allows.  A single row above the limit is a shard of its own (its bytes
show it), as rows are never cut.

Only histograms are shuffled, by prefix and so without hot keys; the rows themselves
get their shard by a join with the leaves of the directory.

Rows: null text has no bytes, null ids hash as an empty id, repeated rows are placed
as often as they come; an empty table gives no rows; columns other than ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hindcast.llm.common import stored, texts
from hindcast.sources.tables import read_table

HASH_BITS = 60
#: Depth of the first histogram beyond what even shards would need.
SLACK_BITS = 6
STEP_BITS = 12
LIMIT_BYTES = 1_000_000


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, n_bytes)."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))
    digits = F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4)
    return texts(docs).select("doc_id", F.conv(digits, 16, 10).cast("long").alias("hash"),
                              F.octet_length("text").cast("long").alias("n_bytes"))


def leaves(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(depth, prefix, shard_bytes, n_rows), the directory's buckets that hold rows,
    and a depth at which there are about two cells for each of them."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    first = depth = min(HASH_BITS, ceil(log2(max(1, total / limit))) + SLACK_BITS)
    cells, done, top = rows, None, 0
    while True:
        fine = cells.groupBy(F.shiftright("hash", HASH_BITS - depth).alias("cell")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
        each = fine.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(depth))))
        counts = each.groupBy("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix")).agg(
            F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("n_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") == HASH_BITS)
        counts = stored(spark, counts.withColumn("fits", fits), "sharding-counts")
        split = counts.where(~F.col("fits")).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        here = counts.where("fits").drop("fits")
        here = here.join(split, ["depth", "prefix"], "left_semi").unionByName(here.where((F.col("depth") == 0) & F.lit(top == 0)))
        done = here if done is None else done.unionByName(here)
        full = counts.where((F.col("depth") == depth) & ~F.col("fits")).select("prefix")
        if full.isEmpty():
            return stored(spark, done, "sharding-leaves"), max(0, first - SLACK_BITS + 1)
        cells = rows.withColumn("prefix", F.shiftright("hash", HASH_BITS - depth)).join(full, "prefix", "left_semi")
        top, depth = depth, min(HASH_BITS, depth + STEP_BITS)


def located(rows: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """``rows`` with a hash, joined with their leaf.  Hashes fall into cells of
    ``bits`` bits; a leaf of fewer bits stands in all the cells below it, one of more
    bits in its cell with its range of hashes, so a row meets its cell's leaves only."""
    low = F.expr(f"shiftleft(prefix, {HASH_BITS} - depth)")
    high = F.expr(f"shiftleft(prefix + 1, {HASH_BITS} - depth)") - 1
    cell = F.sequence(F.shiftright("low", HASH_BITS - bits), F.shiftright("high", HASH_BITS - bits))
    cells = found.withColumn("low", low).withColumn("high", high).withColumn("cell", F.explode(cell))
    keyed = rows.withColumn("row_cell", F.shiftright("hash", HASH_BITS - bits))
    return keyed.join(cells, (F.col("row_cell") == F.col("cell")) & F.col("hash").between(F.col("low"), F.col("high"))).drop(
        "row_cell", "cell", "low", "high")


def shards(spark: SparkSession, docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, page, shard_bytes) for each row: a shard is
    named by a prefix of ``depth`` bits and, in a chain of equal rows, a page."""
    if limit < 1:
        raise ValueError("the byte limit must be positive")
    rows = stored(spark, hashed(docs).withColumn("task", F.spark_partition_id()), "sharding-rows")
    found, bits = leaves(rows, limit)
    placed = located(rows, found, bits).withColumn(
        "chained", (F.col("shard_bytes") > limit) & (F.col("n_rows") > 1))
    plain = placed.where(~F.col("chained")).withColumn("page", F.lit(0).cast("long"))
    columns = ["doc_id", "n_bytes", "depth", "prefix", "page", "shard_bytes"]

    chain = placed.where("chained")
    before = Window.partitionBy("hash").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = chain.groupBy("hash", "task").agg(F.count(F.lit(1)).alias("n")).select(
        "hash", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("hash", "task").orderBy("doc_id")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes")))
    paged = chain.withColumn("nth", nth).join(earlier, ["hash", "task"]).withColumn("each", each).withColumn(
        "page", F.floor((F.col("earlier") + F.col("nth")) / F.col("each"))).withColumn(
        "shard_bytes", F.least("each", F.col("n_rows") - F.col("page") * F.col("each")) * F.col("n_bytes"))
    return plain.select(*columns).unionByName(paged.select(*columns))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shards(spark, read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash,
    row_number() OVER (PARTITION BY doc_id, text) - 1 AS nth FROM documents),
d AS (SELECT range AS depth FROM range(0, {HASH_BITS + 1})),
c AS (SELECT depth, hash >> ({HASH_BITS} - depth) AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*) AS n FROM r, d GROUP BY ALL),
f AS (SELECT r.*, min(depth) AS depth FROM r, c WHERE r.hash >> ({HASH_BITS} - depth) = prefix
      AND (bytes <= {LIMIT_BYTES} OR n = 1 OR depth = {HASH_BITS}) GROUP BY ALL),
p AS (SELECT f.*, c.prefix, bytes, n, bytes > {LIMIT_BYTES} AND n > 1 AS chained,
      greatest(1, {LIMIT_BYTES} // greatest(n_bytes, 1)) AS each FROM f, c WHERE f.depth = c.depth AND f.hash >> ({HASH_BITS} - f.depth) = c.prefix)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, prefix, CASE WHEN chained THEN nth // each ELSE 0 END AS page,
    CASE WHEN chained THEN least(each, n - (nth // each) * each) * n_bytes ELSE bytes END AS shard_bytes FROM p
"""
