"""Operator 5, SimHash fingerprints of 128 bits, and search within a Hamming radius
by permuted block tables.

A text's terms are its distinct words; a term weighs 1, or 2 if it has more than three
characters, and votes with the 128 bits of its hash.  A bit is set if more than half
of the weight votes for it.  Words are exploded and combined inside the scan's task:
a sum packs the votes for two bits into the halves of one number, so a text reaches
the shuffle as 64 sums whatever its length (a half holds a weight of 2**31).

For search, the 128 bits are cut into 8 blocks.  Two fingerprints within 6 bits agree
in at least two whole blocks, so there is one table for each pair of blocks, keyed by
their 32 bits.  A pair of fingerprints counts in the first table in which it agrees.
Equal fingerprints are one entry, so copies cost nothing there; an entry is a
fingerprint and one number of table and key.  What is found are pairs of distinct
fingerprints; ``members`` tells which documents have one, so copies aren't expanded.

The following document, whose text the query needs, is found without a global order:
ids are cut at quantiles that are ids themselves, and the rows that begin a bucket are
also put behind the last row of the one before.  One shuffle of the texts by bucket
serves the order, the edited texts and the sums of votes.

Rows: null text counts as empty, an empty text has the fingerprint of zeros; equal
texts have equal fingerprints; repeated ids follow one another in the order of a hash
of their texts; null ids come after all others; a single row is followed by itself;
an empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hindcast.llm.common import stored, texts
from hindcast.sources.tables import read_table

BITS, BLOCKS, RADIUS = 128, 8, 6
LONG_WORD = 4
LAST_KEY = 2**63 - 1
#: Buckets of following ids for each shuffle partition.
BUCKETS = 4
QUERY_EVERY = 20


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, hi, lo) of ``rows`` with a column ``text``; the keys name a row."""
    words = F.array_distinct(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    terms = rows.select(*keys, F.explode_outer(words).alias("word"))
    weight = F.when(F.col("word").isNull(), 0).when(F.char_length("word") < LONG_WORD, 1).otherwise(2).cast("long")
    hashed = terms.select(*keys, weight.alias("weight"), F.xxhash64("word").alias("h0"), F.xxhash64("word", F.lit(1)).alias("h1"))
    both = F.lit((1 << 32) | 1)
    sums = hashed.groupBy(*keys).agg(F.sum("weight").alias("total"), *(
        F.sum(F.shiftrightunsigned(h, j).bitwiseAND(both) * F.col("weight")).alias(f"{h}_{j}")
        for h in ("h0", "h1") for j in range(32)))

    def number(h: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            low, high = F.col(f"{h}_{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"{h}_{j}", 32)
            for votes, bit in ((low, j), (high, j + 32)):
                value = (1 << bit) - (1 << 64 if bit == 63 else 0)
                out = out.bitwiseOR(F.when(votes * 2 > F.col("total"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return sums.select(*keys, number("h0").alias("hi"), number("h1").alias("lo"))


def text_of(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.lit(1.0) - distance(tuple(map(F.col, a)), tuple(map(F.col, b))) / F.lit(BITS)


def _block(hi: Column, lo: Column, n: int) -> Column:
    part, at = (hi, n) if n < BLOCKS // 2 else (lo, n - BLOCKS // 2)
    return F.shiftrightunsigned(part, 16 * at).bitwiseAND(F.lit(0xFFFF))


def near_pairs(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q_hi, q_lo, hi, lo, distance): each distinct fingerprint of ``queries`` (hi, lo)
    with each of ``prints`` (hi, lo) within ``radius``, equal ones included."""
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"the tables answer radius 0 to {BLOCKS - 2}")
    pairs = list(combinations(range(BLOCKS), 2))

    def tables(df: DataFrame) -> DataFrame:
        hi, lo = F.col("hi"), F.col("lo")
        keys = [F.shiftleft(_block(hi, lo, a), 16).bitwiseOR(_block(hi, lo, b)).bitwiseOR(F.lit(n << 32))
                for n, (a, b) in enumerate(pairs)]
        return df.select("hi", "lo", F.explode(F.array(*keys)).alias("key"))

    every = tables(prints.select("hi", "lo").distinct()).alias("x")
    asked = tables(queries.select("hi", "lo").distinct()).alias("q")
    a, b = (F.col("x.hi"), F.col("x.lo")), (F.col("q.hi"), F.col("q.lo"))
    agree = [_block(*a, n) == _block(*b, n) for n in range(BLOCKS)]
    first = F.coalesce(*(F.when(agree[i] & agree[j], F.lit(n)) for n, (i, j) in enumerate(pairs)))
    found = asked.join(every, (F.col("x.key") == F.col("q.key")) & (distance(a, b) <= radius)
                       & (first == F.shiftrightunsigned("q.key", 32)))
    return found.select(b[0].alias("q_hi"), b[1].alias("q_lo"), a[0].alias("hi"), a[1].alias("lo"), distance(a, b).alias("distance"))


def members(prints: DataFrame) -> DataFrame:
    """(hi, lo, doc_id): which documents have a fingerprint, a row for each of ``prints``."""
    return prints.select("hi", "lo", "doc_id")


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, near): for each distinct fingerprint of ``queries`` (hi, lo) the number
    of rows of ``prints`` (hi, lo) within ``radius``, equal ones included."""
    found = near_pairs(queries, prints, radius)
    counted = found.join(prints.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")), ["hi", "lo"])
    return counted.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(F.sum("n").alias("near"))


def near_classes(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, near, classes): as ``neighbours``, and the fingerprints found as
    (distance, least doc_id, rows), nearest first; one for each, however many copies."""
    named = members(prints).groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    found = near_pairs(queries, prints, radius).join(named, ["hi", "lo"])
    lists = found.groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(
        F.sort_array(F.collect_list(F.struct("distance", "doc_id", "n"))).alias("classes"))
    return lists.withColumn("near", F.expr("aggregate(classes, 0L, (s, c) -> s + c.n)"))


def with_buckets(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """``rows`` with ``key`` and a bucket of following keys, and the buckets' first keys: at most ``BUCKETS`` for each shuffle partition."""
    spark = rows.sparkSession
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LAST_KEY)))
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.agg(F.min("key").alias("least"), F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n).alias("cuts")).first()
    cuts = sorted({cut.least, *cut.cuts}) if cut.cuts else [0]
    listed, steps = ",".join(map(str, cuts)), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    bucket = F.expr(f"aggregate(array({','.join(map(str, steps))}), 0, (p, s) -> "
                    f"if(p + s <= {len(cuts)} and get(cast(split('{listed}', ',') as array<bigint>), p + s - 1) <= key, p + s, p))")
    return rows.withColumn("bucket", bucket), cuts


def with_next(rows: DataFrame, cuts: list[int], columns: list[str]) -> DataFrame:
    """``rows`` of ``with_buckets`` and next_<column> of the following row by (key,
    tie), after the last of all the first."""
    firsts = rows.sparkSession.createDataFrame([(c,) for c in cuts], "first_key long")
    begin = rows.join(F.broadcast(firsts), F.col("key") == F.col("first_key"), "left_semi")
    before = F.when(F.col("bucket") == 1, F.lit(len(cuts))).otherwise(F.col("bucket") - 1)
    both = rows.withColumn("guest", F.lit(False)).unionByName(begin.withColumn("bucket", before).withColumn("guest", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "tie")
    led = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return led.where(~F.col("guest")).drop("guest")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness and that
    to the next document, and for ids divisible by 20 ``n_near``: how many other rows
    lie within 6 bits, derived from ``near_ids``: the fingerprints found, its own among
    them, as distance:least doc_id:rows."""
    docs = texts(read_table(spark, sf_dir, "documents"))
    rows, cuts = with_buckets(docs.withColumn("tie", F.xxhash64("text")))
    led = with_next(rows, cuts, ["text"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    led = led.withColumn("row", F.monotonically_increasing_id())
    two = led.select("row", "doc_id", "bucket", "key", "tie",
                     F.char_length("text").cast("long").alias("n_chars"), F.explode(F.array(
                         F.struct(F.lit(False).alias("is_edit"), F.col("text")),
                         F.struct(F.lit(True).alias("is_edit"), edited.alias("text")))).alias("t"))
    two = two.select("row", "doc_id", "bucket", "key", "tie", "n_chars", "t.is_edit", "t.text",
                     F.when(F.col("t.is_edit"), F.sha2(F.col("t.text").cast("binary"), 256)).alias("edited_sha256"))
    own = ["row", "doc_id", "bucket", "key", "tie", "n_chars"]
    halves = stored(spark, fingerprints(two, [*own, "is_edit", "edited_sha256"]), "simhash-prints")
    plain = halves.where(~F.col("is_edit")).select(*own, "hi", "lo")
    edits = halves.where("is_edit").select("row", "edited_sha256", F.col("hi").alias("edited_hi"), F.col("lo").alias("edited_lo"))
    led = with_next(plain, cuts, ["hi", "lo"])
    asked = plain.where(F.col("doc_id") % QUERY_EVERY == 0)
    near = near_classes(asked, plain)
    out = led.join(edits, "row").join(near, ["hi", "lo"], "left")
    return out.select("doc_id", "n_chars", "edited_sha256", text_of("hi", "lo").alias("fingerprint"),
                      text_of("edited_hi", "edited_lo").alias("edited_fingerprint"),
                      likeness(("hi", "lo"), ("edited_hi", "edited_lo")).alias("near_edited"),
                      likeness(("hi", "lo"), ("next_hi", "next_lo")).alias("near_next"),
                      F.when(F.col("doc_id") % QUERY_EVERY == 0, F.col("near") - 1).alias("n_near"),
                      F.when(F.col("doc_id") % QUERY_EVERY == 0, F.array_join(F.transform("classes", lambda c: F.concat(
                          c["distance"], F.lit(":"), F.coalesce(c["doc_id"].cast("string"), F.lit("")), F.lit(":"), c["n"])), ",")).alias("near_ids"))
