"""Operator 11, filter interaction audit by decision diagrams.

Each document fails some of the filters; the set is its mask.  Spark counts documents
by part and mask, which leaves at most 2^filters rows for a part whatever its size.
From them a task builds the part's diagram: one level for each filter, a pass and a
fail edge from every node, equal subdiagrams shared, counts (documents, good, toxic)
in the leaves and their sums in the nodes.  All orders of the filters are reached by
swapping two adjacent levels at a time; a swap touches the nodes of its two levels
only.  In each order the path of pass edges from the top gives the steps: the pass
child's count is kept, the fail child's is removed.

Filters of ``measured``, a letter each: A under ``LEAST_WORDS`` words; B fewer than
half of the words distinct; C more than two capitals A-Z in a hundred code points;
D holds a sign of ``SIGNS``; E equals the text of any smaller doc_id.  E compares the
sha256 of texts: one pass writes a row of some 50 bytes for each document, a combining
aggregate gives the least id of every text, and a join on text and id finds the rows that
have it.  So copies move no text, and as the ids of copies differ no key of it is hot.

Rows: null texts are empty texts (and equal to each other); a null id is no smaller id
than any other and has none below it; rows of one id and text are no copies of each
other, but all are copies of a smaller id's; null sources are the part of the empty
string; a document with several labels is good or toxic if any says so, labels without
a document and null labels count for nothing; ties don't occur, as counts have no order;
an empty table has no parts and gives no rows; columns other than ``doc_id``, ``text``
and ``source`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.common import map_texts, ship_code, stored, texts
from hindcast.sources.tables import read_table

LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SIGNS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"

COUNTS = ["n", "good", "toxic"]
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def failures(text: bytes, n_chars: int) -> int:
    """The mask of filters A to D.  ``bytes.split`` parts at \\x20 and \\x09-\\x0D."""
    words = text.split()
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * n_chars) << 2
            | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for each row of ``docs``."""

    def make():
        def work(batch):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            chars = pc.utf8_length(batch.column("text")).to_pylist()
            return {"doc_id": batch.column("doc_id"), "part": batch.column("part"),
                    "mask": [failures(t, n) for t, n in zip(raw, chars)],
                    "same": [hashlib.sha256(t).digest() for t in raw]}
        return work

    named = docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = map_texts(texts(named, "part").withColumn("doc_id", F.col("doc_id").cast("long")), make,
                     "doc_id long, part string, mask int, same binary")
    rows = stored(docs.sparkSession, rows, "audit-rows").withColumn("n", F.lit(1))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    told = told.where("is_good or is_toxic")
    firsts = rows.groupBy(F.col("same").alias("text_of")).agg(F.min("doc_id").alias("first"))
    found = rows.join(firsts, (F.col("same") == F.col("text_of")) & (F.col("doc_id") == F.col("first")), "left")
    found = found.join(told, F.col("doc_id") == F.col("labelled"), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return found.select(
        "part", (F.col("mask") + copy.cast("int") * (1 << FILTERS.index("E"))).alias("mask"), "n",
        F.when(F.col("is_good"), F.col("n")).otherwise(0).alias("good"),
        F.when(F.col("is_toxic"), F.col("n")).otherwise(0).alias("toxic"))


class Node:
    """A subdiagram: what passes and what fails the filter of its level, and its count."""

    __slots__ = ("passed", "failed", "count")

    def __init__(self, passed, failed):
        self.passed, self.failed = passed, failed
        self.count = tuple(a + b for a, b in zip(passed.count, failed.count))


class Leaf:
    __slots__ = ("count",)

    def __init__(self, count):
        self.count = count


class Diagram:
    """Counts by mask as a diagram whose levels test ``order`` from the top down."""

    def __init__(self, filters: str, masks: dict[int, tuple]):
        self.order = list(filters)
        zero = (0,) * len(COUNTS)
        leaves: dict[tuple, Leaf] = {}
        self.levels: list[dict[tuple, Node]] = [{} for _ in filters]

        def built(level: int, mask: int):
            if level == len(filters):
                count = masks.get(mask, zero)
                return leaves.setdefault(count, Leaf(count))
            return self._node(level, built(level + 1, mask), built(level + 1, mask | 1 << level))
        self.top = built(0, 0)

    def _node(self, level: int, passed, failed) -> Node:
        key = (id(passed), id(failed))
        known = self.levels[level].get(key)
        if known is None:
            known = self.levels[level][key] = Node(passed, failed)
        return known

    def swap(self, level: int) -> None:
        """Exchange ``level`` with the one below it.  The upper nodes stay the same
        objects with the same counts, so nothing above them changes."""
        upper = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:
            a, b = node.passed, node.failed
            node.passed, node.failed = (self._node(level + 1, a.passed, b.passed), self._node(level + 1, a.failed, b.failed))
            self.levels[level][id(node.passed), id(node.failed)] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, tuple, tuple]]:
        """(filter, kept, removed) along the path that passes everything."""
        node = self.top
        for name in self.order:
            yield name, node.passed.count, node.failed.count
            node = node.passed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after another, to pass through all orders of ``n`` levels."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:  # the last level travels to the other end, then the others move once
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        move = next(inner, None)
        if move is None:
            return
        yield move + 1 if down else move
        down = not down


def audited(part: str, masks: dict[int, tuple], filters: str = FILTERS) -> list[tuple]:
    """The rows of ``RESULT`` for one part."""
    diagram = Diagram(filters, masks)
    fails = {f: sum(c[0] for m, c in masks.items() if m >> k & 1) for k, f in enumerate(filters)}
    alone = {f: masks.get(1 << k, (0,))[0] for k, f in enumerate(filters)}
    shapley, rows = dict.fromkeys(filters, 0), []

    def walk():
        order = "".join(diagram.order)
        for step, (name, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[name] += removed[0]
            rows.append((part, order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2]))

    walk()
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        walk()
    return [(*r, shapley[r[1][r[2] - 1]]) for r in rows]


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``RESULT`` for rows (part, mask, n, good, toxic), a row for each part, order and step."""
    ship_code(rows.sparkSession)
    counted = rows.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    # at most 2^filters rows for a part
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
                told = audited(part, {m["mask"]: tuple(m[c] for c in COUNTS) for m in masks}, filters)
                columns = [pa.array(list(c)) for c in zip(*told)]
                columns[2] = columns[2].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return parts.mapInArrow(run, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(measured(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def _oracle() -> str:
    """Each order's step by a test of masks, without diagrams."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words} AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
      CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * length(d.t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN d.doc_id > f.first THEN 'E' ELSE '' END AS fails
      FROM d JOIN f ON d.t = f.t LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT col0 AS filter_order FROM (VALUES {orders})),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS name, substr(filter_order, 1, step - 1) AS before
      FROM o, (SELECT unnest(range(1, {len(FILTERS) + 1})) AS step)),
x AS (SELECT part, filter_order, step, name, n, good, toxic, fails, contains(fails, name) AS failing,
      len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AS gone FROM c, s),
y AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, name,
      coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (fails = name), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley FROM y
"""


ORACLE = _oracle()
