"""Newest-wins selection per key (W1-W5, ST3).

Three forms, by what a key's group and its rows look like:

* ``latest_per_key``: an aggregate, for narrow rows and for DataFrames of any origin.
* ``without_older`` / ``newest_only``: late materialization, for wide rows (payload
  text) in Parquet files.  The choice is made on the key, the order and the row's
  coordinates (file, row number); only then are the wide rows read, and filtered by
  coordinates.  ``without_older`` suits keys that mostly have one row (replays),
  ``newest_only`` keys of many rows (latest state).
* ``latest_version``: a window, for wide rows of fixed-width columns in small groups.

``row_number() over (partition by k order by ...) = 1`` sends every row of a key
to one task and sorts it there; a key holding a third of the data would stall
one task.  The same result is an aggregate: ``max_by(row, order_key)`` per key.
Spark runs it as a partial (map-side) aggregate, so each task ships at most one
row per key to the shuffle, whatever the skew.  The order key is a struct, so
ties are broken field by field exactly like the window's ORDER BY; callers pass
a total order (the last field is unique), which makes the result
deterministic.  NULL order fields sort lowest, i.e. ``DESC NULLS LAST``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.joins import DEFAULT_BROADCAST_BYTES, estimated_row_bytes
from hindcast.session import ensure_checkpoint_dir

_ROW = "__row"


def _order_struct(order: Sequence) -> Column:
    """``order`` items are column names (descending) or ``(name, "asc")`` pairs.
    Ascending items must be numeric or timestamps; they are negated."""
    fields = []
    for i, item in enumerate(order):
        if isinstance(item, tuple):
            name, direction = item
        else:
            name, direction = item, "desc"
        c = F.col(name)
        if direction == "asc":
            c = -F.unix_micros(c) if _is_time(name) else -c
        fields.append(c.alias(f"o{i}"))
    return F.struct(*fields)


_TIME_HINTS = ("_at", "timestamp")


def _is_time(name: str) -> bool:
    return name.endswith(_TIME_HINTS)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence,
                   count_as: str | None = None, where: str | None = None) -> DataFrame:
    """Keep one row per ``keys``: the greatest by ``order``.

    ``count_as`` adds the number of rows the key had (W5's
    ``count(*) over (partition by keys)``) from the same aggregate.

    ``where`` names a boolean column: only rows where it is true compete (and
    are counted), keys without such a row are dropped, and the column itself is
    not returned.  Same rows as filtering first, but the predicate is evaluated
    inside the aggregate, so Catalyst cannot push it below an expensive
    projection (such as a JSON parse) and evaluate that projection twice."""
    cols = [c for c in df.columns if c != where]
    ordering = _order_struct(order)
    if where:
        ordering = F.when(F.col(where), ordering)  # NULL orderings never win in max_by
    aggs = [F.max_by(F.struct(*[F.col(c) for c in cols]), ordering).alias(_ROW)]
    if count_as:
        aggs.append((F.count_if(F.col(where)) if where else F.count(F.lit(1))).alias(count_as))
    out = df.groupBy(*keys).agg(*aggs)
    if where:
        out = out.filter(F.col(_ROW).isNotNull())
    select = [F.col(f"{_ROW}.{c}").alias(c) for c in cols]
    if count_as:
        select.append(F.col(count_as))
    return out.select(*select)




# --------------------------------------------------------------------------- late materialization
_AT = ["__file", "__at"]


def _with_coordinates(df: DataFrame) -> DataFrame:
    """Adds where each row of a Parquet table stands: a hash of its file's path and its
    number in the file.  Needs a DataFrame over files (projections and filters of one)."""
    return df.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__at": F.col("_metadata.row_index")})


def _same_key(keys: Sequence[str], left: str, right: str) -> Column:
    """Equality of all keys, NULL equal to NULL (as in a group)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _settled(coordinates: DataFrame) -> DataFrame:
    """The coordinates, written once to the shared folder, and broadcast if their number
    (from the files' footers) keeps them under the broadcast bound; beyond it the join
    shuffles both sides."""
    spark = coordinates.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/coordinates-{uuid.uuid4().hex}"
    coordinates.write.parquet(path)
    found = spark.read.schema(coordinates.schema).parquet(path)
    small = found.count() * estimated_row_bytes(found.schema) <= DEFAULT_BROADCAST_BYTES
    return F.broadcast(found) if small else found


def _newest_coordinates(at: DataFrame, keys: Sequence[str], order: Sequence, where: str | None = None) -> DataFrame:
    """(keys, number of rows, coordinates of the newest) from narrow columns only.  Rows
    equal in the whole order are told apart by their coordinates."""
    names = [o[0] if isinstance(o, tuple) else o for o in order]
    narrow = at.select(*dict.fromkeys([*keys, *names, *_AT, *([where] if where else [])]))
    ordering = F.struct(_order_struct(order).alias("o"), *_AT)
    if where:
        ordering = F.when(F.col(where), ordering)
    return narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(*_AT), ordering).alias("__best"))


def without_older(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``latest_per_key(df, keys, order)`` for a table in files whose keys mostly have
    one row: the rows that lose are found on narrow columns, and the wide rows are read
    once, minus those.  Payload is neither sorted nor (under the broadcast bound)
    shuffled; a hot key is combined before the shuffle and then one row."""
    at = _with_coordinates(df)
    best = _newest_coordinates(at, keys, order).where("__n > 1")
    rivals = at.select(*keys, *_AT).alias("r").join(best.alias("b"), _same_key(keys, "r", "b"))
    older = rivals.where(F.struct(*(F.col(f"r.{c}") for c in _AT)) != F.col("b.__best")).select(*(F.col(f"r.{c}") for c in _AT))
    return at.join(_settled(older), _AT, "left_anti").select(*df.columns)


def newest_only(df: DataFrame, keys: Sequence[str], order: Sequence, where: str | None = None) -> DataFrame:
    """``latest_per_key(df, keys, order, where=where)`` for a table in files whose keys
    have many rows each: the winners' coordinates are found on narrow columns and the
    wide rows read by them.  The keys come from the narrow side, so that what later
    steps infer about them is not pushed into the wide side's projection."""
    at = _with_coordinates(df)
    best = _newest_coordinates(at, keys, order, where).where(F.col("__best").isNotNull()).select(*keys, "__best.*")
    columns = [c for c in df.columns if c != where]
    wide = at.select(*(c for c in columns if c not in keys), *_AT)
    return wide.join(_settled(best), _AT).select(*columns)


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[str], count_as: str) -> DataFrame:
    """W4 + W5: the newest row of each key and how many it had, for keys whose groups
    are small by nature (the versions of one hour): one shuffle, one sort."""
    group = Window.partitionBy(*keys)
    newest = F.row_number().over(group.orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumns({count_as: F.count(F.lit(1)).over(group), "__nth": newest}).where("__nth = 1").drop("__nth")
