"""Join helpers: dimension joins behind a size check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension is broadcast explicitly only when its size, estimated from a row
# count and the widths of the columns actually joined, is under this many bytes
# (every executor receives a copy, so the bound is on bytes, not rows).  Above
# it the join is left to AQE, which broadcasts only from measured runtime sizes
# and otherwise keeps a shuffled sort-merge join (with skew splitting).
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024

# Per-value byte estimates for the row-width bound; strings (names, codes, zone
# ids) get 48 bytes, above Spark's own planning estimate of 20; nested and
# unknown types 64.
_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
    T.StringType: 48,
}


def estimated_row_bytes(schema: T.StructType) -> int:
    """Estimated bytes per row: value widths plus an 8-byte header per row."""
    return 8 + sum(_WIDTHS.get(type(f.dataType), 64) for f in schema.fields)


def join_dimension(fact: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "inner",
                   max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                   dim_rows: int | None = None) -> DataFrame:
    """Join a fact to a dimension, broadcasting the dimension only when its
    estimated size ``dim_rows x row width`` is under ``max_broadcast_bytes``.

    ``dim_rows`` may be passed when the caller knows an upper bound (e.g. the
    row count of the Parquet table the dimension de-duplicates, read from file
    footers); otherwise the dimension is counted - one cheap aggregate over a
    dimension, never over the fact."""
    if dim_rows is None:
        dim_rows = dim.count()
    small = dim_rows * estimated_row_bytes(dim.schema) <= max_broadcast_bytes
    return fact.join(F.broadcast(dim) if small else dim, on, how)


def missing_keys(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str | None = None) -> DataFrame:
    """Fact rows whose non-NULL key has no dimension row (``left_anti``)."""
    dim_key = dim_key or fact_key
    d = dim.select(F.col(dim_key).alias("__k")).distinct()
    return fact.filter(F.col(fact_key).isNotNull()).join(d, F.col(fact_key) == F.col("__k"), "left_anti")
