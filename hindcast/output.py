"""Presentation helpers for checked outputs.

Results handed to an outside comparison are made independent of the reader's
session time zone (instants become UTC wall-clock ``timestamp_ntz``) and of the
order floating point sums ran in (doubles rounded to ``DIGITS`` places).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def round_double(c):
    """Round via DECIMAL(38,9) then to ``DIGITS`` places (half away from zero).

    The first step absorbs last-bit differences between engines that summed in a
    different order, so ties such as ``...1249999`` vs ``...125`` round alike."""
    return F.round(c.try_cast("decimal(38,9)"), DIGITS).cast("double")


def finalize(df: DataFrame) -> DataFrame:
    """Round doubles, make instants UTC ``timestamp_ntz``, widen ints to bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round_double(c)
        elif isinstance(f.dataType, T.TimestampType):
            # Session time zone is UTC (hindcast.session), so this keeps the UTC wall time.
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def round_sql(inner: str, doubles: list[str]) -> str:
    """Wrap oracle SQL so the listed double columns are rounded like :func:`finalize`."""
    if not doubles:
        return inner
    rep = ", ".join(f"cast(round(try_cast({c} as decimal(38, 9)), {DIGITS}) as double) as {c}"
                    for c in doubles)
    return f"select * replace ({rep}) from (\n{inner}\n) as q"
