"""Lateral unnest of JSON arrays (J6) and typed hourly rows (P10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.json import (
    ODD,
    json_query_array,
    metric_columns,
    parse_text_fields,
    parse_typed_fields,
    safe_cast,
    scalar_only,
)
from hindcast.schemas import METRICS, metric_sql_type


def explode_json_array(df: DataFrame, json_col: str, as_col: str = "hourly") -> DataFrame:
    """One row per element of the JSON array text in ``json_col``; a NULL, empty
    or non-array value yields no rows (``explode``, not ``explode_outer``)."""
    return df.withColumn(as_col, F.explode(json_query_array(json_col)))


def typed_hourly(df: DataFrame, keep: list[str], record_col: str = "hourly",
                 with_lead: bool = False) -> DataFrame:
    """Project carried columns + ``valid_at`` (+ lead) + the 17 typed metrics.

    Each element is parsed once into text fields, then safely cast."""
    fields = ["valid_at"] + (["lead_time_hours"] if with_lead else []) + METRICS
    parsed = df.withColumn("__rec", parse_text_fields(record_col, fields))
    cols = [F.col(c) for c in keep]
    cols.append(safe_cast(scalar_only(F.col("__rec.valid_at")), "timestamp").alias("valid_at"))
    if with_lead:
        cols.append(safe_cast(scalar_only(F.col("__rec.lead_time_hours")), "bigint").alias("lead_time_hours"))
    return parsed.select(*cols, *metric_columns("__rec"))


def document_hours(df: DataFrame, keep: Sequence[str], doc: str, lifted: dict[str, str], array: str,
                   with_lead: bool = False) -> DataFrame:
    """Columns ``keep``, the scalars ``lifted`` (name: path, as text) and one typed row for
    each element of the JSON array at path ``array``: the rows of ``typed_hourly`` over
    ``explode_json_array``, from one parse of ``doc``.

    A document whose every value has its type is parsed into typed rows at once.  Any
    other is parsed again as text, first the document, then each element, and cast
    safely; for the first kind that second parse reads NULL."""
    kinds = ({"lead_time_hours": "bigint"} if with_lead else {}) | {m: metric_sql_type(m) for m in METRICS}
    record = ", ".join(f"`{n}` {k}" for n, k in ({"valid_at": "string"} | kinds).items())
    texts = dict.fromkeys(lifted.values())
    parsed = df.select(*keep, parse_typed_fields(doc, texts | {array: f"array<struct<{record}>>"}).alias("__doc"))
    parsed = parsed.withColumn("__text", parse_text_fields(f"__doc.{ODD}", [*texts, array]))
    plain = F.col(f"__doc.{ODD}").isNull()
    elements = F.transform(json_query_array(f"__text.{array}"), lambda e: parse_text_fields(e, ["valid_at", *kinds]))
    elements = F.transform(elements, lambda r: F.struct(r["valid_at"].alias("valid_at"), *(
        safe_cast(scalar_only(r[n]), k).alias(n) for n, k in kinds.items())))
    found = F.when(plain, F.col(f"__doc.{array}")).otherwise(elements)
    told = [scalar_only(F.when(plain, F.col(f"__doc.{p}")).otherwise(F.col(f"__text.{p}"))).alias(n) for n, p in lifted.items()]
    rows = inline_elements(parsed.select(*keep, *told, found.alias("__rows")), [*keep, *lifted], "__rows")
    return rows.select(*keep, *lifted, safe_cast(scalar_only("__el.valid_at"), "timestamp").alias("valid_at"),
                       *(F.col(f"__el.{n}") for n in kinds))


def inline_elements(df: DataFrame, keep: Sequence[str], array_col: str) -> DataFrame:
    """``select(*keep, explode(array_col) as __el)``, written as ``inline_rows`` is."""
    out = df.select(*keep, F.posexplode_outer(array_col).alias("__pos", "__el"))
    return out.filter(F.col("__pos").isNotNull()).select(*keep, "__el")


def inline_rows(df: DataFrame, keep: list[str], array_col: str) -> DataFrame:
    """``select(*keep, inline(array_col))``: one row per struct element, none for
    a NULL or empty array.

    Written with ``posexplode_outer`` and a filter on the position (NULL only
    for the padding row of an empty array): plain ``inline``/``explode`` makes
    Catalyst infer ``size(array) > 0`` and push it below the projection that
    builds the array, which re-runs that projection (e.g. a JSON decode) inside
    the filter."""
    return inline_elements(df, keep, array_col).select(*keep, "__el.*")
