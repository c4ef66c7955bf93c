"""JSON access with warehouse semantics.

The warehouse reads payloads late: ``json_value`` returns a scalar as text,
``json_query`` returns JSON text, ``json_query_array`` splits a JSON array into
element texts, and ``safe_cast`` turns text into a type or NULL.  Typed
``from_json`` would silently coerce (a quoted number becomes NULL, a lone object
becomes a 1-element array), so parsing goes through text first (X1).

For speed a document is parsed once with :func:`parse_text_fields`, an
all-string ``from_json`` schema: Spark captures scalars as their text and nested
objects/arrays as JSON text, which is exactly ``json_value``/``json_query``
after :func:`scalar_only` removes the non-scalars.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.schemas import METRICS, metric_sql_type


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scalar_only(text) -> Column:
    """NULL for object/array text (``json_value`` semantics)."""
    c = _col(text)
    return F.when(c.startswith("{") | c.startswith("["), F.lit(None).cast("string")).otherwise(c)


def json_value(doc, path: str) -> Column:
    """scalar at ``path`` as text; objects and arrays give NULL."""
    return scalar_only(F.get_json_object(_col(doc), path))


def json_query(doc, path: str) -> Column:
    """JSON text at ``path`` (objects and arrays kept as text)."""
    return F.get_json_object(_col(doc), path)


def json_query_array(doc) -> Column:
    """JSON array text -> array of element JSON texts; non-arrays -> NULL."""
    return F.from_json(_col(doc), "array<string>")


def _schema(tree: dict) -> str:
    parts = []
    for name, sub in tree.items():
        parts.append(f"`{name}` {_schema(sub) if isinstance(sub, dict) else sub or 'string'}")
    return "struct<" + ", ".join(parts) + ">"


def _tree(paths: dict[str, str | None]) -> dict:
    tree: dict = {}
    for p, sql_type in paths.items():
        node = tree
        parts = p.split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node.setdefault(parts[-1], sql_type)
    return tree


def parse_text_fields(doc, paths: list[str]) -> Column:
    """Parse ``doc`` once into a struct whose leaves (the dotted ``paths``) are
    text: scalars as their text, objects/arrays as JSON text."""
    return F.from_json(_col(doc), _schema(_tree(dict.fromkeys(paths))))


#: Field of ``parse_typed_fields`` with the whole document if any of it has another type.
ODD = "__odd"


def parse_typed_fields(doc, paths: dict[str, str | None]) -> Column:
    """Parse ``doc`` once into a struct whose leaves have the types given (text where
    None).  Where any value is not of its type (a quoted number, a lone object for an
    array) the field ``ODD`` holds the document, which must then be read as text; where
    it is NULL, each leaf is what :func:`safe_cast` makes of the text."""
    return F.from_json(_col(doc), _schema(_tree(paths) | {ODD: None}), {"columnNameOfCorruptRecord": ODD})


def safe_cast(text, sql_type: str) -> Column:
    """text -> type or NULL.  Booleans accept only ``true``/``false`` (X3);
    integers reject fractional text such as ``3.7``."""
    c = _col(text)
    if sql_type == "boolean":
        low = F.lower(F.trim(c))
        return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))
    return c.try_cast(sql_type)


def metric_columns(parsed_record: str) -> list[Column]:
    """The 17 typed metric columns from a record parsed by :func:`parse_text_fields`."""
    return [
        safe_cast(scalar_only(F.col(f"{parsed_record}.{m}")), metric_sql_type(m)).alias(m)
        for m in METRICS
    ]
