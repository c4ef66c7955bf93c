"""City prefix search for a table of terms (P15, K1 in bulk).

A term matches the cities that begin with it, in any case; ``%`` and ``_`` in it are
wildcards.  Its head is what stands before the first ``%`` or backslash: letters at fixed
places, with ``_`` between them (up to three runs of letters).  The places are the term's
shape and the letters its key: every city is laid out by its letters at the places of
exactly the shapes that occur among the terms, and terms and cities meet in an equi-join.
A term that goes on after its head also meets cities by the first letters (three at most)
of the longest run that must follow, and is then compared in full.  The country is part
of the key where one is asked.

Equal requests are answered once.  Where the head is the whole term the best of each key
are cut off before the join, in every task before the shuffle; cities are dealt to tasks
in the order of their names, so that those of one beginning are cut off in one place and
a short term that half of all cities match does not gather them.

No side that grows with the tables is broadcast: Spark plans a broadcast from the size of
the files under a side, before the layout has multiplied its rows, and keeps to that plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.joins import estimated_row_bytes
from hindcast.operators.locations import clamp_limit

_RUNS = 3
_GRAM = 3
_HEAD = rf"^((?:_*[^_%\\]+){{0,{_RUNS}}})"
#: Rows of the layout in one task, which sorts them in memory.
TASK_ROWS = 2_000_000
#: Terms that are compared in full are broadcast under this size, by their count.
TERM_BYTES = 8 << 20
_KEYS = ["__shape", "__key", "__gram", "__in"]
_WHOLE = ["__hash", "__shape", "__key", "__in"]


def _terms(asked: DataFrame) -> DataFrame:
    """The distinct terms with their shape (head's places, length of the gram, whether a
    country is asked, whether the head is all), key and gram."""
    t = asked.select("__term", "__country").distinct().withColumn("__head", F.regexp_extract("__term", _HEAD, 1))
    rest = F.substring("__term", F.length("__head") + 1, F.length("__term"))
    runs = F.split(rest, r"[%_\\]")
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    t = t.withColumns({"__gram": F.substring(longest, 1, _GRAM), "__whole": rest == "", "__in": F.col("__country"),
                       "__key": F.regexp_replace("__head", "_", "")})
    return t.withColumn("__shape", F.concat_ws(
        ":", F.regexp_replace("__head", "(?s)[^_]", "x"), F.length("__gram"), F.col("__country") != "", "__whole")).drop("__head")


def _shape(text: str) -> Column:
    """A shape as a struct: itself, the head's length, start and length of its runs, ..."""
    head, gram, country, whole = text.split(":")
    runs = [(m.start() + 1, len(m[0])) for m in re.finditer("x+", head)] + [(1, 0)] * _RUNS
    places = [F.lit(v).alias(f"__{c}{i}") for i, run in enumerate(runs[:_RUNS]) for c, v in zip("sl", run)]
    return F.struct(F.lit(text).alias("__shape"), F.lit(len(head)).alias("__n"), *places, F.lit(int(gram)).alias("__g"),
                    F.lit(country == "true").alias("__abroad"), F.lit(whole == "true").alias("__whole"))


def _layout(locations: DataFrame, shapes: list[str]) -> DataFrame:
    """Every city once for each shape that it is long enough for, and for each gram after
    the shape's head where the shape has one.  As many structs as there are kinds of terms."""
    city = F.lower("city")
    n = F.length(city)
    # without terms one shape gives the array its type
    kinds = F.array(*(_shape(s) for s in shapes or ["x:0:false:true"]))
    kinds = F.filter(kinds, lambda s: (s["__n"] <= n) & F.lit(bool(shapes)))
    laid = locations.select(*locations.columns, F.inline(kinds))
    g, after = F.col("__g"), F.col("__n") + 1
    grams: Column = F.when(g == 0, F.array(F.lit(""))).when(n - g + 1 < after, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(after, F.greatest(after, n - g + 1)), lambda i: F.substring(city, i, F.col("__g")))))
    key = F.concat(*(F.substring(city, F.col(f"__s{i}"), F.col(f"__l{i}")) for i in range(_RUNS)))
    return laid.select(*locations.columns, "__shape", "__whole", key.alias("__key"),
                       F.when(F.col("__abroad"), F.col("country_code")).otherwise("").alias("__in"), F.explode(grams).alias("__gram"))


def candidates(cities: DataFrame, terms: DataFrame, n_terms: int | None = None) -> DataFrame:
    """The pairs that are compared in full: equal shape, key, gram and country.  ``n_terms``
    is the number of those terms, where it is known."""
    mine = terms.where(~F.col("__whole")).drop("__whole")
    small = n_terms is not None and n_terms * estimated_row_bytes(mine.schema) <= TERM_BYTES
    return cities.where(~F.col("__whole")).drop("__whole").join(F.broadcast(mine) if small else mine.hint("merge"), _KEYS)


def _hashed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("__hash", F.xxhash64(*by))


def _best(matches: DataFrame, by: list[str], n: int) -> DataFrame:
    """``position`` 1 to ``n`` within ``by``; their hash, ``__hash``, leads the sort."""
    rank = F.row_number().over(Window.partitionBy("__hash", *by).orderBy(
        F.col("population").desc_nulls_last(), F.col("city").asc(), F.col("location_id").asc()))
    return _hashed(matches, by).withColumn("position", rank).where(F.col("position") <= n).withColumn("position", F.col("position").cast("bigint"))


def bulk_search(locations: DataFrame, requests: DataFrame, limit: int | None = None) -> DataFrame:
    """(request_id, position, the columns of ``locations``) of ``requests`` (request_id,
    term, country_code): the first ``limit`` matches of each, by population (NULLs last),
    city and id.  A blank or NULL country asks for any; a NULL term matches nothing, an
    empty one everything.  A request without a match has no row."""
    n = clamp_limit(limit)
    spark = locations.sparkSession
    asked = requests.select("request_id", F.lower("term").alias("__term"),
                            F.coalesce(F.upper(F.trim("country_code")), F.lit("")).alias("__country")).where(F.col("__term").isNotNull())
    terms = _terms(asked)
    counts = {r[0]: r[1] for r in terms.groupBy("__shape").count().collect()}
    shapes = sorted(counts)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), locations.count() * len(shapes) // TASK_ROWS + 1)
    cities = _layout(locations.repartitionByRange(tasks, F.lower("city")), shapes)
    found = [*locations.columns, "position", "__term", "__country"]
    whole = _best(cities.where("__whole").drop("__whole", "__gram"), _WHOLE[1:], n)
    # the best of each key stay where the window has dealt and sorted them; only terms are dealt
    answers = _hashed(terms.where("__whole"), _WHOLE[1:]).select(*_WHOLE, "__term", "__country")
    whole = whole.join(answers.hint("merge"), _WHOLE)
    like = candidates(cities, terms, sum(n for shape, n in counts.items() if shape.endswith(":false")))
    like = like.where(F.like(F.lower("city"), F.concat("__term", F.lit("%"))))
    best = whole.select(*found).unionByName(_best(like, ["__term", "__country"], n).select(*found))
    return best.join(asked.hint("merge"), ["__term", "__country"]).select("request_id", "position", *locations.columns)
