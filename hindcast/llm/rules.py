"""Operator 3, quality rules: fixed base rules, and robust multivariate outliers by
minimum covariance determinant for each language and source.

Each text gives a vector of four statistics: the arcsine root of the shares of
symbols, capitals and sentence marks in its word characters, and the logarithm of the
mean word length.  Shares and means of short texts scatter more, so deviations from
the group's median shrink by sqrt(n / (n + 100)) of n words.  Within a group the
estimate has three starts, run side by side: the three quarters of rows nearest to the
median in units of the median deviation, by the sum of squares or by the largest one, and
all rows.  Concentration steps take mean and covariance of the chosen rows and choose
again the three quarters of least Mahalanobis distance, until no determinant falls any
more (``STEPS`` at most); a group keeps the start of least determinant, of equal ones the
first.  Rows at the edge's distance all count as chosen.  The covariance is scaled so that the median distance is that of a normal sample, and a small variance
is added to each statistic, as some (symbols) hardly vary among good texts.  Rows
beyond the cut-off are rejected.

Everything is DataFrame expressions.  The texts are read in one narrow pass that
writes one row of numbers for each document; groups are only ever aggregated (sums,
percentile sketches), so a source with a third of all rows is combined before the
shuffle, and parameters return to the rows by an equi-join that can split.

Groups under ``LEAST_ROWS`` rows are pooled within their language, and languages whose
pool is under that size in one pool of the whole corpus.  Only if that pool, too, is
smaller, so for under ``LEAST_ROWS`` rows in all, is there no estimate; the base rules
alone then decide.  Null
language or source counts as an empty one.  Null and empty texts have no words and
fail the base rules.  Repeated rows get equal results; an empty table gives no rows;
columns other than ``doc_id``, ``text``, ``lang`` and ``source`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hindcast.llm.common import stored
from hindcast.sources.tables import read_table

LEAST_ROWS = 50
FEW_GROUPS = 20_000
KEPT_SHARE = 0.75
STEPS = 6
#: Least fall of the logarithm of a determinant that calls for another step.
FALL = 1e-3
SHRINK_WORDS = 100
#: Squared distance of rejection, the chi-square quantile of 4 degrees at 1 - 6e-10.
CUT_OFF = 50.0
MEDIAN_CHI2_4 = 3.3567
#: Standard deviations added to the statistics, in the order of ``VECTOR``.
FLOORS = [0.02, 0.05, 0.03, 0.03]
VECTOR = ["symbols", "word_length", "capitals", "marks"]
GROUP = ["lang_key", "source_key"]

_WS = r"[\\x20\\x09-\\x0D]"
_WHITE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_MARKS = ".,;:!?"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _words_in_repeats() -> str:
    """(n words, words in 5-word windows that occur twice): windows by 64-bit hash;
    only texts with a hash twice sort them to find the windows and their union."""
    windows = "if(size(w) < 5, cast(array() as array<bigint>), transform(sequence(1, size(w) - 4), i -> xxhash64(slice(w, i, 5))))"
    ordered = "sort_array(transform(h, (x, i) -> struct(x, i)))"
    starts = ("sort_array(transform(filter(s, (y, k) -> (k > 0 and get(s, k - 1).x = y.x)"
              " or (k + 1 < size(s) and get(s, k + 1).x = y.x)), y -> y.i))")
    union = "aggregate(transform(p, (a, k) -> least(5, coalesce(get(p, k + 1) - a, 5))), 0, (t, v) -> t + v)"
    repeated = _let(ordered, "s", _let(starts, "p", union))
    counted = _let(windows, "h", f"if(size(array_distinct(h)) = size(h), 0, {repeated})")
    words = f"array_remove(split(coalesce(text, ''), '{_WS}+'), '')"
    return _let(words, "w", f"struct(size(w) as n, {counted} as r)")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as column ``row`` (a struct) with the base counts and the vector."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def share(chars: str) -> Column:
        return F.asin(F.sqrt((F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.col("word_chars"), F.lit(1))))

    own = docs.select(
        F.struct(*docs.columns).alias("row"), "text",
        F.coalesce(F.col("lang"), F.lit("")).alias("lang_key"), F.coalesce(F.col("source"), F.lit("")).alias("source_key"),
        F.expr(_words_in_repeats()).alias("words"), F.length(F.translate(text, _WHITE, "")).cast("long").alias("word_chars"))
    lines = f"filter(split(coalesce(text, ''), '\\n'), l -> l rlike '[^{_WS[1:-1]}]')"
    return own.select(
        "row", *GROUP, F.col("words.n").cast("long").alias("n_words"), "word_chars",
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(_let(lines, "l", "size(l) - size(array_distinct(l))")).cast("long").alias("n_dup_lines"),
        F.col("words.r").cast("long").alias("n_repeat_words"),
        share(_SYMBOLS).alias("symbols"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("words.n"), F.lit(1))).alias("word_length"),
        share(_CAPITALS).alias("capitals"), share(_MARKS).alias("marks")).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _distance(centre: str, factor: str) -> Column:
    """Squared Mahalanobis distance from the Cholesky factor, by forward substitution."""
    solved: list[Column] = []
    for i, x in enumerate(VECTOR):
        value = F.col(f"{x}") - F.col(f"{centre}{i}")
        for j in range(i):
            value = value - F.col(f"{factor}{i}{j}") * solved[j]
        solved.append(value / F.col(f"{factor}{i}{i}"))
    return sum((y * y for y in solved), F.lit(0.0))


def _factored(moments: DataFrame, scale: Column, floors: bool) -> DataFrame:
    """Adds the Cholesky factor f_ij of scale * covariance c_ij (plus the floors, or a
    tenth of them while concentrating)."""
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            left = F.col(f"c{i}{j}") * scale + (F.lit((FLOORS[i] * (1 if floors else 0.1)) ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                left = left - F.col(f"f{i}{k}") * F.col(f"f{j}{k}")
            moments = moments.withColumn(f"f{i}{j}", F.sqrt(left) if i == j else left / F.col(f"f{j}{j}"))
    return moments


def _shrunk(rows: DataFrame) -> DataFrame:
    """The vector pulled to the group's median (``m*``) as the text is short."""
    weight = F.sqrt(F.col("n_words") / (F.col("n_words") + SHRINK_WORDS))
    return rows.withColumns({x: F.col(f"m{i}") + (F.col(x) - F.col(f"m{i}")) * weight for i, x in enumerate(VECTOR)})


def _settled(spark: SparkSession, groups: DataFrame, name: str) -> DataFrame:
    """A table of one row for each group, computed now.  Up to ``FEW_GROUPS`` rows of at
    most 30 numbers (5 MB) come to the driver and are broadcast from there; more are
    written, and joined by a shuffle whose partitions can split."""
    rows = groups.limit(FEW_GROUPS + 1).collect()
    if len(rows) > FEW_GROUPS:
        return stored(spark, groups, name)
    return F.broadcast(spark.createDataFrame(rows, groups.schema))


def _sizes(numbers: DataFrame) -> DataFrame:
    """Small groups with the pool they fall to: their language's, or the corpus's."""
    sizes = numbers.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < LEAST_ROWS)
    pools = sizes.groupBy("lang_key").agg((F.sum("n") < LEAST_ROWS).alias("wide"))
    return sizes.join(pools, "lang_key").select(*GROUP, "wide")


def _pooled(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows whose group is small get their pool as a group."""
    pool = F.lit("\u0000pool")
    return rows.join(sizes, GROUP, "left").withColumns({
        "source_key": F.when(F.col("wide").isNotNull(), pool).otherwise(F.col("source_key")),
        "lang_key": F.when(F.col("wide"), pool).otherwise(F.col("lang_key"))}).drop("wide")


def _concentrated(spark: SparkSession, rows: DataFrame, spread: DataFrame) -> DataFrame:
    """Moments t*, c** of each group's subset of least determinant."""
    runs = [*GROUP, "start"]
    units = [((F.col(x) - F.col(f"m{i}")) / (1.4826 * F.col(f"d{i}") + FLOORS[i])) ** 2 for i, x in enumerate(VECTOR)]
    starts = F.array(sum(units, F.lit(0.0)), F.greatest(*units), F.lit(0.0))
    ranked = rows.join(spread, GROUP).select(*GROUP, *VECTOR, F.posexplode(starts).alias("start", "distance"))
    before = None
    for _ in range(STEPS):
        edge = _settled(spark, ranked.groupBy(*runs).agg(F.percentile_approx("distance", KEPT_SHARE, 1000).alias("edge")), "rules-edge")
        moments = ranked.join(edge, runs).where("distance <= edge").groupBy(*runs).agg(
            *(F.avg(x).alias(f"t{i}") for i, x in enumerate(VECTOR)),
            *(F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i in range(len(VECTOR)) for j in range(i + 1)))
        moments = _factored(moments, F.lit(1.0), floors=False).withColumn(
            "determinant", sum((2 * F.log(F.col(f"f{i}{i}")) for i in range(len(VECTOR))), F.lit(0.0)))
        moments = _settled(spark, moments, "rules-moments")
        now = moments.select(*runs, "determinant")
        if before is not None and now.join(before, runs).where(F.col("determinant") < F.col("last") - FALL).isEmpty():
            break
        before = now.withColumnRenamed("determinant", "last")
        ranked = rows.join(moments, GROUP).select(*runs, *VECTOR, _distance("t", "f").alias("distance"))
    kept = [c for c in moments.columns if c[0] in "tcf" and c[1:].isdigit()]
    least = moments.groupBy(*GROUP).agg(F.min_by(F.struct(*kept), F.struct("determinant", "start")).alias("m"))
    return _settled(spark, least.select(*GROUP, "m.*"), "rules-least")


def fitted(spark: SparkSession, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pools of small groups, parameters): medians m*, centre t* and factor f** of each
    group that is large enough.  ``numbers`` is a written table of ``measured`` columns."""
    sizes = _settled(spark, _sizes(numbers), "rules-sizes")
    rows = _pooled(numbers.where("n_words > 0").select(*GROUP, "n_words", *VECTOR), sizes)
    medians = rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(VECTOR)))
    medians = _settled(spark, medians.where(F.col("n") >= LEAST_ROWS).drop("n"), "rules-medians")
    rows = stored(spark, _shrunk(rows.join(medians, GROUP)).select(*GROUP, *VECTOR, *(f"m{i}" for i in range(len(VECTOR)))), "rules-vectors")
    spread = rows.groupBy(*GROUP).agg(*(
        F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, x in enumerate(VECTOR)))
    moments = _concentrated(spark, rows, _settled(spark, spread, "rules-spread"))
    middle = rows.join(moments, GROUP).withColumn("distance", _distance("t", "f")).groupBy(*GROUP).agg(
        F.percentile_approx("distance", 0.5, 1000).alias("middle"))
    moments = moments.drop(*(c for c in moments.columns if c[0] == "f"))
    scale = F.greatest(F.col("middle") / MEDIAN_CHI2_4, F.lit(1e-6))
    final = _factored(moments.join(_settled(spark, middle, "rules-middle"), GROUP), scale, floors=True)
    names = [c for c in final.columns if c[0] in "tf" and c[1:].isdigit()]
    return sizes, _settled(spark, medians.join(final.select(*GROUP, *names), GROUP), "rules-parameters")


def judged(rows: DataFrame, sizes: DataFrame, parameters: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with distance (null without a verdict) and kept."""
    names = [c for c in parameters.columns if c not in GROUP]
    found = _shrunk(_pooled(rows, sizes).join(parameters, GROUP, "left")).withColumn("distance", _distance("t", "f"))
    found = found.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT_OFF))
    return found.drop(*names)


NUMBERS = [*GROUP, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *VECTOR, "base_failed"]


def quality_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, distance) for each row."""
    numbers = stored(spark, measured(docs).select(F.col("row.doc_id").alias("doc_id"), *NUMBERS), "rules-numbers")
    found = judged(numbers, *fitted(spark, numbers))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "distance")


def passed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.  The numbers are made
    again beside the text, which is cheaper than to move texts for a join."""
    numbers = stored(spark, measured(docs).select(*NUMBERS), "rules-numbers")
    return judged(measured(docs), *fitted(spark, numbers)).where("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and outlier verdict of every document."""
    return quality_rules(spark, read_table(spark, sf_dir, "documents"))
