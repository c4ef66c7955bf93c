"""Landing: write the bridged raw tables once, physically laid out like the
warehouse's raw dataset (S3, S6), and read them back for every model query.

The reference lands events into date-partitioned, location-clustered raw tables
and runs its models as views over them.  Here the bridge output is written to
Parquet under the shared checkpoint folder (``spark.checkpoint.dir``):

* ``partitionBy(<date column>)`` so filters on the date prune directories,
* a ``REBALANCE(<date>)`` hint: rows are hashed by date and AQE splits a large
  day into advisory-sized tasks and merges small ones, so files stay few and
  even without a sampling pass over the input (a range shuffle would run the
  upstream plan once more to sample it),
* ``sortWithinPartitions(date, location_id, ...)`` for row-group statistics.

A folder is reused only when it holds Spark's ``_SUCCESS`` marker and the
inputs' sizes and times match (the key is derived from them).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.session import ensure_checkpoint_dir, sibling
from hindcast.sources.bridge import Bridge, model_run_events, operational_raw, verification_raw

# table -> (date column name, source instant, clustering columns)
LAYOUT = {
    "locations": (None, None, ["location_id"]),
    "model_run_events": ("run_date", "forecast_run_at", ["location_id", "model_id", "event_id"]),
    "verification_weather_events": ("period_date", "period_start", ["location_id", "source", "event_id"]),
    "operational_forecast_events": ("retrieved_date", "retrieved_at", ["location_id", "event_id"]),
}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _code_digest() -> str:
    """Digest of the library source, so a code change never reuses stale tables."""
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for dirpath, _, files in sorted(os.walk(pkg)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(f.encode() + fh.read())
    return h.hexdigest()


def _input_key(spark: SparkSession, sf_dir: str) -> str:
    h = hashlib.sha1(os.path.abspath(sf_dir).encode())
    h.update(_code_digest().encode())
    for name in ("events", "customer", "nation", "region"):
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        fs, p = _fs(spark, path)
        summary = fs.getContentSummary(p)
        status = fs.getFileStatus(p)
        h.update(f"{name}:{summary.getLength()}:{summary.getFileCount()}:{status.getModificationTime()}".encode())
    return h.hexdigest()[:16]


def laid_out(packs: DataFrame, table: str, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows(packs)``, dealt by date and sorted by the clustering columns that the packs
    have.  ``rows`` is a projection; it widens the rows after the shuffle and the sort, so
    neither ids nor payload text go through them."""
    date_col, instant, cluster = LAYOUT[table]
    cluster = [c for c in cluster if c in packs.columns]
    if date_col is None:
        return rows(packs.hint("rebalance", cluster[0]).sortWithinPartitions(*cluster))
    out = packs.withColumn(date_col, F.to_date(instant))
    return rows(out.hint("rebalance", date_col).sortWithinPartitions(date_col, *cluster))


def land(packs: DataFrame, path: str, table: str, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    out = laid_out(packs, table, rows).write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(LAYOUT[table][0]) if LAYOUT[table][0] else out).parquet(path)


def landed_root(spark: SparkSession, sf_dir: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/landed/{_input_key(spark, sf_dir)}"


# Per-session memo of landed paths and of the DataFrames read from them: a
# DataFrame keeps its file index, so later queries skip listing and footers.
_PATHS: dict[tuple, str] = {}
_READS: dict[tuple, DataFrame] = {}


def _session_key(spark: SparkSession, *parts) -> tuple:
    return (id(spark._jsparkSession), ensure_checkpoint_dir(spark)) + parts


def land_tables(spark: SparkSession, sf_dir: str, tables: Iterable[str], force: bool = False) -> dict[str, str]:
    """Land the named raw tables derived from ``sf_dir`` (idempotent); return their paths.
    A query lands only what it reads."""
    memo = {t: _session_key(spark, "land", os.path.abspath(sf_dir), t) for t in tables}
    todo = [t for t in memo if force or memo[t] not in _PATHS]
    if todo:
        root = landed_root(spark, sf_dir)
        b = Bridge.load(spark, sf_dir)
        builders = {
            "locations": (b.locations, lambda df: df),
            "model_run_events": (b.model_run_packs, model_run_events),
            "verification_weather_events": (b.verification_packs, verification_raw),
            "operational_forecast_events": (b.operational_packs, operational_raw),
        }
        writes = []
        for table in todo:
            path = f"{root}/{table}"
            if force or not _exists(spark, f"{path}/_SUCCESS"):
                packs, rows = builders[table]
                df = packs()  # built on this thread; only the write runs concurrently
                writes.append((lambda d=df, p=path, t=table, r=rows: land(d, p, t, r)))
        run_concurrently(writes)
        _PATHS.update({memo[t]: f"{root}/{t}" for t in todo})
    return {t: _PATHS[memo[t]] for t in memo}


def land_all(spark: SparkSession, sf_dir: str, force: bool = False) -> dict[str, str]:
    """Land every raw table derived from ``sf_dir`` (idempotent); return paths."""
    return land_tables(spark, sf_dir, LAYOUT, force)


def run_concurrently(writes: list, max_jobs: int = 4) -> None:
    """Run independent table writes as concurrent Spark jobs.

    Each write is its own job; submitting them from a few driver threads lets
    the scheduler fill cores that one job's last, straggling tasks leave idle
    (and overlaps the driver-side planning of the jobs).  The first error is
    raised after every write has finished."""
    if len(writes) <= 1:
        for w in writes:
            w()
        return
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=min(max_jobs, len(writes))) as pool:
        futures = [pool.submit(w) for w in writes]
    for f in futures:
        f.result()


def _read(spark: SparkSession, path: str) -> DataFrame:
    memo = _session_key(spark, "read", path)
    if memo not in _READS:
        _READS[memo] = spark.read.parquet(path)
    return _READS[memo]


def read_landed(spark: SparkSession, sf_dir: str, table: str, keep_date: bool = False) -> DataFrame:
    df = _read(spark, land_tables(spark, sf_dir, [table])[table])
    date_col = LAYOUT[table][0]
    if date_col and not keep_date:
        df = df.drop(date_col)
    return df


# Typed intermediate tables: parsed once from JSON, read by every mart.
INTERMEDIATE_LAYOUT = {
    "int_model_run_hourly_forecasts": ("run_date", "forecast_run_at", ["location_id", "model_id", "valid_at"]),
    "int_verification_hourly_weather": ("period_date", "period_start", ["location_id", "valid_at"]),
    "int_operational_hourly_forecasts": ("retrieved_date", "retrieved_at", ["location_id", "valid_at"]),
}


# A scan task of the build: its typed rows are some twenty times as large and are sorted.
BUILD_SPLIT_BYTES = 16 << 20


def build_session(spark: SparkSession) -> SparkSession:
    """``spark`` with small scan splits."""
    return sibling(spark, spark__sql__files__maxPartitionBytes=str(BUILD_SPLIT_BYTES))


def materialize(df: DataFrame, path: str, date_col: str, instant: str, cluster: list[str]) -> None:
    """Write typed rows of a raw table by its date.  The raw files are kept by that date
    and hold neighbouring locations, so a scan task's rows stay where they are: they are
    sorted, not dealt anew."""
    out = df.withColumn(date_col, F.to_date(instant)).sortWithinPartitions(date_col, *cluster)
    out.write.mode("overwrite").option("compression", "zstd").partitionBy(date_col).parquet(path)


def _raw_for_build(spark: SparkSession, own: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = own.read.parquet(land_tables(spark, sf_dir, [table])[table])
    return df.drop(LAYOUT[table][0]) if LAYOUT[table][0] else df


def build_intermediate(spark: SparkSession, sf_dir: str, force: bool = False, tables: Iterable[str] | None = None) -> dict[str, str]:
    """Write the typed intermediate layer, or the named tables of it (idempotent); return paths."""
    from hindcast.plans.models import Models

    memo = {t: _session_key(spark, "int", os.path.abspath(sf_dir), t) for t in tables or INTERMEDIATE_LAYOUT}
    todo = [t for t in memo if force or memo[t] not in _PATHS]
    if todo:
        root = landed_root(spark, sf_dir)
        own = build_session(spark)
        raw = {t: partial(_raw_for_build, spark, own, sf_dir, t) for t in LAYOUT}
        m = Models(*raw.values(), in_files=True)
        writes = []
        for table in todo:
            date_col, instant, cluster = INTERMEDIATE_LAYOUT[table]
            path = f"{root}/{table}"
            if force or not _exists(spark, f"{path}/_SUCCESS"):
                df = getattr(m, table)  # built on this thread; only the write runs concurrently
                writes.append((lambda d=df, p=path, dc=date_col, i=instant, c=cluster: materialize(d, p, dc, i, c)))
        run_concurrently(writes)
        _PATHS.update({memo[t]: f"{root}/{t}" for t in todo})
    return {t: _PATHS[memo[t]] for t in memo}


def read_intermediate(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = build_intermediate(spark, sf_dir, tables=[table])[table]
    return _read(spark, path).drop(INTERMEDIATE_LAYOUT[table][0])
