"""SparkSession construction and session-level helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on.  UTC is mandatory: every instant in the data
# model is a UTC timestamp and local calendar dates are derived explicitly.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Settings that shape the physical plan at scale.  AQE re-plans joins from
# runtime sizes, coalesces small shuffle partitions and splits skewed join
# partitions; they are defaults in Spark 4 but are pinned here on purpose.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    # Wide marts are hundreds of column calls; their call sites need not be recorded.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hindcast") -> SparkSession:
    """Create (or reuse) a session configured for the library.

    ``master`` defaults to ``local[$BENCH_CPUS or *]`` so tests and the bench run
    in-process; on a cluster pass ``master=None`` and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(REQUIRED_CONF)
    conf.update(SCALE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


_SIBLINGS: dict[tuple, SparkSession] = {}


def sibling(spark: SparkSession, **conf: str) -> SparkSession:
    """A session beside ``spark`` with its settings but for ``conf`` (``__`` stands for a
    dot), so that nothing of the caller's changes, even for a moment.  One for each
    session and ``conf``."""
    key = (id(spark._jsparkSession), *sorted(conf.items()))
    own = _SIBLINGS.setdefault(key, None) or spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    use_utc(own)
    for k, v in conf.items():
        own.conf.set(k.replace("__", "."), v)
    _SIBLINGS[key] = own
    return own


def use_utc(spark: SparkSession) -> None:
    """Pin the session time zone the library's expressions assume."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets that (a shared, fault-tolerant path).  Only
    when it is unset (tests, local runs) do we create a scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="hindcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured
