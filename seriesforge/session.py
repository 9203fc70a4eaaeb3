"""Session helpers: a local session for tests / bench, and the shared scratch folder.

Library functions never build their own session; they take the caller's. Files that a
function must write (gold tables, chart bundles, CSV round trips) go below the folder the
cluster names in ``spark.checkpoint.dir`` — a shared file system every executor can reach.
Only when the session has none (local tests) do we create one.
"""

from __future__ import annotations

import tempfile
import time
import uuid
import weakref

from pyspark.sql import SparkSession

# Settings that matter for the plans in this package:
#  * AQE re-plans joins and aggregates from runtime sizes: small sides become broadcast
#    joins only when their measured size is below the threshold, skewed partitions are
#    split, tiny shuffle outputs are coalesced.
#  * the session time zone is pinned so DATE / TIMESTAMP casts are reproducible.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "seriesforge", extra: dict | None = None) -> SparkSession:
    """A local session configured like the tests and the benchmark expect."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written tables.

    Read from the running session: a checkpoint directory already set on the context, else the
    ``spark.checkpoint.dir`` setting. Only a local session without one (tests, the benchmark) gets
    a fresh folder of its own; on a cluster a missing setting is an error, because a machine-local
    folder is not visible to the executors.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a JVM context (Spark Connect)
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        conf_dir = conf_dir or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc is not None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not str(master).startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder on storage shared by all executors")
    local = tempfile.mkdtemp(prefix="seriesforge-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path below the shared folder (one per call)."""
    stamp = time.strftime("%Y%m%d%H%M%S", time.gmtime())
    return f"{shared_dir(spark).rstrip('/')}/seriesforge/{name}-{stamp}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Compute ``df`` once and cut its lineage: a reliable checkpoint in the shared folder.

    For a small result that several branches of a later plan read (a series and the future
    periods derived from it, the training rows of an iterative model). Lost executors then
    re-read the checkpoint instead of recomputing the input scan.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CACHES: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def session_cache(spark: SparkSession) -> dict:
    """A dict that lives as long as the session: resolved tables, checked dimensions."""
    return _CACHES.setdefault(spark, {})
