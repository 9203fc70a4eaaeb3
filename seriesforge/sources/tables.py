"""Gold tables: save and load, plus the driver's Parquet tables.

Overwriting files in place is not atomic and destroys a table that the same plan reads. So every
save writes a new version next to the old one and switches a pointer when it is complete (see
:mod:`seriesforge.sources.versions`); readers resolve the newest. A save whose plan reads an older version of
the table it replaces, or that another save overtakes, fails instead of losing the other's change.
``fmt="delta"`` has versions of its own and works when the caller's session has that connector on its classpath.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import quoted_all
from ..session import session_cache
from . import versions

DEFAULT_FORMAT = "parquet"


def save_table(df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT, mode: str = "overwrite",
               partition_by: Sequence[str] = (), cluster: bool = True, keep: int | None = None,
               based_on: str | None = None, check_base: bool = True) -> str:
    """Write ``df`` as the newest version of the table at ``path``. Returns the path.

    ``mode`` is ``overwrite`` (a new version; the plan may read the table itself, and a failed save
    leaves it as it was) or ``error`` (fail if there is anything at ``path``). ``keep`` removes older versions after
    the switch, all but that many newest ones; readers of those would fail.

    Changes are not lost: if the plan reads the table itself, it must read the newest version, and that must still be
    the newest when the new one is complete; else :class:`~seriesforge.sources.versions.ConcurrentSaveError`. What the plan
    reads is seen from its input files. A checkpoint hides them: name the version it came from as ``based_on``
    (from :func:`table_version`; None with ``check_base`` off overwrites whatever there is).

    With ``partition_by`` the rows are first range-partitioned on the partition columns (then the
    others, as tie-breakers): every task covers a contiguous slice and writes into one or two
    partition directories, instead of every task writing a small file into every directory, and
    a partition value holding a large share of the rows is still spread over several tasks.
    """
    if mode not in ("overwrite", "error"):
        raise ValueError(f"mode must be 'overwrite' or 'error', got {mode!r}")
    spark, root = df.sparkSession, path.rstrip("/")
    if mode == "error" and fmt != "delta" and not versions.is_empty(spark, root):
        raise FileExistsError(f"table {path!r} exists")
    if fmt != "delta":
        claim = versions.begin(spark, root)
        base = {based_on} if based_on is not None else versions.versions_read(df, root) if check_base else set()
        now = table_version(spark, root)
        if base and base != {now}:
            raise versions.ConcurrentSaveError(f"the plan builds on {sorted(base)} of {path!r}, the newest version is {now!r}")
    if partition_by and cluster:
        from ..operators.series import tie_breakers
        df = df.repartitionByRange(*quoted_all(partition_by), *tie_breakers(df, list(partition_by)))
    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "delta":
        writer.mode(mode).save(root)
        return path
    writer.save(claim.path)
    versions.publish(spark, claim, keep)
    return path


def table_version(spark: SparkSession, path: str) -> str | None:
    """Name of the newest version of a saved table, None if there is none."""
    target = versions.newest(spark, path.rstrip("/"))
    return target.rsplit("/", 1)[1] if target else None


def load_table(spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT) -> DataFrame:
    """Read the newest version of a saved table with its stored schema (column metadata included for
    Parquet); a folder without versions is read as it is."""
    target = None if fmt == "delta" else versions.newest(spark, path.rstrip("/"))
    return spark.read.format(fmt).load(target or path)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the generated (read-only) benchmark tables: ``<sf_dir>/<name>.parquet``.

    Resolved once per session, like a catalog table: the DataFrame keeps its file index, so
    later queries don't list the files and read the footers again (on a large table in object
    storage that listing alone takes long). The tables never change while a session runs.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    cache = session_cache(spark)
    if path not in cache:
        cache[path] = spark.read.parquet(path)
    return cache[path]
