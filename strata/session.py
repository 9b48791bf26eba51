"""Session settings shared by tests, benchmarks and the driver entry."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "strata") -> SparkSession:
    """A local session with the settings every query assumes (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STRATA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names that folder; only where it is unset and everything runs in
    this process (tests, a laptop) a temporary one is used, and deleted at the end.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or _own_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _temporary() -> str:
    path = tempfile.mkdtemp(prefix="strata-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def _own_root(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    return _temporary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` holds at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a result that is used several
    times is computed once, and the loss of an executor doesn't reach behind it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    _delete_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS: list[tuple[SparkSession, str]] = []


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Results read from a cut are lazy, so its folder stays while the driver runs and goes when it ends."""
    if not _CUTS:
        atexit.register(delete_cuts)
    _CUTS.append((spark, path))


def delete_cuts() -> None:
    """Deletes the folders of all cuts made so far; a long-lived driver calls it between its jobs."""
    while _CUTS:
        spark, path = _CUTS.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended; what is left is only space
            continue
