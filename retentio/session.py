"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the library needs regardless of cluster size. Periods are cut from
# timestamps, so the session time zone must be fixed; AQE coalesces the many
# small shuffle partitions of the aggregated frames and splits skewed ones.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "retentio", extra: dict | None = None) -> SparkSession:
    """Session for tests, the bench and local runs."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to a session created elsewhere, and let go of
    the frames that earlier queries of this session persisted."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    release()
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package, also when the driver found it
    by ``sys.path`` alone. On a cluster with the package installed this changes nothing."""
    try:
        env = spark.sparkContext.environment
    except Exception:  # noqa: BLE001 -- Spark Connect: the server owns its workers
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if here not in known:
        env["PYTHONPATH"] = os.pathsep.join([here, *known])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared (HDFS/object store) folder. Only
    a ``local`` master (tests, a laptop), where driver and executors are one
    process, falls back to a fresh local folder; elsewhere its absence is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: no SparkContext, the server owns the setting
        sc = None
    active = sc.getCheckpointDir() if sc is not None else None
    if active:
        return active
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    current = spark.conf.get("spark.checkpoint.dir", None) or local_fallback(master)
    spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None:
        sc.setCheckpointDir(current)
    return current


def local_fallback(master: str) -> str:
    """A fresh machine-local folder, for local masters only."""
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="retentio-ckpt-")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used before iterative work (model fits, per-cluster loops) so a lost
    executor re-reads the checkpoint instead of replaying the whole plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: for narrow frames that several
    scans of one query share. A lost executor re-reads the table; scans take only the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/retentio-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that several actions of one query reuse (recomputable from lineage)."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(out)
    return out


_SET: list[tuple[SparkSession, str, str | None]] = []


def set_for_query(spark: SparkSession, key: str, value: str) -> None:
    """Set a session setting that the frames of the current query need when they run; :func:`release` puts it back."""
    before = spark.conf.get(key, None)
    if before != value:
        _SET.append((spark, key, before))
        spark.conf.set(key, value)


def release() -> None:
    """Unpersist what :func:`keep` holds and put back what :func:`set_for_query` set. A frame still in use is only recomputed."""
    while _KEPT:
        try:
            _KEPT.pop().unpersist()
        except Exception:  # noqa: BLE001 -- the frame's session has been stopped
            pass
    while _SET:
        spark, key, before = _SET.pop()
        try:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        except Exception:  # noqa: BLE001 -- the session has been stopped
            pass


def keep_fanout(df: DataFrame) -> DataFrame:
    """Persist a small aggregate read by several branches of one plan.

    Without it each branch re-runs the upstream plan (Catalyst prunes the
    branches differently, so their exchanges are not reused). Switched off
    with RETENTIO_PERSIST_FANOUT=0 (useful to compare plans).
    """
    if os.environ.get("RETENTIO_PERSIST_FANOUT", "1") == "0":
        return df
    return keep(df)


# A side is broadcast only when counting it gave at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it was counted small; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
