"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Conf key naming the shared folder where this library writes intermediate
# tables; falls back to spark.checkpoint.dir.
WORK_DIR_CONF = "threatsift.work.dir"

_SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "threatsift",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    checkpoint folder is only set here when the cluster has not named one.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``threatsift`` importable in executor Python workers (pandas UDFs,
    mapInPandas, applyInPandas): zip the package once and add it with
    ``addPyFile``, which Spark distributes with the job. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_threatsift_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = os.path.join(tempfile.mkdtemp(prefix="threatsift-pkg-"), "threatsift.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._threatsift_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. One is created in the machine's
    temporary folder only for a local master (tests); any other session must
    set spark.checkpoint.dir to shared storage."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="threatsift-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def work_dir(spark: SparkSession) -> str:
    """Shared folder for tables this library writes (derived sources, history)."""
    base = spark.conf.get(WORK_DIR_CONF, None)
    if not base:
        base = ensure_checkpoint_dir(spark).rstrip("/") + "/work"
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the work folder."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a file: scheme for stdlib file access in tests."""
    return path[5:] if path.startswith("file:") else path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_arrow_batches(spark: SparkSession, rows: int = 500) -> None:
    """Few whole texts in one Arrow batch, unless the session sets its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


MIN_PARTITIONS_CONF = "threatsift.scan.minPartitions"
# Tables whose rows carry whole texts: per-row work on them is CPU-heavy.
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Opt-in parallelism for tables stored in few splits: with
    ``threatsift.scan.minPartitions`` set, a scan of fewer partitions is hash-
    repartitioned by ``key`` (only the columns a query reads cross that
    shuffle). Unset, the default, scans stay as they are."""
    target = df.sparkSession.conf.get(MIN_PARTITIONS_CONF, None)
    if not target or df.rdd.getNumPartitions() >= int(target):
        return df
    return df.repartition(int(target), key or df.columns[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXT_TABLES else df
