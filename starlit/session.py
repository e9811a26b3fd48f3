"""Session helpers: a tuned local/cluster session and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on. AQE re-plans joins at run time (broadcast when
# the built side turns out small, skew-split when one key is hot) and coalesces
# small shuffle partitions.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Window stages (framed medians) cost far more CPU per byte than the shuffle size
    # suggests; do not merge partitions below 256 KB (at scale partitions are far larger).
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "starlit",
                  driver_memory: str | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the settings the engine needs. Master, shuffle partitions and driver memory are left to
    the submitter (spark-submit, spark-defaults) unless given here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    given = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.driver.memory": driver_memory}
    for key, value in {**ENGINE_CONF, **{k: str(v) for k, v in given.items() if v is not None}, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``starlit`` importable in Python workers (executors): zip the package once per
    application into the shared checkpoint folder and register it with addPyFile.

    When the checkpoint folder is remote storage (hdfs://, s3a://, ...) nothing is written: on a
    cluster the package ships with the job (``spark-submit --py-files starlit.zip``)."""
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    folder = base[len("file:"):] if base.startswith("file:") else base
    if "://" in folder:
        _SHIPPED.add(app)
        return
    folder = os.path.join(folder, "starlit-pyfiles", app)
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, "starlit.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def apply_engine_conf(spark: SparkSession) -> None:
    """Turn on the runtime settings the plans assume (safe on any session) and make sure
    checkpoints have a folder (the session's spark.checkpoint.dir when set)."""
    for key, value in ENGINE_CONF.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001 - static conf on a shared session
            pass
    if getattr(spark, "_jsc", None) is None:  # a remote client: the server's own settings hold
        return
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; create a local one only when unset (tests)."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster, name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="starlit-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "starlit", name)
