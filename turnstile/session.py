"""Session helpers: build a local session for tests/bench and resolve the
shared checkpoint folder from the session (never a machine-local default on a
cluster)."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the operators rely on; a cluster session may already carry them.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "turnstile") -> SparkSession:
    """Local session for tests and the bench (UI off, checkpoint dir in /tmp)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the session leaves it unset (local tests) do we pick a fresh
    scratch folder and register it; on a cluster the setting is expected to
    point at shared storage.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = tempfile.mkdtemp(prefix="turnstile-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:                                  # classic sessions: also register for checkpoint()
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 - e.g. Spark Connect has no SparkContext
        pass
    return current


def session_key(spark: SparkSession) -> str:
    """Stable id of the running application (for per-session memo tables)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return str(id(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint dir for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers on every executor, however
    the driver found it: a zip of the sources goes out once per application."""
    key = session_key(spark)
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix=f"{name}-src-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    try:
        spark.sparkContext.addPyFile(target)
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        spark.addArtifacts(target, pyfile=True)
    _SHIPPED.add(key)
