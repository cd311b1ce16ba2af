"""Session helpers: building a session for tests/bench and locating the
shared folder that jobs write intermediate tables, models and outputs to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "dailycast", extra: dict | None = None) -> SparkSession:
    """Session with the settings the library assumes (UTC, AQE, no UI)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Broadcast joins only on measured sizes (AQE, at run time) or after an
        # explicit bounded check (checked_broadcast); never on file-size guesses.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """Folder on the cluster's shared file system for this application.

    Uses ``spark.checkpoint.dir`` (or the context's checkpoint dir) as set by
    the cluster.  Only when neither is set (tests, local runs) a folder is
    created and registered as the checkpoint dir.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="dailycast-")
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    path = "/".join([base.rstrip("/"), "dailycast", *parts])
    if path.startswith("/") or path.startswith("file:"):
        os.makedirs(path.replace("file:", "", 1), exist_ok=True)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder (never reused)."""
    return shared_dir(spark, "scratch") + f"/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint dir.

    A reliable checkpoint survives executor loss (unlike a local one)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_SHIPPED: set[str] = set()


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write ``data`` to ``path`` on the cluster file system (any Hadoop URI)."""
    if path.startswith("/") or path.startswith("file:"):
        with open(path.replace("file:", "", 1), "wb") as f:
            f.write(data)
        return
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def ship_package(spark: SparkSession) -> None:
    """Make ``dailycast`` importable on executors (Python workers): a zip of
    the package is written to the shared folder and added with
    ``addPyFile``.  Done once per application."""
    import io
    import zipfile

    import dailycast

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(dailycast.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(root):
            for fn in sorted(files):
                if fn.endswith(".py"):
                    full = os.path.join(dirpath, fn)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    target = shared_dir(spark, "pkg") + f"/dailycast-{uuid.uuid4().hex[:8]}.zip"
    _write_bytes(spark, target, buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(app)
