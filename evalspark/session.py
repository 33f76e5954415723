"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "evalspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC and adaptive execution.

    Shuffle partition counts are left to the caller: AQE coalesces a generous number, so a
    cluster should set ``spark.sql.shuffle.partitions`` to two or three times its cores.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Rank filters up to this bound are applied before the shuffle as well.
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a session in one local process (unit tests) may
    do without and gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="evalspark-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "evalspark")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder, for tables written between steps.

    What lies there is needed as long as tables derived from it are; ``release_scratch`` removes all of it, at the latest
    when the driver ends.
    """
    if not _exit_hooks:
        _exit_hooks.append(atexit.register(_release_active))
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


_exit_hooks: list = []


def _release_active() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release_scratch(spark)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this session."""
    remove_path(spark, scratch_root(spark))
