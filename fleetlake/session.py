"""Session settings the library relies on, and shared scratch locations.

Every public entry point calls :func:`ensure_conf` so results do not depend on
how the caller built the session: hour buckets are UTC hours (the mart is
defined in UTC), ANSI mode stays on (bad casts fail loudly; the parsers use
``try_*`` forms on purpose) and AQE re-plans joins and shuffle sizes at run
time.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results or plans; applied at runtime, so they also hold
# for sessions created by someone else (tests, the driver, a notebook).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
# Partition overwrite mode is passed per write (dynamic for loads, static for
# full rebuilds) instead of being changed for the whole session.


def ensure_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "fleetlake",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster leave ``master`` unset so spark-submit decides; tests pass
    ``local[N]`` and a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return ensure_conf(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system or
    object store). Only when it is unset, as in local tests, a private temp
    folder is created and registered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fleetlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/fleetlake-scratch/{label}-{uuid.uuid4().hex[:12]}"


_GLOB_CHARS = "\\[]*?{}"


def literal_path(path: str) -> str:
    """``path`` with glob characters escaped: Spark's readers take it as it stands."""
    return "".join("\\" + c if c in _GLOB_CHARS else c for c in path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so plain Python can inspect a local path (tests only)."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
