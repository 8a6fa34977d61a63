"""Session helpers.

The library never creates a cluster configuration of its own: on a cluster
the session comes from the platform. ``local_session`` is for tests, bench
and examples only.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
    "spark.ui.showConsoleProgress": "false",
    # Python call-site capture costs ~4 JVM round trips per DataFrame API call
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_live(spark: SparkSession) -> bool:
    """False once a classic session's context has been stopped."""
    try:
        return spark.sparkContext._jsc is not None
    except Exception:  # a session without a local SparkContext (e.g. Spark Connect)
        return True


def _own_scratch() -> str:
    """A folder of this process on this machine, removed when it ends."""
    path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("LEDGERLENS_SCRATCH"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a session whose
    master is this machine (tests, examples) gets a scratch folder of its own
    where the setting is missing; anywhere else that is an error, because a
    folder of the driver is not one that the executors share.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no local SparkContext (Spark Connect): the configured folder is all we have
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master or ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = _own_scratch()
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A path for a written table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
