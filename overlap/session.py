"""Session helpers: a tuned local session for tests/bench, and the shared scratch folder.

Library functions never build their own session; they take the caller's ``spark``.
Scratch output (bucketed tables, staged partials, streaming checkpoints) goes under the
folder the cluster names in ``spark.checkpoint.dir``; only a local-mode session without that
setting gets a private temporary folder (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings that matter for this workload (see README "Configuration").
TUNED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sketch aggregates (theta/hll/collect_set) run in ObjectHashAggregate; the default
    # fallback to sort-based aggregation after 128 keys per task costs a sort per task for
    # the few-thousand (location, interest) groups of a pair query.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "overlap",
                  extra: dict | None = None) -> SparkSession:
    """A local[N] session with the tuned settings (tests and bench only)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(TUNED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder every executor can reach "
            "(e.g. on HDFS/S3) before running jobs that stage data")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="overlap-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder (never reused across runs)."""
    root = ensure_checkpoint_dir(spark)
    base = os.path.dirname(root.rstrip("/")) if "/" in root else root
    return f"{base}/overlap-scratch/{name}-{uuid.uuid4().hex[:12]}"
