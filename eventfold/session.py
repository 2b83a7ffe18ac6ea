"""Session construction and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "eventfold",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """A session with AQE, skew-join handling and no UI.

    On a cluster ``master`` stays None so spark-submit decides; tests and
    the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir`` of the session; it is a core setting, so the
    session shows it although it cannot be changed at run time."""
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A path for new data under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session and never changed. Where it is unset,
    a local session gets a temporary folder of this process (all its tasks run
    on this machine); any other session gets a clear error, as a
    machine-local folder could not be read by the other machines.
    """
    base = _configured_dir(spark)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base.rstrip("/"), f"{purpose}-{uuid.uuid4().hex[:12]}")


@functools.cache
def _local_dir() -> str:
    """One folder a process, removed at its end."""
    path = tempfile.mkdtemp(prefix="eventfold-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scale_conf(input_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Settings sized from the input volume, for spark-submit or the builder.

    Shuffle partitions start at input / 256 MiB and AQE coalesces
    them after each stage from measured sizes; scans split files into
    256 MiB; a shuffle partition five times the median and over 1 GiB is
    split by the skew-join rule. Broadcast stays on the size check AQE
    applies at run time (the threshold below).
    """
    n = max(200, -(-input_bytes // partition_bytes))
    mib = f"{partition_bytes // (1024 * 1024)}m"
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mib,
        "spark.sql.files.maxPartitionBytes": mib,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    }
