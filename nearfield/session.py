"""Session settings and what Python workers need."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def session(master: str = "local[*]", partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; ``partitions`` overrides the shuffle default on small machines."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def reachable(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package from where the driver did.

    On a cluster that doesn't share it, ship the package with --py-files; the extra entry does no harm there.
    """
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    held = [x for x in environment.get("PYTHONPATH", "").split(":") if x]
    if root not in held:
        environment["PYTHONPATH"] = ":".join([root, *held])


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a local master has one temporary folder for the whole process; any other master is an error,
    since its executors would each write to a disk of their own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="nearfield-"))
    return _LOCAL[0]
