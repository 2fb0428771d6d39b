"""What the library needs to know of a session: where Python workers find it, and which folder all machines share."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def find_package(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster: ship it with ``--py-files``)."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the checkpoint folder that the application chose.

    A temporary folder stands in only where driver and executors are one process; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="rollweave-")
    return _own[sc.applicationId]


def checkpoint(df):
    """Eager reliable checkpoint in the shared folder: lineage is cut and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
