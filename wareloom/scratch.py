"""Where intermediate tables go: a folder that the driver and every executor see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where none is named, a temporary folder of this machine
    if Spark runs in this process alone (tests), else one in the warehouse, which all share."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            root = _OWN.setdefault("root", f"file://{tempfile.mkdtemp(prefix='wareloom-')}")
        else:
            root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
