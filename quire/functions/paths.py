"""Shared work folders."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, which has no other machines, may do without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.conf.get("spark.master", "").startswith("local"):
        root = tempfile.mkdtemp(prefix="quire-")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{root.rstrip('/')}/quire/{purpose}-{uuid.uuid4().hex}"
