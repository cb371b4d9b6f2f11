"""Folders for intermediate files that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. A local session without it gets one of its own; a cluster
    gets an error, as its machines share no temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/jamolake-files"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
