"""Written tables in the folder that all nodes share."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; local sessions alone may leave that unset and get a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/tidewatch/{name}-{uuid.uuid4().hex}"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a path as Spark tells it (not percent-encoded), and the path in it."""
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: for what several branches of a plan read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
