"""Tables that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def repeated(value, n: int) -> pd.Series:
    """A column that holds one value n times, as plain objects: Spark joins such columns of many groups into one batch."""
    return pd.Series([value] * n, dtype=object)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's spark.checkpoint.dir, which all executors share.

    Only where that is unset, on a local master, a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barspan-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
