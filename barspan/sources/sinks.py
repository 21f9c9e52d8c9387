"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BOM = "\ufeff"


def write_results(df: DataFrame, path: str, *, digits: int | None = None, fixed: bool = False, bom: bool = False, partition_by: list[str] | None = None, fmt: str = "csv") -> None:
    """CSV (with header) or Parquet, doubles rounded on demand, one folder for each value of partition_by.

    fixed: doubles as text with exactly `digits` places (6 where not given).  bom: each CSV file
    begins with a byte order mark, as some spreadsheets want it.
    """
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    if fixed:
        df = df.withColumns({c: F.format_string(f"%.{6 if digits is None else digits}f", F.col(c)) for c in doubles})
    elif digits is not None:
        df = df.withColumns({c: F.round(c, digits) for c in doubles})
    if bom and fmt == "csv":
        first = next(c for c in df.columns if c not in (partition_by or []))
        df = df.withColumnRenamed(first, BOM + first)
    writer = df.write.partitionBy(*(partition_by or []))
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results written as CSV, all columns as text, without a byte order mark."""
    out = spark.read.option("header", True).csv(path)
    return out.withColumnsRenamed({c: c.removeprefix(BOM) for c in out.columns})


def write_return_matrix(returns: DataFrame, path: str, *, strategy: str = "strategy_id") -> None:
    """The long return table, one folder for each strategy."""
    returns.repartition(strategy).write.partitionBy(strategy).parquet(path)


def export_wide(returns: DataFrame, path: str, strategies: list[str], *, strategy: str = "strategy_id") -> None:
    """The return matrix as gzip CSV with one column for each of the given strategies."""
    returns.groupBy("ts").pivot(strategy, strategies).agg(F.first("ret")).write.option("header", True).option("compression", "gzip").csv(path)


def write_json_summary(summary: DataFrame, path: str) -> None:
    """A short table of nested results as JSON lines."""
    summary.write.json(path)
