"""Bars and side series of the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.operators.bars import ticks_to_bars

HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, step: int = HOUR) -> DataFrame:
    """Hourly bars of events: one symbol for each event type."""
    return ticks_to_bars(table(spark, sf_dir, "events"), symbol="event_type", ts="ts", price="value", tie=["event_id"], step_seconds=step)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of lineitem: one symbol for each return flag, price per unit."""
    ticks = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return ticks_to_bars(ticks, symbol="l_returnflag", ts="l_shipdate", price="price", volume=F.col("l_quantity"), tie=["l_orderkey", "l_linenumber"], step_seconds=86400)


def _bars_sql(symbol: str, ts: str, price: str, volume: str, tie: str, source: str, step: int, name: str) -> str:
    return f"""{name}0 AS (SELECT {symbol} AS symbol, to_timestamp(floor(epoch({ts}) / {step}) * {step}) AT TIME ZONE 'UTC' AS ts, {price} AS price, {volume} AS vol,
  row({ts}, {tie}) AS ord FROM {source} WHERE {price} > 0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row_pos FROM (
  SELECT symbol, ts, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low, arg_max(price, ord) AS "close", sum(vol) AS volume FROM {name}0 GROUP BY symbol, ts))"""


def hourly_sql(step: int = HOUR, name: str = "bars") -> str:
    return _bars_sql("event_type", "ts", "value", "1.0::DOUBLE", "event_id", "events", step, name)


def daily_sql(name: str = "days") -> str:
    return _bars_sql("l_returnflag", "l_shipdate", "l_extendedprice / l_quantity", "l_quantity", "l_orderkey, l_linenumber", "lineitem", 86400, name)
