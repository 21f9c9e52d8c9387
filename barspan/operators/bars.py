"""Bars: from ticks, cleaned, checked and profiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import positions, rolling


def ticks_to_bars(ticks: DataFrame, *, symbol: str, ts: str, price: str, volume: Column | None = None, tie: list[str], step_seconds: int = 3600) -> DataFrame:
    """symbol, ts, open, high, low, close, volume, row_pos: bars of step_seconds over ticks with a positive price.

    Partial aggregation before the shuffle; `tie` orders ticks of the same time.
    """
    order = F.struct(ts, *tie)
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / step_seconds) * step_seconds)
    bars = (
        ticks.filter(F.col(price) > 0)
        .groupBy(F.col(symbol).alias("symbol"), start.alias("_ts"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum(F.lit(1.0) if volume is None else volume).alias("volume"),
        )
        .withColumnRenamed("_ts", "ts")
    )
    return positions(bars)


def coarser(bars: DataFrame, step_seconds: list[int], *, keys: tuple[str, ...] = ("symbol",), origin: int = 0) -> DataFrame:
    """keys, step, ts and the bars of every coarser step, rolled up from finer ones in one aggregation.

    Bars merge: the open of the earliest, the close of the latest, the extremes and the sum of volumes.
    Each step must be a multiple of the finer bars' own.
    """
    t = F.unix_timestamp("ts")
    step = F.explode(F.array(*[F.lit(s) for s in step_seconds])).alias("step")
    fine = bars.select(*keys, step, t.alias("_t"), "open", "high", "low", "close", "volume")
    start = (F.floor((F.col("_t") - origin) / F.col("step")) * F.col("step") + origin).alias("_start")
    out = fine.groupBy(*keys, "step", start).agg(F.min_by("open", "_t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_t").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumn("ts", F.timestamp_seconds("_start")).drop("_start")


PRICES = ("open", "high", "low", "close")


def clean(raw: DataFrame, *, keys: tuple[str, ...] = ("symbol", "ts"), seq: str = "ingest_seq", keep: str = "last") -> DataFrame:
    """Rows with all prices, one per key: the last or first in order of ingestion."""
    order = F.desc(seq) if keep == "last" else F.asc(seq)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return raw.dropna(subset=[*keys, *[c for c in PRICES if c in raw.columns]]).withColumn("_n", place).filter("_n = 1").drop("_n")


def inconsistencies() -> dict[str, Column]:
    """Named OHLC checks, each a condition that should not hold."""
    o, h, low, c = (F.col(x) for x in PRICES)
    return {
        "high_below_body": h < F.greatest(o, c),
        "low_above_body": low > F.least(o, c),
        "high_below_low": h < low,
        "open_outside": (o > h) | (o < low),
        "close_outside": (c > h) | (c < low),
        "non_positive": F.least(o, h, low, c) <= 0,
    }


def profile(raw: DataFrame, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows, distinct times, duplicates, missing values, first and last time and OHLC checks per key."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in (*PRICES, "volume")]
    checks = [F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in inconsistencies().items()]
    per_time = raw.groupBy(key, ts).agg(F.count("*").alias("_n"), *missing, *checks)
    names = [*(f"missing_{c}" for c in (*PRICES, "volume")), *inconsistencies()]
    return per_time.groupBy(key).agg(
        F.sum("_n").alias("raw_rows"),
        F.count(ts).alias("clean_rows"),
        (F.sum("_n") - F.count(ts)).alias("duplicate_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *[F.sum(n).alias(n) for n in names],
    )


def steps(bars: DataFrame) -> DataFrame:
    """Add previous_ts and the seconds since it, in chunks; places are counted where row_pos is not there yet."""
    placed = bars if "row_pos" in bars.columns else positions(bars)
    out = rolling(placed, {"previous_ts": lambda w: F.lag("ts").over(w)}, back=1)
    return out.withColumn("seconds", F.unix_timestamp("ts") - F.unix_timestamp("previous_ts"))


def gaps(bars: DataFrame, step_seconds: int) -> DataFrame:
    """Gap events: a bar later than one step after the one before, with the bars missing between."""
    found = steps(bars).select("symbol", "ts", "previous_ts", F.col("seconds").alias("gap_seconds"))
    return found.filter(F.col("gap_seconds") > step_seconds).withColumn("missing_bars", F.floor(F.col("gap_seconds") / step_seconds) - 1)


def gap_summary(bars: DataFrame, step_seconds: int) -> DataFrame:
    """Steps off the expected one, over 1.01 and 1.5 times and over 3 bars; smallest and largest step."""
    step = steps(bars).select("symbol", F.col("seconds").alias("d"))
    d = F.col("d")
    return step.groupBy("symbol").agg(
        F.count_if(d != step_seconds).alias("off_steps"),
        F.count_if(d > 1.01 * step_seconds).alias("gaps"),
        F.count_if(d > 1.5 * step_seconds).alias("wide_gaps"),
        F.count_if(d > 3 * step_seconds).alias("long_gaps"),
        F.count_if(d <= 0).alias("non_monotonic"),
        F.min("d").alias("min_step"),
        F.max("d").alias("max_step"),
    )


def completeness(bars: DataFrame, step_seconds: int) -> DataFrame:
    """Rows expected if continuous, rows missing, and PASS or WARN."""
    out = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    expected = ((F.unix_timestamp("b") - F.unix_timestamp("a")) / step_seconds + 1).cast("bigint")
    out = out.select("symbol", "rows", expected.alias("expected_rows"), (expected - F.col("rows")).alias("missing_rows"))
    return out.withColumn("status", F.when(F.col("missing_rows") == 0, "PASS").otherwise("WARN"))


def common_period(bars: DataFrame, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars inside the period that all symbols share, clipped to the given bounds (inclusive)."""
    spans = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).agg(F.max("a").alias("a"), F.min("b").alias("b"))
    if start:
        spans = spans.withColumn("a", F.greatest("a", F.to_timestamp(F.lit(start))))
    if end:
        spans = spans.withColumn("b", F.least("b", F.to_timestamp(F.lit(end))))
    return bars.join(F.broadcast(spans), (F.col("ts") >= F.col("a")) & (F.col("ts") <= F.col("b"))).drop("a", "b")


def timeframe(bars: DataFrame) -> DataFrame:
    """Median and mode of the steps (mode among steps of at most 3 medians, smallest first) and its share."""
    d = steps(bars).select("symbol", F.col("seconds").alias("d")).filter("d is not null")
    mid = d.groupBy("symbol").agg(F.percentile("d", 0.5).alias("median_step"), F.count("*").alias("n"))
    counts = d.groupBy("symbol", "d").agg(F.count("*").alias("k")).join(mid, "symbol").filter(F.col("d") <= 3 * F.col("median_step"))
    best = counts.groupBy("symbol", "median_step", "n").agg(F.max_by(F.struct("d", "k"), F.struct("k", -F.col("d"))).alias("m"))
    return best.select("symbol", "median_step", F.col("m.d").alias("mode_step"), (F.col("m.k") / F.col("n")).alias("mode_share"))


def bars_per_year(bars: DataFrame, step_seconds: int) -> DataFrame:
    """By timeframe at five days a week, by rows over elapsed years, and by rows per weekday times 252."""
    year = 365.25 * 86400
    out = bars.groupBy("symbol").agg(
        F.count("*").alias("n"),
        (F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).alias("span"),
        F.count_if(F.weekday("ts") < 5).alias("work_rows"),
        F.count_distinct(F.when(F.weekday("ts") < 5, F.to_date("ts"))).alias("days"),
    )
    return out.select(
        "symbol",
        F.lit(year / step_seconds * 5 / 7).alias("by_timeframe"),
        (F.col("n") / (F.expr("nullif(span, 0)") / F.lit(year))).alias("by_elapsed"),
        (F.col("work_rows") / F.expr("nullif(days, 0)") * 252).alias("by_weekday"),
    )
