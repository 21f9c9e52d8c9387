"""As-of and interval joins of a slower side series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stacked(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Both sides in one table: right rows hold their values, left rows their whole row."""
    whole = F.struct(*[F.col(c) for c in left.columns])
    value = F.struct(F.col(right_ts).alias("side_ts"), *values)
    a = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), whole.alias("_row"))
    known = right.dropna(subset=[*keys, right_ts]).dropDuplicates([*keys, right_ts])
    b = known.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), value.alias("_value"))
    return a.unionByName(b, allowMissingColumns=True)


def _carry(stacked: DataFrame, keys: list[str], span: str, *, ahead: bool = False) -> DataFrame:
    """_b: the last side value at or before each left row; with ahead also _a: the first one after it.

    Rows are scanned inside calendar spans; one row for each span carries the last value on and the
    first one back, so a key with a long history is many tasks.  Left rows with a null key or time
    stay and find nothing.
    """
    s = stacked.withColumn("_span", F.date_trunc(span, "_t"))
    side_t = F.when(F.col("_side") == 0, F.col("_t"))
    spans = s.groupBy(*keys, "_span").agg(F.max_by("_value", side_t).alias("_end"), F.min_by("_value", side_t).alias("_start"))

    def scan(row: str, end: str, forth: bool) -> tuple[Column, Column]:
        """The nearest value passed within a span, and the nearest of the spans passed."""
        turn = (lambda c: F.col(c).asc()) if forth else (lambda c: F.col(c).desc())
        inside = Window.partitionBy(*keys, "_span").orderBy(turn("_t"), turn("_side")).rowsBetween(Window.unboundedPreceding, 0)
        across = Window.partitionBy(*keys).orderBy(turn("_span")).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(row, ignorenulls=True).over(inside), F.last(end, ignorenulls=True).over(across)

    inside, across = {}, {}
    inside["_b"], across["_b_far"] = scan("_value", "_end", True)
    if ahead:
        inside["_a"], across["_a_far"] = scan("_value", "_start", False)
    local = s.withColumns(inside).filter("_side = 1")
    carried = spans.withColumns(across).drop("_end", "_start")
    return local.join(carried, [*keys, "_span"], "left").withColumns({n: F.coalesce(n, f"{n}_far") for n in inside})


def asof_backward(left: DataFrame, right: DataFrame, *, keys: list[str], left_ts: str = "ts", right_ts: str = "side_ts", values: list[str], tolerance: int | None = None, span: str = "month") -> DataFrame:
    """left with values and side_ts of the last right row at or before it, null beyond tolerance seconds.

    Right times are made unique first; a null key or time matches nothing, and its left row stays.
    """
    out = _carry(_stacked(left, right, keys, left_ts, right_ts, values), keys, span).withColumnRenamed("_b", "_found")
    fresh = F.lit(True) if tolerance is None else F.unix_timestamp("_t") - F.unix_timestamp("_found.side_ts") <= tolerance
    return out.select("_row.*", *[F.when(fresh, F.col(f"_found.{c}")).alias(c) for c in ["side_ts", *values]])


def asof_nearest(left: DataFrame, right: DataFrame, *, keys: list[str], left_ts: str = "ts", right_ts: str = "side_ts", values: list[str], tolerance: int | None = None, span: str = "month") -> DataFrame:
    """As asof_backward, with the nearest right row on either side; the earlier one wins ties."""
    s = _carry(_stacked(left, right, keys, left_ts, right_ts, values), keys, span, ahead=True)
    away: Column = F.unix_timestamp("_a.side_ts") - F.unix_timestamp("_t")
    since: Column = F.unix_timestamp("_t") - F.unix_timestamp("_b.side_ts")
    found = F.when(F.col("_b").isNull() | (away < since), F.col("_a")).otherwise(F.col("_b"))
    s = s.withColumn("_found", found)
    fresh = F.lit(True) if tolerance is None else F.abs(F.unix_timestamp("_t") - F.unix_timestamp("_found.side_ts")) <= tolerance
    return s.select("_row.*", *[F.when(fresh, F.col(f"_found.{c}")).alias(c) for c in ["side_ts", *values]])


def interval_sum(events: DataFrame, series: DataFrame, *, key: str, start: str, end: str, ts: str, value: str, out: str = "interval_sum") -> DataFrame:
    """events with the total of series values at start < ts <= end, by prefix sums and two as-of joins.

    Null where a bound is null, the end lies before the start or the key has no series.  Values
    with a null key or time count nowhere.
    """
    totals = series.dropna(subset=[key, ts]).groupBy(key, ts).agg(F.sum(value).alias("_v")).withColumn("_span", F.date_trunc("month", ts))
    upto = Window.partitionBy(key, "_span").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.groupBy(key, "_span").agg(F.sum("_v").alias("_s")).select(key, "_span", F.sum("_s").over(earlier).alias("_far"))
    part = F.coalesce("_near", F.lit(0.0)) + F.coalesce("_far", F.lit(0.0))
    prefix = totals.withColumn("_near", F.sum("_v").over(upto)).join(carried, [key, "_span"]).select(key, F.col(ts).alias("side_ts"), part.alias("_p"))
    a = asof_backward(events, prefix, keys=[key], left_ts=start, values=["_p"]).withColumnRenamed("_p", "_from").drop("side_ts")
    b = asof_backward(a, prefix, keys=[key], left_ts=end, values=["_p"]).drop("side_ts")
    known = series.select(key).distinct().withColumn("_known", F.lit(True))
    total = F.coalesce("_p", F.lit(0.0)) - F.coalesce("_from", F.lit(0.0))
    return b.join(known, key, "left").withColumn(out, F.when(F.col("_known") & (F.col(end) >= F.col(start)), total)).drop("_p", "_from", "_known")
