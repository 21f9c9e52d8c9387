"""Queries on bars, cleaning and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspan.functions import adjusted_kurtosis, adjusted_skew, share
from barspan.operators import bars as B
from barspan.operators.scan import rolling

from .registry import query
from .tables import HOUR, daily, daily_sql, hourly, hourly_sql, table

H, D = hourly_sql(), daily_sql()


def epoch(c):
    return F.unix_timestamp(c).alias(c if isinstance(c, str) else "ts")


@query("bars_hourly", f"WITH {H} SELECT symbol, epoch(ts)::BIGINT AS ts, open, high, low, \"close\", volume, row_pos FROM bars")
def bars_hourly(spark, sf):
    return hourly(spark, sf).select("symbol", epoch("ts"), "open", "high", "low", "close", "volume", "row_pos")


@query(
    "bars_daily",
    f"WITH {D} SELECT symbol, epoch(ts)::BIGINT AS ts, open, high, low, \"close\", volume, row_pos FROM days",
)
def bars_daily(spark, sf):
    return daily(spark, sf).select("symbol", epoch("ts"), *B.PRICES, "volume", "row_pos")


RAW = "raw AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, value AS open, value AS high, value AS low, value AS \"close\", 1.0 AS volume, event_id AS ingest_seq FROM events)"


def raw_bars(spark, sf):
    """Ticks as raw one-price bars with many rows for each hour."""
    e = table(spark, sf, "events")
    price = [F.col("value").alias(c) for c in B.PRICES]
    return e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts"), *price, F.lit(1.0).alias("volume"), F.col("event_id").alias("ingest_seq"))


for _keep, _dir in (("last", "DESC"), ("first", "ASC")):

    @query(
        f"c02_clean_keep_{_keep}",
        f'WITH {RAW} SELECT symbol, epoch(ts)::BIGINT AS ts, "close", ingest_seq FROM raw WHERE "close" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_seq {_dir}) = 1',
    )
    def clean_keep(spark, sf, keep=_keep):
        return B.clean(raw_bars(spark, sf), keep=keep).select("symbol", epoch("ts"), "close", "ingest_seq")


@query(
    "c03_profile",
    f"""WITH {RAW} SELECT symbol, count(*)::BIGINT AS raw_rows, count(DISTINCT ts) AS clean_rows, count(*) - count(DISTINCT ts) AS duplicate_rows,
  epoch(min(ts))::BIGINT AS first_ts, epoch(max(ts))::BIGINT AS last_ts, count(*) FILTER ("close" IS NULL) AS missing_close,
  count(*) FILTER (high < greatest(open, "close")) AS high_below_body, count(*) FILTER (least(open, high, low, "close") <= 0) AS non_positive FROM raw GROUP BY symbol""",
)
def profile(spark, sf):
    return B.profile(raw_bars(spark, sf)).select(
        "symbol", "raw_rows", "clean_rows", "duplicate_rows", epoch("first_ts"), epoch("last_ts"), "missing_close", "high_below_body", "non_positive"
    )


@query(
    "c04_consistency",
    f"""WITH {H} SELECT symbol, count(*) AS rows, count(*) FILTER (high < greatest(open, "close")) AS high_below_body, count(*) FILTER (low > least(open, "close")) AS low_above_body,
  count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (open > high OR open < low) AS open_outside, count(*) FILTER ("close" > high OR "close" < low) AS close_outside,
  count(*) FILTER (least(open, high, low, "close") <= 0) AS non_positive FROM bars GROUP BY symbol""",
)
def consistency(spark, sf):
    return hourly(spark, sf).groupBy("symbol").agg(F.count("*").alias("rows"), *[F.count_if(x).alias(n) for n, x in B.inconsistencies().items()])


STEP = 'steps AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS previous_ts, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)))::BIGINT AS d FROM bars)'


@query("c05_gap_summary", f"""WITH {hourly_sql(300)}, {STEP} SELECT symbol, count(*) FILTER (d <> 300) AS off_steps, count(*) FILTER (d > 303) AS gaps, count(*) FILTER (d > 450) AS wide_gaps,
  count(*) FILTER (d > 900) AS long_gaps, count(*) FILTER (d <= 0) AS non_monotonic, min(d) AS min_step, max(d) AS max_step FROM steps GROUP BY symbol""")
def gap_summary(spark, sf):
    return B.gap_summary(hourly(spark, sf, 300), 300)


@query("c06_gap_events", f"WITH {hourly_sql(300)}, {STEP} SELECT symbol, epoch(previous_ts)::BIGINT AS previous_ts, epoch(ts)::BIGINT AS ts, d AS gap_seconds, d // 300 - 1 AS missing_bars FROM steps WHERE d > 300")
def gap_events(spark, sf):
    return B.gaps(hourly(spark, sf, 300), 300).select("symbol", epoch("previous_ts"), epoch("ts"), "gap_seconds", "missing_bars")


@query("c07_completeness", f"""WITH {hourly_sql(300)}, x AS (SELECT symbol, count(*) AS rows, ((epoch(max(ts)) - epoch(min(ts))) / 300 + 1)::BIGINT AS expected_rows FROM bars GROUP BY symbol)
SELECT *, expected_rows - rows AS missing_rows, CASE WHEN expected_rows = rows THEN 'PASS' ELSE 'WARN' END AS status FROM x""")
def completeness(spark, sf):
    return B.completeness(hourly(spark, sf, 300), 300)


@query("c09_common_period", f"""WITH {H}, s AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol))
SELECT symbol, count(*) AS rows, epoch(min(ts))::BIGINT AS first_ts, epoch(max(ts))::BIGINT AS last_ts FROM bars, s WHERE ts BETWEEN a AND b GROUP BY symbol""")
def common_period(spark, sf):
    return B.common_period(hourly(spark, sf)).groupBy("symbol").agg(F.count("*").alias("rows"), F.unix_timestamp(F.min("ts")).alias("first_ts"), F.unix_timestamp(F.max("ts")).alias("last_ts"))


@query("c10_period_audit", f"""WITH {D} SELECT symbol, count(*) AS rows, count(*) FILTER (ts >= TIMESTAMP '1993-01-01' AND ts < TIMESTAMP '1998-01-01') AS selected,
  count(*) FILTER (ts >= TIMESTAMP '1993-01-01' AND ts < TIMESTAMP '1996-01-01') AS dev, count(*) FILTER (ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01') AS oos FROM days GROUP BY symbol""")
def period_audit(spark, sf):
    inside = lambda a, b: F.count_if((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
    return daily(spark, sf).groupBy("symbol").agg(F.count("*").alias("rows"), inside("1993-01-01", "1998-01-01").alias("selected"), inside("1993-01-01", "1996-01-01").alias("dev"), inside("1996-01-01", "1998-01-01").alias("oos"))


@query("c11_timeframe", f"""WITH {hourly_sql(300)}, {STEP}, d AS (SELECT * FROM steps WHERE d IS NOT NULL), m AS (SELECT symbol, quantile_cont(d, 0.5) AS median_step, count(*) AS n FROM d GROUP BY symbol),
k AS (SELECT symbol, d.d, median_step, n, count(*) AS k FROM d JOIN m USING (symbol) WHERE d.d <= 3 * median_step GROUP BY ALL)
SELECT symbol, median_step::DOUBLE AS median_step, d AS mode_step, round(k / n, 8) AS mode_share FROM k QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY k DESC, d) = 1""")
def timeframe(spark, sf):
    return B.timeframe(hourly(spark, sf, 300)).withColumn("mode_share", F.round("mode_share", 8))


@query("c12_bars_per_year", f"""WITH {H} SELECT symbol, round(365.25 * 86400 / 3600 * 5 / 7, 6)::DOUBLE AS by_timeframe, round(count(*) / ((epoch(max(ts)) - epoch(min(ts))) / (365.25 * 86400)), 6) AS by_elapsed,
  round(count(*) FILTER (isodow(ts) < 6) / count(DISTINCT CASE WHEN isodow(ts) < 6 THEN ts::DATE END) * 252, 6) AS by_weekday FROM bars GROUP BY symbol""")
def bars_per_year(spark, sf):
    out = B.bars_per_year(hourly(spark, sf), HOUR)
    return out.select("symbol", *[F.round(c, 6).alias(c) for c in ("by_timeframe", "by_elapsed", "by_weekday")])


RET = 'rets AS (SELECT *, ln("close" / lag("close") OVER (PARTITION BY symbol ORDER BY row_pos)) AS ret FROM bars)'


def returns(bars, kind: str = "log"):
    c, prev = F.col("close"), lambda w: F.lag("close").over(w)
    return rolling(bars, {"ret": (lambda w: F.log(c / prev(w))) if kind == "log" else (lambda w: c / prev(w) - 1)}, back=1)


@query("c13_return_diagnostics", f"""WITH {H}, {RET}, m AS (SELECT symbol, quantile_cont(ret, 0.5) AS med, avg(ret) AS mean, stddev_samp(ret) AS sd FROM rets GROUP BY symbol),
d AS (SELECT symbol, quantile_cont(abs(ret - med), 0.5) AS mad FROM rets JOIN m USING (symbol) GROUP BY symbol)
SELECT symbol, count(ret) AS n, round(any_value(mean) * 10000, 6) AS mean_bp, round(any_value(sd) * 10000, 6) AS std_bp, round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS kurtosis, round(min(ret), 8) AS min_ret, round(max(ret), 8) AS max_ret,
  count(*) FILTER (abs((ret - mean) / sd) > 8) AS z8, count(*) FILTER (abs(ret) > 0.01) AS over_1pct, count(*) FILTER (abs(ret - med) > 10 * mad) AS mad10 FROM rets JOIN m USING (symbol) JOIN d USING (symbol) GROUP BY symbol""")
def return_diagnostics(spark, sf):
    r = returns(hourly(spark, sf)).select("symbol", "ret")
    m = r.groupBy("symbol").agg(F.percentile("ret", 0.5).alias("med"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    rm = r.join(m, "symbol")
    d = rm.groupBy("symbol").agg(F.percentile(F.abs(F.col("ret") - F.col("med")), 0.5).alias("mad"))
    x = F.col("ret")
    return rm.join(d, "symbol").groupBy("symbol").agg(
        F.count(x).alias("n"),
        F.round(F.first("mean") * 10000, 6).alias("mean_bp"),
        F.round(F.first("sd") * 10000, 6).alias("std_bp"),
        F.round(adjusted_skew(x), 6).alias("skew"),
        F.round(adjusted_kurtosis(x), 6).alias("kurtosis"),
        F.round(F.min(x), 8).alias("min_ret"),
        F.round(F.max(x), 8).alias("max_ret"),
        F.count_if(F.abs((x - F.col("mean")) / F.col("sd")) > 8).alias("z8"),
        F.count_if(F.abs(x) > 0.01).alias("over_1pct"),
        F.count_if(F.abs(x - F.col("med")) > 10 * F.col("mad")).alias("mad10"),
    )


@query("c14_annual_volatility", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, er AS (SELECT symbol, row_pos, ts, ret,
  abs("close" - lag("close", 20) OVER w) / nullif(sum(abs_step) OVER (PARTITION BY symbol ORDER BY row_pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS er
  FROM (SELECT *, abs("close" - lag("close") OVER (PARTITION BY symbol ORDER BY row_pos)) AS abs_step FROM rets) WINDOW w AS (PARTITION BY symbol ORDER BY row_pos))
SELECT symbol, year(ts)::INT AS year, round(stddev_samp(ret) * sqrt(252), 6) AS vol, round(quantile_cont(er, 0.5), 6) AS er_median, round(avg((coalesce(er > 0.3, false))::INT), 6) AS trend_share FROM er GROUP BY ALL""")
def annual_volatility(spark, sf):
    steps = rolling(daily(spark, sf), {"ret": lambda w: F.log(F.col("close") / F.lag("close").over(w)), "step": lambda w: F.abs(F.col("close") - F.lag("close").over(w))}, back=1)
    er = rolling(steps, {"er": lambda w: F.abs(F.col("close") - F.lag("close", 20).over(w)) / F.nullif(F.sum("step").over(w.rowsBetween(-19, 0)), F.lit(0))}, back=20)
    return er.groupBy("symbol", F.year("ts").alias("year")).agg(
        F.round(F.stddev_samp("ret") * F.sqrt(F.lit(252)), 6).alias("vol"), F.round(F.percentile("er", 0.5), 6).alias("er_median"), F.round(share(F.col("er") > 0.3), 6).alias("trend_share")
    )


@query("c15_coverage", """SELECT 'orders' AS source, count(*) AS rows, min(o_orderdate)::DATE::VARCHAR AS first_day, max(o_orderdate)::DATE::VARCHAR AS last_day, list_aggregate(list_sort(list_distinct(list(o_orderstatus))), 'string_agg', ',') AS quality FROM orders
UNION ALL SELECT 'lineitem', count(*), min(l_shipdate)::DATE::VARCHAR, max(l_shipdate)::DATE::VARCHAR, list_aggregate(list_sort(list_distinct(list(l_linestatus))), 'string_agg', ',') FROM lineitem
UNION ALL SELECT 'events', count(*), min(ts)::DATE::VARCHAR, max(ts)::DATE::VARCHAR, list_aggregate(list_sort(list_distinct(list(event_type))), 'string_agg', ',') FROM events""")
def coverage(spark, sf):
    parts = [("orders", "o_orderdate", "o_orderstatus"), ("lineitem", "l_shipdate", "l_linestatus"), ("events", "ts", "event_type")]
    out = [
        table(spark, sf, t).agg(
            F.lit(t).alias("source"), F.count("*").alias("rows"), F.min(d).cast("date").cast("string").alias("first_day"), F.max(d).cast("date").cast("string").alias("last_day"), F.array_join(F.array_sort(F.collect_set(q)), ",").alias("quality")
        )
        for t, d, q in parts
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])
