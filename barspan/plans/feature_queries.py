"""Queries on rolling, expanding and forward features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions import right_closed, true_range
from barspan.operators import features as X
from barspan.operators.scan import framed, rolling, running

from .profile_queries import RET, returns
from .registry import query
from .tables import HOUR, daily, daily_sql, hourly, hourly_sql

H, D = hourly_sql(), daily_sql()
W = "WINDOW w AS (PARTITION BY symbol ORDER BY row_pos)"


def keep(df, *columns, digits=8):
    return df.select("symbol", "row_pos", *[F.round(c, digits).alias(c) for c in columns])


@query("p01_returns", f"""WITH {H} SELECT symbol, row_pos, round(ln("close" / lag("close") OVER w), 8) AS log_ret, round("close" / lag("close") OVER w - 1, 8) AS simple_ret, round(ln("close" / lag("close", 4) OVER w) * 10000, 5) AS log4_bp FROM bars {W}""")
def p01(spark, sf):
    c = F.col("close")
    b = rolling(hourly(spark, sf), {"log_ret": lambda w: F.log(c / F.lag("close").over(w)), "simple_ret": lambda w: c / F.lag("close").over(w) - 1, "log4_bp": lambda w: F.log(c / F.lag("close", 4).over(w)) * 10000}, back=4)
    return b.select("symbol", "row_pos", F.round("log_ret", 8).alias("log_ret"), F.round("simple_ret", 8).alias("simple_ret"), F.round("log4_bp", 5).alias("log4_bp"))


@query("p02_gap_aware_returns", f"""WITH {H} SELECT symbol, row_pos, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) = 3600 THEN round("close" / lag("close") OVER w - 1, 8) END AS ret FROM bars {W}""")
def p02(spark, sf):
    step = lambda w: F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return keep(rolling(hourly(spark, sf), {"ret": lambda w: F.when(step(w) == HOUR, F.col("close") / F.lag("close").over(w) - 1)}, back=1), "ret")


@query("p03_true_range", f"""WITH {H}, t AS (SELECT symbol, row_pos, greatest(high - low, abs(high - lag("close") OVER w), abs(low - lag("close") OVER w)) AS tr, (high + low + "close") / 3 AS typical FROM bars {W})
SELECT symbol, row_pos, round(tr, 8) AS tr, round(typical, 8) AS typical, CASE WHEN count(tr) OVER (w ROWS 13 PRECEDING) = 14 THEN round(avg(tr) OVER (w ROWS 13 PRECEDING), 6) END AS atr FROM t {W}""")
def p03(spark, sf):
    b = rolling(hourly(spark, sf), {"tr": lambda w: true_range(F.lag("close").over(w))}, back=1).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = rolling(b, {"atr": framed(F.avg, F.col("tr"), -13, 0)}, back=14)
    return b.select("symbol", "row_pos", F.round("tr", 8).alias("tr"), F.round("typical", 8).alias("typical"), F.round("atr", 6).alias("atr"))


@query("w01_lags", f"""WITH {H} SELECT symbol, row_pos, lag("close", 3) OVER w AS lag3, lead("close", 2) OVER w AS lead2, round("close" - lag("close", 6) OVER w, 8) AS diff6 FROM bars {W}""")
def w01(spark, sf):
    return rolling(hourly(spark, sf), {"lag3": lambda w: F.lag("close", 3).over(w), "lead2": lambda w: F.lead("close", 2).over(w), "diff6": lambda w: F.round(F.col("close") - F.lag("close", 6).over(w), 8)}, back=6, ahead=2).select("symbol", "row_pos", "lag3", "lead2", "diff6")


@query("w02_rolling", f"""WITH {H}, {RET} SELECT symbol, row_pos, CASE WHEN count(ret) OVER (w ROWS 19 PRECEDING) >= 10 THEN round(avg(ret) OVER (w ROWS 19 PRECEDING), 8) END AS mean20,
 CASE WHEN count(ret) OVER (w ROWS 19 PRECEDING) >= 20 THEN round(stddev_samp(ret) OVER (w ROWS 19 PRECEDING), 8) END AS std20, CASE WHEN count(*) OVER (w ROWS 47 PRECEDING) = 48 THEN max(high) OVER (w ROWS 47 PRECEDING) END AS max48,
 CASE WHEN count(*) OVER (w ROWS 47 PRECEDING) = 48 THEN min(low) OVER (w ROWS 47 PRECEDING) END AS min48, sum(volume) OVER (w ROWS 5 PRECEDING) AS sum6 FROM rets {W}""")
def w02(spark, sf):
    b = rolling(returns(hourly(spark, sf)), {
        "mean20": framed(F.avg, F.col("ret"), -19, 0, 10), "std20": framed(F.stddev_samp, F.col("ret"), -19, 0), "max48": framed(F.max, F.col("high"), -47, 0), "min48": framed(F.min, F.col("low"), -47, 0), "sum6": framed(F.sum, F.col("volume"), -5, 0, 1)}, back=48)
    return b.select("symbol", "row_pos", F.round("mean20", 8).alias("mean20"), F.round("std20", 8).alias("std20"), "max48", "min48", "sum6")


@query("w03_vwap_z", f"""WITH {H}, v AS (SELECT symbol, row_pos, "close" / (CASE WHEN count(*) OVER (w ROWS 23 PRECEDING) = 24 THEN sum((high + low + "close") / 3 * volume) OVER (w ROWS 23 PRECEDING) / sum(volume) OVER (w ROWS 23 PRECEDING) END) - 1 AS d FROM bars {W})
SELECT symbol, row_pos, round(d, 8) AS deviation, CASE WHEN count(d) OVER (w ROWS 47 PRECEDING) = 48 THEN round((d - avg(d) OVER (w ROWS 47 PRECEDING)) / nullif(stddev_samp(d) OVER (w ROWS 47 PRECEDING), 0), 6) END AS vwap_z FROM v {W}""")
def w03(spark, sf):
    b = X.rolling_vwap(hourly(spark, sf), 24, 48)
    return b.select("symbol", "row_pos", F.round("deviation", 8).alias("deviation"), F.round("vwap_z", 6).alias("vwap_z"))


@query("w04_sigma_score", f"""WITH {H}, {RET} SELECT symbol, row_pos, CASE WHEN count(ret) OVER (w ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING) = 180 THEN round((ret - avg(ret) OVER (w ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING)) / stddev_samp(ret) OVER (w ROWS BETWEEN 180 PRECEDING AND 1 PRECEDING), 6) END AS sigma FROM rets {W}""")
def w04(spark, sf):
    return keep(X.sigma_score(returns(hourly(spark, sf))), "sigma", digits=6)


@query("w05_percentile_rank", f"""WITH {H}, {RET}, r AS (SELECT a.symbol, a.row_pos, a.ret, count(b.ret) AS n, count(*) FILTER (b.ret < a.ret) AS lt, count(*) FILTER (b.ret = a.ret) AS eq FROM rets a JOIN rets b ON a.symbol = b.symbol AND b.row_pos BETWEEN a.row_pos - 99 AND a.row_pos GROUP BY ALL)
SELECT symbol, row_pos, CASE WHEN ret IS NOT NULL AND n >= 50 THEN round((lt + (eq + 1) / 2) / n, 8) END AS pct_rank FROM r""")
def w05(spark, sf):
    return keep(X.percentile_rank(returns(hourly(spark, sf)), 100, 50), "pct_rank")


@query("w06_expanding_percentile", f"""WITH {H}, {RET}, r AS (SELECT a.symbol, a.row_pos, count(*) AS n, count(*) FILTER (b.ret <= a.ret) AS le FROM rets a JOIN rets b ON a.symbol = b.symbol AND b.row_pos <= a.row_pos AND b.ret IS NOT NULL WHERE a.ret IS NOT NULL GROUP BY ALL)
SELECT bars.symbol, bars.row_pos, CASE WHEN n >= 180 THEN round(le / n, 8) END AS exp_pct FROM bars LEFT JOIN r USING (symbol, row_pos)""")
def w06(spark, sf):
    return keep(X.expanding_percentile(returns(hourly(spark, sf)), "ret"), "exp_pct")


@query("w07_rolling_slope", f"""WITH {H} SELECT symbol, row_pos, CASE WHEN count(*) OVER (w ROWS 9 PRECEDING) >= 2 THEN round(regr_slope("close", row_pos) OVER (w ROWS 9 PRECEDING), 6) END AS slope FROM bars {W}""")
def w07(spark, sf):
    return keep(X.slope(hourly(spark, sf), "close", 10), "slope", digits=6)


@query("w08_rolling_median", f"""WITH {H} SELECT symbol, row_pos, CASE WHEN count(*) OVER (w ROWS 199 PRECEDING) >= 100 THEN round(quantile_cont("close", 0.5) OVER (w ROWS 199 PRECEDING), 8) END AS median200 FROM bars {W}""")
def w08(spark, sf):
    return keep(rolling(hourly(spark, sf), {"median200": framed(lambda x: F.percentile(x, 0.5), F.col("close"), -199, 0, 100)}, back=200), "median200")


@query("w09_efficiency_ratio", f"""WITH {H}, d AS (SELECT *, abs("close" - lag("close") OVER w) AS step FROM bars {W})
SELECT symbol, row_pos, round(abs("close" - lag("close", 20) OVER w) / nullif(sum(step) OVER (w ROWS 19 PRECEDING), 0), 8) AS er FROM d {W}""")
def w09(spark, sf):
    b = rolling(hourly(spark, sf), {"step": lambda w: F.abs(F.col("close") - F.lag("close").over(w))}, back=1)
    return keep(rolling(b, {"er": lambda w: F.abs(F.col("close") - F.lag("close", 20).over(w)) / F.nullif(F.sum("step").over(w.rowsBetween(-19, 0)), F.lit(0))}, back=20), "er")


@query("w10_exponential_mean", f"""WITH RECURSIVE {H}, e AS (SELECT symbol, row_pos, "close" AS y FROM bars WHERE row_pos = 0 UNION ALL SELECT b.symbol, b.row_pos, e.y * (1 - 2.0::DOUBLE / 21) + 2.0::DOUBLE / 21 * b."close" FROM e JOIN bars b ON b.symbol = e.symbol AND b.row_pos = e.row_pos + 1)
SELECT symbol, row_pos, CASE WHEN row_pos >= 19 THEN round(y, 6) END AS ema FROM e""")
def w10(spark, sf):
    return keep(X.exponential_mean(hourly(spark, sf), "close", X.span_alpha(20), least=20), "ema", digits=6)


@query("w10_adx", f"""WITH RECURSIVE {H}, l AS (SELECT symbol, row_pos, high, low, high - lag(high) OVER q AS up, lag(low) OVER q - low AS down, lag("close") OVER q AS c FROM bars WINDOW q AS (PARTITION BY symbol ORDER BY row_pos)),
v AS MATERIALIZED (SELECT symbol, row_pos, coalesce(CASE WHEN up > down AND up > 0 THEN up END, 0) AS p, coalesce(CASE WHEN down > up AND down > 0 THEN down END, 0) AS m, greatest(high - low, abs(high - c), abs(low - c)) AS r FROM l),
e AS (SELECT * FROM v WHERE row_pos = 0 UNION ALL SELECT v.symbol, v.row_pos, e.p * (1 - 1 / 14) + v.p / 14, e.m * (1 - 1 / 14) + v.m / 14, e.r * (1 - 1 / 14) + v.r / 14 FROM e JOIN v ON v.symbol = e.symbol AND v.row_pos = e.row_pos + 1),
d AS (SELECT symbol, row_pos, CASE WHEN row_pos >= 13 THEN 100 * p / nullif(r, 0) END AS plus_di, CASE WHEN row_pos >= 13 THEN 100 * m / nullif(r, 0) END AS minus_di FROM e), x AS MATERIALIZED (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM d),
a AS (SELECT symbol, row_pos, dx AS y, (dx IS NOT NULL)::INT AS k FROM x WHERE row_pos = 0 UNION ALL SELECT x.symbol, x.row_pos, CASE WHEN x.dx IS NULL THEN a.y WHEN a.y IS NULL THEN x.dx ELSE a.y * (1 - 1 / 14) + x.dx / 14 END, a.k + (x.dx IS NOT NULL)::INT FROM a JOIN x ON x.symbol = a.symbol AND x.row_pos = a.row_pos + 1)
SELECT symbol, row_pos, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di, round(dx, 6) AS dx, round(CASE WHEN k >= 14 THEN y END, 6) AS adx FROM x JOIN a USING (symbol, row_pos)""")
def w10_adx(spark, sf):
    return keep(X.adx(hourly(spark, sf)), "plus_di", "minus_di", "dx", "adx", digits=6)


@query("w11_donchian", f"""WITH {H} SELECT symbol, row_pos, CASE WHEN count(*) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS upper,
CASE WHEN count(*) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS lower FROM bars {W}""")
def w11(spark, sf):
    return rolling(hourly(spark, sf), {"upper": framed(F.max, F.col("high"), -20, -1), "lower": framed(F.min, F.col("low"), -20, -1)}, back=20).select("symbol", "row_pos", "upper", "lower")


@query("w12_forward_paths", f"""WITH {H} SELECT symbol, row_pos, round(ln(lead("close", 12) OVER w / lead(open) OVER w), 8) AS path_ret,
CASE WHEN lead("close", 12) OVER w IS NOT NULL THEN round(ln(min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) / lead(open) OVER w), 8) END AS mae,
CASE WHEN lead("close", 12) OVER w IS NOT NULL THEN round(ln(max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) / lead(open) OVER w), 8) END AS mfe FROM bars {W}""")
def w12(spark, sf):
    return keep(X.forward_paths(hourly(spark, sf), 12), "path_ret", "mae", "mfe")


@query("w12_forward_paths_open_exit", f"""WITH {H} SELECT symbol, row_pos, round(lead(open, 7) OVER w / lead(open) OVER w - 1, 8) AS path_ret,
CASE WHEN lead(open, 7) OVER w IS NOT NULL THEN round(least(min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) / lead(open) OVER w - 1, 0), 8) END AS mae,
CASE WHEN lead(open, 7) OVER w IS NOT NULL THEN round(greatest(max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) / lead(open) OVER w - 1, 0), 8) END AS mfe FROM bars {W}""")
def w12_open(spark, sf):
    return keep(X.forward_paths(hourly(spark, sf), 6, leave="open", leave_bar=7, last_bar=7, clamp=True, log=False), "path_ret", "mae", "mfe")


@query("w13_drawdown", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, q AS (SELECT symbol, row_pos, sum(coalesce(ret, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS eq FROM rets {W}), k AS (SELECT *, greatest(max(eq) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS peak FROM q {W})
SELECT symbol, row_pos, round(eq, 7) AS equity, round(peak, 7) AS peak, round(eq - peak, 7) AS drawdown FROM k""")
def w13(spark, sf):
    b = running(returns(daily(spark, sf)), {"equity": ("sum", F.coalesce("ret", F.lit(0.0)))}, keys=["symbol"], size=512)
    b = running(b, {"peak": ("max", F.col("equity"))}, keys=["symbol"], size=512).withColumn("peak", F.greatest("peak", F.lit(0.0)))
    return keep(b.withColumn("drawdown", F.col("equity") - F.col("peak")), "equity", "peak", "drawdown", digits=7)


@query("w15_quantile_buckets", f"""WITH {H}, {RET}, v AS (SELECT *, CASE WHEN count(ret) OVER (w ROWS 23 PRECEDING) = 24 THEN stddev_samp(ret) OVER (w ROWS 23 PRECEDING) END AS vol FROM rets {W}),
e AS (SELECT symbol, quantile_cont(vol, [0.2, 0.4, 0.6, 0.8]) AS q FROM v GROUP BY symbol)
SELECT symbol, row_pos, CASE WHEN vol IS NOT NULL THEN 'V' || (1 + (vol > q[1])::INT + (vol > q[2])::INT + (vol > q[3])::INT + (vol > q[4])::INT) END AS bucket FROM v JOIN e USING (symbol)""")
def w15(spark, sf):
    b = rolling(returns(hourly(spark, sf)), {"vol": framed(F.stddev_samp, F.col("ret"), -23, 0)}, back=24)
    return X.quantile_bucket(b, "vol", [f"V{k}" for k in range(1, 6)]).select("symbol", "row_pos", "bucket")


@query("w16_fixed_bins", f"""WITH {H}, {RET} SELECT symbol, row_pos, CASE WHEN ret >= -2 AND ret <= -0.1 THEN 'down' WHEN ret > -0.1 AND ret <= 0 THEN 'dip' WHEN ret > 0 AND ret <= 0.1 THEN 'rise' WHEN ret > 0.1 AND ret <= 2 THEN 'up' END AS bin FROM rets""")
def w16(spark, sf):
    return returns(hourly(spark, sf)).select("symbol", "row_pos", right_closed(F.col("ret"), [-2, -0.1, 0, 0.1, 2], ["down", "dip", "rise", "up"]).alias("bin"))


@query("w17_rolling_z_pop", f"""WITH {D} SELECT symbol, row_pos, CASE WHEN count(*) OVER (w ROWS 251 PRECEDING) >= 20 THEN round(("close" - avg("close") OVER (w ROWS 251 PRECEDING)) / nullif(stddev_pop("close") OVER (w ROWS 251 PRECEDING), 0), 6) END AS z FROM days {W}""")
def w17(spark, sf):
    mean, sd = framed(F.avg, F.col("close"), -251, 0, 20), framed(F.stddev_pop, F.col("close"), -251, 0, 20)
    return keep(rolling(daily(spark, sf), {"z": lambda w: (F.col("close") - mean(w)) / F.nullif(sd(w), F.lit(0))}, back=252), "z", digits=6)


@query("w18_valid_forward", f"""WITH {H} SELECT symbol, row_pos, coalesce(epoch(lead(ts, 6) OVER w) - epoch(ts) = 6 * 3600, false) AS valid_forward FROM bars {W}""")
def w18(spark, sf):
    return X.valid_forward(hourly(spark, sf), 6, HOUR).select("symbol", "row_pos", "valid_forward")


@query("p24_latest_z", f"""WITH {D}, z AS (SELECT symbol, row_pos, round(("close" - avg("close") OVER (PARTITION BY symbol)) / nullif(stddev_pop("close") OVER (PARTITION BY symbol), 0), 6) AS z, max(row_pos) OVER (PARTITION BY symbol) AS top FROM days) SELECT symbol, row_pos, z FROM z WHERE row_pos > top - 700""")
def p24(spark, sf):
    d = daily(spark, sf)
    m = d.groupBy("symbol").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("s"), F.max("row_pos").alias("top"))
    return d.join(m, "symbol").filter(F.col("row_pos") > F.col("top") - 700).select("symbol", "row_pos", F.round((F.col("close") - F.col("m")) / F.nullif("s", F.lit(0)), 6).alias("z"))


@query("p23_winsorise", f"""WITH {H}, {RET}, q AS (SELECT symbol, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi, quantile_cont(abs(ret), 0.95) AS cap FROM rets GROUP BY symbol)
SELECT symbol, row_pos, round(least(greatest(ret, lo), hi), 8) AS winsorised, round(least(greatest(ret, -cap), cap), 8) AS clipped FROM rets JOIN q USING (symbol) WHERE ret IS NOT NULL""")
def p23(spark, sf):
    r = returns(hourly(spark, sf)).filter("ret is not null")
    q = r.groupBy("symbol").agg(F.percentile("ret", F.array(F.lit(0.01), F.lit(0.99))).alias("q"), F.percentile(F.abs("ret"), 0.95).alias("cap"))
    x = F.col("ret")
    return keep(r.join(q, "symbol").withColumns({"winsorised": F.least(F.greatest(x, F.col("q")[0]), F.col("q")[1]), "clipped": F.least(F.greatest(x, -F.col("cap")), F.col("cap"))}), "winsorised", "clipped")
