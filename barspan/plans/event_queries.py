"""Queries on event tables, thinning, candidates and classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspan.functions import ratio, share, t_stat
from barspan.operators import asof as J
from barspan.operators import events as E
from barspan.operators import features as X
from barspan.operators import stats as S
from barspan.operators.bars import steps
from barspan.operators.scan import rolling

from .asof_queries import SIDE, fund
from .profile_queries import RET, returns
from .registry import query
from .stat_queries import FORWARD, SHOCK, forward, t_sql
from .tables import HOUR, daily, daily_sql, hourly, hourly_sql, table

H, D = hourly_sql(), daily_sql()
SHOCKS = f"{H}, {RET}, lim AS (SELECT symbol, quantile_cont(ret, 0.1) AS lo FROM rets GROUP BY symbol), ev AS (SELECT rets.*, row_number() OVER (PARTITION BY symbol ORDER BY row_pos) AS k FROM rets JOIN lim USING (symbol) WHERE ret <= lo)"


def shocks(spark, sf):
    r = returns(hourly(spark, sf))
    q = r.groupBy("symbol").agg(F.percentile("ret", 0.1).alias("lo"))
    return r.join(q, "symbol").filter("ret <= lo")


@query("e01_cooldown", f"""WITH RECURSIVE {SHOCKS}, kept AS (SELECT symbol, min(row_pos) AS row_pos FROM ev GROUP BY symbol UNION ALL SELECT k.symbol, min(e.row_pos) FROM kept k JOIN ev e ON e.symbol = k.symbol AND e.row_pos >= k.row_pos + 12 GROUP BY k.symbol, k.row_pos)
SELECT symbol, row_pos FROM kept""")
def e01(spark, sf):
    return E.cooldown(shocks(spark, sf), 12).select("symbol", "row_pos")


@query("e02_non_overlapping", f"""WITH RECURSIVE {SHOCKS}, x AS (SELECT symbol, row_pos + 1 AS entry_pos, row_pos + 2 + row_pos % 9 AS exit_pos FROM ev),
kept AS (SELECT symbol, min(entry_pos) AS entry_pos, arg_min(exit_pos, entry_pos) AS exit_pos FROM x GROUP BY symbol UNION ALL SELECT k.symbol, min(x.entry_pos), arg_min(x.exit_pos, x.entry_pos) FROM kept k JOIN x ON x.symbol = k.symbol AND x.entry_pos > k.exit_pos GROUP BY k.symbol, k.entry_pos)
SELECT symbol, entry_pos, exit_pos, row_number() OVER (PARTITION BY symbol ORDER BY entry_pos)::INT AS trade_no FROM kept""")
def e02(spark, sf):
    ev = shocks(spark, sf).select("symbol", (F.col("row_pos") + 1).alias("entry_pos"), (F.col("row_pos") + 2 + F.col("row_pos") % 9).alias("exit_pos"))
    return E.non_overlapping(ev, keys=["symbol"]).select("symbol", "entry_pos", "exit_pos", "trade_no")


PATHS = """pth AS (SELECT symbol, row_pos, ts, ret, lead(open) OVER q / "close" - 1 AS gap, lead("close", 12) OVER q / lead(open) OVER q - 1 AS path_ret,
  CASE WHEN lead("close", 12) OVER q IS NOT NULL THEN least(min(low) OVER (PARTITION BY symbol ORDER BY row_pos ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) / lead(open) OVER q - 1, 0) END AS mae,
  CASE WHEN lead("close", 12) OVER q IS NOT NULL THEN greatest(max(high) OVER (PARTITION BY symbol ORDER BY row_pos ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) / lead(open) OVER q - 1, 0) END AS mfe FROM rets WINDOW q AS (PARTITION BY symbol ORDER BY row_pos))"""
EVENTS = f"{H}, {RET}, {PATHS}, {SHOCK}, evt AS (SELECT symbol || '_' || side || '_' || CASE level WHEN 0.05 THEN '50' WHEN 0.025 THEN '25' ELSE '10' END AS candidate_id, pth.* FROM pth JOIN lim USING (symbol) WHERE path_ret IS NOT NULL AND CASE WHEN side = 'low' THEN ret <= threshold ELSE ret >= threshold END)"


def path_events(spark, sf):
    """Shock candidates with the path of the 12 bars after them."""
    b = X.forward_paths(returns(hourly(spark, sf)), 12, clamp=True, log=False)
    b = b.withColumn("gap", F.col("entry_price") / F.col("close") - 1)
    ev = S.shock_events(b, "ret", [0.05, 0.025, 0.01]).filter("path_ret is not null")
    name = F.concat_ws("_", "symbol", "side", F.when(F.col("level") == 0.05, "50").when(F.col("level") == 0.025, "25").otherwise("10"))
    return ev.withColumn("candidate_id", name)


@query("e03_path_events", f"WITH {EVENTS} SELECT candidate_id, row_pos, round(gap, 8) AS gap, round(path_ret, 8) AS path_ret, round(mae, 8) AS mae, round(mfe, 8) AS mfe FROM evt")
def e03(spark, sf):
    return path_events(spark, sf).select("candidate_id", "row_pos", *[F.round(c, 8).alias(c) for c in ("gap", "path_ret", "mae", "mfe")])


@query("e07_best_candidates", f"""WITH {EVENTS}, c AS (SELECT symbol, candidate_id, count(*) AS n, round(avg(path_ret), 9) AS mean, round(avg((path_ret > 0)::INT), 9) AS win_rate FROM evt GROUP BY ALL)
SELECT symbol, candidate_id, n, round(mean, 6) AS mean, round(win_rate, 6) AS win_rate FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, win_rate DESC, candidate_id) = 1""")
def e07(spark, sf):
    c = path_events(spark, sf).groupBy("symbol", "candidate_id").agg(F.count("*").alias("n"), F.round(F.avg("path_ret"), 9).alias("mean"), F.round(share(F.col("path_ret") > 0), 9).alias("win_rate"))
    best = E.best_by(c, ["symbol"], F.desc("mean"), F.desc("win_rate"), F.asc("candidate_id"))
    return best.select("symbol", "candidate_id", "n", F.round("mean", 6).alias("mean"), F.round("win_rate", 6).alias("win_rate"))


@query("a27_path_risk", f"""WITH {EVENTS} SELECT candidate_id, count(*) AS n, round(avg(gap), 6) AS gap, round(avg(path_ret), 6) AS mean, round(avg(mae), 6) AS mae, round(quantile_cont(mae, 0.05), 6) AS mae_p05, round(avg(mfe), 6) AS mfe, round(quantile_cont(mfe, 0.95), 6) AS mfe_p95, {t_sql('path_ret')} AS t FROM evt GROUP BY candidate_id""")
def a27(spark, sf):
    return path_events(spark, sf).groupBy("candidate_id").agg(
        F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("gap"), F.round(F.avg("path_ret"), 6).alias("mean"), F.round(F.avg("mae"), 6).alias("mae"), F.round(F.percentile("mae", 0.05), 6).alias("mae_p05"), F.round(F.avg("mfe"), 6).alias("mfe"), F.round(F.percentile("mfe", 0.95), 6).alias("mfe_p95"), F.round(t_stat(F.col("path_ret")), 6).alias("t")
    )


DAYS = f"{D}, bars AS (SELECT * FROM days), {RET}, lim AS (SELECT symbol, quantile_cont(ret, 0.02) AS lo FROM rets GROUP BY symbol), f AS (SELECT *, lead(\"close\", 5) OVER (PARTITION BY symbol ORDER BY row_pos) / \"close\" - 1 AS f5 FROM rets), ev AS (SELECT symbol, year(ts)::INT AS year, f5 FROM f JOIN lim USING (symbol) WHERE ret <= lo AND f5 IS NOT NULL), grid AS (SELECT symbol, y::INT AS year FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(range(min(year(ts)), max(year(ts)) + 1)) AS y FROM bars)), ann AS (SELECT symbol, year, count(f5) AS n, avg(f5) AS mean FROM grid LEFT JOIN ev USING (symbol, year) GROUP BY ALL)"


def annual(spark, sf):
    r = returns(daily(spark, sf))
    r = rolling(r, {"f5": lambda w: F.lead("close", 5).over(w) / F.col("close") - 1}, ahead=5)
    q = r.groupBy("symbol").agg(F.percentile("ret", 0.02).alias("lo"))
    ev = r.join(q, "symbol").filter("ret <= lo and f5 is not null").select("symbol", F.year("ts").alias("year"), "f5")
    per = ev.groupBy("symbol", "year").agg(F.count("f5").alias("n"), F.avg("f5").alias("mean"))
    years = r.agg(F.explode(F.sequence(F.min(F.year("ts")), F.max(F.year("ts")))).alias("year"))
    grid = r.select("symbol").distinct().join(F.broadcast(years), F.lit(True))
    return grid.join(per, ["symbol", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("a25_annual_grid", f"WITH {DAYS} SELECT symbol, year, n, round(mean, 6) AS mean, CASE WHEN n = 0 THEN 'NO_EVENTS' WHEN n < 5 THEN 'LOW_COUNT' ELSE 'OK' END AS status, round(n / sum(n) OVER (PARTITION BY symbol), 6)::DOUBLE AS event_share FROM ann")
def a25(spark, sf):
    w = Window.partitionBy("symbol")
    status = F.when(F.col("n") == 0, "NO_EVENTS").when(F.col("n") < 5, "LOW_COUNT").otherwise("OK")
    return annual(spark, sf).select("symbol", "year", "n", F.round("mean", 6).alias("mean"), status.alias("status"), F.round(ratio(F.col("n"), F.sum("n").over(w)), 6).alias("event_share"))


@query("a26_annual_stability", f"""WITH {DAYS} SELECT symbol, count(mean) AS years, round(avg((mean > 0)::INT) FILTER (mean IS NOT NULL), 6) AS positive_rate, round(avg(mean), 6) AS avg_mean, round(quantile_cont(mean, 0.5), 6) AS median_mean, round(min(mean), 6) AS worst, round(max(mean), 6) AS best,
CASE WHEN avg((mean > 0)::INT) FILTER (mean IS NOT NULL) >= 0.7 THEN 'STABLE' WHEN avg((mean > 0)::INT) FILTER (mean IS NOT NULL) >= 0.5 THEN 'MIXED' ELSE 'UNSTABLE' END AS label FROM ann GROUP BY symbol""")
def a26(spark, sf):
    rate = F.avg((F.col("mean") > 0).cast("int"))
    return annual(spark, sf).groupBy("symbol").agg(
        F.count("mean").alias("years"), F.round(rate, 6).alias("positive_rate"), F.round(F.avg("mean"), 6).alias("avg_mean"), F.round(F.percentile("mean", 0.5), 6).alias("median_mean"), F.round(F.min("mean"), 6).alias("worst"), F.round(F.max("mean"), 6).alias("best"),
        F.when(rate >= 0.7, "STABLE").when(rate >= 0.5, "MIXED").otherwise("UNSTABLE").alias("label"),
    )


@query("c16_side_profile", f"""WITH {H}, {SIDE}, d AS (SELECT *, epoch(side_ts) - epoch(lag(side_ts) OVER (PARTITION BY symbol ORDER BY side_ts)) AS d FROM fund), p AS (SELECT symbol, count(*) AS rows, count(*) FILTER (d > 7200) AS breaks, round(quantile_cont(rate, 0.2), 6) AS q20, round(quantile_cont(rate, 0.8), 6) AS q80, round(avg((rate < 20)::INT), 6) AS low_share FROM d GROUP BY symbol),
m AS (SELECT b.symbol, count(*) FILTER (f.side_ts IS NULL OR epoch(b.ts) - epoch(f.side_ts) > 3600) AS unmatched FROM bars b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.ts >= f.side_ts GROUP BY b.symbol) SELECT * FROM p JOIN m USING (symbol)""")
def c16(spark, sf):
    f = fund(spark, sf)
    d = steps(f.withColumnRenamed("side_ts", "ts")).withColumnRenamed("seconds", "d")
    p = d.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(F.col("d") > 7200).alias("breaks"), F.round(F.percentile("rate", 0.2), 6).alias("q20"), F.round(F.percentile("rate", 0.8), 6).alias("q80"), F.round(share(F.col("rate") < 20), 6).alias("low_share"))
    m = J.asof_backward(hourly(spark, sf), f, keys=["symbol"], values=["rate"], tolerance=HOUR).groupBy("symbol").agg(F.count_if(F.col("side_ts").isNull()).alias("unmatched"))
    return p.join(m, "symbol")


@query("a17_side_regimes", f"""WITH {H}, {RET}, {FORWARD}, {SIDE}, j AS (SELECT b.symbol, f4, rate FROM fwd b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.ts >= f.side_ts), q AS (SELECT symbol, quantile_cont(rate, 0.2) AS lo, quantile_cont(rate, 0.8) AS hi FROM j GROUP BY symbol)
SELECT symbol, CASE WHEN rate IS NULL THEN 'MISSING' WHEN rate <= lo THEN 'LOW' WHEN rate >= hi THEN 'HIGH' ELSE 'MIDDLE' END AS regime, CASE WHEN rate IS NULL THEN 9 WHEN rate <= lo THEN 1 WHEN rate >= hi THEN 3 ELSE 2 END AS place, count(f4) AS n, round(avg(f4), 6) AS mean FROM j JOIN q USING (symbol) GROUP BY ALL""")
def a17(spark, sf):
    j = J.asof_backward(forward(returns(hourly(spark, sf))), fund(spark, sf), keys=["symbol"], values=["rate"])
    q = j.groupBy("symbol").agg(F.percentile("rate", 0.2).alias("lo"), F.percentile("rate", 0.8).alias("hi"))
    r = F.col("rate")
    pick = lambda a, b, c, d: F.when(r.isNull(), a).when(r <= F.col("lo"), b).when(r >= F.col("hi"), c).otherwise(d)
    return j.join(q, "symbol").groupBy("symbol", pick("MISSING", "LOW", "HIGH", "MIDDLE").alias("regime"), pick(9, 1, 3, 2).alias("place")).agg(F.count("f4").alias("n"), F.round(F.avg("f4"), 6).alias("mean"))


PERIODS = [("all", None, None), ("early", None, "1995-01-01"), ("mid", "1994-01-01", "1997-01-01"), ("late", "1996-01-01", None)]


@query("p05_periods", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, p(period, a, b) AS (VALUES ('all', NULL, NULL), ('early', NULL, TIMESTAMP '1995-01-01'), ('mid', TIMESTAMP '1994-01-01', TIMESTAMP '1997-01-01'), ('late', TIMESTAMP '1996-01-01', NULL))
SELECT symbol, period, count(ret) AS n, round(avg(ret), 8) AS mean FROM rets JOIN p ON (a IS NULL OR ts >= a) AND (b IS NULL OR ts < b) GROUP BY ALL""")
def p05(spark, sf):
    return E.in_periods(returns(daily(spark, sf)), PERIODS).groupBy("symbol", "period").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 8).alias("mean"))


@query("p12_quadrants", f"""WITH {H}, d AS (SELECT symbol, row_pos, "close" - lag("close", 6) OVER (PARTITION BY symbol ORDER BY row_pos) AS dp, volume - lag(volume, 6) OVER (PARTITION BY symbol ORDER BY row_pos) AS dv FROM bars)
SELECT symbol, CASE WHEN dp IS NULL THEN 'UNKNOWN' WHEN dp > 0 AND dv > 0 THEN 'UP_UP' WHEN dp > 0 THEN 'UP_DOWN' WHEN dv > 0 THEN 'DOWN_UP' ELSE 'DOWN_DOWN' END AS quadrant, sign(coalesce(dp, 0))::INT AS direction, count(*) AS n FROM d GROUP BY ALL""")
def p12(spark, sf):
    b = rolling(hourly(spark, sf), {"dp": lambda w: F.col("close") - F.lag("close", 6).over(w), "dv": lambda w: F.col("volume") - F.lag("volume", 6).over(w)}, back=6)
    dp, dv = F.col("dp"), F.col("dv")
    name = F.when(dp.isNull(), "UNKNOWN").when((dp > 0) & (dv > 0), "UP_UP").when(dp > 0, "UP_DOWN").when(dv > 0, "DOWN_UP").otherwise("DOWN_DOWN")
    return b.groupBy("symbol", name.alias("quadrant"), F.signum(F.coalesce(dp, F.lit(0.0))).cast("int").alias("direction")).agg(F.count("*").alias("n"))


@query("p14_trade_returns", f"""WITH {H}, x AS (SELECT symbol, row_pos, lead(open) OVER q AS e, lead(open, 5) OVER q AS x, ret FROM (SELECT *, "close" / lag("close") OVER (PARTITION BY symbol ORDER BY row_pos) - 1 AS ret FROM bars) WINDOW q AS (PARTITION BY symbol ORDER BY row_pos))
SELECT symbol, row_pos, round(x / e - 1 - 0.8 / e, 8) AS long_net, round(1 - x / e - 0.8 / e, 8) AS short_net, round(CASE WHEN ret < -0.2 THEN x / e - 1 - 0.8 / e WHEN ret > 0.2 THEN 1 - x / e - 0.8 / e END, 8) AS contrarian, round(2 * (x / e - 1) - 2 * 2 * 5 / 1e4, 8) AS levered FROM x WHERE x IS NOT NULL""")
def p14(spark, sf):
    b = rolling(returns(hourly(spark, sf), "simple"), {"e": lambda w: F.lead("open").over(w), "x": lambda w: F.lead("open", 5).over(w)}, back=1, ahead=5).filter("x is not null")
    up, cost, r = F.col("x") / F.col("e") - 1, 0.8 / F.col("e"), F.col("ret")
    cols = {"long_net": up - cost, "short_net": 1 - F.col("x") / F.col("e") - cost, "contrarian": F.when(r < -0.2, up - cost).when(r > 0.2, 1 - F.col("x") / F.col("e") - cost), "levered": 2 * up - 2 * 2 * 5 / 1e4}
    return b.select("symbol", "row_pos", *[F.round(v, 8).alias(k) for k, v in cols.items()])


@query("p18_fragility_flags", f"""WITH {H}, {RET}, {FORWARD}, g AS (SELECT symbol, count(f4) AS n, avg(f4) AS mean, avg((f4 > 0)::INT) FILTER (f4 IS NOT NULL) AS win, quantile_cont(f4, 0.05) AS p05 FROM fwd GROUP BY symbol)
SELECT symbol, n, CASE WHEN n < 30 THEN 'LOW_COUNT' WHEN mean <= 0 THEN 'NEGATIVE' WHEN win < 0.5 THEN 'LOW_WIN' WHEN p05 < -100 THEN 'FAT_TAIL' ELSE 'OK' END AS flag FROM g""")
def p18(spark, sf):
    c = F.col("f4")
    g = forward(returns(hourly(spark, sf))).groupBy("symbol").agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.avg((c > 0).cast("int")).alias("win"), F.percentile(c, 0.05).alias("p05"))
    flag = F.when(F.col("n") < 30, "LOW_COUNT").when(F.col("mean") <= 0, "NEGATIVE").when(F.col("win") < 0.5, "LOW_WIN").when(F.col("p05") < -100, "FAT_TAIL").otherwise("OK")
    return g.select("symbol", "n", flag.alias("flag"))


@query("a16_directed_groups", """WITH o AS (SELECT o_orderpriority AS p, o_orderstatus AS s, o_totalprice AS x, lead(o_totalprice) OVER q / o_totalprice - 1 AS f1, lead(o_totalprice, 3) OVER q / o_totalprice - 1 AS f3 FROM orders WINDOW q AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)), d AS (SELECT *, CASE WHEN s = 'O' THEN 1 WHEN s = 'F' THEN -1 END AS dir FROM o)
SELECT p, s, count(dir) AS n, round(avg(dir * f1 - 0.01), 6) AS mean1, round(avg(dir * f3 - 0.01), 6) AS mean3, round(avg((dir * f1 - 0.01 > 0)::INT), 6) AS win1 FROM d GROUP BY p, s""")
def a16(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    x = F.col("o_totalprice")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), (F.lead(x).over(w) / x - 1).alias("f1"), (F.lead(x, 3).over(w) / x - 1).alias("f3"))
    d = F.when(F.col("s") == "O", 1).when(F.col("s") == "F", -1)
    n1, n3 = d * F.col("f1") - 0.01, d * F.col("f3") - 0.01
    return o.groupBy("p", "s").agg(F.count(d).alias("n"), F.round(F.avg(n1), 6).alias("mean1"), F.round(F.avg(n3), 6).alias("mean3"), F.round(F.avg((n1 > 0).cast("int")), 6).alias("win1"))


@query("j07_dev_oos", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, m AS (SELECT symbol, isodow(ts)::INT AS dow, avg(ret) FILTER (ts < TIMESTAMP '1996-01-01') AS dev, avg(ret) FILTER (ts >= TIMESTAMP '1996-01-01') AS oos FROM rets GROUP BY ALL)
SELECT symbol, dow, round(dev, 8) AS dev, round(oos, 8) AS oos, round(oos - dev, 8) AS delta, dev > 0 AND oos > 0 AS both_positive FROM m""")
def j07(spark, sf):
    early = F.col("ts") < F.lit("1996-01-01").cast("timestamp")
    m = returns(daily(spark, sf)).groupBy("symbol", (F.weekday("ts") + 1).alias("dow")).agg(F.avg(F.when(early, F.col("ret"))).alias("dev"), F.avg(F.when(~early, F.col("ret"))).alias("oos"))
    return m.select("symbol", "dow", F.round("dev", 8).alias("dev"), F.round("oos", 8).alias("oos"), F.round(F.col("oos") - F.col("dev"), 8).alias("delta"), ((F.col("dev") > 0) & (F.col("oos") > 0)).alias("both_positive"))


@query("w20_ranks", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, m AS (SELECT symbol, month(ts)::INT AS month, round(avg(ret), 10) AS mean FROM rets GROUP BY ALL)
SELECT symbol, month, row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, month)::INT AS place, (rank() OVER (PARTITION BY symbol ORDER BY mean) + (count(*) OVER (PARTITION BY symbol, mean) - 1) / 2)::DOUBLE AS average_rank FROM m""")
def w20(spark, sf):
    m = returns(daily(spark, sf)).groupBy("symbol", F.month("ts").alias("month")).agg(F.round(F.avg("ret"), 10).alias("mean"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("mean"), "month"))
    average = F.rank().over(Window.partitionBy("symbol").orderBy("mean")) + (F.count("*").over(Window.partitionBy("symbol", "mean")) - 1) / 2
    return m.select("symbol", "month", place.alias("place"), average.cast("double").alias("average_rank"))


@query("a33_regime_split", f"""WITH {H}, {RET}, {FORWARD}, v AS (SELECT *, CASE WHEN row_pos >= 24 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 23 PRECEDING) END AS vol FROM fwd), q AS (SELECT symbol, quantile_cont(vol, 0.5) AS med FROM v GROUP BY symbol), r AS (SELECT v.*, coalesce(vol > med, false) AS hi FROM v JOIN q USING (symbol) WHERE f1 IS NOT NULL)
SELECT symbol, regime, count(*) AS n, round(avg(x) / nullif(stddev_samp(x), 0), 6) AS score FROM (SELECT symbol, unnest(['high', 'low']) AS regime, unnest([CASE WHEN hi THEN f1 ELSE 0 END, CASE WHEN hi THEN 0 ELSE f1 END]) AS x FROM r) GROUP BY ALL""")
def a33(spark, sf):
    from barspan.operators.scan import framed

    b = rolling(forward(returns(hourly(spark, sf))), {"vol": framed(F.stddev_samp, F.col("ret"), -23, 0)}, back=24)
    q = b.groupBy("symbol").agg(F.percentile("vol", 0.5).alias("med"))
    hi = F.coalesce(F.col("vol") > F.col("med"), F.lit(False))
    rows = F.explode(F.array(F.struct(F.lit("high").alias("regime"), F.when(hi, F.col("f1")).otherwise(0.0).alias("x")), F.struct(F.lit("low").alias("regime"), F.when(hi, 0.0).otherwise(F.col("f1")).alias("x")))).alias("r")
    r = b.join(q, "symbol").filter("f1 is not null").select("symbol", rows).select("symbol", "r.*")
    return r.groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.round(F.avg("x") / F.nullif(F.stddev_samp("x"), F.lit(0)), 6).alias("score"))


@query("a34_histogram", f"""WITH {H}, {RET} SELECT symbol, least(greatest(floor((ret + 2) / 0.1), 0), 39)::INT AS bin, count(*) AS n FROM rets WHERE ret IS NOT NULL GROUP BY ALL""")
def a34(spark, sf):
    r = returns(hourly(spark, sf)).filter("ret is not null")
    return r.groupBy("symbol", F.least(F.greatest(F.floor((F.col("ret") + 2) / 0.1), F.lit(0)), F.lit(39)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("p20_labels", """SELECT event_type, upper(substr(event_type, 1, 3)) AS base, upper(substr(event_type, 4, 3)) AS quote, strftime(ts, '%Y-%m') AS month, (ts::DATE + 1)::VARCHAR AS available, count(*) AS n FROM events GROUP BY ALL""")
def p20(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.upper(F.substring("event_type", 1, 3)).alias("base"), F.upper(F.substring("event_type", 4, 3)).alias("quote"), F.date_format("ts", "yyyy-MM").alias("month"), F.date_add(F.to_date("ts"), 1).cast("string").alias("available")).agg(F.count("*").alias("n"))
