"""Queries on joins of bars with side series and with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions import true_range
from barspan.operators import asof as J
from barspan.operators.panel import pair_correlations, panel, symbols_of
from barspan.operators.scan import framed, positions, ranked, rolling

from .profile_queries import RET, returns
from .registry import query
from .tables import daily, daily_sql, hourly, hourly_sql, table

H, D = hourly_sql(), daily_sql()
#: Minutes of one event type act as the slower side series of the same symbol.
SIDE = "fund AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS side_ts, round(avg(value), 6) AS rate FROM events GROUP BY ALL)"


def fund(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").alias("side_ts")).agg(F.round(F.avg("value"), 6).alias("rate"))


@query("j01_panel", f"""WITH {H} SELECT epoch(ts)::BIGINT AS ts, count(*) AS assets, round(sum("close"), 6) AS total, max(symbol) AS top FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)""")
def j01(spark, sf):
    b = hourly(spark, sf)
    per = b.groupBy("ts").agg(F.count("*").alias("assets"), F.round(F.sum("close"), 6).alias("total"), F.max("symbol").alias("top"))
    n = b.agg(F.count_distinct("symbol").alias("n"))
    return per.join(F.broadcast(n), F.col("assets") == F.col("n")).select(F.unix_timestamp("ts").alias("ts"), "assets", "total", "top")


@query("j01_panel_rows", f"""WITH {H}, n AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM bars)), p AS (SELECT ts, list("close" ORDER BY symbol) AS v FROM bars GROUP BY ts HAVING count(*) = (SELECT count(*) FROM n))
SELECT epoch(ts)::BIGINT AS ts, {', '.join(f'round(v[{k + 1}], 6) AS close_{k}' for k in range(5))} FROM p""")
def j01_rows(spark, sf):
    """The panel itself: the closes of all symbols at each time at which all have one, in the order of their names."""
    b = hourly(spark, sf)
    p = panel(b, "close", names=symbols_of(b))
    return p.select(F.unix_timestamp("ts").alias("ts"), *[F.round(F.get("values", F.lit(k)), 6).alias(f"close_{k}") for k in range(5)])


@query("j02_spread", """WITH y AS (SELECT o_orderpriority AS cur, o_orderdate::DATE AS d, avg(o_totalprice) AS y FROM orders GROUP BY ALL)
SELECT a.d::VARCHAR AS d, a.cur AS base, b.cur AS quote, round(a.y - b.y, 4) AS spread FROM y a JOIN y b ON a.d = b.d AND a.cur < b.cur""")
def j02(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("cur"), F.col("o_orderdate").cast("date").alias("d")).agg(F.avg("o_totalprice").alias("y"))
    a, b = y.select("d", F.col("cur").alias("base"), F.col("y").alias("ya")), y.select("d", F.col("cur").alias("quote"), F.col("y").alias("yb"))
    return a.join(b, "d").filter("base < quote").select(F.col("d").cast("string").alias("d"), "base", "quote", F.round(F.col("ya") - F.col("yb"), 4).alias("spread"))


@query("j03_asof_backward", f"""WITH {H}, {SIDE} SELECT b.symbol, row_pos, CASE WHEN epoch(ts) - epoch(side_ts) <= 1800 THEN epoch(side_ts)::BIGINT END AS side_ts, CASE WHEN epoch(ts) - epoch(side_ts) <= 1800 THEN rate END AS rate
FROM bars b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.ts >= f.side_ts""")
def j03(spark, sf):
    out = J.asof_backward(hourly(spark, sf), fund(spark, sf), keys=["symbol"], values=["rate"], tolerance=1800)
    return out.select("symbol", "row_pos", F.unix_timestamp("side_ts").alias("side_ts"), "rate")


@query("j04_asof_nearest", f"""WITH {H}, {SIDE}, p AS (SELECT b.symbol, row_pos, b.ts, side_ts AS bt, rate AS br FROM bars b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.ts >= f.side_ts),
q AS (SELECT p.*, f.side_ts AS nt, f.rate AS ar FROM p ASOF LEFT JOIN fund f ON p.symbol = f.symbol AND p.ts <= f.side_ts), r AS (SELECT *, CASE WHEN bt IS NULL OR nt - ts < ts - bt THEN nt ELSE bt END AS t, CASE WHEN bt IS NULL OR nt - ts < ts - bt THEN ar ELSE br END AS v FROM q)
SELECT symbol, row_pos, CASE WHEN abs(epoch(ts) - epoch(t)) <= 600 THEN epoch(t)::BIGINT END AS side_ts, CASE WHEN abs(epoch(ts) - epoch(t)) <= 600 THEN v END AS rate FROM r""")
def j04(spark, sf):
    out = J.asof_nearest(hourly(spark, sf), fund(spark, sf), keys=["symbol"], values=["rate"], tolerance=600)
    return out.select("symbol", "row_pos", F.unix_timestamp("side_ts").alias("side_ts"), "rate")


@query("j05_asof_shifted", f"""WITH {H}, {SIDE}, g AS (SELECT symbol, side_ts + INTERVAL 1 DAY AS side_ts, rate FROM fund) SELECT b.symbol, row_pos, epoch(side_ts)::BIGINT AS side_ts, rate FROM bars b ASOF LEFT JOIN g f ON b.symbol = f.symbol AND b.ts >= f.side_ts""")
def j05(spark, sf):
    late = fund(spark, sf).withColumn("side_ts", F.col("side_ts") + F.expr("INTERVAL 1 DAY"))
    out = J.asof_backward(hourly(spark, sf), late, keys=["symbol"], values=["rate"])
    return out.select("symbol", "row_pos", F.unix_timestamp("side_ts").alias("side_ts"), "rate")


@query("j06_interval_sum", f"""WITH {H}, {SIDE}, e AS (SELECT symbol, row_pos, ts, lead(ts, 8) OVER (PARTITION BY symbol ORDER BY row_pos) AS until FROM bars)
SELECT e.symbol, row_pos, round(coalesce(sum(rate), 0), 4) AS funding FROM e LEFT JOIN fund f ON f.symbol = e.symbol AND f.side_ts > e.ts AND f.side_ts <= e.until WHERE until IS NOT NULL GROUP BY ALL""")
def j06(spark, sf):
    e = rolling(hourly(spark, sf), {"until": lambda w: F.lead("ts", 8).over(w)}, ahead=8).filter("until is not null").select("symbol", "row_pos", "ts", "until")
    out = J.interval_sum(e, fund(spark, sf), key="symbol", start="ts", end="until", ts="side_ts", value="rate", out="funding")
    return out.select("symbol", "row_pos", F.round("funding", 4).alias("funding"))


@query("j09_fold_bars", f"""WITH {D}, folds AS (SELECT f AS fold, (DATE '1992-01-01' + to_months(6 * f::INT))::TIMESTAMP AS a FROM range(10) t(f))
SELECT symbol, fold, count(*) FILTER (ts < a + INTERVAL 24 MONTH) AS train, count(*) FILTER (ts >= a + INTERVAL 24 MONTH AND ts < a + INTERVAL 30 MONTH) AS validation, count(*) FILTER (ts >= a + INTERVAL 30 MONTH) AS test FROM days JOIN folds ON ts >= a AND ts < a + INTERVAL 33 MONTH GROUP BY ALL""")
def j09(spark, sf):
    folds = month_folds(spark, "1992-01-01", 10)
    j = daily(spark, sf).join(F.broadcast(folds), (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("d")))
    return j.groupBy("symbol", "fold").agg(F.count_if(F.col("ts") < F.col("b")).alias("train"), F.count_if((F.col("ts") >= F.col("b")) & (F.col("ts") < F.col("c"))).alias("validation"), F.count_if(F.col("ts") >= F.col("c")).alias("test"))


def month_folds(spark, start: str, n: int, train: int = 24, validation: int = 6, test: int = 3, step: int = 6):
    """fold, a (train start), b (train end), c (validation end), d (test end): a short fixed table."""
    at = lambda m: F.add_months(F.lit(start).cast("date"), (F.col("id") * step + m).cast("int")).cast("timestamp")
    return spark.range(n).select(F.col("id").alias("fold"), at(0).alias("a"), at(train).alias("b"), at(train + validation).alias("c"), at(train + validation + test).alias("d"))


@query("j10_parameter_grid", f"""WITH {H}, t AS (SELECT symbol, row_pos, greatest(high - low, abs(high - lag("close") OVER w), abs(low - lag("close") OVER w)) AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY row_pos)), v AS (SELECT symbol, row_pos, CASE WHEN row_pos >= 13 THEN avg(r) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 13 PRECEDING) END AS atr FROM t),
g AS (SELECT row_number() OVER (ORDER BY s, l, sl, tp) - 1 AS grid_ix, s, l, sl, tp FROM (VALUES (5), (10), (20), (40)) a(s), (VALUES (50), (80), (120), (200)) b(l), (VALUES (0.0::DOUBLE), (1.5), (3.0)) c(sl), (VALUES (0.0::DOUBLE), (2.0), (4.0)) d(tp))
SELECT symbol, grid_ix, s AS short_ma, l AS long_ma, count(*) FILTER (row_pos >= l) AS bars, round(avg(sl * atr) FILTER (row_pos >= l), 6) AS mean_stop, round(avg(tp * atr) FILTER (row_pos >= l), 6) AS mean_target FROM v, g GROUP BY ALL""")
def j10(spark, sf):
    """The 144 strategies against the bars: bars with a known signal, mean distance of stop and target."""
    b = rolling(hourly(spark, sf), {"tr": lambda w: true_range(F.lag("close").over(w))}, back=1)
    b = rolling(b, {"atr": framed(F.avg, F.col("tr"), -13, 0)}, back=14)
    j = b.select("symbol", "row_pos", "atr").join(F.broadcast(strategy_grid(spark)), F.lit(True))
    on = F.col("row_pos") >= F.col("long_ma")
    mean = lambda k: F.round(F.avg(F.when(on, F.coalesce(F.col(k), F.lit(0.0)) * F.col("atr"))), 6)
    return j.groupBy("symbol", "grid_ix", "short_ma", "long_ma").agg(F.count_if(on).alias("bars"), mean("sl_atr").alias("mean_stop"), mean("tp_atr").alias("mean_target"))


def strategy_grid(spark):
    """144 strategies: four short and four long averages, three stops and three targets (null: none)."""
    rows = [(s, x, sl, tp) for s in (5, 10, 20, 40) for x in (50, 80, 120, 200) for sl in (None, 1.5, 3.0) for tp in (None, 2.0, 4.0)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "grid_ix bigint, short_ma int, long_ma int, sl_atr double, tp_atr double")


@query("j12_buy_and_hold", f"""WITH {D} SELECT symbol, year(ts)::INT AS year, round(arg_max("close", ts) / arg_min(open, ts) - 1, 8) AS hold_ret, count(*) AS bars FROM days GROUP BY ALL""")
def j12(spark, sf):
    d = daily(spark, sf)
    return d.groupBy("symbol", F.year("ts").alias("year")).agg(F.round(F.max_by("close", "ts") / F.min_by("open", "ts") - 1, 8).alias("hold_ret"), F.count("*").alias("bars"))


@query("w14_side_features", f"""WITH {SIDE}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY side_ts) - 1 AS row_pos FROM fund)
SELECT symbol, row_pos, round(sum(rate) OVER (w ROWS 2 PRECEDING), 6) AS sum3, round(ln(rate / lag(rate, 6) OVER w), 6) AS chg6 FROM r WHERE rate > 0 WINDOW w AS (PARTITION BY symbol ORDER BY row_pos)""")
def w14(spark, sf):
    f = positions(fund(spark, sf), ts="side_ts").filter("rate > 0").withColumnRenamed("row_pos", "pos")
    f = ranked(f, keys=["symbol"], order=["pos"], out="row_pos")
    f = rolling(f, {"sum3": lambda w: F.sum("rate").over(w.rowsBetween(-2, 0)), "chg6": lambda w: F.log(F.col("rate") / F.lag("rate", 6).over(w))}, back=6)
    return f.select("symbol", F.col("pos").alias("row_pos"), F.round("sum3", 6).alias("sum3"), F.round("chg6", 6).alias("chg6"))


@query("a18_pairwise_correlation", f"""WITH {H}, {RET}, p AS (SELECT a.symbol AS x, b.symbol AS y, a.ts, a.ret AS rx, b.ret AS ry FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
m AS (SELECT ts, avg(ret) AS mkt FROM rets WHERE ret IS NOT NULL GROUP BY ts), q AS (SELECT quantile_cont(mkt, 0.1) AS lo, quantile_cont(mkt, 0.9) AS hi FROM m),
g AS (SELECT p.*, unnest(['all', CASE WHEN mkt <= lo THEN 'bottom' WHEN mkt >= hi THEN 'top' ELSE 'central' END]) AS regime FROM p JOIN m USING (ts), q), c0 AS (SELECT regime, x, y, CASE WHEN count(*) > 1 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS r FROM g GROUP BY ALL), c AS (SELECT * FROM c0)
SELECT regime, count(r) AS pairs, round(avg(r), 6) AS mean_corr, round(min(r), 6) AS min_corr, round(max(r), 6) AS max_corr FROM c GROUP BY regime""")
def a18(spark, sf):
    r = returns(hourly(spark, sf)).filter("ret is not null").select("symbol", "ts", "ret")
    names = symbols_of(r)
    m = r.groupBy("ts").agg(F.avg("ret").alias("mkt"))
    q = m.agg(F.percentile("mkt", 0.1).alias("lo"), F.percentile("mkt", 0.9).alias("hi"))
    own = F.when(F.col("mkt") <= F.col("lo"), "bottom").when(F.col("mkt") >= F.col("hi"), "top").otherwise("central")
    rows = panel(r, "ret", names=names, whole=False).join(m, "ts").join(F.broadcast(q), F.lit(True)).select("values", F.explode(F.array(F.lit("all"), own)).alias("regime"))
    c = pair_correlations(rows, len(names), group="regime")
    return c.groupBy("regime").agg(F.count("r").alias("pairs"), F.round(F.avg("r"), 6).alias("mean_corr"), F.round(F.min("r"), 6).alias("min_corr"), F.round(F.max("r"), 6).alias("max_corr"))


@query("a19_tail_dependence", f"""WITH {H}, {RET}, p AS (SELECT a.symbol AS x, b.symbol AS y, a.ret AS rx, b.ret AS ry FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
q AS (SELECT x, y, quantile_cont(rx, 0.1) AS qx, quantile_cont(ry, 0.1) AS qy FROM p GROUP BY ALL)
SELECT x, y, round(avg((ry <= qy)::INT) FILTER (rx <= qx), 6) AS tail_dep, round(corr(rx, ry) FILTER (rx < 0 AND ry < 0), 6) AS down_corr, round(avg((rx + ry) / 2) FILTER (rx <= qx AND ry <= qy), 6) AS joint_es, round(min((rx + ry) / 2), 6) AS worst FROM p JOIN q USING (x, y) GROUP BY ALL""")
def a19(spark, sf):
    r = returns(hourly(spark, sf)).filter("ret is not null").select("symbol", "ts", "ret")
    p = r.select("ts", F.col("symbol").alias("x"), F.col("ret").alias("rx")).join(r.select("ts", F.col("symbol").alias("y"), F.col("ret").alias("ry")), "ts").filter("x < y")
    q = p.groupBy("x", "y").agg(F.percentile("rx", 0.1).alias("qx"), F.percentile("ry", 0.1).alias("qy"))
    low_x, low_y, both = F.col("rx") <= F.col("qx"), F.col("ry") <= F.col("qy"), (F.col("rx") + F.col("ry")) / 2
    down = (F.col("rx") < 0) & (F.col("ry") < 0)
    return p.join(q, ["x", "y"]).groupBy("x", "y").agg(
        F.round(F.avg(F.when(low_x, low_y.cast("int"))), 6).alias("tail_dep"), F.round(F.corr(F.when(down, F.col("rx")), F.when(down, F.col("ry"))), 6).alias("down_corr"),
        F.round(F.avg(F.when(low_x & low_y, both)), 6).alias("joint_es"), F.round(F.min(both), 6).alias("worst"))
