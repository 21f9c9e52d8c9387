"""Queries on event tables of several kinds, stress suites and whole studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspan.functions import profit_factor, share
from barspan.operators import asof as J
from barspan.operators import montecarlo as MC
from barspan.operators import positions as T
from barspan.operators import resample as R
from barspan.operators import stats as S
from barspan.operators.scan import ranked, rolling

from .asof_queries import SIDE, fund
from .event_queries import EVENTS, path_events
from .position_queries import CROSS, LOG, cross, log
from .profile_queries import RET, returns
from .registry import query
from .resample_queries import H as BARS
from .resample_queries import SEED, grid_returns, grid_sql, md5_sql
from .stat_queries import FORWARD, LONG, SHOCK, VOL, forward, long_horizons, regimes, t_sql
from .tables import daily, daily_sql, hourly, table

H, D = BARS, daily_sql()
MR = "CASE WHEN side = 'low' THEN fret ELSE -fret END"
HIT = "CASE WHEN side = 'low' THEN ret <= threshold ELSE ret >= threshold END"
CLOSE_EVENTS = f"ce AS (SELECT symbol, side, horizon, row_pos, ts, ret, fret AS gross, {MR} AS mr FROM long JOIN lim USING (symbol) WHERE level = 0.05 AND {HIT} AND fret IS NOT NULL)"
BASE = f"{H}, {RET}, {FORWARD}, {LONG}, {SHOCK}, {CLOSE_EVENTS}"


def close_events(spark, sf):
    """Shocks beyond the 5 % thresholds, from close to close over each horizon, by side."""
    f = forward(returns(hourly(spark, sf))).select("symbol", "row_pos", "ts", "ret", "f1", "f4", "f12", "f24")
    ev = long_horizons(S.shock_events(f, "ret", [0.05])).filter("fret is not null")
    mr = F.when(F.col("side") == "low", F.col("fret")).otherwise(-F.col("fret"))
    return ev.select("symbol", "side", "horizon", "row_pos", "ts", "ret", F.col("fret").alias("gross"), mr.alias("mr"))


@query("e04_close_events", f"WITH {BASE} SELECT symbol, side, horizon::INT AS horizon, row_pos, row_pos + horizon AS exit_pos, round(ret, 6) AS ret, round(gross, 6) AS gross, round(mr, 6) AS mr FROM ce")
def e04(spark, sf):
    return close_events(spark, sf).select("symbol", "side", "horizon", "row_pos", (F.col("row_pos") + F.col("horizon")).alias("exit_pos"), *[F.round(c, 6).alias(c) for c in ("ret", "gross", "mr")])


#: A side series of whole hours, and what it pays while an event is held.
SIDED = f"""{SIDE}, lo AS (SELECT ce.*, lead_ts AS until FROM ce JOIN (SELECT symbol, row_pos, unnest([1, 4, 12, 24]) AS horizon, unnest([lead(ts, 1) OVER w, lead(ts, 4) OVER w, lead(ts, 12) OVER w, lead(ts, 24) OVER w]) AS lead_ts FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY row_pos)) USING (symbol, row_pos, horizon) WHERE side = 'low'),
se AS (SELECT l.*, f.rate FROM lo l ASOF LEFT JOIN fund f ON l.symbol = f.symbol AND l.ts >= f.side_ts), pay AS (SELECT l.symbol, l.horizon, l.row_pos, coalesce(sum(f.rate), 0) AS held FROM lo l LEFT JOIN fund f ON f.symbol = l.symbol AND f.side_ts > l.ts AND f.side_ts <= l.until GROUP BY ALL),
sa AS (SELECT se.*, held, gross - held / 100 AS adjusted FROM se JOIN pay USING (symbol, horizon, row_pos) WHERE rate IS NOT NULL)"""


def side_events(spark, sf):
    """Low shocks with the side value known at the signal and the side payments until the exit taken off."""
    ev = close_events(spark, sf).filter("side = 'low'")
    steps = rolling(hourly(spark, sf), {f"u{h}": lambda w, h=h: F.lead("ts", h).over(w) for h in (1, 4, 12, 24)}, ahead=24)
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"u{h}").alias("until")) for h in (1, 4, 12, 24)])).alias("h")
    until = steps.select("symbol", "row_pos", rows).select("symbol", "row_pos", "h.*")
    side = fund(spark, sf)
    ev = J.asof_backward(ev.join(until, ["symbol", "row_pos", "horizon"]), side, keys=["symbol"], values=["rate"]).drop("side_ts").filter("rate is not null")
    paid = J.interval_sum(ev, side, key="symbol", start="ts", end="until", ts="side_ts", value="rate", out="held")
    return paid.withColumn("adjusted", F.col("gross") - F.col("held") / 100)


@query("e05_side_adjusted_events", f"WITH {BASE}, {SIDED} SELECT symbol, horizon::INT AS horizon, row_pos, round(rate, 6) AS rate, round(held, 4) AS held, round(gross, 6) AS gross, round(adjusted, 4) AS adjusted FROM sa")
def e05(spark, sf):
    return side_events(spark, sf).select("symbol", "horizon", "row_pos", F.round("rate", 6).alias("rate"), F.round("held", 4).alias("held"), F.round("gross", 6).alias("gross"), F.round("adjusted", 4).alias("adjusted"))


@query("e06_stacked_events", f"""WITH {EVENTS.replace("lim AS", "lim0 AS").replace("JOIN lim ", "JOIN lim0 ")}, {FORWARD}, {LONG}, {SHOCK}, {CLOSE_EVENTS}, {SIDED},
st AS (SELECT 'path' AS source, candidate_id, row_pos, ts, path_ret * 100 AS value FROM evt UNION ALL SELECT 'close', concat_ws('_', symbol, side, horizon), row_pos, ts, mr FROM ce UNION ALL SELECT 'side', concat_ws('_', symbol, horizon), row_pos, ts, adjusted FROM sa)
SELECT source, candidate_id, concat_ws(':', source, candidate_id, row_pos) AS event_key, year(ts)::INT AS year, round(value, 4) AS value FROM st""")
def e06(spark, sf):
    """Path, close and side-adjusted events in one table, with a key and the year."""
    a = path_events(spark, sf).select(F.lit("path").alias("source"), "candidate_id", "row_pos", "ts", (F.col("path_ret") * 100).alias("value"))
    b = close_events(spark, sf).select(F.lit("close"), F.concat_ws("_", "symbol", "side", "horizon"), "row_pos", "ts", "mr")
    c = side_events(spark, sf).select(F.lit("side"), F.concat_ws("_", "symbol", "horizon"), "row_pos", "ts", "adjusted")
    both = a.union(b).union(c)
    return both.select("source", "candidate_id", F.concat_ws(":", "source", "candidate_id", "row_pos").alias("event_key"), F.year("ts").alias("year"), F.round("value", 4).alias("value"))


@query("e08_candidate_by_year", f"""WITH {H}, {RET}, {FORWARD}, {VOL}, lim AS (SELECT symbol, quantile_cont(ret, 0.05) AS lo FROM rets GROUP BY symbol)
SELECT symbol, year(ts)::INT AS year, count(*) AS n, round(avg(ret), 6) AS ret, round(avg(vol), 6) AS vol, round(avg(f4), 6) AS mean, round(quantile_cont(f4, 0.5), 6) AS median, round(avg((f4 > 0)::INT), 6) AS win_rate FROM reg JOIN lim USING (symbol) WHERE regime = 'V5' AND ret <= lo AND f4 IS NOT NULL GROUP BY ALL""")
def e08(spark, sf):
    """Low shocks in the highest volatility regime, by year."""
    r = returns(hourly(spark, sf))
    lim = r.groupBy("symbol").agg(F.percentile("ret", 0.05).alias("lo"))
    ev = regimes(forward(r)).filter("regime = 'V5' and f4 is not null").join(lim, "symbol").filter("ret <= lo")
    mean = lambda c: F.round(F.avg(c), 6)
    return ev.groupBy("symbol", F.year("ts").alias("year")).agg(F.count("*").alias("n"), mean("ret").alias("ret"), mean("vol").alias("vol"), mean("f4").alias("mean"), F.round(F.percentile("f4", 0.5), 6).alias("median"), F.round(share(F.col("f4") > 0), 6).alias("win_rate"))


@query("j08_masks_on_paths", f"""WITH {EVENTS}, {FORWARD}, {VOL} SELECT pth.symbol, regime, count(*) AS n, round(avg(path_ret), 6) AS mean, round(avg(mae), 6) AS mae FROM pth JOIN reg ON reg.symbol = pth.symbol AND reg.row_pos = pth.row_pos
WHERE path_ret IS NOT NULL AND EXISTS (SELECT 1 FROM lim WHERE lim.symbol = pth.symbol AND side = 'low' AND level = 0.05 AND pth.ret <= threshold) GROUP BY ALL""")
def j08(spark, sf):
    """An event mask met with path outcomes and regime flags by (symbol, row_pos)."""
    events = path_events(spark, sf).filter("side = 'low' and level = 0.05").select("symbol", "row_pos", "path_ret", "mae")
    flags = regimes(forward(returns(hourly(spark, sf)))).select("symbol", "row_pos", "regime")
    return events.join(flags, ["symbol", "row_pos"]).groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.round(F.avg("path_ret"), 6).alias("mean"), F.round(F.avg("mae"), 6).alias("mae"))


@query("t06_trade_segments", f"""{CROSS}, sr AS (SELECT symbol, row_pos, pos, coalesce(pos * ("close" / lag("close") OVER q - 1), 0) - 0.001 * abs(pos - coalesce(lag(pos) OVER q, 0)) AS ret FROM ps WINDOW q AS (PARTITION BY symbol ORDER BY row_pos)), g AS (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY row_pos) AS run FROM (SELECT *, (pos <> coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY row_pos), 0))::INT AS turn FROM sr))
SELECT symbol, min(row_pos) AS entry_pos, any_value(pos)::INT AS side, count(*) AS bars, round(product(1 + ret) - 1, 6) AS pnl FROM g WHERE pos <> 0 GROUP BY symbol, run""")
def t06(spark, sf):
    return T.segments(T.bar_returns(cross(spark, sf), ["symbol"], cost=0.001), ["symbol"]).select("symbol", "entry_pos", "side", "bars", F.round("pnl", 6).alias("pnl"))


@query("t08_best_series", f"""WITH {D}, {grid_sql('days')}, sc AS (SELECT symbol, s, l, round(avg(ret) / nullif(stddev_samp(ret), 0), 9) AS score FROM r GROUP BY ALL), b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC NULLS LAST, s, l) = 1)
SELECT symbol, s AS short_ma, l AS long_ma, row_pos, round(ret, 8) AS ret, round(sum(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS UNBOUNDED PRECEDING), 6) AS equity FROM r JOIN b USING (symbol, s, l)""")
def t08(spark, sf):
    """Bar returns and running (additive) equity of each symbol's best strategy."""
    from barspan.operators.scan import running

    r = grid_returns(daily(spark, sf))
    m = r.groupBy("symbol", "short_ma", "long_ma").agg(F.round(F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0)), 9).alias("score"))
    best = m.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("score"), "short_ma", "long_ma"))).filter("n = 1").select("symbol", "short_ma", "long_ma")
    e = running(r.join(best, ["symbol", "short_ma", "long_ma"], "semi"), {"equity": ("sum", F.col("ret"))}, keys=["symbol"])
    return e.select("symbol", "short_ma", "long_ma", "row_pos", F.round("ret", 8).alias("ret"), F.round("equity", 6).alias("equity"))


CASES = [("q20", 0.2, 0.8), ("q30", 0.3, 0.7), ("q10", 0.1, 0.9)]


@query("p10_case_pairs", f"""WITH {H}, {RET}, {FORWARD}, {SIDE}, j AS (SELECT b.symbol, f4, rate FROM fwd b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.ts >= f.side_ts), c AS (SELECT symbol, unnest(['q20', 'q30', 'q10']) AS name, unnest([quantile_cont(rate, 0.2), quantile_cont(rate, 0.3), quantile_cont(rate, 0.1)]) AS lo, unnest([quantile_cont(rate, 0.8), quantile_cont(rate, 0.7), quantile_cont(rate, 0.9)]) AS hi FROM j GROUP BY symbol)
SELECT symbol, name, CASE WHEN rate <= lo THEN 'low' ELSE 'high' END AS grp, count(f4) AS n, round(avg(f4), 6) AS mean FROM j JOIN c USING (symbol) WHERE rate <= lo OR rate >= hi GROUP BY ALL""")
def p10(spark, sf):
    """Low and high groups of the side series under three definitions."""
    j = J.asof_backward(forward(returns(hourly(spark, sf))), fund(spark, sf), keys=["symbol"], values=["rate"]).select("symbol", "f4", "rate")
    c = j.groupBy("symbol").agg(F.array(*[F.struct(F.lit(n).alias("name"), F.percentile("rate", a).alias("lo"), F.percentile("rate", b).alias("hi")) for n, a, b in CASES]).alias("cs")).select("symbol", F.explode("cs").alias("c")).select("symbol", "c.*")
    return j.join(c, "symbol").filter("rate <= lo or rate >= hi").groupBy("symbol", "name", F.when(F.col("rate") <= F.col("lo"), "low").otherwise("high").alias("grp")).agg(F.count("f4").alias("n"), F.round(F.avg("f4"), 6).alias("mean"))


@query("p11_quality_pairs", """WITH q AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'stale' ELSE 'missing' END AS a, CASE WHEN o_orderpriority < '3' THEN 'ok' WHEN o_orderpriority < '4' THEN 'filled' WHEN o_orderpriority < '5' THEN 'stale' ELSE 'missing' END AS b FROM orders)
SELECT CASE WHEN 'missing' IN (a, b) THEN 'missing' WHEN 'stale' IN (a, b) THEN 'stale' WHEN 'filled' IN (a, b) THEN 'filled' ELSE least(a, b) END AS quality, count(*) AS n FROM q GROUP BY ALL""")
def p11(spark, sf):
    """The worse of two sources' states, by severity."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    a = F.when(s == "F", "ok").when(s == "O", "stale").otherwise("missing")
    b = F.when(p < "3", "ok").when(p < "4", "filled").when(p < "5", "stale").otherwise("missing")
    both = F.array(a, b)
    worst = F.coalesce(*[F.when(F.array_contains(both, x), x) for x in ("missing", "stale", "filled")], F.array_min(both))
    return table(spark, sf, "orders").groupBy(worst.alias("quality")).agg(F.count("*").alias("n"))


@query("p12_trend_bias", f"""WITH {D}, f AS (SELECT symbol, volume - lag(volume, 5) OVER w AS dv, ln("close" / lag("close", 20) OVER w) AS dp, CASE WHEN row_pos >= 19 THEN regr_slope(volume, row_pos) OVER (w ROWS 19 PRECEDING) END AS slope FROM days WINDOW w AS (PARTITION BY symbol ORDER BY row_pos)),
c AS (SELECT *, CASE WHEN dv IS NULL OR dp IS NULL THEN 'unknown' WHEN dv = 0 OR dp = 0 THEN 'neutral' WHEN dv * dp > 0 THEN 'confirmed' ELSE 'divergent' END AS trend FROM f)
SELECT symbol, trend, CASE WHEN dv >= 10 AND round(slope, 9) >= 0 AND trend = 'confirmed' THEN 'long_base' WHEN dv <= -10 AND round(slope, 9) <= 0 AND trend = 'confirmed' THEN 'short_base' ELSE 'neutral' END AS bias, count(*) AS n FROM c GROUP BY ALL""")
def p12_bias(spark, sf):
    """Row classifiers: does the price confirm the change of the other series, and the side that follows."""
    frame = lambda w: w.rowsBetween(-19, 0)
    b = rolling(daily(spark, sf), {"dv": lambda w: F.col("volume") - F.lag("volume", 5).over(w), "dp": lambda w: F.log(F.col("close") / F.lag("close", 20).over(w)), "slope": lambda w: F.when(F.col("row_pos") >= 19, F.round(F.regr_slope("volume", F.col("row_pos").cast("double")).over(frame(w)), 9))}, back=20)
    dv, dp, k = F.col("dv"), F.col("dp"), F.col("slope")
    trend = F.when(dv.isNull() | dp.isNull(), "unknown").when((dv == 0) | (dp == 0), "neutral").when(dv * dp > 0, "confirmed").otherwise("divergent")
    b = b.withColumn("trend", trend)
    sure = F.col("trend") == "confirmed"
    return b.groupBy("symbol", "trend", F.when((dv >= 10) & (k >= 0) & sure, "long_base").when((dv <= -10) & (k <= 0) & sure, "short_base").otherwise("neutral").alias("bias")).agg(F.count("*").alias("n"))


@query("p22_typed_text", """SELECT o_orderstatus AS status, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS number, try_cast(o_orderpriority AS DOUBLE) IS NULL AS stays_text, count(*) AS n, round(avg(try_cast(o_totalprice::VARCHAR AS DOUBLE)), 2) AS price FROM orders GROUP BY ALL""")
def p22(spark, sf):
    """Text that is a number becomes one, other text stays; values are rounded for a report."""
    p = F.col("o_orderpriority")
    number = F.substring(p, 1, 1).try_cast("double")
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), number.alias("number"), p.try_cast("double").isNull().alias("stays_text")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("o_totalprice").cast("string").try_cast("double")), 2).alias("price"))


@query("o01_display_order", f"""WITH {BASE} SELECT symbol, side, horizon::INT AS horizon, round(avg(mr), 6) AS mean, row_number() OVER (ORDER BY CASE symbol WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 9 END, symbol, CASE side WHEN 'low' THEN 1 ELSE 2 END, horizon)::INT AS place FROM ce GROUP BY symbol, side, horizon""")
def o01(spark, sf):
    """A short report in its display order: named symbols first, then the others; the low side before the high one."""
    g = close_events(spark, sf).groupBy("symbol", "side", "horizon").agg(F.round(F.avg("mr"), 6).alias("mean"))
    first = F.when(F.col("symbol") == "purchase", 1).when(F.col("symbol") == "click", 2).otherwise(9)
    return g.withColumn("place", F.row_number().over(Window.orderBy(first, "symbol", F.when(F.col("side") == "low", 1).otherwise(2), "horizon"))).orderBy("place")


#: One factor varied at a time: (scenario, level of the shock, entry, cost in %, period).
SCENARIOS = [("baseline", 0.05, "close", 0.0, "all"), ("cost_5bp", 0.05, "close", 0.05, "all"), ("cost_20bp", 0.05, "close", 0.2, "all"), ("next_bar", 0.05, "next", 0.0, "all"), ("rarer", 0.025, "close", 0.0, "all"), ("rarest", 0.01, "close", 0.0, "all"), ("first_half", 0.05, "close", 0.0, "first"), ("second_half", 0.05, "close", 0.0, "second")]
STRESS = f"""{H}, {RET}, f AS (SELECT *, ln(lead("close", 4) OVER w / "close") * 100 AS a, ln(lead("close", 5) OVER w / lead("close") OVER w) * 100 AS b, 2 * row_pos < count(*) OVER (PARTITION BY symbol) AS early FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY row_pos)),
lim AS (SELECT symbol, unnest([0.05::DOUBLE, 0.025, 0.01]) AS level, unnest([quantile_cont(ret, 0.05), quantile_cont(ret, 0.025), quantile_cont(ret, 0.01)]) AS threshold FROM rets GROUP BY symbol), sn(scenario, level, entry, cost, period) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE, '{c}', {d}::DOUBLE, '{e}')" for a, b, c, d, e in SCENARIOS)}),
x AS (SELECT symbol, scenario, CASE entry WHEN 'close' THEN a ELSE b END - cost AS r FROM f JOIN lim USING (symbol) JOIN sn USING (level) WHERE ret <= threshold AND (period = 'all' OR early = (period = 'first'))),
st AS (SELECT symbol, scenario, count(r) AS n, avg(r) AS mean, avg((r > 0)::INT) FILTER (r IS NOT NULL) AS win, quantile_cont(r, 0.05) AS p05 FROM x GROUP BY ALL)"""


def stress(spark, sf):
    """Group results under every scenario; the fixed table of scenarios is joined once."""
    c = lambda w, k: F.lead("close", k).over(w)
    r = rolling(returns(hourly(spark, sf)), {"a": lambda w: F.log(c(w, 4) / F.col("close")) * 100, "b": lambda w: F.log(c(w, 5) / c(w, 1)) * 100}, ahead=5)
    n = r.groupBy("symbol").agg(F.count("*").alias("n"), *[F.percentile("ret", p).alias(f"q{k}") for k, p in enumerate((0.05, 0.025, 0.01))])
    levels = F.explode(F.array(*[F.struct(F.lit(p).alias("level"), F.col(f"q{k}").alias("threshold")) for k, p in enumerate((0.05, 0.025, 0.01))])).alias("l")
    hit = r.join(n.select("symbol", "n", levels).select("symbol", "n", "l.*"), "symbol").filter("ret <= threshold")
    scenarios = spark.createDataFrame(SCENARIOS, "scenario string, level double, entry string, cost double, period string")
    x = hit.join(F.broadcast(scenarios), "level").filter("period = 'all' or (2 * row_pos < n) = (period = 'first')")
    x = x.withColumn("r", F.when(F.col("entry") == "close", F.col("a")).otherwise(F.col("b")) - F.col("cost"))
    return x.groupBy("symbol", "scenario").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.avg((F.col("r") > 0).cast("int")).alias("win"), F.percentile("r", 0.05).alias("p05"))


@query("r14_stress_suite", f"WITH {STRESS} SELECT symbol, scenario, n, round(mean, 6) AS mean, round(win, 6) AS win, round(p05, 6) AS p05, CASE WHEN n < 30 THEN 'LOW_COUNT' WHEN mean <= 0 THEN 'NEGATIVE' WHEN win < 0.5 THEN 'LOW_WIN' ELSE 'OK' END AS flag FROM st")
def r14(spark, sf):
    flag = F.when(F.col("n") < 30, "LOW_COUNT").when(F.col("mean") <= 0, "NEGATIVE").when(F.col("win") < 0.5, "LOW_WIN").otherwise("OK")
    return stress(spark, sf).select("symbol", "scenario", "n", *[F.round(c, 6).alias(c) for c in ("mean", "win", "p05")], flag.alias("flag"))


@query("j13_stress_beside_baseline", f"""WITH {STRESS}, m AS (SELECT symbol, scenario, unnest(['mean', 'win', 'p05']) AS metric, unnest([mean, win, p05]) AS value FROM st)
SELECT s.symbol, s.scenario, metric, round(b.value, 6) AS baseline, round(s.value, 6) AS stressed, round(s.value - b.value, 6) AS change FROM m s JOIN m b USING (symbol, metric) WHERE b.scenario = 'baseline' AND s.scenario <> 'baseline'""")
def j13(spark, sf):
    """Every stressed cell beside its baseline."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mean", "win", "p05")])).alias("m")
    m = stress(spark, sf).select("symbol", "scenario", rows).select("symbol", "scenario", "m.*")
    base = m.filter("scenario = 'baseline'").select("symbol", "metric", F.col("value").alias("baseline"))
    j = m.filter("scenario <> 'baseline'").join(base, ["symbol", "metric"])
    return j.select("symbol", "scenario", "metric", F.round("baseline", 6).alias("baseline"), F.round("value", 6).alias("stressed"), F.round(F.col("value") - F.col("baseline"), 6).alias("change"))


@query("r13_train_test_events", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, f AS (SELECT *, lead("close", 5) OVER (PARTITION BY symbol ORDER BY row_pos) / "close" - 1 AS f5 FROM rets), lim AS (SELECT symbol, quantile_cont(ret, 0.05) AS lo FROM rets GROUP BY symbol), ev AS (SELECT symbol, year(ts) AS y, f5 FROM f JOIN lim USING (symbol) WHERE ret <= lo AND f5 IS NOT NULL), ys AS (SELECT symbol, y AS test_year FROM ev GROUP BY ALL)
SELECT ys.symbol, test_year::INT AS test_year, count(*) FILTER (y < test_year) AS train_n, round(avg(f5) FILTER (y < test_year), 6) AS train_mean, count(*) FILTER (y = test_year) AS test_n, round(avg(f5) FILTER (y = test_year), 6) AS test_mean, round(avg((f5 > 0)::INT) FILTER (y = test_year), 6) AS test_win FROM ys JOIN ev ON ev.symbol = ys.symbol AND y <= test_year GROUP BY ALL""")
def r13(spark, sf):
    """Events of every year against those of all years before; yearly sums are added up, events are read once."""
    r = rolling(returns(daily(spark, sf)), {"f5": lambda w: F.lead("close", 5).over(w) / F.col("close") - 1}, ahead=5)
    lim = r.groupBy("symbol").agg(F.percentile("ret", 0.05).alias("lo"))
    ev = r.join(lim, "symbol").filter("ret <= lo and f5 is not null")
    per = ev.groupBy("symbol", F.year("ts").alias("test_year")).agg(F.count("*").alias("n"), F.sum("f5").alias("s"), F.sum((F.col("f5") > 0).cast("int")).alias("k"))
    w = Window.partitionBy("symbol").orderBy("test_year").rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    return per.select("symbol", "test_year", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("train_n"), F.round(F.sum("s").over(w) / F.sum("n").over(w), 6).alias("train_mean"), F.col("n").alias("test_n"), F.round(F.col("s") / F.col("n"), 6).alias("test_mean"), F.round(F.col("k") / F.col("n"), 6).alias("test_win"))


GRID_RUNS = 5000
#: (method, leverage, round-trip cost): every method plain, and one under each leverage and each cost.
CELLS = [*[(m, 1.0, 0.0) for m in MC.METHODS], *[("iid", x, 0.0) for x in (1.5, 2.0, 3.0, 4.0)], *[("iid", 1.0, c) for c in (0.001, 0.002, 0.004)]]
DRAWN = ("shuffle", "iid", "block", "stationary", "restart", "regime")


def mix_sql(rows: str, x: str, out: str) -> str:
    step = lambda a, b, shift, times, rows: f"(SELECT *, (xor({a}, {a} >> {shift}) * {times}) & {MC.MASK} AS {b} FROM {rows})"
    return f"(SELECT * EXCLUDE (m0, m1, m2), xor(m2, m2 >> 15) AS {out} FROM {step('m1', 'm2', 15, MC.SECOND, step('m0', 'm1', 16, MC.FIRST, f'(SELECT *, {x} AS m0 FROM {rows})'))})"


def path_sql(keys: str, rows: str) -> str:
    """Growth, worst share of a peak, losing streak and ruin of rows(keys, pos, net)."""
    w = f"PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING"
    return f"""(SELECT {keys}, arg_max(eq, pos) AS equity, min(least(eq / pk, 1)) AS worst, max(pos - coalesce(gain, -1)) AS streak, bool_or(1 + net <= 0) AS ruined, count(*) AS n FROM (SELECT *, greatest(max(eq) OVER ({w}), 1) AS pk FROM (SELECT *, exp(sum(ln(greatest(1 + net, 1e-300))) OVER ({w})) AS eq, max(CASE WHEN net >= 0 THEN pos END) OVER ({w}) AS gain FROM {rows})) GROUP BY {keys})"""


GROUPS = """v AS (SELECT side, horizon::INT AS horizon, mr / 100 AS x, coalesce(regime, '') AS label, row_number() OVER (PARTITION BY side, horizon ORDER BY ts, symbol) - 1 AS i, count(*) OVER (PARTITION BY side, horizon) AS n FROM ce LEFT JOIN (SELECT symbol, row_pos, regime FROM reg) USING (symbol, row_pos) WHERE horizon IN (4, 12))"""
SIMULATED = f"""{BASE}, {VOL}, {GROUPS}, r0 AS (SELECT DISTINCT side, horizon, n, method, run, ('0x' || substr(md5(concat_ws('|', '{SEED}|' || method, side, horizon)), 1, 8))::BIGINT AS base FROM v, (SELECT unnest({list(DRAWN)}) AS method), (SELECT range AS run FROM range({GRID_RUNS}))),
r2 AS MATERIALIZED (SELECT * FROM {mix_sql(mix_sql('r0', 'run', 'h0'), 'xor(base, h0)', 'h')}),
d AS MATERIALIZED (SELECT * FROM {mix_sql("(SELECT r2.side, r2.horizon, r2.n, method, run, h, i AS pos, label FROM r2 JOIN v USING (side, horizon))", f"(h + (CASE method WHEN 'block' THEN pos // 5 ELSE pos END) * {MC.GOLDEN}) & {MC.MASK}", 'd')}),
members AS (SELECT *, row_number() OVER (PARTITION BY side, horizon, label ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY side, horizon, label) AS k FROM v), kinds AS (SELECT DISTINCT side, horizon, label, k FROM members),
fresh AS (SELECT s.*, s.pos = 0 OR f.d % 1000000 < 200000 AS f FROM d s JOIN d f ON f.method = 'restart' AND f.side = s.side AND f.horizon = s.horizon AND f.run = s.run AND f.pos = s.pos WHERE s.method = 'stationary'),
pk AS (SELECT 'original' AS method, side, horizon, 0 AS run, i AS pos, i FROM v
  UNION ALL SELECT method, side, horizon, run, pos, d % n FROM d WHERE method = 'iid'
  UNION ALL SELECT method, side, horizon, run, pos, (d % n + pos % 5) % n FROM d WHERE method = 'block'
  UNION ALL SELECT method, side, horizon, run, row_number() OVER (PARTITION BY side, horizon, run ORDER BY d, pos) - 1, pos FROM d WHERE method = 'shuffle'
  UNION ALL SELECT method, side, horizon, run, pos, (last_value(CASE WHEN f THEN d % n END IGNORE NULLS) OVER q + pos - last_value(CASE WHEN f THEN pos END IGNORE NULLS) OVER q) % n FROM fresh WINDOW q AS (PARTITION BY side, horizon, run ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT d.method, d.side, d.horizon, run, pos, m.i FROM d JOIN kinds USING (side, horizon, label) JOIN members m ON m.side = d.side AND m.horizon = d.horizon AND m.label = d.label AND m.r = d.d % kinds.k WHERE d.method = 'regime'),
cells(method, leverage, cost) AS (VALUES {', '.join(f"('{m}', {x}::DOUBLE, {c}::DOUBLE)" for m, x, c in CELLS)}),
nets AS (SELECT method, side, horizon, leverage, cost, run, pos, leverage * (x - cost) AS net FROM pk JOIN v USING (side, horizon, i) JOIN cells USING (method)),
paths AS MATERIALIZED (SELECT *, (equity - 1) * 100 AS final, (worst - 1) * 100 AS dd FROM {path_sql('method, side, horizon, leverage, cost, run', 'nets')})"""
QUANTILES = ", ".join(f"round(quantile_cont({c}, {q}), 4) AS {n}" for n, c, q in (("final_median", "final", 0.5), ("final_q05", "final", 0.05), ("final_q01", "final", 0.01), ("dd_median", "dd", 0.5), ("dd_q05", "dd", 0.05), ("dd_q01", "dd", 0.01), ("streak_median", "streak", 0.5), ("streak_q95", "streak", 0.95)))


def grouped_events(spark, sf):
    """Close events of two horizons in order of time, as fractions, with the volatility regime at the signal."""
    ev = close_events(spark, sf).filter("horizon in (4, 12)")
    state = regimes(forward(returns(hourly(spark, sf)))).select("symbol", "row_pos", "regime")
    return ev.join(state, ["symbol", "row_pos"], "left").select("side", "horizon", (F.col("mr") / 100).alias("x"), "regime", F.unix_timestamp("ts").alias("t"), "symbol")


@query("r07_resample_grid", f"""WITH {SIMULATED} SELECT side, horizon, method, leverage, cost, count(*) AS runs, any_value(n) AS n, {QUANTILES}, round(avg((dd <= -30)::INT) * 100, 4) AS prob_dd30, round(avg((dd <= -50)::INT) * 100, 4) AS prob_dd50, round(avg((equity <= 0.5)::INT) * 100, 4) AS prob_halving, round(avg(ruined::INT) * 100, 4) AS prob_ruin,
round(avg(final) FILTER (final <= f5), 4) AS final_cvar05, round(avg(dd) FILTER (dd <= d5), 4) AS dd_cvar05 FROM (SELECT *, quantile_cont(final, 0.05) OVER g AS f5, quantile_cont(dd, 0.05) OVER g AS d5 FROM paths WINDOW g AS (PARTITION BY method, side, horizon, leverage, cost)) GROUP BY side, horizon, method, leverage, cost""")
def r07(spark, sf):
    """Groups by horizons by six methods, and by leverage and cost: growth, drawdown and streaks over 5,000 runs each."""
    keys = ["side", "horizon"]
    paths = MC.simulate(grouped_events(spark, sf), keys=keys, x="x", order=["t", "symbol"], cells=CELLS, runs=GRID_RUNS, seed=SEED, label="regime")
    return MC.simulation_pack(paths, keys=[*keys, "method", "leverage", "cost"])


COSTS = (0.0, 0.001, 0.002, 0.004)


@query("r06_path_summary", f"""WITH {BASE}, {VOL}, {GROUPS}, nets AS (SELECT side, horizon, cost, i AS pos, x - cost AS net FROM v, (VALUES {', '.join(f'({c}::DOUBLE)' for c in COSTS)}) c(cost)), p AS {path_sql('side, horizon, cost', 'nets')},
m AS (SELECT side, horizon, cost, round(avg(net) * 100, 6) AS mean, round(quantile_cont(net, 0.5) * 100, 6) AS median, round(avg((net > 0)::INT) * 100, 6) AS win_rate, round(CASE WHEN sum(net) FILTER (net < 0) < 0 THEN coalesce(sum(net) FILTER (net > 0), 0) / -sum(net) FILTER (net < 0) WHEN sum(net) FILTER (net > 0) > 0 THEN 'inf'::DOUBLE END, 6) AS profit_factor, round(max(net) * 100, 6) AS best, round(min(net) * 100, 6) AS worst_trade FROM nets GROUP BY ALL)
SELECT m.*, n, round((equity - 1) * 100, 6) AS final, round((worst - 1) * 100, 6) AS max_drawdown, streak, ruined FROM m JOIN p USING (side, horizon, cost)""")
def r06_paths(spark, sf):
    """The trades of each group in their own order, under every cost: the baseline of all resampling."""
    keys = ["side", "horizon"]
    placed = ranked(grouped_events(spark, sf), keys=keys, order=["t", "symbol"])
    net = placed.withColumn("cost", F.explode(F.array(*[F.lit(c) for c in COSTS]))).withColumn("net", F.col("x") - F.col("cost"))
    by = [*keys, "cost"]
    at = lambda c: F.round(c * 100, 6)
    pack = net.groupBy(*by).agg(at(F.avg("net")).alias("mean"), at(F.percentile("net", 0.5)).alias("median"), at(share(F.col("net") > 0)).alias("win_rate"), F.round(profit_factor(F.col("net")), 6).alias("profit_factor"), at(F.max("net")).alias("best"), at(F.min("net")).alias("worst_trade"))
    paths = MC.summarise_paths(net, keys=by, order="i", x="net").select(*by, "n", at(F.col("equity") - 1).alias("final"), at(F.col("worst") - 1).alias("max_drawdown"), "streak", "ruined")
    return pack.join(paths, by)


@query("a28_event_pack", f"""WITH {EVENTS}, v AS (SELECT candidate_id, row_pos, path_ret AS x, mae, mfe, row_number() OVER (PARTITION BY candidate_id ORDER BY row_pos) - 1 AS i, quantile_cont(path_ret, 0.05) OVER (PARTITION BY candidate_id) AS q FROM evt), p AS {path_sql('candidate_id', '(SELECT candidate_id, i AS pos, x AS net FROM v)')}
SELECT v.candidate_id, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(avg((x > 0)::INT), 6) AS win_rate, round(CASE WHEN sum(x) FILTER (x < 0) < 0 THEN coalesce(sum(x) FILTER (x > 0), 0) / -sum(x) FILTER (x < 0) WHEN sum(x) FILTER (x > 0) > 0 THEN 'inf'::DOUBLE END, 6) AS profit_factor, {t_sql('x')} AS t,
round(avg(mae), 6) AS mae, round(avg(mfe), 6) AS mfe, round(any_value(q), 6) AS var5, round(avg(x) FILTER (x <= q), 6) AS es5, round(any_value(equity) - 1, 6) AS growth, round(any_value(worst) - 1, 6) AS max_drawdown, any_value(streak) AS losing_streak FROM v JOIN p USING (candidate_id) GROUP BY v.candidate_id""")
def a28_pack(spark, sf):
    return S.event_pack(path_events(spark, sf), "path_ret", keys=["candidate_id"], order="row_pos", mae="mae", mfe="mfe")


@query("a10_calmar", f"""WITH {D}, r AS (SELECT symbol, row_pos AS pos, "close" / lag("close") OVER (PARTITION BY symbol ORDER BY row_pos) - 1 AS net FROM days), m AS (SELECT symbol, count(net) AS bars, stddev_samp(net) FILTER (net < 0) AS down, avg(net) AS mean FROM r GROUP BY symbol), p AS {path_sql('symbol', '(SELECT * FROM r WHERE net IS NOT NULL)')}
SELECT symbol, bars, round(equity - 1, 6) AS total, round(equity ** (252.0::DOUBLE / bars) - 1, 6) AS annual, round(worst - 1, 6) AS max_drawdown, round((equity ** (252.0::DOUBLE / bars) - 1) / nullif(1 - worst, 0), 6) AS calmar, round(mean / nullif(down, 0) * sqrt(252), 6) AS sortino FROM m JOIN p USING (symbol)""")
def a10_calmar(spark, sf):
    """Growth a year over the deepest fall, and the mean over the deviation of losses."""
    r = returns(daily(spark, sf), "simple").filter("ret is not null")
    m = r.groupBy("symbol").agg(F.count("*").alias("bars"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), F.avg("ret").alias("mean"))
    p = MC.summarise_paths(r, keys=["symbol"], order="row_pos", x="ret")
    annual = F.pow("equity", 252.0 / F.col("bars")) - 1
    values = {"total": F.col("equity") - 1, "annual": annual, "max_drawdown": F.col("worst") - 1, "calmar": annual / F.nullif(1 - F.col("worst"), F.lit(0.0)), "sortino": F.col("mean") / F.nullif("down", F.lit(0.0)) * F.sqrt(F.lit(252))}
    return m.join(p, "symbol").select("symbol", "bars", *[F.round(v, 6).alias(k) for k, v in values.items()])


@query("a11_monthly_tail", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, m AS (SELECT symbol, strftime(ts, '%Y-%m') AS month, exp(sum(ret)) - 1 AS r FROM rets WHERE ret IS NOT NULL GROUP BY ALL), q AS (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY symbol) AS q FROM m)
SELECT symbol, count(*) AS months, round(any_value(q), 6) AS var5, round(avg(r) FILTER (r <= q), 6) AS cvar5, round(min(r), 6) AS worst, round(avg((r > 0)::INT), 6) AS win_rate FROM q GROUP BY symbol""")
def a11_monthly(spark, sf):
    r = returns(daily(spark, sf)).filter("ret is not null")
    m = r.groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg((F.exp(F.sum("ret")) - 1).alias("r"))
    j = m.join(m.groupBy("symbol").agg(F.percentile("r", 0.05).alias("q")), "symbol")
    return j.groupBy("symbol").agg(F.count("*").alias("months"), F.round(F.first("q"), 6).alias("var5"), F.round(F.avg(F.when(F.col("r") <= F.col("q"), F.col("r"))), 6).alias("cvar5"), F.round(F.min("r"), 6).alias("worst"), F.round(share(F.col("r") > 0), 6).alias("win_rate"))


@query("a12_top_percent", f"""{CROSS}, {LOG}, w AS (SELECT symbol, net, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, entry_pos) AS k, count(*) OVER (PARTITION BY symbol) AS n, sum(net) OVER (PARTITION BY symbol) AS total FROM tr WHERE net > 0), t AS (SELECT symbol, sum(net) AS total FROM tr GROUP BY symbol)
SELECT t.symbol, {', '.join(f"coalesce(any_value(ceil(n * {p} / 100)), 0)::BIGINT AS top{p}_trades, round(100 * sum(net) FILTER (k <= ceil(n * {p} / 100)) / any_value(w.total), 6) AS top{p}_pct, round(any_value(t.total) - coalesce(sum(net) FILTER (k <= ceil(n * {p} / 100)), 0), 6) AS without_top{p}" for p in (5, 10, 20))} FROM t LEFT JOIN w USING (symbol) GROUP BY t.symbol""")
def a12_percent(spark, sf):
    return S.top_percent(log(spark, sf), "net", keys=["symbol"], tie=["entry_pos"])


TRIALS = 500


@query("a30_subsample_instability", f"""WITH {H}, {RET}, p AS (SELECT a.symbol AS x, b.symbol AS y, a.ret AS rx, b.ret AS ry, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts) - 1 AS pos, count(*) OVER (PARTITION BY a.symbol, b.symbol) AS n FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
k AS (SELECT x, y, any_value(n) AS n FROM p GROUP BY ALL), s AS (SELECT x, y, len, trial, {md5_sql('(n - len)', str(SEED), 'x', 'y', 'len', 'trial')} AS start FROM k, (VALUES (20), (40), (80)) l(len), (SELECT range AS trial FROM range({TRIALS})) WHERE n > len),
w AS (SELECT s.x, s.y, len, trial, rx, ry FROM s JOIN p ON p.x = s.x AND p.y = s.y AND pos >= start AND pos < start + len), q AS (SELECT x, y, len, trial, quantile_cont(rx, 0.1) AS qx, quantile_cont(ry, 0.1) AS qy FROM w GROUP BY ALL), d AS (SELECT x, y, len, trial, avg((ry <= qy)::INT) FILTER (rx <= qx) AS dep FROM w JOIN q USING (x, y, len, trial) GROUP BY ALL)
SELECT x, y, len::INT AS len, count(*) AS trials, round(quantile_cont(dep, 0.5), 6) AS median, round(quantile_cont(dep, 0.05), 6) AS p05, round(quantile_cont(dep, 0.95), 6) AS p95, round(avg((dep = 0)::INT), 6) AS zero_share FROM d GROUP BY ALL""")
def a30(spark, sf):
    """Tail dependence on random windows of several lengths; windows meet the rows by place."""
    r = returns(hourly(spark, sf)).filter("ret is not null").select("symbol", "ts", "ret")
    p = r.select("ts", F.col("symbol").alias("x"), F.col("ret").alias("rx")).join(r.select("ts", F.col("symbol").alias("y"), F.col("ret").alias("ry")), "ts").filter("x < y")
    p = ranked(p.select("x", "y", "rx", "ry", F.unix_timestamp("ts").alias("t")), keys=["x", "y"], order=["t"], out="pos").drop("n", "t")
    k = p.groupBy("x", "y").agg(F.count("*").alias("n"))
    s = k.select("x", "y", "n", F.explode(F.array(F.lit(20), F.lit(40), F.lit(80))).alias("len")).filter("n > len").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(TRIALS - 1))))
    s = s.withColumn("start", R.draw(F.col("n") - F.col("len"), F.lit(SEED), F.col("x"), F.col("y"), F.col("len"), F.col("trial")))
    w = s.select("x", "y", "len", "trial", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).join(p, ["x", "y", "pos"])
    by = ["x", "y", "len", "trial"]
    q = w.groupBy(*by).agg(F.percentile("rx", 0.1).alias("qx"), F.percentile("ry", 0.1).alias("qy"))
    d = w.join(q, by).groupBy(*by).agg(F.avg(F.when(F.col("rx") <= F.col("qx"), (F.col("ry") <= F.col("qy")).cast("int"))).alias("dep"))
    return d.groupBy("x", "y", "len").agg(F.count("*").alias("trials"), *[F.round(F.percentile("dep", c), 6).alias(n) for n, c in (("median", 0.5), ("p05", 0.05), ("p95", 0.95))], F.round(F.avg((F.col("dep") == 0).cast("int")), 6).alias("zero_share"))
