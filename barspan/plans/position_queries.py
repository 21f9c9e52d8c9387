"""Queries on signals, positions and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.functions import profit_factor, true_range
from barspan.operators import positions as T
from barspan.operators import stats as S
from barspan.operators.scan import framed, rolling

from .registry import query
from .tables import hourly, hourly_sql

H = hourly_sql()
P = "PARTITION BY symbol ORDER BY row_pos"
SIG = f"sg AS (SELECT *, CASE WHEN row_pos >= 19 THEN sign(avg(\"close\") OVER ({P} ROWS 4 PRECEDING) - avg(\"close\") OVER ({P} ROWS 19 PRECEDING))::INT ELSE 0 END AS sig FROM bars)"
POS = f"ps AS (SELECT *, coalesce(lag(sig) OVER ({P}), 0) AS pos FROM sg), tn AS (SELECT *, abs(pos - coalesce(lag(pos) OVER ({P}), 0)) AS turnover FROM ps)"
LOG = f"""rn AS (SELECT *, sum((turnover > 0)::INT) OVER ({P}) AS run, lead(open) OVER ({P}) AS nxt FROM tn), tr0 AS (SELECT symbol, run, any_value(pos) AS direction, min(row_pos) AS entry_pos, max(row_pos) AS exit_pos, arg_min(open, row_pos) AS entry_price,
  arg_max(open, row_pos) AS cl, max(CASE WHEN row_pos = mx THEN nxt END) AS nxt FROM (SELECT *, max(row_pos) OVER (PARTITION BY symbol, run) AS mx FROM rn) WHERE pos <> 0 GROUP BY symbol, run), tr AS (SELECT *, direction * (coalesce(nxt, cl) - entry_price) - 0.5 AS net FROM tr0)"""
CROSS = f"WITH {H}, {SIG}, {POS}"


def cross(spark, sf):
    return T.average_cross(hourly(spark, sf), [(5, 20)])


def log(spark, sf):
    return T.trade_log(cross(spark, sf), ["symbol"], cost=0.5)


@query("t01_average_cross", f"{CROSS} SELECT symbol, row_pos, sig FROM sg")
def t01(spark, sf):
    return cross(spark, sf).select("symbol", "row_pos", "sig")


@query("t02_breakout", f"""WITH {H}, c AS (SELECT *, CASE WHEN row_pos >= 20 THEN max(high) OVER ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS u, CASE WHEN row_pos >= 20 THEN min(low) OVER ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS d FROM bars)
SELECT symbol, row_pos, coalesce(last_value(CASE WHEN "close" > u THEN 1 WHEN "close" < d THEN -1 END IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING), 0) AS sig FROM c""")
def t02(spark, sf):
    return T.breakout(hourly(spark, sf), 20).select("symbol", "row_pos", "sig")


@query("t03_hysteresis", f"""WITH RECURSIVE {H}, z AS (SELECT symbol, row_pos, CASE WHEN row_pos >= 23 THEN ("close" - avg("close") OVER ({P} ROWS 23 PRECEDING)) / stddev_samp("close") OVER ({P} ROWS 23 PRECEDING) END AS z FROM bars),
s AS (SELECT symbol, row_pos, CASE WHEN z < -1 THEN 1 WHEN z > 1 THEN -1 ELSE 0 END AS sig FROM z WHERE row_pos = 0 UNION ALL SELECT z.symbol, z.row_pos, CASE s.sig WHEN -1 THEN CASE WHEN z < -1 THEN 1 WHEN z > 0.2 THEN -1 ELSE 0 END WHEN 0 THEN CASE WHEN z < -1 THEN 1 WHEN z > 1 THEN -1 ELSE 0 END ELSE CASE WHEN z > 1 THEN -1 WHEN z < -0.2 THEN 1 ELSE 0 END END FROM s JOIN z ON z.symbol = s.symbol AND z.row_pos = s.row_pos + 1)
SELECT symbol, row_pos, sig FROM s""")
def t03(spark, sf):
    mean, sd = framed(F.avg, F.col("close"), -23, 0), framed(F.stddev_samp, F.col("close"), -23, 0)
    b = rolling(hourly(spark, sf), {"z": lambda w: (F.col("close") - mean(w)) / F.nullif(sd(w), F.lit(0))}, back=24)
    z = F.col("z")
    return T.hysteresis(b, z < -1, z > 1, z < -0.2, z > 0.2, keys=["symbol"]).select("symbol", "row_pos", "sig")


@query("t04_bar_returns", f"""{CROSS} SELECT symbol, row_pos, pos, turnover, round(coalesce(pos * ("close" / lag("close") OVER ({P}) - 1), 0) - 0.001 * turnover, 8) AS ret FROM tn""")
def t04(spark, sf):
    return T.bar_returns(cross(spark, sf), ["symbol"], cost=0.001).select("symbol", "row_pos", "pos", "turnover", F.round("ret", 8).alias("ret"))


@query("t05_trade_log", f"""{CROSS}, {LOG} SELECT symbol, direction, entry_pos, exit_pos, round(net, 6) AS net, exit_pos - entry_pos + (nxt IS NOT NULL)::INT AS bars, CASE WHEN nxt IS NULL THEN 'period_end' ELSE 'flip' END AS exit_reason FROM tr""")
def t05(spark, sf):
    return log(spark, sf).select("symbol", "direction", "entry_pos", "exit_pos", F.round("net", 6).alias("net"), "bars", "exit_reason")


@query("t07_stopped_trades", f"""WITH RECURSIVE {H}, {SIG}, {POS}, tr0 AS (SELECT *, greatest(high - low, abs(high - lag("close") OVER ({P})), abs(low - lag("close") OVER ({P}))) AS r FROM tn), av AS (SELECT *, CASE WHEN row_pos >= 13 THEN avg(r) OVER ({P} ROWS 13 PRECEDING) END AS atr FROM tr0),
x AS (SELECT symbol, row_pos, open, high, low, "close", pos, lag(atr) OVER ({P}) AS a, coalesce(lead(pos) OVER ({P}) <> pos, true) AS ends, coalesce(lead(open) OVER ({P}), "close") AS fin FROM av),
s AS (SELECT symbol, row_pos, NULL::DOUBLE AS e, NULL::DOUBLE AS ea, NULL::BIGINT AS ep, false AS done, NULL::DOUBLE AS px, NULL::VARCHAR AS why, NULL::DOUBLE AS e0, 0 AS pos0 FROM x WHERE row_pos = 0 AND pos = 0
UNION ALL SELECT symbol, row_pos, CASE WHEN NOT (hs OR ht OR ends) THEN ne END, CASE WHEN NOT (hs OR ht OR ends) THEN na END, CASE WHEN hs OR ht OR ends THEN NULL ELSE np END, ne IS NOT NULL AND (hs OR ht OR ends), CASE WHEN hs THEN ne - pos * 1.5 * na WHEN ht THEN ne + pos * 2 * na ELSE fin END, CASE WHEN hs THEN 'stop' WHEN ht THEN 'target' ELSE 'run_end' END, ne, pos FROM (
  SELECT *, coalesce(CASE WHEN pos > 0 THEN low <= ne - 1.5 * na ELSE high >= ne + 1.5 * na END, false) AS hs, coalesce(CASE WHEN pos > 0 THEN high >= ne + 2 * na ELSE low <= ne - 2 * na END, false) AS ht FROM (
    SELECT x.*, CASE WHEN x.pos = 0 THEN NULL WHEN s.e IS NULL AND x.a IS NOT NULL THEN x.open ELSE s.e END AS ne, CASE WHEN s.e IS NULL THEN x.a ELSE s.ea END AS na, CASE WHEN s.e IS NULL THEN x.row_pos ELSE s.ep END AS np FROM s JOIN x ON x.symbol = s.symbol AND x.row_pos = s.row_pos + 1)))
SELECT symbol, pos0 AS direction, row_pos AS exit_pos, why, round(pos0 * (px - e0), 6) AS pnl FROM s WHERE done""")
def t07(spark, sf):
    b = rolling(hourly(spark, sf), {"tr": lambda w: true_range(F.lag("close").over(w))}, back=1)
    b = rolling(b, {"atr": framed(F.avg, F.col("tr"), -13, 0)}, back=14)
    t = T.stopped_trades(T.average_cross(b, [(5, 20)]), ["symbol"], stop=F.lit(1.5), target=F.lit(2.0))
    return t.select("symbol", "direction", "exit_pos", "why", F.round("pnl", 6).alias("pnl"))


@query("t09_grid_metrics", f"""WITH {H}, pairs AS (SELECT * FROM (VALUES (5), (10), (20)) a(s), (VALUES (40), (80), (120)) b(l)),
m AS (SELECT *, {', '.join(f'CASE WHEN row_pos >= {n - 1} THEN avg("close") OVER ({P} ROWS {n - 1} PRECEDING) END AS m{n}' for n in (5, 10, 20, 40, 80, 120))} FROM bars),
sg AS (SELECT m.*, s, l, coalesce(sign((CASE s WHEN 5 THEN m5 WHEN 10 THEN m10 ELSE m20 END) - (CASE l WHEN 40 THEN m40 WHEN 80 THEN m80 ELSE m120 END))::INT, 0) AS sig FROM m, pairs),
ps AS (SELECT *, coalesce(lag(sig) OVER q, 0) AS pos, "close" / lag("close") OVER q - 1 AS mv FROM sg WINDOW q AS (PARTITION BY symbol, s, l ORDER BY row_pos)), r AS (SELECT *, coalesce(pos * mv, 0) - 0.001 * abs(pos - coalesce(lag(pos) OVER q, 0)) AS ret, abs(pos - coalesce(lag(pos) OVER q, 0)) AS tno FROM ps WINDOW q AS (PARTITION BY symbol, s, l ORDER BY row_pos))
SELECT symbol, s AS short_ma, l AS long_ma, count(*) AS bars, round(avg(ret) / stddev_samp(ret) * sqrt(6000), 6) AS sharpe, sum(tno)::BIGINT AS turnover, row_number() OVER (PARTITION BY symbol ORDER BY round(avg(ret) / stddev_samp(ret) * sqrt(6000), 6) DESC, s, l) AS place FROM r GROUP BY symbol, s, l""")
def t09(spark, sf):
    from pyspark.sql import Window

    sig = T.average_cross(hourly(spark, sf), [(s, x) for s in (5, 10, 20) for x in (40, 80, 120)])
    r = T.bar_returns(sig, ["symbol", "short_ma", "long_ma"], cost=0.001)
    g = r.groupBy("symbol", "short_ma", "long_ma").agg(F.count("*").alias("bars"), F.round(S.sharpe("ret", 6000, "null"), 6).alias("sharpe"), F.sum("turnover").cast("bigint").alias("turnover"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("sharpe"), "short_ma", "long_ma")))


@query("a08_trade_metrics", f"""{CROSS}, {LOG} SELECT symbol, count(*) AS trades, round(sum(net), 9) AS total, round(avg((net > 0)::INT), 9) AS win_rate, round(sum(net) FILTER (net > 0) / -sum(net) FILTER (net < 0), 9) AS profit_factor, round(avg(net) FILTER (net > 0), 9) AS avg_win, round(avg(net) FILTER (net < 0), 9) AS avg_loss,
round(avg(net) FILTER (net > 0) / -avg(net) FILTER (net < 0), 9) AS payoff, round(quantile_cont(net, 0.5), 9) AS median, round(max(net), 9) AS best, round(min(net), 9) AS worst, round(skewness(net), 9) AS skew FROM tr GROUP BY symbol""")
def a08(spark, sf):
    return log(spark, sf).groupBy("symbol").agg(*S.trade_pack("net", 9))


@query("a09_profit_factors", f"""{CROSS}, {LOG}, g AS (SELECT symbol, direction, year_part, sum(net) FILTER (net > 0) AS w, -sum(net) FILTER (net < 0) AS l FROM (SELECT *, entry_pos // 12 AS year_part FROM tr) GROUP BY ALL)
SELECT symbol, direction, year_part, CASE WHEN coalesce(l, 0) = 0 THEN CASE WHEN w > 0 THEN 'inf' END ELSE round(coalesce(w, 0) / l, 6)::VARCHAR END IS NULL AS a_null, CASE WHEN l > 0 THEN round(coalesce(w, 0) / l, 6) END AS b, coalesce(l, 0) = 0 AS c_inf FROM g""")
def a09(spark, sf):
    x = F.col("net")
    g = log(spark, sf).withColumn("year_part", F.floor(F.col("entry_pos") / 12)).groupBy("symbol", "direction", "year_part").agg(profit_factor(x, "a").alias("a"), profit_factor(x, "b").alias("b"), profit_factor(x, "c").alias("c"))
    return g.select("symbol", "direction", "year_part", F.col("a").isNull().alias("a_null"), F.round("b", 6).alias("b"), (F.col("c") == float("inf")).alias("c_inf"))


@query("a09_factor_values", f"""{CROSS}, {LOG}, g AS (SELECT symbol, direction, entry_pos // 12 AS year_part, coalesce(sum(net) FILTER (net > 0), 0) AS w, -coalesce(sum(net) FILTER (net < 0), 0) AS l, count(*) FILTER (net <= 0) AS z FROM tr GROUP BY ALL)
SELECT symbol, direction, year_part, round(CASE WHEN l > 0 THEN w / l WHEN w > 0 THEN 'inf'::DOUBLE END, 6) AS a, round(CASE WHEN l > 0 THEN w / l END, 6) AS b, round(CASE WHEN l > 0 THEN w / l ELSE 'inf'::DOUBLE END, 6) AS c, round(CASE WHEN z = 0 OR l = 0 THEN 'inf'::DOUBLE ELSE w / l END, 6) AS d FROM g""")
def a09_values(spark, sf):
    """The values of all four variants."""
    x = F.col("net")
    g = log(spark, sf).groupBy("symbol", "direction", F.floor(F.col("entry_pos") / 12).alias("year_part"))
    return g.agg(*[F.round(profit_factor(x, v), 6).alias(v) for v in "abcd"])


@query("a12_top_contribution", f"""{CROSS}, {LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, entry_pos) AS n FROM tr)
SELECT symbol, {', '.join(f"round(100 * sum(net) FILTER (n <= {k} AND net > 0) / nullif(sum(net) FILTER (net > 0), 0), 6) AS top{k}_pct, round(sum(net) FILTER (NOT (n <= {k} AND net > 0)), 6) AS without_top{k}" for k in (1, 3, 5))} FROM k GROUP BY symbol""")
def a12(spark, sf):
    return S.top_contribution(log(spark, sf), "net", keys=["symbol"], tie=["entry_pos"])


@query("a13_long_short", f"{CROSS}, {LOG} SELECT symbol, direction, count(*) AS trades, round(sum(net), 6) AS total, round(avg((net > 0)::INT), 6) AS win_rate FROM tr GROUP BY ALL")
def a13(spark, sf):
    return log(spark, sf).groupBy("symbol", "direction").agg(F.count("*").alias("trades"), F.round(F.sum("net"), 6).alias("total"), F.round(F.avg((F.col("net") > 0).cast("int")), 6).alias("win_rate"))


@query("w19_streaks", f"""{CROSS}, {LOG}, q AS (SELECT *, (net < 0)::INT AS loss, sum(net) OVER o AS eq FROM tr WINDOW o AS (PARTITION BY symbol ORDER BY entry_pos ROWS UNBOUNDED PRECEDING)),
u AS (SELECT *, sum(1 - loss) OVER o AS run2, greatest(max(eq) OVER o, 0) AS pk FROM q WINDOW o AS (PARTITION BY symbol ORDER BY entry_pos ROWS UNBOUNDED PRECEDING)), v AS (SELECT *, (eq < pk)::INT AS un FROM u), x AS (SELECT *, sum(1 - un) OVER (PARTITION BY symbol ORDER BY entry_pos ROWS UNBOUNDED PRECEDING) AS uw, (un = 0 AND lag(un) OVER (PARTITION BY symbol ORDER BY entry_pos) = 1)::INT AS back FROM v)
SELECT symbol, (SELECT max(k) FROM (SELECT sum(loss) AS k FROM x y WHERE y.symbol = x.symbol GROUP BY run2))::BIGINT AS losing_streak, (SELECT max(k) FROM (SELECT sum(un) AS k FROM x y WHERE y.symbol = x.symbol GROUP BY uw))::BIGINT AS underwater_trades, sum(back)::BIGINT AS recoveries, arg_max(un, entry_pos) = 1 AS open_underwater, round(min(eq - pk), 6) AS max_drawdown FROM x GROUP BY symbol""")
def w19(spark, sf):
    return T.streaks(log(spark, sf), "net", keys=["symbol"], order="entry_pos")
