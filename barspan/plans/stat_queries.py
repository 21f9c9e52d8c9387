"""Queries on aggregated statistics and regimes."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from barspan.functions import correlation_p_value, normal_quantile, share, t_p_value, t_stat, wilson
from barspan.operators import events as E
from barspan.operators import features as X
from barspan.operators import stats as S
from barspan.operators.scan import framed, rolling

from .profile_queries import RET, returns
from .registry import query
from .tables import daily, daily_sql, hourly, hourly_sql, table

H, D = hourly_sql(), daily_sql()
HORIZONS = (1, 4, 12, 24)
FWD = ", ".join(f'round(ln(lead("close", {h}) OVER (PARTITION BY symbol ORDER BY row_pos) / "close") * 100, 10) AS f{h}' for h in HORIZONS)
FORWARD = f"fwd AS (SELECT *, {FWD} FROM rets)"
LONG = "long AS (SELECT fwd.*, unnest([1, 4, 12, 24]) AS horizon, unnest([f1, f4, f12, f24]) AS fret FROM fwd)"


def forward(bars):
    """Forward log returns in % over each horizon, as columns f1, f4, ..."""
    c = F.col("close")
    return rolling(bars, {f"f{h}": lambda w, h=h: F.round(F.log(F.lead("close", h).over(w) / c) * 100, 10) for h in HORIZONS}, ahead=max(HORIZONS))


def long_horizons(df):
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("fret")) for h in HORIZONS])).alias("h")
    return df.select("*", rows).select("*", "h.horizon", "h.fret").drop("h")


def t_sql(x):
    return f"CASE WHEN count({x}) >= 2 AND stddev_samp({x}) > 0 THEN round(avg({x}) / (stddev_samp({x}) / sqrt(count({x}))), 6) END"


@query("a01_moments", f"""WITH {H}, {RET} SELECT symbol, count(ret) AS n, round(avg(ret), 6) AS mean, round(var_samp(ret), 6) AS var, round(stddev_samp(ret), 6) AS std, round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS kurtosis, round(min(ret), 6) AS min, round(max(ret), 6) AS max,
round(quantile_cont(ret, 0.01), 6) AS q01, round(quantile_cont(ret, 0.05), 6) AS q05, round(quantile_cont(ret, 0.5), 6) AS median, round(quantile_cont(ret, 0.95), 6) AS q95, round(quantile_cont(ret, 0.99), 6) AS q99 FROM rets GROUP BY symbol""")
def a01(spark, sf):
    return returns(hourly(spark, sf)).groupBy("symbol").agg(*S.moments("ret"))


@query("a04_direction_continuation", f"""WITH {H}, {RET}, {FORWARD}, {LONG} SELECT symbol, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS direction, horizon, count(fret) AS n, round(avg(fret), 6) AS mean, round(avg((CASE WHEN ret > 0 THEN fret > 0 ELSE fret < 0 END)::INT), 6) AS continuation, {t_sql('fret')} AS t
FROM long WHERE ret <> 0 AND fret IS NOT NULL GROUP BY ALL""")
def a04(spark, sf):
    d = long_horizons(forward(returns(hourly(spark, sf)))).filter("ret <> 0 and fret is not null").withColumn("direction", F.when(F.col("ret") > 0, "up").otherwise("down"))
    goes_on = F.when(F.col("ret") > 0, F.col("fret") > 0).otherwise(F.col("fret") < 0)
    return d.groupBy("symbol", "direction", "horizon").agg(F.count("fret").alias("n"), F.round(F.avg("fret"), 6).alias("mean"), F.round(share(goes_on), 6).alias("continuation"), F.round(t_stat(F.col("fret")), 6).alias("t"))


SHOCK = """lim AS (SELECT symbol, unnest(['low', 'low', 'low', 'high', 'high', 'high']) AS side, unnest([0.05::DOUBLE, 0.025, 0.01, 0.05, 0.025, 0.01]) AS level, unnest([quantile_cont(ret, 0.05), quantile_cont(ret, 0.025), quantile_cont(ret, 0.01), quantile_cont(ret, 0.95), quantile_cont(ret, 0.975), quantile_cont(ret, 0.99)]) AS threshold FROM rets GROUP BY symbol)"""


@query("a05_shock_mean_reversion", f"""WITH {H}, {RET}, {FORWARD}, {LONG}, {SHOCK} SELECT symbol, side, level, horizon, count(mr) AS n, round(avg(mr), 6) AS mean, round(quantile_cont(mr, 0.5), 6) AS median, round(stddev_samp(mr), 6) AS std, round(avg((mr > 0)::INT), 6) AS reversion, {t_sql('mr')} AS t
FROM (SELECT *, CASE WHEN side = 'low' THEN fret ELSE -fret END AS mr FROM long JOIN lim USING (symbol)) WHERE CASE WHEN side = 'low' THEN ret <= threshold ELSE ret >= threshold END AND fret IS NOT NULL GROUP BY ALL""")
def a05(spark, sf):
    """Shock mean reversion by side, level and horizon, returns turned against the shock: the flagship."""
    ev = long_horizons(S.shock_events(forward(returns(hourly(spark, sf))).select("symbol", "ret", *[f"f{h}" for h in HORIZONS]), "ret", [0.05, 0.025, 0.01])).filter("fret is not null")
    ev = ev.withColumn("mr", F.when(F.col("side") == "low", F.col("fret")).otherwise(-F.col("fret")))
    return ev.groupBy("symbol", "side", "level", "horizon").agg(F.count("mr").alias("n"), F.round(F.avg("mr"), 6).alias("mean"), F.round(F.percentile("mr", 0.5), 6).alias("median"), F.round(F.stddev_samp("mr"), 6).alias("std"), F.round(share(F.col("mr") > 0), 6).alias("reversion"), F.round(t_stat(F.col("mr")), 6).alias("t"))


VOL = "vols AS (SELECT *, CASE WHEN count(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 23 PRECEDING) = 24 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 23 PRECEDING) END AS vol FROM fwd), edges AS (SELECT symbol, quantile_cont(vol, [0.2, 0.4, 0.6, 0.8]) AS q FROM vols GROUP BY symbol), reg AS (SELECT vols.*, 'V' || (1 + (vol > q[1])::INT + (vol > q[2])::INT + (vol > q[3])::INT + (vol > q[4])::INT) AS regime FROM vols JOIN edges USING (symbol) WHERE vol IS NOT NULL)"


def regimes(bars):
    b = rolling(bars, {"vol": framed(F.stddev_samp, F.col("ret"), -23, 0)}, back=24)
    return X.quantile_bucket(b, "vol", [f"V{k}" for k in range(1, 6)], out="regime").filter("regime is not null")


@query("a06_volatility_regimes", f"""WITH {H}, {RET}, {FORWARD}, {VOL} SELECT symbol, regime, count(f4) AS n, round(avg(f4), 6) AS mean, round(stddev_samp(f4), 6) AS std, round(avg((f4 > 0)::INT), 6) AS win_rate FROM reg WHERE f4 IS NOT NULL GROUP BY ALL""")
def a06(spark, sf):
    b = regimes(forward(returns(hourly(spark, sf)))).filter("f4 is not null")
    return b.groupBy("symbol", "regime").agg(F.count("f4").alias("n"), F.round(F.avg("f4"), 6).alias("mean"), F.round(F.stddev_samp("f4"), 6).alias("std"), F.round(share(F.col("f4") > 0), 6).alias("win_rate"))


@query("a05_shock_by_regime", f"""WITH {H}, {RET}, {FORWARD}, {VOL}, {SHOCK} SELECT symbol, side, level, regime, count(f4) AS n, round(avg(f4), 6) AS mean FROM reg JOIN lim USING (symbol) WHERE f4 IS NOT NULL AND CASE WHEN side = 'low' THEN ret <= threshold ELSE ret >= threshold END GROUP BY ALL""")
def a05_regime(spark, sf):
    fwd = forward(returns(hourly(spark, sf)))
    limits = S.tail_thresholds(fwd, "ret", [0.05, 0.025, 0.01])
    beyond = F.when(F.col("side") == "low", F.col("ret") <= F.col("threshold")).otherwise(F.col("ret") >= F.col("threshold"))
    ev = regimes(fwd).join(limits, "symbol").filter(beyond & F.col("f4").isNotNull())
    return ev.groupBy("symbol", "side", "level", "regime").agg(F.count("f4").alias("n"), F.round(F.avg("f4"), 6).alias("mean"))


COND = {"oversold": "z < -1.5 AND pr < 0.2", "overbought": "z > 1.5 AND pr > 0.8", "stretched": "abs(z) > 2", "calm": "abs(z) < 0.5"}
ZPR = """zr AS (SELECT a.*, (ret - avg(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 47 PRECEDING)) / stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 47 PRECEDING) AS z0, count(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 47 PRECEDING) AS nz FROM fwd a),
pr AS (SELECT a.symbol, a.row_pos, CASE WHEN count(b.ret) >= 100 THEN (count(*) FILTER (b.ret < a.ret) + (count(*) FILTER (b.ret = a.ret) + 1) / 2) / count(b.ret) END AS pr FROM rets a JOIN rets b ON a.symbol = b.symbol AND b.row_pos BETWEEN a.row_pos - 99 AND a.row_pos WHERE a.ret IS NOT NULL GROUP BY ALL),
cond AS (SELECT zr.*, CASE WHEN nz = 48 THEN z0 END AS z, pr FROM zr LEFT JOIN pr USING (symbol, row_pos))"""


def conditions(bars):
    mean, sd = framed(F.avg, F.col("ret"), -47, 0), framed(F.stddev_samp, F.col("ret"), -47, 0)
    b = rolling(bars, {"z": lambda w: (F.col("ret") - mean(w)) / F.nullif(sd(w), F.lit(0))}, back=48)
    return X.percentile_rank(b, 100, 100, out="pr")


@query("a07_condition_study", f"""WITH {H}, {RET}, {FORWARD}, {ZPR}, g AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT cond.*, '{n}' AS condition FROM cond WHERE {c}" for n, c in COND.items())}) WHERE f4 IS NOT NULL), base AS (SELECT avg(f4) AS b FROM fwd)
SELECT condition, count(f4) AS n, round(avg((f4 > 0)::INT), 6) AS win_rate, round(avg(f4), 6) AS mean, round(quantile_cont(f4, 0.5), 6) AS median, round(quantile_cont(f4, 0.05), 6) AS p05, round(quantile_cont(f4, 0.95), 6) AS p95, round(stddev_samp(f4), 6) AS std, {t_sql('f4')} AS t, round(avg(f4) - any_value(b), 6) AS excess FROM g, base GROUP BY condition""")
def a07(spark, sf):
    fwd = forward(returns(hourly(spark, sf)))
    base = fwd.agg(F.avg("f4").alias("b"))
    z, pr = F.col("z"), F.col("pr")
    masks = {"oversold": (z < -1.5) & (pr < 0.2), "overbought": (z > 1.5) & (pr > 0.8), "stretched": F.abs(z) > 2, "calm": F.abs(z) < 0.5}
    g = E.tagged(conditions(fwd), masks, "condition").filter("f4 is not null").join(F.broadcast(base), F.lit(True))
    return g.groupBy("condition").agg(*S.return_pack("f4"), F.round(F.avg("f4") - F.first("b"), 6).alias("excess"))


@query("a15_binned_pivot", f"""WITH {H}, {RET}, {FORWARD}, {ZPR}, c AS (SELECT CASE WHEN z <= -1 THEN 'z-' WHEN z <= 1 THEN 'z0' ELSE 'z+' END AS z_bin, CASE WHEN pr <= 0.5 THEN 'p-' ELSE 'p+' END AS p_bin, f4 FROM cond WHERE z IS NOT NULL AND pr IS NOT NULL),
grid AS (SELECT * FROM (VALUES ('z-'), ('z0'), ('z+')) a(z_bin), (VALUES ('p-'), ('p+')) b(p_bin)) SELECT z_bin, p_bin, count(f4) AS n, round(avg(f4), 6) AS mean, round(avg((f4 > 0)::INT) FILTER (f4 IS NOT NULL), 6) AS win_rate FROM grid LEFT JOIN c USING (z_bin, p_bin) GROUP BY ALL""")
def a15(spark, sf):
    z, pr = F.col("z"), F.col("pr")
    c = conditions(forward(returns(hourly(spark, sf)))).filter("z is not null and pr is not null").select(F.when(z <= -1, "z-").when(z <= 1, "z0").otherwise("z+").alias("z_bin"), F.when(pr <= 0.5, "p-").otherwise("p+").alias("p_bin"), "f4")
    grid = spark.createDataFrame([(a, b) for a in ("z-", "z0", "z+") for b in ("p-", "p+")], "z_bin string, p_bin string")
    agg = c.groupBy("z_bin", "p_bin").agg(F.count("f4").alias("n"), F.round(F.avg("f4"), 6).alias("mean"), F.round(F.avg((F.col("f4") > 0).cast("int")), 6).alias("win_rate"))
    return F.broadcast(grid).join(agg, ["z_bin", "p_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("a11_var_es", f"""WITH {H}, {RET}, q AS (SELECT symbol, quantile_cont(ret, 0.05) AS v5, quantile_cont(ret, 0.01) AS v1 FROM rets GROUP BY symbol) SELECT symbol, round(any_value(v5), 8) AS var5, round(any_value(v1), 8) AS var1, round(avg(ret) FILTER (ret <= v5), 8) AS es5, round(avg(ret) FILTER (ret <= v1), 8) AS es1 FROM rets JOIN q USING (symbol) GROUP BY symbol""")
def a11(spark, sf):
    out = S.value_at_risk(returns(hourly(spark, sf)), "ret", keys=["symbol"])
    return out.select("symbol", *[F.round(c, 8).alias(c) for c in ("var5", "var1", "es5", "es1")])


@query("a10_ratios", f"""WITH {D}, bars AS (SELECT * FROM days), r AS (SELECT *, "close" / lag("close") OVER (PARTITION BY symbol ORDER BY row_pos) - 1 AS ret FROM bars), y AS (SELECT symbol, year(ts)::INT AS year, ret, row_pos FROM r WHERE ret IS NOT NULL),
e AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY symbol, year ORDER BY row_pos) AS eq FROM y), k AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol, year ORDER BY row_pos), 0) AS pk FROM e)
SELECT symbol, year, count(*) AS n, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 6) AS sharpe, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 6) AS sharpe_pop, round(avg(ret) * sqrt(252) / nullif(sqrt(avg(least(ret, 0) ** 2)), 0), 6) AS sortino, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(exp(min(eq - pk)) - 1, 6) AS max_dd FROM k GROUP BY ALL""")
def a10(spark, sf):
    y = returns(daily(spark, sf), "simple").filter("ret is not null").withColumn("year", F.year("ts"))
    down = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2)))
    m = y.groupBy("symbol", "year").agg(F.count("*").alias("n"), F.round(S.sharpe("ret", 252, "null"), 6).alias("sharpe"), F.round(S.sharpe("ret", 252, "population"), 6).alias("sharpe_pop"), F.round(F.avg("ret") * F.sqrt(F.lit(252)) / F.nullif(down, F.lit(0)), 6).alias("sortino"), F.round(S.compounded("ret"), 6).alias("total"))
    dd = S.max_drawdown(y, "ret", keys=["symbol", "year"], order="row_pos", kind="compounded").withColumn("max_dd", F.round("max_drawdown", 6)).drop("max_drawdown")
    return m.join(dd, ["symbol", "year"])


@query("a14_monthly_returns", f"""WITH {D}, bars AS (SELECT * FROM days), {RET} SELECT symbol, strftime(ts, '%Y-%m') AS month, count(ret) AS n, round(exp(sum(ret)) - 1, 6) AS ret FROM rets WHERE ret IS NOT NULL GROUP BY ALL""")
def a14(spark, sf):
    r = returns(daily(spark, sf)).filter("ret is not null")
    return r.groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("ret").alias("n"), F.round(F.exp(F.sum("ret")) - 1, 6).alias("ret"))


RISK = "risk AS (SELECT ts, coalesce(avg((ret < 0)::INT) >= 0.6, false) AS risk_off FROM rets WHERE ret IS NOT NULL GROUP BY ts)"


def interaction_rows(spark, sf):
    r = forward(returns(hourly(spark, sf)))
    risk = r.filter("ret is not null").groupBy("ts").agg((F.avg((F.col("ret") < 0).cast("int")) >= 0.6).alias("risk_off"))
    return r.join(risk, "ts").withColumns({"low": F.coalesce(F.col("volume") <= 4, F.lit(False)), "risk": F.coalesce("risk_off", F.lit(False))})


@query("a20_interaction_ols", f"""WITH {H}, {RET}, {FORWARD}, {RISK}, d AS (SELECT symbol, f4 AS y, (volume <= 4)::INT AS a, risk_off::INT AS b FROM fwd JOIN risk USING (ts) WHERE f4 IS NOT NULL),
c AS (SELECT symbol, 2 * a + b AS cell, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM d GROUP BY ALL), g AS (SELECT symbol, sum(n) AS n, sum(ss) / (sum(n) - 4) AS s2, map(list(cell), list(m)) AS m, map(list(cell), list(1.0::DOUBLE / n)) AS v FROM c GROUP BY symbol)
SELECT symbol, n::BIGINT AS n, term, round(coef, 6) AS coef, round(sqrt(s2 * vv), 6) AS se FROM (SELECT symbol, n, s2, unnest(['intercept', 'a', 'b', 'a_x_b']) AS term, unnest([m[0], m[2] - m[0], m[1] - m[0], m[3] - m[2] - m[1] + m[0]]) AS coef, unnest([v[0], v[0] + v[2], v[0] + v[1], v[0] + v[1] + v[2] + v[3]]) AS vv FROM g)""")
def a20(spark, sf):
    out = S.interaction_ols(interaction_rows(spark, sf), "f4", F.col("low"), F.col("risk"), keys=["symbol"])
    return out.select("symbol", "n", "term", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"))


@query("a28_group_pack", f"""WITH {H}, {RET}, {FORWARD}, {RISK}, d AS (SELECT *, volume <= 4 AS lowv FROM fwd JOIN risk USING (ts) WHERE f4 IS NOT NULL), g AS (SELECT d.*, unnest(list_filter(['all', CASE WHEN lowv THEN 'low' END, CASE WHEN NOT lowv THEN 'high' END, CASE WHEN risk_off THEN 'risk_off' END, CASE WHEN lowv AND risk_off THEN 'low_risk_off' END], lambda x: x IS NOT NULL)) AS grp FROM d)
SELECT grp, count(*) AS trades, round(sum(f4), 6) AS total, round(avg((f4 > 0)::INT), 6) AS win_rate, round(sum(f4) FILTER (f4 > 0) / -sum(f4) FILTER (f4 < 0), 6) AS profit_factor, round(avg(f4) FILTER (f4 > 0), 6) AS avg_win, round(avg(f4) FILTER (f4 < 0), 6) AS avg_loss, round(avg(f4) FILTER (f4 > 0) / -avg(f4) FILTER (f4 < 0), 6) AS payoff, round(quantile_cont(f4, 0.5), 6) AS median, round(max(f4), 6) AS best, round(min(f4), 6) AS worst, round(skewness(f4), 6) AS skew FROM g GROUP BY grp""")
def a28(spark, sf):
    low, risk = F.col("low"), F.col("risk")
    g = E.tagged(interaction_rows(spark, sf).filter("f4 is not null"), {"all": F.lit(True), "low": low, "high": ~low, "risk_off": risk, "low_risk_off": low & risk})
    return g.groupBy("grp").agg(*S.trade_pack("f4"))


@query("a21_contrasts", f"""WITH {H}, {RET}, {FORWARD}, {RISK}, d AS (SELECT symbol, f4, volume <= 4 AS low, risk_off FROM fwd JOIN risk USING (ts) WHERE f4 IS NOT NULL)
SELECT symbol, round(avg(f4) FILTER (low AND risk_off) - avg(f4) FILTER (low AND NOT risk_off), 6) AS low_effect, round(avg(f4) FILTER (NOT low AND risk_off) - avg(f4) FILTER (NOT low AND NOT risk_off), 6) AS high_effect,
round((avg(f4) FILTER (low AND risk_off) - avg(f4) FILTER (low AND NOT risk_off)) - (avg(f4) FILTER (NOT low AND risk_off) - avg(f4) FILTER (NOT low AND NOT risk_off)), 6) AS did FROM d GROUP BY symbol""")
def a21(spark, sf):
    low, risk = F.col("low"), F.col("risk")
    m = lambda c: F.avg(F.when(c, F.col("f4")))
    g = interaction_rows(spark, sf).filter("f4 is not null").groupBy("symbol").agg((m(low & risk) - m(low & ~risk)).alias("x"), (m(~low & risk) - m(~low & ~risk)).alias("y"))
    return g.select("symbol", F.round("x", 6).alias("low_effect"), F.round("y", 6).alias("high_effect"), F.round(F.col("x") - F.col("y"), 6).alias("did"))


@query("a22_regression", f"""WITH {H}, {RET}, {FORWARD}, d AS (SELECT symbol, ret AS x, f4 AS y FROM fwd WHERE ret IS NOT NULL AND f4 IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2 AS ry FROM d)
SELECT symbol, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_r2(y, x), 6) AS r2 FROM r GROUP BY symbol""")
def a22(spark, sf):
    d = forward(returns(hourly(spark, sf))).filter("ret is not null and f4 is not null").select("symbol", F.col("ret").alias("x"), F.col("f4").alias("y"))
    r = S.average_ranks(S.average_ranks(d, ["symbol"], "x", "rx"), ["symbol"], "y", "ry")
    return r.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


#: Terms of finite and power series as running products: of Student's t for whole degrees of freedom, and of the normal distribution.
T_SERIES = """ser AS (SELECT k.*, exp(coalesce(sum(CASE WHEN v % 2 = 0 THEN ln((2 * i - 1) / (2 * i)::DOUBLE) ELSE ln(2 * i / (2 * i + 1)::DOUBLE) END + ln(v / (v + t * t))) FILTER (i > 0) OVER (PARTITION BY id ORDER BY i), 0)) AS term FROM k, range(2000) r(i) WHERE i <= CASE WHEN v % 2 = 0 THEN (v - 2) // 2 ELSE (v - 3) // 2 END),
pv AS (SELECT id, 1 - CASE WHEN any_value(v) % 2 = 0 THEN any_value(abs(t) / sqrt(v + t * t)) * sum(term) ELSE 2 / pi() * any_value(atan(abs(t) / sqrt(v::DOUBLE))) + 2 / pi() * any_value(abs(t) / sqrt(v + t * t) * sqrt(v / (v + t * t))) * sum(term) END AS p FROM ser GROUP BY id)"""


@query("a20_interaction_tests", f"""WITH {H}, {RET}, {FORWARD}, {RISK}, d AS (SELECT symbol, f4 AS y, (volume <= 4)::INT AS a, risk_off::INT AS b FROM fwd JOIN risk USING (ts) WHERE f4 IS NOT NULL),
c AS (SELECT symbol, 2 * a + b AS cell, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM d GROUP BY ALL), g AS (SELECT symbol, sum(n) AS n, sum(ss) / (sum(n) - 4) AS s2, map(list(cell), list(m)) AS m, map(list(cell), list(1.0::DOUBLE / n)) AS v FROM c GROUP BY symbol),
e AS (SELECT symbol, n::BIGINT AS n, s2, unnest(['intercept', 'a', 'b', 'a_x_b']) AS term_name, unnest([m[0], m[2] - m[0], m[1] - m[0], m[3] - m[2] - m[1] + m[0]]) AS coef, unnest([v[0], v[0] + v[2], v[0] + v[1], v[0] + v[1] + v[2] + v[3]]) AS vv FROM g),
k AS (SELECT symbol, n, term_name, coef / sqrt(s2 * vv) AS t, n - 4 AS v, symbol || term_name AS id FROM e WHERE coef IS NOT NULL), {T_SERIES}
SELECT symbol, n, term_name AS term, round(t, 6) AS t, round(p, 6) AS p FROM k JOIN pv USING (id)""")
def a20_tests(spark, sf):
    """t and two-sided p of every coefficient of the interaction model."""
    out = S.interaction_ols(interaction_rows(spark, sf), "f4", F.col("low"), F.col("risk"), keys=["symbol"]).filter("t is not null")
    return out.select("symbol", "n", "term", F.round("t", 6).alias("t"), F.round(t_p_value(F.col("t"), F.col("n") - 4), 6).alias("p"))


@query("a22_correlation_tests", f"""WITH {H}, {RET}, {FORWARD}, d AS (SELECT symbol, corr(ret, f4) AS r, count(*) AS n FROM fwd WHERE ret IS NOT NULL AND f4 IS NOT NULL GROUP BY symbol), z AS (SELECT *, abs(0.5 * ln((1 + r) / (1 - r)) * sqrt(n - 3)) AS z FROM d),
q AS (SELECT symbol, sum(term) AS total FROM (SELECT symbol, z * exp(coalesce(sum(ln(z * z / (2 * i + 1))) FILTER (i > 0) OVER (PARTITION BY symbol ORDER BY i), 0)) AS term FROM z, range(200) t(i)) GROUP BY symbol)
SELECT symbol, n, round(r, 6) AS pearson, round(1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * total, 6) AS p FROM z JOIN q USING (symbol)""")
def a22_tests(spark, sf):
    """Correlation of a return with the one after it, and its p by Fisher's z."""
    g = forward(returns(hourly(spark, sf))).filter("ret is not null and f4 is not null").groupBy("symbol").agg(F.count("*").alias("n"), F.corr("ret", "f4").alias("r"))
    return g.select("symbol", "n", F.round("r", 6).alias("pearson"), F.round(correlation_p_value(F.col("r"), F.col("n")), 6).alias("p"))


PROBABILITIES = [0.001, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.999]


@query("a34_normal_quantiles", f"""WITH {H}, {RET}, s AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS sd FROM rets GROUP BY symbol), q AS (SELECT symbol, unnest({PROBABILITIES}::DOUBLE[]) AS p, unnest(quantile_cont(ret, {PROBABILITIES})) AS found, unnest({[NormalDist().inv_cdf(p) for p in PROBABILITIES]}::DOUBLE[]) AS z FROM rets GROUP BY symbol)
SELECT symbol, p, round(z, 9) AS z, round(m + sd * z, 6) AS normal, round(found, 6) AS found FROM q JOIN s USING (symbol)""")
def a34_quantiles(spark, sf):
    """Quantiles of returns beside those of a normal distribution with their mean and deviation."""
    ps = F.array(*[F.lit(p) for p in PROBABILITIES])
    g = returns(hourly(spark, sf)).groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.percentile("ret", ps).alias("q"))
    rows = g.select("symbol", "m", "sd", F.explode(F.arrays_zip(ps.alias("p"), F.col("q").alias("found"))).alias("r")).select("symbol", "m", "sd", "r.p", "r.found")
    rows = rows.withColumn("z", normal_quantile(F.col("p")))
    return rows.select("symbol", "p", F.round("z", 9).alias("z"), F.round(F.col("m") + F.col("sd") * F.col("z"), 6).alias("normal"), F.round("found", 6).alias("found"))


@query("a23_wilson", f"""WITH {H}, {RET}, g AS (SELECT symbol, count(*) FILTER (ret > 0) AS k, count(ret) AS n FROM rets GROUP BY symbol)
SELECT symbol, k, n, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 6)::DOUBLE AS low, round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((k / n * (1 - k / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 6)::DOUBLE AS high FROM g""")
def a23(spark, sf):
    g = returns(hourly(spark, sf)).groupBy("symbol").agg(F.count_if(F.col("ret") > 0).alias("k"), F.count("ret").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("symbol", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("a31_worst_windows", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, s AS (SELECT symbol, row_pos, sum(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 20 PRECEDING) AS w21, count(ret) OVER (PARTITION BY symbol ORDER BY row_pos ROWS 20 PRECEDING) AS n FROM rets)
SELECT symbol, round(exp(min(w21)) - 1, 6) AS worst21, arg_min(row_pos, (w21, row_pos)) AS at_pos FROM s WHERE n = 21 GROUP BY symbol""")
def a31(spark, sf):
    b = rolling(returns(daily(spark, sf)), {"w21": framed(F.sum, F.col("ret"), -20, 0)}, back=21).filter("w21 is not null")
    return b.groupBy("symbol").agg(F.round(F.exp(F.min("w21")) - 1, 6).alias("worst21"), F.min_by("row_pos", F.struct("w21", "row_pos")).alias("at_pos"))


@query("a31_drawdown_anatomy", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, e AS (SELECT symbol, row_pos, ret, sum(ret) OVER (PARTITION BY symbol ORDER BY row_pos) AS eq FROM rets WHERE ret IS NOT NULL),
k AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY row_pos), 0) AS pk FROM e), a AS (SELECT *, coalesce(max(CASE WHEN eq >= pk THEN row_pos END) OVER (PARTITION BY symbol ORDER BY row_pos), -1) AS since FROM k),
w AS (SELECT * FROM a WHERE eq - pk < 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY eq - pk, row_pos) = 1), u AS (SELECT symbol, max(row_pos - since) AS under, arg_max(eq < pk, row_pos) AS still_under FROM a GROUP BY symbol)
SELECT w.symbol, w.since AS peak, w.row_pos AS trough, round(exp(w.eq - w.pk) - 1, 6) AS depth, arg_min(e.row_pos, (e.ret, e.row_pos)) AS worst_at, round(exp(min(e.ret)) - 1, 6) AS worst_step, round(min(e.ret) / any_value(w.eq - w.pk), 6) AS worst_share, any_value(under) AS under, any_value(still_under) AS still_under
FROM w JOIN e ON e.symbol = w.symbol AND e.row_pos > w.since AND e.row_pos <= w.row_pos JOIN u ON u.symbol = w.symbol GROUP BY w.symbol, w.since, w.row_pos, w.eq, w.pk""")
def a31_anatomy(spark, sf):
    """Start, end, worst step and its share of the deepest fall; longest time under water in bars."""
    out = S.drawdown_anatomy(returns(daily(spark, sf)), "ret", keys=["symbol"], order="row_pos")
    return out.select("symbol", "peak", "trough", F.round("depth", 6).alias("depth"), "worst_at", F.round("worst_step", 6).alias("worst_step"), F.round("worst_share", 6).alias("worst_share"), "under", "still_under")


@query("a32_expanding_std", f"""WITH {D}, bars AS (SELECT * FROM days), {RET}, e AS (SELECT symbol, row_pos, stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY row_pos) AS sd FROM rets)
SELECT row_pos, round(quantile_cont(sd, 0.05), 8) AS p05, round(quantile_cont(sd, 0.5), 8) AS p50, round(quantile_cont(sd, 0.95), 8) AS p95 FROM e WHERE row_pos IN (50, 100, 250, 500, 1000, 2000) GROUP BY row_pos""")
def a32(spark, sf):
    from barspan.operators.scan import running

    r = F.col("ret")
    b = running(returns(daily(spark, sf)), {"s": ("sum", r), "q": ("sum", r * r), "n": ("sum", r.isNotNull().cast("double"))}, keys=["symbol"], size=512)
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    e = b.withColumn("sd", sd).filter(F.col("row_pos").isin(50, 100, 250, 500, 1000, 2000))
    return e.groupBy("row_pos").agg(*[F.round(F.percentile("sd", p), 8).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])


@query("p19_kelly", f"""WITH {H}, {RET}, {FORWARD}, s AS (SELECT symbol, avg((f4 > 0)::INT) FILTER (f4 IS NOT NULL) AS p, avg(f4) FILTER (f4 > 0) AS w, -avg(f4) FILTER (f4 < 0) AS l FROM fwd GROUP BY symbol), k AS (SELECT *, (w - 0.5) / (l + 0.5) AS b FROM s), f AS (SELECT *, p - (1 - p) / b AS kf FROM k)
SELECT symbol, round(b, 6) AS payoff, round(kf, 6) AS kelly, round(greatest(least(kf, 0.25), 0), 6) AS fraction, round(greatest(least(kf, 0.25), 0) * 10000, 4) AS budget, floor(greatest(least(kf, 0.25), 0) * 10000 / 25 / 10)::BIGINT * 10 AS quantity FROM f""")
def p19(spark, sf):
    c = F.col("f4")
    s = forward(returns(hourly(spark, sf))).groupBy("symbol").agg(F.avg((c > 0).cast("int")).alias("p"), F.avg(F.when(c > 0, c)).alias("w"), (-F.avg(F.when(c < 0, c))).alias("l"))
    k = S.kelly(F.col("p"), F.col("w"), F.col("l"), cost=0.5, cap=0.25, equity=10_000, stop=25, step=10)
    return s.select("symbol", F.round(k["payoff"], 6).alias("payoff"), F.round(k["kelly"], 6).alias("kelly"), F.round(k["fraction"], 6).alias("fraction"), F.round(k["budget"], 4).alias("budget"), k["quantity"].cast("bigint").alias("quantity"))


@query("p25_equal_vol_portfolio", f"""WITH {H}, {RET}, p AS (SELECT corr(a.ret, b.ret) AS r FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol), m AS (SELECT avg(r) AS rho FROM p)
SELECT n::BIGINT AS n, round(sqrt(rho + (1 - rho) / n), 6) AS vol_ratio FROM m, range(1, 31) t(n)""")
def p25(spark, sf):
    r = returns(hourly(spark, sf)).select("symbol", "ts", "ret")
    pairs = r.select("ts", F.col("symbol").alias("x"), F.col("ret").alias("rx")).join(r.select("ts", F.col("symbol").alias("y"), F.col("ret").alias("ry")), "ts").filter("x < y and rx is not null and ry is not null")
    rho = pairs.groupBy("x", "y").agg(F.corr("rx", "ry").alias("r")).agg(F.avg("r").alias("rho"))
    n = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(30).cast("bigint"))).alias("n")
    return rho.select("rho", n).select("n", F.round(F.sqrt(F.col("rho") + (1 - F.col("rho")) / F.col("n")), 6).alias("vol_ratio"))


@query("o02_latest", f"""WITH {H} SELECT symbol, row_pos, "close" FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY row_pos DESC) <= 5""")
def o02(spark, sf):
    b = hourly(spark, sf)
    top = b.groupBy("symbol").agg(F.max("row_pos").alias("top"))
    return b.join(top, "symbol").filter(F.col("row_pos") > F.col("top") - 5).select("symbol", "row_pos", "close")


@query("o03_best_category", """SELECT event_type, arg_max(user_id, (n, -user_id)) AS top_user, max(n) AS n FROM (SELECT event_type, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL) GROUP BY event_type""")
def o03(spark, sf):
    n = table(spark, sf, "events").filter("user_id is not null").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("top_user"), F.max("n").alias("n"))
