"""Queries on resampling, cross-validation and walk-forward selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspan.operators import bars as B
from barspan.operators import positions as T
from barspan.operators import resample as R
from barspan.operators.scan import ranked

from .asof_queries import month_folds
from .position_queries import CROSS, LOG, log
from .registry import query
from .tables import daily, daily_sql, hourly, hourly_sql

H, D = hourly_sql(), daily_sql()
RUNS, SEED = 1000, 20240609
V = f"{CROSS}, {LOG}, v AS (SELECT symbol, net, direction, row_number() OVER (PARTITION BY symbol ORDER BY entry_pos) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM tr), rr AS (SELECT range AS run FROM range({RUNS})), base AS (SELECT symbol, i AS pos, n, direction, run FROM v, rr)"


def md5_sql(n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT % {n})"


PICKS = {
    "iid": f"SELECT symbol, run, pos, {md5_sql('n', str(SEED), 'symbol', 'run', 'pos')} AS i FROM base",
    "block": f"SELECT symbol, run, pos, ({md5_sql('n', str(SEED), 'symbol', 'run', 'pos // 5')} + pos % 5) % n AS i FROM base",
    "shuffle": f"SELECT symbol, run, pos AS i, row_number() OVER (PARTITION BY symbol, run ORDER BY md5(concat_ws('|', {SEED}, symbol, run, pos))) - 1 AS pos FROM base",
    "stationary": f"""SELECT symbol, run, pos, (last_value(CASE WHEN f THEN s END IGNORE NULLS) OVER q + pos - last_value(CASE WHEN f THEN pos END IGNORE NULLS) OVER q) % n AS i FROM (SELECT *, pos = 0 OR {md5_sql('1000000', str(SEED + 1), 'symbol', 'run', 'pos')} < 200000 AS f, {md5_sql('n', str(SEED), 'symbol', 'run', 'pos')} AS s FROM base) WINDOW q AS (PARTITION BY symbol, run ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "regime": f"""SELECT a.symbol, run, pos, b.i FROM (SELECT symbol, direction, run, pos, {md5_sql('k', str(SEED), 'symbol', 'run', 'pos')} AS r FROM base JOIN (SELECT symbol, direction, count(*) AS k FROM v GROUP BY ALL) USING (symbol, direction)) a JOIN (SELECT symbol, direction, i, row_number() OVER (PARTITION BY symbol, direction ORDER BY i) - 1 AS r FROM v) b ON a.symbol = b.symbol AND a.direction = b.direction AND a.r = b.r""",
}


def values(spark, sf):
    return R.indexed(log(spark, sf), ["symbol"], "net", ["entry_pos"], ["direction"])


for _no, _method in ((1, "iid"), (2, "shuffle"), (3, "block"), (4, "stationary"), (5, "regime")):

    @query(
        f"r0{_no}_{_method}_resample",
        f"""{V}, pk AS ({PICKS[_method]}), d AS (SELECT pk.symbol, run, pos, net FROM pk JOIN v USING (symbol, i)), e AS (SELECT *, sum(net) OVER (PARTITION BY symbol, run ORDER BY pos ROWS UNBOUNDED PRECEDING) AS eq FROM d), k AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol, run ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS pk FROM e)
SELECT symbol, run::INT AS run, count(*) AS n, round(sum(net), 4) AS total, round(avg((net > 0)::INT), 6) AS win_rate, round(min(eq - pk), 4) AS max_drawdown FROM k GROUP BY ALL""",
    )
    def run_resample(spark, sf, method=_method):
        v = values(spark, sf)
        d = R.drawn(v, R.resample(v, keys=["symbol"], runs=RUNS, seed=SEED, method=method, label="direction" if method == "regime" else None), ["symbol"], "net")
        w = Window.partitionBy("symbol", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        e = d.withColumn("eq", F.sum("net").over(w))
        e = e.withColumn("peak", F.greatest(F.max("eq").over(w), F.lit(0.0)))
        return e.groupBy("symbol", "run").agg(F.count("*").alias("n"), F.round(F.sum("net"), 4).alias("total"), F.round(F.avg((F.col("net") > 0).cast("int")), 6).alias("win_rate"), F.round(F.min(F.col("eq") - F.col("peak")), 4).alias("max_drawdown"))


@query("r06_resample_bands", f"""{V}, pk AS ({PICKS['iid']}), t AS (SELECT pk.symbol, run, sum(net) AS total FROM pk JOIN v USING (symbol, i) GROUP BY ALL)
SELECT symbol, round(quantile_cont(total, 0.05), 4) AS p05, round(quantile_cont(total, 0.5), 4) AS p50, round(quantile_cont(total, 0.95), 4) AS p95, round(avg((total < 0)::INT), 6) AS loss_rate FROM t GROUP BY symbol""")
def r06(spark, sf):
    v = values(spark, sf)
    t = R.drawn(v, R.resample(v, keys=["symbol"], runs=RUNS, seed=SEED), ["symbol"], "net").groupBy("symbol", "run").agg(F.sum("net").alias("total"))
    return t.groupBy("symbol").agg(*[F.round(F.percentile("total", p), 4).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))], F.round(F.avg((F.col("total") < 0).cast("int")), 6).alias("loss_rate"))


@query("r08_random_direction", f"""{V}, s AS (SELECT base.symbol, run, sum(CASE WHEN {md5_sql('2', str(SEED), 'base.symbol', 'run', 'pos')} = 0 THEN -1 ELSE 1 END * v.direction * (net + 0.5) - 0.5) AS total FROM base JOIN v ON v.symbol = base.symbol AND v.i = base.pos GROUP BY ALL), a AS (SELECT symbol, sum(net) AS actual FROM v GROUP BY symbol)
SELECT symbol, round(any_value(actual), 4) AS actual, round(avg((total <= actual)::INT), 6) AS percentile, round(quantile_cont(total, 0.5), 4) AS random_median FROM s JOIN a USING (symbol) GROUP BY symbol""")
def r08(spark, sf):
    """The price difference of each trade in a random direction, less its cost whatever the direction."""
    v = values(spark, sf)
    base = v.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    sign = F.when(R.draw(F.lit(2), F.lit(SEED), F.col("symbol"), F.col("run"), F.col("i")) == 0, -1).otherwise(1)
    s = base.groupBy("symbol", "run").agg(F.sum(sign * F.col("direction") * (F.col("net") + 0.5) - 0.5).alias("total"))
    a = v.groupBy("symbol").agg(F.sum("net").alias("actual"))
    j = s.join(a, "symbol")
    return j.groupBy("symbol").agg(F.round(F.first("actual"), 4).alias("actual"), F.round(F.avg((F.col("total") <= F.col("actual")).cast("int")), 6).alias("percentile"), F.round(F.percentile("total", 0.5), 4).alias("random_median"))


SHORTS, LONGS = (5, 10, 20, 40), (50, 80, 120, 200)
GRID = [(s, x) for s in SHORTS for x in LONGS]
MA = ", ".join(f'CASE WHEN row_pos >= {n - 1} THEN avg("close") OVER (PARTITION BY symbol ORDER BY row_pos ROWS {n - 1} PRECEDING) END AS m{n}' for n in SHORTS + LONGS)


def grid_sql(bars: str) -> str:
    pick = lambda c, ns: f"CASE {c} " + " ".join(f"WHEN {n} THEN m{n}" for n in ns) + " END"
    return f"""pairs AS (SELECT * FROM (VALUES (5), (10), (20), (40)) a(s), (VALUES (50), (80), (120), (200)) b(l)), m AS (SELECT *, {MA} FROM {bars}), sg AS (SELECT m.*, s, l, coalesce(sign(({pick('s', SHORTS)}) - ({pick('l', LONGS)}))::INT, 0) AS sig FROM m, pairs),
ps AS (SELECT *, coalesce(lag(sig) OVER q, 0) AS pos, "close" / lag("close") OVER q - 1 AS mv FROM sg WINDOW q AS (PARTITION BY symbol, s, l ORDER BY row_pos)), r AS (SELECT symbol, s, l, ts, row_pos, pos, coalesce(pos * mv, 0) - 0.0005 * abs(pos - coalesce(lag(pos) OVER q, 0)) AS ret FROM ps WINDOW q AS (PARTITION BY symbol, s, l ORDER BY row_pos))"""


def grid_returns(bars):
    return T.bar_returns(T.average_cross(bars, GRID), ["symbol", "short_ma", "long_ma"], cost=0.0005).select("symbol", "short_ma", "long_ma", "ts", "row_pos", "ret")


SELECTED = f"""WITH {H}, {grid_sql('bars')}, nb AS (SELECT *, count(*) OVER (PARTITION BY symbol, s, l) AS n FROM r), bl AS (SELECT *, CASE WHEN row_pos < (n % 8) * (n // 8 + 1) THEN row_pos // (n // 8 + 1) ELSE n % 8 + (row_pos - (n % 8) * (n // 8 + 1)) // (n // 8) END AS block FROM nb),
c0 AS (SELECT list_sort([a.x, b.x, c.x, d.x]) AS ch FROM range(8) a(x), range(8) b(x), range(8) c(x), range(8) d(x) WHERE a.x < b.x AND b.x < c.x AND c.x < d.x), combos AS (SELECT row_number() OVER (ORDER BY ch) - 1 AS combo, ch FROM c0),
bs AS (SELECT symbol, s, l, block, count(*) AS n, sum(ret) AS x, sum(ret * ret) AS q, sum(ln(nullif(abs(1 + ret), 0))) AS g, count(*) FILTER (1 + ret <= 0) AS neg FROM bl GROUP BY ALL),
h AS (SELECT symbol, combo, s, l, list_contains(ch, block) AS inside, sum(n) AS n, sum(x) AS x, sum(q) AS q, sum(g) AS g, sum(neg) AS neg FROM bs, combos GROUP BY ALL), sr AS (SELECT *, round(CASE WHEN q - x * x / n > 0 THEN x / n / sqrt((q - x * x / n) / (n - 1)) ELSE 0 END, 9) AS sharpe FROM h),
g AS (SELECT symbol, combo, s, l, max(sharpe) FILTER (inside) AS i, max(sharpe) FILTER (NOT inside) AS o, bool_or(NOT inside AND (round(g, 9) < 0 OR neg % 2 = 1)) AS oos_loss FROM sr GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, combo ORDER BY i DESC, s, l) AS ir, row_number() OVER (PARTITION BY symbol, combo ORDER BY o DESC, s, l) AS orank, quantile_cont(o, 0.5) OVER (PARTITION BY symbol, combo) AS med FROM g),
sel AS (SELECT symbol, combo::INT AS combo, s AS short_ma, l AS long_ma, i AS is_sharpe, o AS oos_sharpe, orank::INT AS oos_rank, o <= med AS below_median, oos_loss FROM k WHERE ir = 1)"""


def selected(spark, sf):
    sums = R.block_sums(grid_returns(hourly(spark, sf)), strategy=["symbol", "short_ma", "long_ma"], counted=True)
    return R.cross_validate(sums, strategy=["symbol", "short_ma", "long_ma"], keys=["symbol"])


@query("r09_cross_validation", f"{SELECTED} SELECT symbol, combo, short_ma, long_ma, round(is_sharpe, 6) AS is_sharpe, round(oos_sharpe, 6) AS oos_sharpe, oos_rank, below_median, oos_loss FROM sel")
def r09(spark, sf):
    return selected(spark, sf).select("symbol", "combo", "short_ma", "long_ma", F.round("is_sharpe", 6).alias("is_sharpe"), F.round("oos_sharpe", 6).alias("oos_sharpe"), "oos_rank", "below_median", "oos_loss")


@query("r09_overfit_probability", f"""{SELECTED} SELECT symbol, count(*) AS combinations, round(avg(below_median::INT), 6) AS overfit_probability, round(avg(oos_loss::INT), 6) AS loss_probability, round(avg(is_sharpe), 6) AS mean_is, round(avg(oos_sharpe), 6) AS mean_oos, round(quantile_cont(oos_sharpe, 0.5), 6) AS median_oos, round(avg(oos_rank), 6) AS mean_rank,
round(avg(ln((17.0::DOUBLE - oos_rank) / oos_rank)), 6) AS mean_logit FROM sel GROUP BY symbol""")
def r09_overfit(spark, sf):
    """Over all choices of blocks: how often the best inside is at or under the median outside, or loses there; logit of its relative rank."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    mean = lambda c: F.round(F.avg(c), 6)
    logit = F.log((F.col("strategies") + 1 - F.col("oos_rank")) / F.col("oos_rank"))
    return selected(spark, sf).groupBy("symbol").agg(F.count("*").alias("combinations"), rate("below_median").alias("overfit_probability"), rate("oos_loss").alias("loss_probability"), mean("is_sharpe").alias("mean_is"), mean("oos_sharpe").alias("mean_oos"), F.round(F.percentile("oos_sharpe", 0.5), 6).alias("median_oos"), mean("oos_rank").alias("mean_rank"), mean(logit).alias("mean_logit"))


@query("r11_walk_forward", f"""WITH {D}, {grid_sql('days')}, folds AS (SELECT f AS fold, (DATE '1992-01-01' + to_months(6 * f::INT))::TIMESTAMP AS a FROM range(10) t(f)),
j AS (SELECT symbol, s, l, fold, ret, CASE WHEN ts < a + INTERVAL 24 MONTH THEN 1 WHEN ts < a + INTERVAL 30 MONTH THEN 2 ELSE 3 END AS seg FROM r JOIN folds ON ts >= a AND ts < a + INTERVAL 33 MONTH),
mm AS (SELECT symbol, fold, s, l, avg(ret) FILTER (seg = 1) / nullif(stddev_samp(ret) FILTER (seg = 1), 0) AS a1, avg(ret) FILTER (seg = 2) / nullif(stddev_samp(ret) FILTER (seg = 2), 0) AS a2, sum(ret) FILTER (seg = 3) AS t FROM j GROUP BY ALL HAVING count(*) FILTER (seg = 1) >= 30 AND count(*) FILTER (seg = 2) > 1 AND count(*) FILTER (seg = 3) > 0),
sc AS (SELECT *, round(0.7 * a2 + 0.3 * a1 - 0.35 * greatest(abs(a1 - a2) - 1, 0), 9) AS score FROM mm WHERE a1 IS NOT NULL AND a2 IS NOT NULL), b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY score DESC, s, l) = 1)
SELECT e.symbol, e.fold, s AS short_ma, l AS long_ma, round(score, 6) AS score, round(coalesce(t, 0), 6) AS test_sum FROM (SELECT * FROM (SELECT DISTINCT symbol FROM days), (SELECT fold FROM folds)) e LEFT JOIN b ON b.symbol = e.symbol AND b.fold = e.fold""")
def r11(spark, sf):
    train, validation = (F.col(f"{s}_mean") / F.nullif(F.col(f"{s}_sd"), F.lit(0)) for s in ("train", "validation"))
    score = F.round(0.7 * validation + 0.3 * train - 0.35 * F.greatest(F.abs(train - validation) - 1, F.lit(0.0)), 9)
    score = F.when(train.isNotNull() & validation.isNotNull(), score)
    out = R.walk_forward(grid_returns(daily(spark, sf)), month_folds(spark, "1992-01-01", 10), keys=["symbol"], strategy=["short_ma", "long_ma"], score=score)
    return out.select("symbol", "fold", "short_ma", "long_ma", F.round("score", 6).alias("score"), F.round("test_sum", 6).alias("test_sum"))


@query("r12_cost_sensitivity", f"""{CROSS}, {LOG} SELECT symbol, cost::DOUBLE AS cost, round(sum(net + 0.5 - cost), 4) AS total, round(avg((net + 0.5 - cost > 0)::INT), 6) AS win_rate FROM tr, (VALUES (0.0), (0.8), (1.0), (2.0)) c(cost) GROUP BY ALL""")
def r12(spark, sf):
    costs = F.explode(F.array(*[F.lit(c) for c in (0.0, 0.8, 1.0, 2.0)])).alias("cost")
    t = log(spark, sf).select("symbol", "gross", costs)
    net = F.col("gross") - F.col("cost")
    return t.groupBy("symbol", "cost").agg(F.round(F.sum(net), 4).alias("total"), F.round(F.avg((net > 0).cast("int")), 6).alias("win_rate"))


STEPS = (1800, 3600, 14400)
FRAMES = f"""{hourly_sql(1800, 'fine')}, cb AS (SELECT symbol, step, row_number() OVER (PARTITION BY symbol, step ORDER BY s) - 1 AS row_pos, s, open, high, low, "close" FROM (SELECT symbol, step, floor(epoch(ts) / step)::BIGINT * step AS s, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max("close", ts) AS "close" FROM fine, (VALUES {', '.join(f'({x})' for x in STEPS)}) f(step) GROUP BY ALL)),
fg AS (SELECT *, CASE WHEN row_pos >= 19 THEN sign(avg("close") OVER (PARTITION BY symbol, step ORDER BY row_pos ROWS 4 PRECEDING) - avg("close") OVER (PARTITION BY symbol, step ORDER BY row_pos ROWS 19 PRECEDING))::INT ELSE 0 END AS sig FROM cb),
fp AS (SELECT *, coalesce(lag(sig) OVER q, 0) AS pos, "close" / lag("close") OVER q - 1 AS mv FROM fg WINDOW q AS (PARTITION BY symbol, step ORDER BY row_pos)), fr AS (SELECT symbol, step, row_pos, coalesce(pos * mv, 0) - 0.0005 * abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol, step ORDER BY row_pos), 0)) AS ret, abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol, step ORDER BY row_pos), 0)) AS turn FROM fp)"""


@query("r12_timeframes", f"""WITH {FRAMES} SELECT symbol, step::INT AS step, count(*) AS bars, sum(turn)::BIGINT AS turnover, round(sum(ret), 6) AS total, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365.25 * 86400 / any_value(step)), 6) AS sharpe FROM fr GROUP BY symbol, step""")
def r12_timeframes(spark, sf):
    """One family on 30, 60 and 240 minutes, all rolled up from the finest bars in one scan."""
    bars = B.coarser(hourly(spark, sf, 1800), list(STEPS))
    keys = ["symbol", "step"]
    placed = ranked(bars.withColumn("t", F.unix_timestamp("ts")), keys=keys, order=["t"], out="row_pos").drop("n", "t")
    r = T.bar_returns(T.average_cross(placed, [(5, 20)], keys=keys), keys, cost=0.0005)
    sharpe = F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0)) * F.sqrt(365.25 * 86400 / F.col("step"))
    return r.groupBy(*keys).agg(F.count("*").alias("bars"), F.sum("turnover").cast("bigint").alias("turnover"), F.round(F.sum("ret"), 6).alias("total"), F.round(sharpe, 6).alias("sharpe"))


@query("p17_mae_stress", f"""{CROSS}, pth AS (SELECT symbol, row_pos, "close" / lead("close", 12) OVER (PARTITION BY symbol ORDER BY row_pos) AS x, ln(lead("close", 12) OVER q / lead(open) OVER q) AS ret, CASE WHEN lead("close", 12) OVER q IS NOT NULL THEN ln(min(low) OVER (PARTITION BY symbol ORDER BY row_pos ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) / lead(open) OVER q) END AS mae FROM bars WINDOW q AS (PARTITION BY symbol ORDER BY row_pos))
SELECT symbol, stop::DOUBLE AS stop, lev::DOUBLE AS leverage, count(*) AS n, round(avg(CASE WHEN mae > ln(1 + stop) THEN ret ELSE ln(1 + stop) END * lev), 6) AS mean_ret, round(avg((mae * lev < -0.8)::INT), 6) AS breach_rate FROM pth, (VALUES (-0.05::DOUBLE), (-0.2)) s(stop), (VALUES (1.0::DOUBLE), (3.0)) l(lev) WHERE ret IS NOT NULL GROUP BY ALL""")
def p17(spark, sf):
    from barspan.operators.features import forward_paths

    b = forward_paths(hourly(spark, sf), 12).filter("path_ret is not null")
    stress = spark.createDataFrame([(s, x) for s in (-0.05, -0.2) for x in (1.0, 3.0)], "stop double, leverage double")
    j = b.join(F.broadcast(stress), F.lit(True))
    cap = F.log1p("stop")
    r = F.when(F.col("mae") > cap, F.col("path_ret")).otherwise(cap) * F.col("leverage")
    return j.groupBy("symbol", "stop", "leverage").agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean_ret"), F.round(F.avg((F.col("mae") * F.col("leverage") < -0.8).cast("int")), 6).alias("breach_rate"))

