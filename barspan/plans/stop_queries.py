"""Queries on strategies with stops: candidates, cross-validation of the whole grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.operators import montecarlo as MC
from barspan.operators import resample as R
from barspan.operators import stops as X

from .registry import query
from .study_queries import path_sql
from .tables import hourly, hourly_sql

SHORTS, LONGS, STOPS, TARGETS = [5, 10, 20, 30], [50, 100, 150, 200], [None, 1.0, 1.5], [None, 1.5, 2.0]
GRID = X.average_strategies(SHORTS, LONGS, STOPS, TARGETS)
SIDE_COST, YEAR_BARS = 0.05, 24 * 252
P = "PARTITION BY symbol ORDER BY row_pos"


def _values(items: list) -> str:
    return ", ".join("(NULL::DOUBLE)" if v is None else f"({v}::DOUBLE)" for v in items)


_ma = lambda n: f'CASE WHEN row_pos >= {n} THEN avg("close") OVER ({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END'
#: One step a bar: close if another side is wanted, open, look for the touch, and take the bar's return.
STOPPED = f"""WITH RECURSIVE {hourly_sql()}, tr AS (SELECT *, greatest(high - low, abs(high - lag("close") OVER ({P})), abs(low - lag("close") OVER ({P}))) AS tr FROM bars),
m AS (SELECT symbol, row_pos, open, high, low, lead(open) OVER ({P}) AS nxt, lead(open, 2) OVER ({P}) IS NULL AS final, CASE WHEN row_pos >= 14 THEN avg(tr) OVER ({P} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS atr, {', '.join(f'{_ma(n)} AS m{n}' for n in SHORTS + LONGS)} FROM tr),
x AS MATERIALIZED (SELECT symbol, row_pos, open, high, low, nxt, final, atr, [{', '.join(f'coalesce(sign(m{a} - m{b})::INT, 0)' for a in SHORTS for b in LONGS)}] AS wants FROM m WHERE nxt IS NOT NULL),
st AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY pair, sl NULLS FIRST, tp NULLS FIRST) - 1)::INT AS strategy, pair, sl, tp, sl IS NOT NULL OR tp IS NOT NULL AS needs FROM range({len(SHORTS) * len(LONGS)}) q(pair), (VALUES {_values(STOPS)}) a(sl), (VALUES {_values(TARGETS)}) b(tp)),
s AS (SELECT DISTINCT symbol, strategy, pair, sl, tp, needs, -1::BIGINT AS row_pos, 0 AS pos, NULL::DOUBLE AS stop, NULL::DOUBLE AS target, NULL::DOUBLE AS ret FROM x, st
UNION ALL SELECT symbol, strategy, pair, sl, tp, needs, row_pos, CASE WHEN px IS NULL THEN p1 ELSE 0 END, s1, t1,
  -shut - CASE WHEN opened THEN {SIDE_COST} / open ELSE 0 END + CASE WHEN p1 = 0 THEN 0 WHEN px IS NULL THEN p1 * (nxt - open) / open ELSE p1 * (px - open) / open - {SIDE_COST} / greatest(abs(px), 1e-12) END - CASE WHEN final AND px IS NULL AND p1 <> 0 THEN {SIDE_COST} / nxt ELSE 0 END
FROM (SELECT *, CASE WHEN p1 <> 0 THEN CASE WHEN CASE p1 WHEN 1 THEN low <= s1 ELSE high >= s1 END THEN s1 WHEN CASE p1 WHEN 1 THEN high >= t1 ELSE low <= t1 END THEN t1 END END AS px
FROM (SELECT *, CASE WHEN opened THEN open - want * sl * atr ELSE stop END AS s1, CASE WHEN opened THEN open + want * tp * atr ELSE target END AS t1
FROM (SELECT *, CASE WHEN pos <> 0 AND want <> pos THEN {SIDE_COST} / open ELSE 0 END AS shut, want <> pos AND want <> 0 AND (NOT needs OR atr IS NOT NULL) AS opened, CASE WHEN want = pos THEN pos WHEN want <> 0 AND (NOT needs OR atr IS NOT NULL) THEN want ELSE 0 END AS p1
FROM (SELECT s.symbol, strategy, pair, sl, tp, needs, s.pos, s.stop, s.target, x.row_pos, x.open, x.high, x.low, x.nxt, x.final, x.atr, x.wants[s.pair + 1] AS want FROM s JOIN x ON x.symbol = s.symbol AND x.row_pos = s.row_pos + 1))))),
r AS MATERIALIZED (SELECT symbol, strategy, row_pos, ret FROM s WHERE row_pos >= 0)"""


def stopped(spark, sf):
    return X.stopped_returns(hourly(spark, sf), GRID, cost=SIDE_COST)


@query("j10_strategy_candidates", f"""{STOPPED}, p AS {path_sql('symbol, strategy', '(SELECT symbol, strategy, row_pos AS pos, ret AS net FROM r)')},
k AS (SELECT symbol, strategy, count(*) AS bars, round(coalesce(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) END, 0) * sqrt({YEAR_BARS}), 6) AS sharpe, round(CASE WHEN sum(ret) FILTER (ret < 0) < 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / -sum(ret) FILTER (ret < 0) WHEN sum(ret) FILTER (ret > 0) > 0 THEN 'inf'::DOUBLE END, 6) AS profit_factor FROM r GROUP BY ALL)
SELECT k.symbol, short_ma, long_ma, sl AS stop, tp AS target, bars, sharpe, round((equity - 1) * 100, 4) AS final, round((worst - 1) * 100, 4) AS max_drawdown, profit_factor, row_number() OVER (PARTITION BY k.symbol ORDER BY sharpe DESC, k.strategy) AS place
FROM k JOIN p USING (symbol, strategy) JOIN (SELECT strategy, [{', '.join(str(a) for a in SHORTS for _ in LONGS)}][pair + 1] AS short_ma, [{', '.join(str(b) for _ in SHORTS for b in LONGS)}][pair + 1] AS long_ma, sl, tp FROM st) USING (strategy)""")
def j10_candidates(spark, sf):
    """The whole product of averages, stops and targets, backtested: Sharpe ratio, growth, drawdown, profit factor and place."""
    from pyspark.sql import Window

    from barspan.functions import profit_factor

    r = stopped(spark, sf)
    sd = F.stddev_samp("ret")
    k = r.groupBy("symbol", "strategy").agg(F.count("*").alias("bars"), F.round(F.coalesce(F.when(sd > 0, F.avg("ret") / sd), F.lit(0.0)) * F.sqrt(F.lit(YEAR_BARS)), 6).alias("sharpe"), F.round(profit_factor(F.col("ret")), 6).alias("profit_factor"))
    paths = MC.summarise_paths(r, keys=["symbol", "strategy"], order="row_pos", x="ret").select("symbol", "strategy", F.round((F.col("equity") - 1) * 100, 4).alias("final"), F.round((F.col("worst") - 1) * 100, 4).alias("max_drawdown"))
    named = F.broadcast(X.described(spark, GRID))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("sharpe"), "strategy"))
    return k.join(paths, ["symbol", "strategy"]).withColumn("place", place).join(named, "strategy").drop("strategy")


SELECTED = f"""{STOPPED}, nb AS (SELECT *, count(*) OVER (PARTITION BY symbol, strategy) AS n FROM r), bl AS (SELECT *, CASE WHEN row_pos < (n % 8) * (n // 8 + 1) THEN row_pos // (n // 8 + 1) ELSE n % 8 + (row_pos - (n % 8) * (n // 8 + 1)) // (n // 8) END AS block FROM nb),
combos AS (SELECT row_number() OVER (ORDER BY ch) - 1 AS combo, ch FROM (SELECT [a.x, b.x, c.x, d.x] AS ch FROM range(8) a(x), range(8) b(x), range(8) c(x), range(8) d(x) WHERE a.x < b.x AND b.x < c.x AND c.x < d.x)),
bs AS MATERIALIZED (SELECT symbol, strategy, block, count(*) AS n, sum(ret) AS x, sum(ret * ret) AS q, sum(ln(nullif(abs(1 + ret), 0))) AS g, count(*) FILTER (1 + ret <= 0) AS neg FROM bl GROUP BY ALL),
h AS (SELECT symbol, combo, strategy, list_contains(ch, block) AS inside, sum(n) AS n, sum(x) AS x, sum(q) AS q, sum(g) AS g, sum(neg) AS neg FROM bs, combos GROUP BY ALL), sr AS (SELECT *, round(CASE WHEN q - x * x / n > 0 THEN x / n / sqrt((q - x * x / n) / (n - 1)) ELSE 0 END, 9) AS sharpe FROM h),
g AS (SELECT symbol, combo, strategy, max(sharpe) FILTER (inside) AS i, max(sharpe) FILTER (NOT inside) AS o, bool_or(NOT inside AND (round(g, 9) < 0 OR neg % 2 = 1)) AS oos_loss FROM sr GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, combo ORDER BY i DESC, strategy) AS ir, row_number() OVER (PARTITION BY symbol, combo ORDER BY o DESC, strategy) AS orank, quantile_cont(o, 0.5) OVER (PARTITION BY symbol, combo) AS med FROM g)
SELECT symbol, count(*) AS combinations, round(avg((o <= med)::INT), 6) AS overfit_probability, round(avg(oos_loss::INT), 6) AS loss_probability, round(avg(i), 6) AS mean_is, round(avg(o), 6) AS mean_oos, round(quantile_cont(o, 0.5), 6) AS median_oos, round(avg(orank), 6) AS mean_rank FROM k WHERE ir = 1 GROUP BY symbol"""


@query("r09_overfit_stops", SELECTED)
def r09_stops(spark, sf):
    """144 strategies with stops by 70 choices of 4 of 8 blocks: how often the best inside is at or under the median outside, or loses there."""
    sums = R.block_sums(stopped(spark, sf), strategy=["symbol", "strategy"], counted=True)
    best = R.cross_validate(sums, strategy=["symbol", "strategy"], keys=["symbol"])
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    mean = lambda c: F.round(F.avg(c), 6)
    return best.groupBy("symbol").agg(F.count("*").alias("combinations"), rate("below_median").alias("overfit_probability"), rate("oos_loss").alias("loss_probability"), mean("is_sharpe").alias("mean_is"), mean("oos_sharpe").alias("mean_oos"), F.round(F.percentile("oos_sharpe", 0.5), 6).alias("median_oos"), mean("oos_rank").alias("mean_rank"))
