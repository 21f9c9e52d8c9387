"""Queries on walk-forward selection with drawdown and trade counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.operators import montecarlo as MC
from barspan.operators import positions as T
from barspan.operators import selection as W
from barspan.operators.store import keep

from .registry import query
from .resample_queries import D, GRID, grid_sql
from .tables import daily

COST = 0.0005
KEYS, STRATEGY = ["symbol"], ["short_ma", "long_ma"]
Q = "PARTITION BY symbol, fold, s, l, seg ORDER BY row_pos"
FOLDS = f"""WITH {D}, {grid_sql('days')}, sp AS (SELECT min(ts) AS lo, max(ts) AS hi FROM days), folds AS (SELECT f AS fold, lo + to_months(3 * f::INT) AS a, lo + to_months(3 * f::INT + 24) AS b, lo + to_months(3 * f::INT + 30) AS c, lo + to_months(3 * f::INT + 33) AS d FROM sp, range(400) t(f) WHERE lo + to_months(3 * f::INT + 33) <= hi),
tn AS (SELECT symbol, s, l, ts, row_pos, pos, ret, pos <> coalesce(lag(pos) OVER q, 0) AND pos <> 0 AS turn, abs(pos - coalesce(lag(pos) OVER q, 0)) AS tno FROM r WINDOW q AS (PARTITION BY symbol, s, l ORDER BY row_pos)),
sf AS (SELECT tn.*, fold, ts < b AS seg FROM tn JOIN folds ON ts >= a AND ts < c), eq AS (SELECT *, exp(sum(ln(greatest(1 + ret, 1e-300))) OVER ({Q})) AS eq FROM sf), dd AS (SELECT *, max(eq) OVER ({Q}) AS pk FROM eq),
mt AS (SELECT symbol, fold, s, l, seg, count(ret) AS n, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(252) END AS sharpe, arg_max(eq, row_pos) - 1 AS total, min(least(eq / pk, 1)) - 1 AS max_drawdown, count(*) FILTER (turn) + (arg_min(pos, row_pos) <> 0 AND NOT arg_min(turn, row_pos))::INT AS trades,
  CASE WHEN sum(ret) FILTER (ret < 0) < 0 THEN coalesce(sum(ret) FILTER (ret > 0), 0) / -sum(ret) FILTER (ret < 0) END AS pf FROM dd GROUP BY ALL),
pr AS (SELECT t.symbol, t.fold, t.s, t.l, t.n AS tn, v.n AS vn, coalesce(t.sharpe, -3) AS sa, coalesce(v.sharpe, -3) AS sb, t.sharpe AS ts, v.sharpe AS vs, t.total AS tt, v.max_drawdown AS vd, t.trades AS tr, v.trades AS vr, v.pf FROM mt t JOIN mt v ON v.symbol = t.symbol AND v.fold = t.fold AND v.s = t.s AND v.l = t.l AND t.seg AND NOT v.seg WHERE t.n > 100 AND v.n > 10),
sc AS (SELECT *, round(0.7 * sb + 0.3 * sa - 0.35 * greatest(0, abs(sa - sb) - 1) - 2 * abs(vd) - CASE WHEN tt < -0.02 THEN 0.5 ELSE 0 END + CASE WHEN pf > 0 THEN 0.1 * ln(least(pf, 5)) ELSE 0 END, 9) AS score FROM pr WHERE tr >= 8 AND vr >= 2),
ch AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY score DESC, s, l) = 1),
ot AS (SELECT tn.symbol, fold, s, l, ts, row_pos, pos, ret, tno, min(row_pos) OVER (PARTITION BY tn.symbol, fold, s, l) AS edge FROM tn JOIN folds ON ts >= c AND ts < d),
ob AS (SELECT ot.symbol, ot.fold, ot.ts, ot.row_pos, pos, ret + CASE WHEN ot.row_pos = edge THEN {COST} * (tno - abs(pos)) ELSE 0 END AS ret FROM ot JOIN ch ON ch.symbol = ot.symbol AND ch.fold = ot.fold AND ch.s = ot.s AND ch.l = ot.l
  UNION ALL SELECT symbol, fold, ts, row_pos, 0, 0 FROM (SELECT DISTINCT symbol, fold, ts, row_pos FROM ot) z WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.symbol = z.symbol AND ch.fold = z.fold)),
os AS (SELECT * FROM ob WHERE (symbol, fold) IN (SELECT (symbol, fold) FROM ob GROUP BY symbol, fold HAVING count(*) > 10))"""


def study(spark, sf):
    bars = daily(spark, sf)
    returns = keep(T.bar_returns(T.average_cross(bars, GRID), [*KEYS, *STRATEGY], cost=COST).select(*KEYS, *STRATEGY, "ts", "row_pos", "pos", "turnover", "ret"), "returns")
    folds = W.month_folds(bars)
    chosen = W.select_strategies(W.segment_metrics(returns, folds, keys=KEYS, strategy=STRATEGY, per_year=252), keys=KEYS, strategy=STRATEGY)
    return returns, folds, chosen


@query("r11_selected_folds", f"{FOLDS} SELECT symbol, fold, s AS short_ma, l AS long_ma, round(score, 6) AS score, round(ts, 6) AS train_sharpe, round(vs, 6) AS validation_sharpe, round(vd, 6) AS validation_drawdown, tr AS train_trades, vr AS validation_trades FROM ch")
def r11_folds(spark, sf):
    """The strategy that each fold chooses, by Sharpe ratios, stability, drawdown, profit factor and enough trades."""
    _, _, chosen = study(spark, sf)
    return chosen.select("symbol", "fold", "short_ma", "long_ma", *[F.round(c, 6).alias(n) for c, n in (("score", "score"), ("train_sharpe", "train_sharpe"), ("validation_sharpe", "validation_sharpe"), ("validation_max_drawdown", "validation_drawdown"))], "train_trades", "validation_trades")


@query("r11_out_of_sample", f"""{FOLDS}, e AS (SELECT *, exp(sum(ln(greatest(1 + ret, 1e-300))) OVER w) AS eq FROM os WINDOW w AS (PARTITION BY symbol ORDER BY row_pos ROWS UNBOUNDED PRECEDING)), k AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol ORDER BY row_pos ROWS UNBOUNDED PRECEDING), 1) AS pk FROM e),
f AS (SELECT symbol, fold, sum(ln(greatest(1 + ret, 1e-300))) AS g, max(abs(pos)) AS held FROM os GROUP BY ALL), fs AS (SELECT symbol, count(*) AS folds, count(*) FILTER (held > 0) AS traded, round(avg((g > 0)::INT), 6) AS positive_folds, round(min(exp(g) - 1), 6) AS worst_fold FROM f GROUP BY symbol)
SELECT k.symbol, count(*) AS bars, round(arg_max(eq, row_pos) - 1, 6) AS total, round(CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(252) END, 6) AS sharpe, round(min(eq / pk) - 1, 6) AS max_drawdown, any_value(folds) AS folds, any_value(traded) AS traded_folds, any_value(positive_folds) AS positive_folds, any_value(worst_fold) AS worst_fold FROM k JOIN fs USING (symbol) GROUP BY k.symbol""")
def r11_oos(spark, sf):
    """All test spans one after the other, each entered from flat: growth, Sharpe ratio, drawdown, and how stable the folds are."""
    returns, folds, chosen = study(spark, sf)
    oos = keep(W.out_of_sample(returns, folds, chosen, keys=KEYS, strategy=STRATEGY, cost=COST), "oos")
    sd = F.stddev_pop("ret")
    m = oos.groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.when(sd > 0, F.avg("ret") / sd * F.sqrt(F.lit(252))), 6).alias("sharpe"))
    p = MC.summarise_paths(oos, keys=KEYS, order="row_pos", x="ret").select("symbol", F.round(F.col("equity") - 1, 6).alias("total"), F.round(F.col("worst") - 1, 6).alias("max_drawdown"))
    per = oos.groupBy("symbol", "fold").agg((F.exp(F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(1e-300))))) - 1).alias("total"), F.max(F.abs("pos")).alias("held"))
    f = per.groupBy("symbol").agg(F.count("*").alias("folds"), F.count_if(F.col("held") > 0).alias("traded_folds"), F.round(F.avg((F.col("total") > 0).cast("int")), 6).alias("positive_folds"), F.round(F.min("total"), 6).alias("worst_fold"))
    return m.join(p, "symbol").join(f, "symbol")
