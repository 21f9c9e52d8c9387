"""Aggregated statistics of returns, events and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions import adjusted_kurtosis, adjusted_skew, profit_factor, ratio, share, t_stat

from .montecarlo import summarise_paths
from .scan import CHUNK, range_running, ranked, running


def moments(x: str, digits: int = 6) -> list[Column]:
    c = F.col(x)
    q = F.percentile(c, F.array(*[F.lit(p) for p in (0.01, 0.05, 0.5, 0.95, 0.99)]))
    named = {
        "n": F.count(c), "mean": F.avg(c), "var": F.var_samp(c), "std": F.stddev_samp(c), "skew": adjusted_skew(c), "kurtosis": adjusted_kurtosis(c), "min": F.min(c), "max": F.max(c),
        "q01": q[0], "q05": q[1], "median": q[2], "q95": q[3], "q99": q[4],
    }
    return [v.alias(k) if k == "n" else F.round(v, digits).alias(k) for k, v in named.items()]


def return_pack(x: str, digits: int = 6) -> list[Column]:
    """n, win rate, mean, median, 5 and 95 % quantiles and std, t statistic."""
    c = F.col(x)
    named = {"win_rate": share(c > 0), "mean": F.avg(c), "median": F.percentile(c, 0.5), "p05": F.percentile(c, 0.05), "p95": F.percentile(c, 0.95), "std": F.stddev_samp(c), "t": t_stat(c)}
    return [F.count(c).alias("n"), *[F.round(v, digits).alias(k) for k, v in named.items()]]


def tail_thresholds(df: DataFrame, x: str, levels: list[float], key: str = "symbol") -> DataFrame:
    """(key, side, level, threshold): lower and upper quantiles of every level."""
    lows = F.percentile(x, F.array(*[F.lit(p) for p in levels]))
    highs = F.percentile(x, F.array(*[F.lit(1 - p) for p in levels]))
    q = df.groupBy(key).agg(lows.alias("lows"), highs.alias("highs"))
    rows = [F.struct(F.lit(s).alias("side"), F.lit(p).alias("level"), F.col(f"{s}s")[k].alias("threshold")) for s in ("low", "high") for k, p in enumerate(levels)]
    return q.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def shock_events(df: DataFrame, x: str, levels: list[float], key: str = "symbol") -> DataFrame:
    """Rows beyond the tail thresholds of their key, once for each level that holds them."""
    limits = tail_thresholds(df, x, levels, key)
    beyond = F.when(F.col("side") == "low", F.col(x) <= F.col("threshold")).otherwise(F.col(x) >= F.col("threshold"))
    return df.join(limits, key).filter(beyond)


def max_drawdown(df: DataFrame, x: str, *, keys: list[str], order: str, kind: str = "additive", floor_at_start: bool = True) -> DataFrame:
    """Largest drawdown of each key, as a value <= 0.

    kind: additive (running sum of x) or compounded (running product of 1 + x, as a share; a
    factor of 0 or less is ruin, -1).  The start, 0 or 1, counts as a peak unless told otherwise.
    """
    step = F.coalesce(F.col(x), F.lit(0.0)) if kind == "additive" else F.when(1 + F.col(x) > 0, F.log1p(x)).otherwise(F.when(F.col(x).isNull(), 0.0))
    ruin = F.lit(False) if kind == "additive" else F.coalesce(1 + F.col(x) <= 0, F.lit(False))
    b = running(df.withColumn("_ruin", ruin), {"_eq": ("sum", step)}, keys=keys, order=order)
    b = running(b, {"_peak": ("max", F.col("_eq"))}, keys=keys, order=order)
    peak = F.greatest("_peak", F.lit(0.0)) if floor_at_start else F.col("_peak")
    fall = F.col("_eq") - peak
    out = b.groupBy(*keys).agg(F.min(fall).alias("_fall"), F.bool_or("_ruin").alias("_ruin"))
    value = F.col("_fall") if kind == "additive" else F.when(F.col("_ruin"), -1.0).otherwise(F.exp("_fall") - 1)
    return out.select(*keys, value.alias("max_drawdown"))


def drawdown_anatomy(df: DataFrame, x: str, *, keys: list[str], order: str) -> DataFrame:
    """The deepest fall of each key's compounded log returns x: its peak and trough (places), depth, worst step inside it and that step's share, longest time under a peak and whether it is still under.

    Peaks carry their place along the scan, so the fall is known with no second pass over the key;
    the start counts as a peak before the first row.  Of equal falls the first counts.
    """
    place = F.col(order)
    b = running(df.filter(F.col(x).isNotNull()), {"_eq": ("sum", F.col(x))}, keys=keys, order=order)
    b = running(b, {"_peak": ("max", F.struct(F.col("_eq").alias("eq"), (-place).alias("at")))}, keys=keys, order=order)
    under_start = F.col("_peak.eq") < 0
    top, since = F.when(under_start, 0.0).otherwise(F.col("_peak.eq")), F.when(under_start, F.lit(-1).cast("bigint")).otherwise(-F.col("_peak.at"))
    b = b.withColumns({"_fall": F.col("_eq") - top, "_since": since.cast("bigint")})
    deepest = F.min(F.struct("_fall", place.alias("trough"), F.col("_since").alias("peak")))
    g = b.groupBy(*keys).agg(deepest.alias("d"), F.max(place - F.col("_since")).alias("under"), F.max_by(F.col("_eq") < top, place).alias("still_under"))
    g = g.select(*keys, F.col("d.peak").alias("peak"), F.col("d.trough").alias("trough"), F.col("d._fall").alias("fall"), "under", "still_under").filter("fall < 0")
    inside = df.join(g, keys).filter((place > F.col("peak")) & (place <= F.col("trough")) & F.col(x).isNotNull())
    worst = inside.groupBy(*keys).agg(F.min(F.struct(F.col(x).alias("step"), place.alias("at"))).alias("w"))
    out = g.join(worst, keys)
    return out.select(*keys, "peak", "trough", (F.exp("fall") - 1).alias("depth"), F.col("w.at").alias("worst_at"), (F.exp("w.step") - 1).alias("worst_step"), (F.col("w.step") / F.col("fall")).alias("worst_share"), "under", "still_under")


def average_ranks(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Add the average-tie rank of x in its key; distinct values are counted first, then summed over ranges of them."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    upto = range_running(counts, keys=keys, order=[x], x=F.col("_c"), out="_upto")
    return df.join(upto.select(*keys, x, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out)), [*keys, x], "left")


def trade_pack(pnl: str, digits: int = 6, variant: str = "a") -> list[Column]:
    c = F.col(pnl)
    win, loss = F.avg(F.when(c > 0, c)), F.avg(F.when(c < 0, c))
    named = {"total": F.sum(c), "win_rate": share(c > 0), "profit_factor": profit_factor(c, variant), "avg_win": win, "avg_loss": loss, "payoff": ratio(win, -loss), "median": F.percentile(c, 0.5), "best": F.max(c), "worst": F.min(c), "skew": adjusted_skew(c)}
    return [F.count(c).alias("trades"), *[F.round(v, digits).alias(k) for k, v in named.items()]]


def top_contribution(trades: DataFrame, pnl: str, *, keys: list[str], tie: list[str], tops: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of all wins that the largest 1, 3 and 5 hold, and the total without them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(pnl), *tie))
    ranked = trades.withColumn("_n", place)
    c = F.col(pnl)
    wins = F.sum(F.when(c > 0, c))
    cols = []
    for k in tops:
        cols += [F.round(100 * ratio(F.sum(F.when((F.col("_n") <= k) & (c > 0), c)), wins), 6).alias(f"top{k}_pct"), F.round(F.sum(F.when(~((F.col("_n") <= k) & (c > 0)), c)), 6).alias(f"without_top{k}")]
    return ranked.groupBy(*keys).agg(*cols)


def top_percent(trades: DataFrame, pnl: str, *, keys: list[str], tie: list[str], percents: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Share of all wins that the largest ceil(p %) of them hold, their number, and the total without them."""
    wins = trades.filter(F.col(pnl) > 0).withColumn("_down", -F.col(pnl))
    placed = range_running(wins, keys=keys, order=["_down", *tie], x=F.lit(1), out="_k")
    n = wins.groupBy(*keys).agg(F.count("*").alias("_wins"), F.sum(pnl).alias("_all"))
    least = lambda p: F.ceil(F.col("_wins") * p / 100)
    tops = [F.sum(F.when(F.col("_k") <= least(p), F.col(pnl))).alias(f"_top{p}") for p in percents]
    best = placed.join(n, keys).groupBy(*keys, "_wins", "_all").agg(*tops)
    total = trades.groupBy(*keys).agg(F.sum(pnl).alias("_total")).join(best, keys, "left")
    cols = []
    for p in percents:
        cols += [F.coalesce(least(p), F.lit(0)).cast("bigint").alias(f"top{p}_trades"), F.round(100 * ratio(F.col(f"_top{p}"), F.col("_all")), 6).alias(f"top{p}_pct"), F.round(F.col("_total") - F.coalesce(F.col(f"_top{p}"), F.lit(0.0)), 6).alias(f"without_top{p}")]
    return total.select(*keys, *cols)


def event_pack(events: DataFrame, x: str, *, keys: list[str], order: str, mae: str, mfe: str, digits: int = 6) -> DataFrame:
    """The whole pack of an event group: n, mean, median, win rate, profit factor, t, mean excursions, value at risk and shortfall at 5 %, growth and drawdown of taking one event after the other."""
    c, at = F.col(x), lambda v, n: F.round(v, digits).alias(n)
    q = events.groupBy(*keys).agg(F.percentile(x, 0.05).alias("_q"))
    pack = events.join(q, keys).groupBy(*keys).agg(
        F.count(c).alias("n"), at(F.avg(c), "mean"), at(F.percentile(c, 0.5), "median"), at(share(c > 0), "win_rate"), at(profit_factor(c), "profit_factor"), at(t_stat(c), "t"),
        at(F.avg(mae), "mae"), at(F.avg(mfe), "mfe"), at(F.first("_q"), "var5"), at(F.avg(F.when(c <= F.col("_q"), c)), "es5"),
    )
    paths = summarise_paths(ranked(events.select(*keys, order, x), keys=keys, order=[order], span=CHUNK), keys=keys, order="i", x=x)
    return pack.join(paths.select(*keys, at(F.col("equity") - 1, "growth"), at(F.col("worst") - 1, "max_drawdown"), F.col("streak").alias("losing_streak")), keys)


def sharpe(x: str, per_year: float | Column, variant: str = "zero") -> Column:
    """Annualised Sharpe: zero (sample sd, 0 where sd is 0), null (sample sd, null), population (population sd, null)."""
    sd = F.stddev_pop(x) if variant == "population" else F.stddev_samp(x)
    value = F.avg(x) / F.when(sd > 0, sd) * F.sqrt(per_year if isinstance(per_year, Column) else F.lit(float(per_year)))
    return F.coalesce(value, F.lit(0.0)) if variant == "zero" else value


def compounded(x: str) -> Column:
    return F.exp(F.sum(F.log1p(x))) - 1


def value_at_risk(df: DataFrame, x: str, levels: tuple[float, ...] = (0.05, 0.01), *, keys: list[str]) -> DataFrame:
    """Value at risk and expected shortfall at each level."""
    q = df.groupBy(*keys).agg(*[F.percentile(x, p).alias(f"var{int(p * 100)}") for p in levels])
    tails = [F.avg(F.when(F.col(x) <= F.col(f"var{int(p * 100)}"), F.col(x))).alias(f"es{int(p * 100)}") for p in levels]
    return df.join(q, keys).groupBy(*keys, *[f"var{int(p * 100)}" for p in levels]).agg(*tails)


def interaction_ols(df: DataFrame, y: str, a: Column, b: Column, *, keys: list[str], least: int = 12) -> DataFrame:
    """Classical OLS of y on 1, a, b and a*b for 0/1 regressors, from the four cells' sums.

    The model is saturated: coefficients are contrasts of cell means, the residual variance is
    pooled within cells.  Terms that an empty cell leaves unidentified are null; fewer than
    `least` rows give no result.
    """
    cell = a.cast("int") * 2 + b.cast("int")
    c = df.filter(F.col(y).isNotNull()).withColumn("_cell", cell).groupBy(*keys, "_cell").agg(F.count("*").alias("n"), F.avg(y).alias("m"), (F.var_pop(y) * F.count("*")).alias("ss"))
    pick = lambda k, x: F.max(F.when(F.col("_cell") == k, F.col(x)))
    g = c.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("ss").alias("sse"), *[pick(k, x).alias(f"{x}{k}") for k in range(4) for x in ("n", "m")]).filter(F.col("n") >= least)
    s2 = F.col("sse") / (F.col("n") - 4)
    inv = lambda *ks: sum((1 / F.col(f"n{k}") for k in ks[1:]), 1 / F.col(f"n{ks[0]}"))
    m = [F.col(f"m{k}") for k in range(4)]
    terms = [("intercept", m[0], inv(0)), ("a", m[2] - m[0], inv(0, 2)), ("b", m[1] - m[0], inv(0, 1)), ("a_x_b", m[3] - m[2] - m[1] + m[0], inv(0, 1, 2, 3))]
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), c.alias("coef"), F.sqrt(s2 * v).alias("se")) for t, c, v in terms])).alias("r")
    return g.select(*keys, "n", rows).select(*keys, "n", "r.*").withColumn("t", ratio(F.col("coef"), F.col("se")))


def kelly(p: Column, win: Column, loss: Column, *, cost: float, cap: float, equity: float, stop: float, step: float) -> dict[str, Column]:
    """Kelly sizing: payoff after cost, full and capped fraction, loss budget, largest quantity in whole steps."""
    payoff = ratio(win - cost, loss + cost)
    full = p - ratio(1 - p, payoff)
    used = F.greatest(F.least(full, F.lit(cap)), F.lit(0.0))
    budget = used * equity
    return {"payoff": payoff, "kelly": full, "fraction": used, "budget": budget, "quantity": F.floor(budget / stop / step) * step}
