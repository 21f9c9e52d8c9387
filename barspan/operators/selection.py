"""Walk-forward selection: folds from the data, scores with drawdown and trade counts, out-of-sample paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .montecarlo import summarise_paths
from .scan import rolling


def month_folds(bars: DataFrame, *, train: int = 24, validation: int = 6, test: int = 3, expanding: bool = False) -> DataFrame:
    """fold, a, b, c, d: train from a, validation from b, test from c to d, each step `test` months on, while d is not past the last bar.

    One row per fold, from the first and last time alone.  expanding: every training begins at the first bar.
    """
    span = bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    steps = F.greatest(F.floor(F.months_between("hi", "lo") / test), F.lit(0)).cast("int")
    folds = span.filter("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), steps)).alias("fold"))
    # Months are added to the first day as a date; its time of day is kept.
    at = lambda m: (F.add_months(F.to_date("lo"), m).cast("timestamp").cast("double") + F.col("lo").cast("double") - F.to_date("lo").cast("timestamp").cast("double")).cast("timestamp")
    k = F.col("fold") * test
    out = folds.select(F.col("fold").cast("bigint").alias("fold"), (F.col("lo") if expanding else at(k)).alias("a"), at(k + train).alias("b"), at(k + train + validation).alias("c"), at(k + train + validation + test).alias("d"), "hi")
    return out.filter("d <= hi").drop("hi")


def _turns(returns: DataFrame, keys: list[str]) -> DataFrame:
    return rolling(returns, {"_turn": lambda w: (F.col("pos") != F.coalesce(F.lag("pos").over(w), F.lit(0))) & (F.col("pos") != 0)}, back=1, key=keys)


def segment_metrics(returns: DataFrame, folds: DataFrame, *, keys: list[str], strategy: list[str], per_year: float) -> DataFrame:
    """Per fold, strategy and segment: n, total, sharpe (population deviation), max_drawdown, trades, profit_factor.

    Bars meet the short fold table in one broadcast range join.  A position held into a segment
    counts as a trade there.  returns: keys, strategy, ts, row_pos, pos, ret.
    """
    j = _turns(returns, [*keys, *strategy]).join(F.broadcast(folds), (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("c")))
    j = j.withColumn("segment", F.when(F.col("ts") < F.col("b"), "train").otherwise("validation"))
    by = [*keys, "fold", *strategy, "segment"]
    r, sd = F.col("ret"), F.stddev_pop("ret")
    first = F.min_by(F.struct("pos", "_turn"), "row_pos")
    wins, losses = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), -F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0))
    m = j.groupBy(*by).agg(F.count(r).alias("n"), F.when(sd > 0, F.avg(r) / sd * per_year**0.5).alias("sharpe"), F.count_if("_turn").alias("_turns"), first.alias("_first"), F.when(losses > 0, wins / losses).alias("profit_factor"))
    held = ((F.col("_first.pos") != 0) & ~F.col("_first._turn")).cast("bigint")
    paths = summarise_paths(j, keys=by, order="row_pos", x="ret", start_is_peak=False)
    return m.withColumn("trades", F.col("_turns") + held).drop("_turns", "_first").join(paths.select(*by, (F.col("equity") - 1).alias("total"), (F.col("worst") - 1).alias("max_drawdown")), by)


def selection_score(train: dict[str, Column], validation: dict[str, Column], *, least_train: int = 8, least_validation: int = 2) -> Column:
    """Validation first: 0.7 and 0.3 of the Sharpe ratios (-3 where unknown), less instability, twice the validation drawdown and a bad training, plus a little of the profit factor; null with too few trades."""
    a, b = (F.coalesce(x["sharpe"], F.lit(-3.0)) for x in (train, validation))
    score = 0.7 * b + 0.3 * a - 0.35 * F.greatest(F.lit(0.0), F.abs(a - b) - 1) - 2 * F.abs(validation["max_drawdown"])
    score = score - F.when(train["total"] < -0.02, 0.5).otherwise(0.0)
    pf = validation["profit_factor"]
    score = score + F.when(pf > 0, 0.1 * F.log(F.least(pf, F.lit(5.0)))).otherwise(0.0)
    return F.when((train["trades"] >= least_train) & (validation["trades"] >= least_validation), score)


def select_strategies(metrics: DataFrame, *, keys: list[str], strategy: list[str], digits: int = 9) -> DataFrame:
    """The best strategy of each fold, its score and both segments' metrics; folds without a score have none.  Of equal scores the first strategy counts."""
    names = ["n", "sharpe", "total", "max_drawdown", "trades", "profit_factor"]
    by = [*keys, "fold", *strategy]
    at = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c))).alias(f"{s}_{c}")
    wide = metrics.groupBy(*by).agg(*[at(s, c) for s in ("train", "validation") for c in names]).filter("train_n > 100 and validation_n > 10")
    of = lambda s: {c: F.col(f"{s}_{c}") for c in names}
    scored = wide.withColumn("score", F.round(selection_score(of("train"), of("validation")), digits)).filter("score is not null")
    place = F.row_number().over(Window.partitionBy(*keys, "fold").orderBy(F.desc("score"), *strategy))
    return scored.withColumn("_n", place).filter("_n = 1").drop("_n")


def out_of_sample(returns: DataFrame, folds: DataFrame, chosen: DataFrame, *, keys: list[str], strategy: list[str], cost: float, least: int = 10) -> DataFrame:
    """Bars of all test spans in time: keys, fold, ts, row_pos, pos, ret of the chosen strategy, entered from flat at each fold's first bar; folds without one are flat.  Folds with at most `least` test bars are left out."""
    j = returns.join(F.broadcast(folds.select("fold", "c", "d")), (F.col("ts") >= F.col("c")) & (F.col("ts") < F.col("d")))
    picked = chosen.select(*keys, "fold", *strategy, F.lit(True).alias("_own"))
    own = j.join(picked, [*keys, "fold", *strategy])
    # Folds without a choice: the bars of any one strategy, flat.
    every = j.groupBy(*keys, "fold", "ts", "row_pos").agg(F.lit(0).alias("pos"), F.lit(0.0).alias("ret"))
    none = every.join(picked.select(*keys, "fold"), [*keys, "fold"], "anti")
    edge = own.groupBy(*keys, "fold").agg(F.min("row_pos").alias("_edge"))
    own = own.join(edge, [*keys, "fold"])
    # What the series paid to turn into its first bar is paid anew, from flat.
    paid = F.when(F.col("row_pos") == F.col("_edge"), cost * (F.col("turnover") - F.abs("pos"))).otherwise(0.0)
    both = own.select(*keys, "fold", "ts", "row_pos", F.col("pos").cast("int").alias("pos"), (F.col("ret") + paid).alias("ret")).unionByName(none.select(*keys, "fold", "ts", "row_pos", "pos", "ret"))
    enough = both.groupBy(*keys, "fold").agg(F.count("*").alias("_n")).filter(F.col("_n") > least).drop("_n")
    return both.join(enough, [*keys, "fold"], "semi")
