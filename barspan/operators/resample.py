"""Seeded resampling, block cross-validation and walk-forward selection.

Draws are md5 hashes of (seed, key, run, place), so that any engine gives the same ones and a
lost task draws again what it drew before.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import ranked


def draw(n: Column, *parts: Column) -> Column:
    """A hash draw from 0..n-1."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, n)


def indexed(values: DataFrame, keys: list[str], x: str, order: list[str], more: list[str] | None = None, span: int = 1 << 13) -> DataFrame:
    """keys, i (from 0), x, n and more columns: the values of each key in order, which begins with a number."""
    held = values.filter(F.col(x).isNotNull()).select(*keys, *order, x, *(more or []))
    return ranked(held, keys=keys, order=order, span=span).select(*keys, x, "i", "n", *(more or []))


def resample(values: DataFrame, *, keys: list[str], runs: int, seed: int, method: str = "iid", block: int = 5, restart: float = 0.2, label: str | None = None) -> DataFrame:
    """keys, run, pos, i: which value each run takes at each place.

    method: original; iid; shuffle (an order by hash); block (circular blocks); stationary
    (a new start with probability `restart`, else the next value); regime (a draw among values of
    the label at that place).
    """
    key = F.concat_ws("|", *keys)
    base = values.select(*keys, F.col("i").alias("pos"), "n", *([label] if label else [])).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    if method == "original":
        return base.select(*keys, "run", "pos", F.col("pos").alias("i"))
    if method == "iid":
        return base.select(*keys, "run", "pos", draw(F.col("n"), F.lit(seed), key, F.col("run"), F.col("pos")).alias("i"))
    if method == "shuffle":
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), key, F.col("run").cast("string"), F.col("pos").cast("string")).cast("binary"))
        return base.select(*keys, "run", F.col("pos").alias("i"), (F.row_number().over(Window.partitionBy(*keys, "run").orderBy(h)) - 1).alias("pos"))
    if method == "block":
        start = draw(F.col("n"), F.lit(seed), key, F.col("run"), F.floor(F.col("pos") / block))
        return base.select(*keys, "run", "pos", F.pmod(start + F.col("pos") % block, F.col("n")).alias("i"))
    if method == "stationary":
        fresh = (F.col("pos") == 0) | (draw(F.lit(1_000_000), F.lit(seed + 1), key, F.col("run"), F.col("pos")) < int(restart * 1_000_000))
        w = Window.partitionBy(*keys, "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        at = F.last(F.when(fresh, F.struct("pos", draw(F.col("n"), F.lit(seed), key, F.col("run"), F.col("pos")).alias("s"))), ignorenulls=True).over(w)
        return base.withColumn("_a", at).select(*keys, "run", "pos", F.pmod(F.col("_a.s") + F.col("pos") - F.col("_a.pos"), F.col("n")).alias("i"))
    if method == "regime":
        w = Window.partitionBy(*keys, label)
        ranked = values.select(*keys, label, "i", (F.row_number().over(w.orderBy("i")) - 1).alias("r"), F.count("*").over(w).alias("k"))
        asks = base.join(ranked.groupBy(*keys, label).agg(F.max("k").alias("k")), [*keys, label])
        asks = asks.select(*keys, label, "run", "pos", draw(F.col("k"), F.lit(seed), key, F.col("run"), F.col("pos")).alias("r"))
        return asks.join(ranked.select(*keys, label, "r", "i"), [*keys, label, "r"]).select(*keys, "run", "pos", "i")
    raise ValueError(method)


def drawn(values: DataFrame, picks: DataFrame, keys: list[str], x: str) -> DataFrame:
    return picks.join(values.select(*keys, "i", x), [*keys, "i"])


def block_sums(returns: DataFrame, *, strategy: list[str], order: str = "row_pos", x: str = "ret", blocks: int = 8, counted: bool = False) -> DataFrame:
    """Sufficient statistics of each strategy in consecutive blocks; the first n % blocks are one longer.

    counted: order holds the places already, gapless from 0, so that no window orders a strategy.
    """
    if counted:
        returns = returns.join(returns.groupBy(*strategy).agg(F.count("*").alias("_n")), strategy)
        n, place = F.col("_n"), F.col(order)
    else:
        w = Window.partitionBy(*strategy)
        n = F.count("*").over(w)
        place = F.row_number().over(w.orderBy(order)) - 1
    size, more = F.floor(n / blocks), n % blocks
    b = F.when(place < more * (size + 1), F.floor(place / (size + 1))).otherwise(more + F.floor((place - more * (size + 1)) / size))
    return returns.filter(F.col(x).isNotNull()).withColumn("block", b.cast("int")).groupBy(*strategy, "block").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"), F.sum(F.log(F.abs(1 + F.col(x)))).alias("g"), F.count_if(1 + F.col(x) <= 0).alias("neg"))


def cross_validate(sums: DataFrame, *, strategy: list[str], keys: list[str], blocks: int = 8, inside: int = 4) -> DataFrame:
    """For each choice of in-sample blocks: the best strategy there and its rank and Sharpe outside.

    Bars are read once: every choice adds up block sums.  Ties go to the first strategy.  oos_loss
    says that the compounded return outside is under 0; bars that lose more than all turn its sign.
    """
    spark = sums.sparkSession
    combos = spark.createDataFrame([(k, list(c)) for k, c in enumerate(combinations(range(blocks), inside))], "combo int, chosen array<int>")
    own = [c for c in strategy if c not in keys]
    j = sums.join(F.broadcast(combos), F.lit(True)).withColumn("inside", F.array_contains("chosen", F.col("block")))

    def sharpe(flag: bool) -> Column:
        at = lambda c: F.sum(F.when(F.col("inside") == flag, F.col(c)))
        n, s, q = at("n"), at("s"), at("q")
        sd = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
        return F.round(F.when(sd > 0, s / n / sd).otherwise(0.0), 9)

    outside = lambda c: F.sum(F.when(~F.col("inside"), F.col(c)))
    loss = (F.round(outside("g"), 9) < 0) | (outside("neg") % 2 == 1)
    m = j.groupBy(*keys, "combo", *own).agg(sharpe(True).alias("is_sharpe"), sharpe(False).alias("oos_sharpe"), loss.alias("oos_loss"))
    w = Window.partitionBy(*keys, "combo")
    ranked = m.withColumns({"_is": F.row_number().over(w.orderBy(F.desc("is_sharpe"), *own)), "oos_rank": F.row_number().over(w.orderBy(F.desc("oos_sharpe"), *own)), "strategies": F.count("*").over(w), "oos_median": F.percentile("oos_sharpe", 0.5).over(w)})
    return ranked.filter("_is = 1").drop("_is").withColumns({"below_median": F.col("oos_sharpe") <= F.col("oos_median")})


def walk_forward(returns: DataFrame, folds: DataFrame, *, keys: list[str], strategy: list[str], score: Column, least: int = 30) -> DataFrame:
    """The strategy with the best score in each fold and its return in the fold's test span.

    Bars meet the folds in one broadcast range join (the fold table is short); segments are
    scored by one aggregation; `score` reads train_* and validation_* mean, sd and n.  A fold in
    which no strategy has a score stays, with null strategy and score and a test_sum of 0.
    """
    j = returns.join(F.broadcast(folds), (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("d")))
    seg = F.when(F.col("ts") < F.col("b"), "train").when(F.col("ts") < F.col("c"), "validation").otherwise("test")
    j = j.withColumn("seg", seg)
    at = lambda s, f: f(F.when(F.col("seg") == s, F.col("ret")))
    aggs = [at(s, f).alias(f"{s}_{n}") for s in ("train", "validation", "test") for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("sum", F.sum))]
    m = j.groupBy(*keys, "fold", *strategy).agg(*aggs).filter((F.col("train_n") >= least) & (F.col("validation_n") > 1) & (F.col("test_n") > 0))
    w = Window.partitionBy(*keys, "fold").orderBy(F.desc_nulls_last("score"), *strategy)
    best = m.withColumn("score", score).filter("score is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    every = returns.select(*keys).distinct().join(F.broadcast(folds.select("fold")), F.lit(True))
    return every.join(best, [*keys, "fold"], "left").withColumn("test_sum", F.coalesce("test_sum", F.lit(0.0)))
