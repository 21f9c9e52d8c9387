"""What resampled runs come to: growth, drawdown and losing streaks of whole paths.

A path's summary is associative, so blocks of places are summed up on their own and merged, and no
window orders a run.  A group whose values fit an array (`most` of them) is drawn and summed up
inside tasks of some runs each: only one row a run leaves.  Larger groups meet their draws in a join
and are summed up by block.  Both draw alike, by a 32-bit mix of (group, run, place) that other
engines can compute too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import ranked
from .store import repeated

# Multipliers and shifts of a public 32-bit mixing function, and the golden ratio.
FIRST, SECOND, GOLDEN, MASK = 0x21F0AAAD, 0x735A2D97, 0x9E3779B1, 0xFFFFFFFF

METHODS = ("original", "shuffle", "iid", "block", "stationary", "regime")


def mix(x: Column) -> Column:
    """Mix 32 bits held in a long; no product passes 63 bits."""
    low = F.lit(MASK)
    x = (x.bitwiseXOR(F.shiftright(x, 16)) * FIRST).bitwiseAND(low)
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * SECOND).bitwiseAND(low)
    return x.bitwiseXOR(F.shiftright(x, 15))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(FIRST)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(SECOND)
    return x ^ (x >> np.uint32(15))


def base_of(seed: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _draws(seed: str, key: str, runs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One row a run, one column a place, of 32-bit numbers."""
    base = np.uint32(int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16))
    of_run = mixed(base ^ mixed(runs.astype(np.uint32)))
    return mixed(of_run[:, None] + places.astype(np.uint32)[None, :] * np.uint32(GOLDEN))


def _picks(method: str, seed: str, key: str, runs: np.ndarray, n: int, block: int, restart: float, labels: np.ndarray) -> np.ndarray:
    """The index of the value at each place of each run."""
    place, size = np.arange(n), np.uint32(n)
    if method == "original":
        return np.broadcast_to(place, (len(runs), n))
    if method == "block":
        starts = _draws(f"{seed}|block", key, runs, np.arange(-(-n // block))) % size
        return (np.repeat(starts, block, axis=1)[:, :n].astype(np.int64) + place % block) % n
    drawn = _draws(f"{seed}|{method}", key, runs, place)
    if method == "shuffle":
        return np.argsort(drawn, axis=1, kind="stable")
    if method == "iid":
        return drawn % size
    if method == "stationary":
        fresh = _draws(f"{seed}|restart", key, runs, place) % np.uint32(1_000_000) < np.uint32(int(restart * 1_000_000))
        fresh[:, 0] = True
        at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
        return (np.take_along_axis((drawn % size).astype(np.int64), at, axis=1) + place - at) % n
    if method == "regime":
        order = np.argsort(labels, kind="stable")
        kinds, starts, counts = np.unique(labels[order], return_index=True, return_counts=True)
        own = np.searchsorted(kinds, labels)
        return order[starts[own] + drawn % counts[own].astype(np.uint32)]
    raise ValueError(method)


def _paths(x: np.ndarray) -> dict[str, np.ndarray]:
    """Summary of each row of net returns."""
    factor = np.maximum(1 + x, 0)
    equity = np.cumprod(factor, axis=1)
    peak = np.maximum.accumulate(np.maximum(equity, 1), axis=1)
    place = np.arange(x.shape[1])
    last_gain = np.maximum.accumulate(np.where(x < 0, -1, place), axis=1)
    return {"equity": equity[:, -1], "worst": np.minimum((equity / peak).min(axis=1), 1), "streak": (place - last_gain).max(axis=1), "ruined": (1 + x <= 0).any(axis=1)}


STATE = "struct<prod:double,high:double,low:double,worst:double,lead:bigint,tail:bigint,streak:bigint,n:bigint,ruined:boolean>"


def path_of(net: Column, start_is_peak: bool = True) -> Column:
    """Summary of one sorted array of net returns: growth, highest and lowest point, worst share of a peak (of which the start is one on demand), losing runs at both ends and longest, count, ruin."""
    zero = F.struct(F.lit(1.0).alias("prod"), F.lit(1.0 if start_is_peak else 0.0).alias("high"), F.lit(float("inf")).alias("low"), F.lit(1.0).alias("worst"), *[F.lit(0).cast("bigint").alias(c) for c in ("lead", "tail", "streak", "n")], F.lit(False).alias("ruined"))

    def step(s: Column, x: Column) -> Column:
        prod = s["prod"] * F.greatest(1 + x, F.lit(0.0))
        high, loss = F.greatest(s["high"], prod), x < 0
        tail = F.when(loss, s["tail"] + 1).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            prod.alias("prod"), high.alias("high"), F.least(s["low"], prod).alias("low"), F.least(s["worst"], F.coalesce(prod / F.nullif(high, F.lit(0.0)), F.lit(0.0))).alias("worst"),
            F.when(loss & (s["lead"] == s["n"]), s["lead"] + 1).otherwise(s["lead"]).alias("lead"), tail.alias("tail"),
            F.greatest(s["streak"], tail).alias("streak"), (s["n"] + 1).alias("n"), (s["ruined"] | (1 + x <= 0)).alias("ruined"),
        )

    return F.aggregate(net, zero, step)


def then(a: Column, b: Column) -> Column:
    """The summary of path a followed by path b."""
    return F.struct(
        (a["prod"] * b["prod"]).alias("prod"), F.greatest(a["high"], a["prod"] * b["high"]).alias("high"), F.least(a["low"], a["prod"] * b["low"]).alias("low"),
        F.least(a["worst"], b["worst"], F.coalesce(a["prod"] * b["low"] / F.nullif(a["high"], F.lit(0.0)), F.lit(0.0))).alias("worst"),
        F.when(a["lead"] == a["n"], a["n"] + b["lead"]).otherwise(a["lead"]).alias("lead"), F.when(b["tail"] == b["n"], a["tail"] + b["n"]).otherwise(b["tail"]).alias("tail"),
        F.greatest(a["streak"], b["streak"], a["tail"] + b["lead"]).alias("streak"), (a["n"] + b["n"]).alias("n"), (a["ruined"] | b["ruined"]).alias("ruined"),
    )


def summarise_paths(rows: DataFrame, *, keys: list[str], order: str, x: str, block: int = 2048, start_is_peak: bool = True) -> DataFrame:
    """equity, worst, streak, ruined and n of each key's path of net returns x in `order` (whole numbers).

    Blocks of places are folded on their own, then their summaries merged in order: a task holds
    one block, or one row per block of a key.  Keys without rows have none.
    """
    blocks = rows.groupBy(*keys, F.floor(F.col(order) / block).alias("_b")).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(x).cast("double").alias("x")))).alias("xs"))
    summed = blocks.select(*keys, "_b", path_of(F.transform("xs", lambda r: r["x"]), start_is_peak).alias("s"))
    parts = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "s"))).alias("parts"))
    first, rest = F.element_at("parts", 1)["s"], F.slice("parts", F.lit(2), F.size("parts"))
    whole = F.aggregate(rest, first.cast(STATE), lambda s, p: then(s, p["s"]).cast(STATE))
    return parts.withColumn("s", whole).select(*keys, F.col("s.prod").alias("equity"), F.least(F.col("s.worst"), F.lit(1.0)).alias("worst"), F.col("s.streak").alias("streak"), F.col("s.ruined").alias("ruined"), F.col("s.n").alias("n"))


def picks(values: DataFrame, *, keys: list[str], method: str, runs: int, seed: int, block: int, restart: float, label: str | None) -> DataFrame:
    """keys, run, pos, i: the draws of `simulate` as rows, for groups of any size; values has keys, i, n and the label."""
    key = F.concat_ws("|", *keys)
    run = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(0 if method == "original" else runs - 1).cast("bigint"))).alias("run")
    base = values.select(*keys, F.col("i").alias("pos"), "n", *([label] if label else []), base_of(f"{seed}|{method}", key).alias("_b"), base_of(f"{seed}|restart", key).alias("_r")).select("*", run)
    drawn = lambda b, place: mix((mix(F.col(b).bitwiseXOR(mix(F.col("run")))) + place * GOLDEN).bitwiseAND(F.lit(MASK)))
    if method == "original":
        return base.select(*keys, "run", "pos", F.col("pos").alias("i"))
    if method == "iid":
        return base.select(*keys, "run", "pos", F.pmod(drawn("_b", F.col("pos")), F.col("n")).alias("i"))
    if method == "block":
        start = F.pmod(drawn("_b", F.floor(F.col("pos") / block)), F.col("n"))
        return base.select(*keys, "run", "pos", F.pmod(start + F.col("pos") % block, F.col("n")).alias("i"))
    if method == "shuffle":
        order = Window.partitionBy(*keys, "run").orderBy(drawn("_b", F.col("pos")), "pos")
        return base.select(*keys, "run", F.col("pos").alias("i"), (F.row_number().over(order) - 1).cast("bigint").alias("pos"))
    if method == "stationary":
        fresh = (F.col("pos") == 0) | (drawn("_r", F.col("pos")) % 1_000_000 < int(restart * 1_000_000))
        upto = Window.partitionBy(*keys, "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        at = F.last(F.when(fresh, F.struct("pos", F.pmod(drawn("_b", F.col("pos")), F.col("n")).alias("s"))), ignorenulls=True).over(upto)
        return base.withColumn("_a", at).select(*keys, "run", "pos", F.pmod(F.col("_a.s") + F.col("pos") - F.col("_a.pos"), F.col("n")).alias("i"))
    if method == "regime":
        own = Window.partitionBy(*keys, label)
        ranked = values.select(*keys, label, "i", (F.row_number().over(own.orderBy("i")) - 1).cast("bigint").alias("r"))
        sizes = ranked.groupBy(*keys, label).agg(F.count("*").alias("k"))
        asks = base.join(sizes, [*keys, label]).select(*keys, label, "run", "pos", F.pmod(drawn("_b", F.col("pos")), F.col("k")).alias("r"))
        return asks.join(ranked, [*keys, label, "r"]).select(*keys, "run", "pos", "i")
    raise ValueError(method)


def simulate(values: DataFrame, *, keys: list[str], x: str, order: list[str], cells: list[tuple[str, float, float]], runs: int = 5000, seed: int = 20240609, label: str | None = None, block: int = 5, restart: float = 0.2, most: int = 1 << 20, task_values: int = 1 << 22, span: int = 1 << 22) -> DataFrame:
    """keys, method, leverage, cost, run, equity, worst, streak, ruined, n: one row a run.

    cells are (method, leverage, cost): net returns are leverage * (x - cost), and draws do not depend on
    leverage and cost.  x are gross simple returns; rows with a null x or key are left out, a null
    label is one of its own; `original` has one run.  order must tell rows of a key apart and begin
    with a number (`span` of it is ranked at a time).  A group of at most `most` values is an array
    in each of its tasks, which draw about task_values values a cell; larger groups are joined with
    their draws.
    """
    spark = values.sparkSession
    known = F.col(x).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    held = values.filter(known).select(*keys, *order, F.col(x).cast("double").alias("_x"), (F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")).alias("_label"))
    # Only counts decide which way a group goes; the array way never gathers more than `most` rows.
    sizes = held.groupBy(*keys).agg(F.count("*").alias("n"))
    marked = held.join(sizes, keys)
    fields = F.struct(*order, F.col("_x"), F.col("_label"))
    groups = marked.filter(F.col("n") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("all"))
    slices = F.greatest(F.lit(1), F.least(F.lit(runs), F.ceil(F.size("all") * F.lit(float(runs)) / task_values)))
    by_method: dict[str, list[tuple[float, float]]] = {}
    for method, leverage, cost in cells:
        by_method.setdefault(method, []).append((float(leverage), float(cost)))
    methods = F.explode(F.array(*[F.lit(m) for m in by_method])).alias("method")
    arrays = groups.select(*keys, F.concat_ws("|", *keys).alias("_key"), F.transform("all", lambda r: r["_x"]).alias("xs"), F.transform("all", lambda r: r["_label"]).alias("labels"), slices.cast("int").alias("_slices"))
    tasks = arrays.select("*", methods).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.when(F.col("method") == "original", 0).otherwise(F.col("_slices") - 1))))
    named = [f"{k} {held.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*named, "method string, leverage double, cost double, run bigint, equity double, worst double, streak bigint, ruined boolean, n bigint"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                method, n = row["method"], len(row["xs"])
                xs, labels = np.asarray(row["xs"], float), np.asarray(row["labels"], object).astype(str)
                first, last = (row["_slice"] + k for k in (0, 1))
                mine = np.zeros(1, np.int64) if method == "original" else np.arange(first * runs // row["_slices"], last * runs // row["_slices"])
                for s in range(0, len(mine), max(1, (1 << 20) // n)):
                    some = mine[s : s + max(1, (1 << 20) // n)]
                    drawn = xs[_picks(method, str(seed), row["_key"], some, n, block, restart, labels)]
                    for leverage, cost in by_method[method]:
                        found = pd.DataFrame(_paths(leverage * (drawn - cost)))
                        for k in keys:
                            found[k] = repeated(row[k], len(found))
                        yield found.assign(method=repeated(method, len(found)), leverage=leverage, cost=cost, run=some, n=n)

    # Slices are about equal work; each is a row, dealt over as many tasks as there are slices.
    small = tasks.repartition(*keys, "method", "_slice").mapInPandas(run, schema)
    if sizes.filter(F.col("n") > most).isEmpty():
        return small
    large = ranked(marked.filter(F.col("n") > most).drop("n"), keys=keys, order=order, span=span)
    grid = spark.createDataFrame([(m, lev, c) for m, own in by_method.items() for lev, c in own], "method string, leverage double, cost double")
    drawn = None
    for method in by_method:
        took = picks(large, keys=keys, method=method, runs=runs, seed=seed, block=block, restart=restart, label="_label").withColumn("method", F.lit(method))
        drawn = took if drawn is None else drawn.unionByName(took)
    net = drawn.join(large.select(*keys, "i", "_x"), [*keys, "i"]).join(F.broadcast(grid), "method").withColumn("_net", F.col("leverage") * (F.col("_x") - F.col("cost")))
    summed = summarise_paths(net, keys=[*keys, "method", "leverage", "cost", "run"], order="pos", x="_net")
    return small.unionByName(summed)


def simulation_pack(paths: DataFrame, *, keys: list[str], digits: int = 4) -> DataFrame:
    """Over the runs of each key: quantiles of growth, drawdown and losing streak, their tails' means, and rates of deep drawdown, halving and ruin (in %)."""
    p = paths.withColumns({"_final": (F.col("equity") - 1) * 100, "_dd": (F.col("worst") - 1) * 100})
    rate = lambda c: F.avg(c.cast("double")) * 100
    q = lambda c, at: F.percentile(c, at)
    found = {
        "final_median": q("_final", 0.5), "final_q05": q("_final", 0.05), "final_q01": q("_final", 0.01),
        "dd_median": q("_dd", 0.5), "dd_q05": q("_dd", 0.05), "dd_q01": q("_dd", 0.01),
        "prob_dd30": rate(F.col("_dd") <= -30), "prob_dd50": rate(F.col("_dd") <= -50), "prob_halving": rate(F.col("equity") <= 0.5), "prob_ruin": rate(F.col("ruined")),
        "streak_median": q("streak", 0.5), "streak_q95": q("streak", 0.95),
    }
    # A key's runs are a fixed number, so its growths and drawdowns are a bounded array.
    g = p.groupBy(*keys).agg(F.count("*").alias("runs"), F.first("n").alias("n"), *[c.alias(n) for n, c in found.items()], F.collect_list("_final").alias("_fs"), F.collect_list("_dd").alias("_ds"))

    def tail(values: str, at: str) -> Column:
        low = F.filter(values, lambda v: v <= F.col(at))
        return F.aggregate(low, F.lit(0.0), lambda s, v: s + v) / F.size(low)

    g = g.withColumns({"final_cvar05": tail("_fs", "final_q05"), "dd_cvar05": tail("_ds", "dd_q05")})
    return g.select(*keys, "runs", "n", *[F.round(c, digits).alias(c) for c in (*found, "final_cvar05", "dd_cvar05")])
