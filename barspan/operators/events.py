"""Event detection, thinning and selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import CHUNK, ranked, running
from .store import keep, repeated


def tagged(df: DataFrame, masks: dict[str, Column], out: str = "grp") -> DataFrame:
    """One row for each named condition that holds; rows may match several."""
    names = F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in masks.items()])
    return df.withColumn(out, F.explode(F.array_compact(names)))


def in_periods(df: DataFrame, periods: list[tuple[str, str | None, str | None]], ts: str = "ts") -> DataFrame:
    """Rows tagged with every half-open period that holds them; the periods are a fixed short list."""
    masks = {}
    for name, a, b in periods:
        inside = F.lit(True)
        if a:
            inside = inside & (F.col(ts) >= F.lit(a).cast("timestamp"))
        if b:
            inside = inside & (F.col(ts) < F.lit(b).cast("timestamp"))
        masks[name] = inside
    return tagged(df, masks, "period")


def thinned(events: DataFrame, *, keys: list[str], entry: str, leave: str, size: int = CHUNK) -> DataFrame:
    """The (keys, entry) that a greedy pass keeps: the first, then always the first entered after the exit of the last kept.

    Each event points to the one that would follow it.  In chunks of `size` events pointers are
    followed to the first event beyond the chunk; of events that such pointers meet, those on the
    chain from the first event are found by doubling the pointers, in as many rounds as the number of
    chunks has bits; then each chunk walks on from the one event at which the chain enters it.  Rows
    with a null key or place are left out; of rows with one entry the earliest exit counts.
    """
    clean = events.select(*keys, entry, leave).dropna()
    one = clean.groupBy(*keys, F.col(entry).cast("bigint").alias("_e")).agg(F.min(F.col(leave).cast("bigint")).alias("_l"))
    both = one.select(*keys, F.col("_e").alias("_v"), F.lit(0).alias("_kind"), "_e").unionByName(one.select(*keys, F.greatest("_l", "_e").alias("_v"), F.lit(1).alias("_kind"), "_e"))
    order = ranked(both, keys=keys, order=["_v", "_kind", "_e"], out="_i", span=size)
    seen = running(order, {"_seen": ("sum", 1 - F.col("_kind"))}, keys=keys, order="_i", size=size)
    # p: an event's place; next: how many are entered up to its exit, the place of the one after.
    at = lambda kind, c: F.max(F.when(F.col("_kind") == kind, c))
    linked = seen.groupBy(*keys, "_e").agg(at(0, F.col("_seen") - 1).cast("bigint").alias("p"), at(1, F.col("_seen")).cast("bigint").alias("next"))
    linked = keep(linked.withColumn("chunk", F.floor(F.col("p") / size)), "linked")
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)

    def beyond(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        first, out = int(rows["p"].iloc[0]), rows["next"].tolist()
        end = first + len(out)
        for k in range(len(out) - 1, -1, -1):
            if out[k] < end:
                out[k] = out[out[k] - first]
        return pd.DataFrame({**{k: repeated(rows[k].iloc[0], len(out)) for k in keys}, "p": rows["p"].to_numpy(), "out": out})

    outs = keep(linked.groupBy(*keys, "chunk").applyInPandas(beyond, f"{kinds}, p bigint, out bigint"), "outs")
    root = outs.filter("p = 0").select(*keys, "p")
    met = outs.select(*keys, F.col("out").alias("p")).union(root).distinct()
    jump = keep(outs.join(met, [*keys, "p"], "semi"), "jump")
    reached = root
    while not jump.isEmpty():
        reached = keep(reached.union(reached.join(jump, [*keys, "p"]).select(*keys, F.col("out").alias("p"))).distinct(), "reached")
        jump = keep(jump.join(jump.select(*keys, F.col("p").alias("out"), F.col("out").alias("_on")), [*keys, "out"]).select(*keys, "p", F.col("_on").alias("out")), "jump")
    starts = reached.select(*keys, F.col("p").alias("start"), F.floor(F.col("p") / size).alias("chunk"))

    def walk(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        if len(rows) and len(start):
            rows = rows.sort_values("p")
            first, follow, at = int(rows["p"].iloc[0]), rows["next"].tolist(), int(start["start"].min())
            while at < first + len(follow):
                kept.append(at - first)
                at = follow[at - first]
        return pd.DataFrame({**{k: repeated(rows[k].iloc[0] if kept else None, len(kept)) for k in keys}, "_e": rows["_e"].to_numpy()[kept] if kept else []})

    kept = linked.groupBy(*keys, "chunk").cogroup(starts.groupBy(*keys, "chunk")).applyInPandas(walk, f"{kinds}, _e bigint")
    return kept.withColumnRenamed("_e", entry)


def cooldown(events: DataFrame, bars: int, *, keys: list[str] | None = None, order: str = "row_pos", size: int = CHUNK) -> DataFrame:
    """Keep an event only if it is at least `bars` after the last one kept."""
    keys = keys or ["symbol"]
    kept = thinned(events.select(*keys, order, (F.col(order) + (bars - 1)).alias("_until")), keys=keys, entry=order, leave="_until", size=size)
    return events.join(kept, [*keys, order], "semi")


def non_overlapping(events: DataFrame, *, keys: list[str], entry: str = "entry_pos", leave: str = "exit_pos", size: int = CHUNK) -> DataFrame:
    """Skip events entered at or before the exit of the last one kept; adds trade_no from 1."""
    kept = ranked(thinned(events, keys=keys, entry=entry, leave=leave, size=size), keys=keys, order=[entry], out="trade_no", span=size).drop("n")
    return events.join(kept.withColumn("trade_no", (F.col("trade_no") + 1).cast("int")), [*keys, entry])


def best_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
