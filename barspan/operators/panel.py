"""Panels of many symbols: one array per time, and pairwise statistics from blocked outer products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import repeated


def symbols_of(df: DataFrame, symbol: str = "symbol", most: int = 100_000) -> list[str]:
    """The symbols of a panel in order; they are its columns, so their number is bounded."""
    found = [r[0] for r in df.select(symbol).filter(F.col(symbol).isNotNull()).distinct().orderBy(symbol).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a panel holds at most {most} symbols")
    return found


def panel(df: DataFrame, x: str, *, names: list[str], symbol: str = "symbol", ts: str = "ts", whole: bool = True) -> DataFrame:
    """ts and values, one array per time in the order of names; whole: only times at which all have a value.

    One aggregation over (ts, place) pairs; no self-join.  Of rows that repeat a symbol and time the
    largest value counts.
    """
    places = df.sparkSession.createDataFrame(list(enumerate(names)), "_i int, _name string")
    rows = df.filter(F.col(x).isNotNull()).join(F.broadcast(places), F.col(symbol) == F.col("_name"))
    grouped = rows.groupBy(ts).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col(x).cast("double").alias("x")))).alias("_at"))
    last = F.filter("_at", lambda r, k: F.coalesce(F.get(F.col("_at"), k + 1)["i"] != r["i"], F.lit(True)))
    held = F.map_from_entries(last)
    out = grouped.withColumn("_m", held)
    if whole:
        out = out.filter(F.size("_m") == len(names))
    return out.select(ts, F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.try_element_at(F.col("_m"), i.cast("int"))).alias("values"))


def pair_correlations(rows: DataFrame, n: int, *, group: str, values: str = "values", block: int = 128) -> DataFrame:
    """group, i, j, r for i < j: correlations over the rows of each group that have both values; null where one does not vary.

    A task adds up block x block products (values, squares and presence); Spark sums the blocks.
    Memory follows the number of pairs, not the rows: n * n numbers a group and task, 32 bytes a pair.
    """
    blocks = [(a, b) for a in range(0, n, block) for b in range(a, n, block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            found = batch.column(group).to_pylist()
            column = batch.column(values)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), n)
            here = ~np.isnan(x)
            x, square = np.where(here, x, 0.0), np.where(here, x * x, 0.0)
            here = here.astype(float)
            for name in dict.fromkeys(found):
                at = np.array([g == name for g in found])
                own = [m[at] for m in (here, x, square)]
                for a, b in blocks:
                    m, v, q = (z[:, a : a + block] for z in own)
                    m2, v2, q2 = (z[:, b : b + block] for z in own)
                    part = np.stack([m.T @ m2, v.T @ m2, m.T @ v2, q.T @ m2, m.T @ q2, v.T @ v2])
                    key = (name, a, b)
                    sums[key] = part if key not in sums else sums[key] + part
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["grp", "a", "b", "sums"])

    parts = rows.select(F.col(group).cast("string").alias(group), values).mapInArrow(run, "grp string, a int, b int, sums binary")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        wide, high = min(block, n - a), min(block, n - b)
        k, sx, sy, qx, qy, xy = sum(np.frombuffer(s, float) for s in pdf["sums"]).reshape(6, wide, high)
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = qx - sx * sx / k, qy - sy * sy / k
            flat = (k < 2) | (vx <= 1e-13 * qx) | (vy <= 1e-13 * qy)
            r = np.where(flat, np.nan, (xy - sx * sy / k) / np.sqrt(vx * vy))
        i, j = np.nonzero(np.arange(a, a + wide)[:, None] < np.arange(b, b + high)[None, :])
        return pd.DataFrame({"grp": repeated(pdf["grp"].iloc[0], len(i)), "i": i + a, "j": j + b, "r": r[i, j], "n": k[i, j].astype(np.int64)})

    found = parts.groupBy("grp", "a", "b").applyInPandas(total, "grp string, i int, j int, r double, n bigint")
    return found.filter("n > 0").select(F.col("grp").alias(group), "i", "j", F.when(~F.isnan("r"), F.col("r")).alias("r"), "n")
