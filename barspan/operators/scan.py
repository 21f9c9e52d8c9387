"""Ordered scans that do not need a whole symbol in one task.

Bounded frames run on chunks of consecutive rows with a halo of neighbours; unbounded ones run
inside chunks and add what the chunks before them carry over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .store import keep

CHUNK = 8192


def positions(df: DataFrame, key: str = "symbol", ts: str = "ts", span: str = "month") -> DataFrame:
    """Add row_pos, the place of a row (from 0) in its key's order of ts, which must be unique there.

    Ranks are taken inside calendar spans and shifted by the counts of the spans before.
    """
    spans = df.withColumn("_span", F.date_trunc(span, ts))
    counts = spans.groupBy(key, "_span").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(key, "_span", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_span").orderBy(ts)) - 1
    return spans.withColumn("_local", local).join(offsets, [key, "_span"]).withColumn("row_pos", F.col("_before") + F.col("_local")).drop("_span", "_before", "_local")


def ranked(df: DataFrame, *, keys: list[str], order: list[str], out: str = "i", span: int = 1 << 22) -> DataFrame:
    """Add out, the place (from 0) of a row in its key's order, whose first column is a number; n, the rows of the key.

    Ranks are taken inside spans of the first column and shifted by the counts of the spans before,
    of which a key has one row each.
    """
    spans = df.withColumn("_span", F.floor(F.col(order[0]) / span))
    counts = spans.groupBy(*keys, "_span").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_k").over(w.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in [*keys, "_span"]], before.alias("_before"), F.sum("_k").over(w).alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*keys, "_span"]]
    local = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(*order)) - 1
    placed = spans.withColumn("_local", local).join(offsets, same).withColumns({out: F.col("_before") + F.col("_local"), "n": F.col("_n")})
    return placed.drop("_span", "_local", "_before", "_n", *[f"_o_{c}" for c in [*keys, "_span"]])


def range_running(df: DataFrame, *, keys: list[str], order: list[str], x: Column, out: str) -> DataFrame:
    """Add the running sum of x in the keys' order of any columns, which must tell rows apart (as far as their sums matter).

    Rows are sorted into ranges that may cut through a key; ranges are summed up on their own and
    shifted by the sums of a key's ranges before, one row each.
    """
    parts = keep(df.withColumn(f"_x_{out}", x).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    names = [*keys, "_part"]
    totals = parts.groupBy(*names).agg(F.sum(f"_x_{out}").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = totals.select(*[F.col(c).alias(f"_o_{c}") for c in names], before.alias("_before"))
    local = parts.withColumn(out, F.sum(f"_x_{out}").over(Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in names]
    return local.join(shifts, same).withColumn(out, F.col(out) + F.col("_before")).drop(f"_x_{out}", "_part", "_before", *[f"_o_{c}" for c in names])


def rolling(df: DataFrame, exprs: dict[str, Callable[[WindowSpec], Column]], *, back: int = 0, ahead: int = 0, key: str | list[str] = "symbol", size: int = CHUNK) -> DataFrame:
    """Add columns over bounded frames: each expression gets the ordered window to frame.

    back and ahead say how many rows the frames reach; a chunk holds that many rows of its
    neighbours too, and only its own rows are returned.
    """
    size = max(size, back, ahead, 1)
    at, place = F.floor(F.col("row_pos") / size), F.pmod("row_pos", F.lit(size))
    homes = F.array_compact(F.array(at, F.when(place >= size - back, at + 1) if back else F.lit(None).cast("bigint"), F.when((place < ahead) & (at > 0), at - 1) if ahead else F.lit(None).cast("bigint")))
    w = Window.partitionBy(*([key] if isinstance(key, str) else key), "_chunk").orderBy("row_pos")
    spread = df.withColumn("_chunk", F.explode(homes))
    return spread.withColumns({name: make(w) for name, make in exprs.items()}).filter(F.col("_chunk") == at).drop("_chunk")


def framed(agg: Callable[[Column], Column], x: Column, first: int, last: int, least: int | None = None) -> Callable[[WindowSpec], Column]:
    """agg(x) over rows first..last, null unless `least` values of x are in the frame."""

    def make(w: WindowSpec) -> Column:
        frame = w.rowsBetween(first, last)
        return F.when(F.count(x).over(frame) >= (last - first + 1 if least is None else least), agg(x).over(frame))

    return make


def running(df: DataFrame, exprs: dict[str, tuple[str, Column]], *, keys: list[str], order: str = "row_pos", size: int = CHUNK) -> DataFrame:
    """Add running sums, maxima, minima or last non-null values: {name: (kind, expression)}.

    Chunks of `size` places are scanned on their own; what earlier chunks carry over comes from
    one row per chunk.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / size)).withColumns({f"_x_{n}": x for n, (_, x) in exprs.items()})
    aggs = {"sum": F.sum, "max": F.max, "min": F.min}

    def total(kind: str, x: str) -> Column:
        return F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order))) if kind == "last" else aggs[kind](x)

    def over(kind: str, x: str, w: WindowSpec) -> Column:
        return F.last(x, ignorenulls=True).over(w) if kind == "last" else aggs[kind](x).over(w)

    def both(kind: str, a: Column, b: Column) -> Column:
        if kind == "last":
            return F.coalesce(b, a)
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise({"sum": a + b, "max": F.greatest(a, b), "min": F.least(a, b)}[kind])

    totals = chunked.groupBy(*keys, "_chunk").agg(*[total(k, f"_x_{n}").alias(f"_t_{n}") for n, (k, _) in exprs.items()])
    w_chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_chunk", *[over(k, f"_t_{n}", w_chunks).alias(f"_c_{n}") for n, (k, _) in exprs.items()])
    w = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumns({f"_l_{n}": over(k, f"_x_{n}", w) for n, (k, _) in exprs.items()})
    joined = local.join(carried, [*keys, "_chunk"])
    out = joined.withColumns({n: both(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in exprs.items()})
    return out.drop("_chunk", *[f"_{p}_{n}" for n in exprs for p in "xlc"])
