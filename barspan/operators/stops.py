"""Bar returns of many strategies with stops and targets, from one pass over chunks of bars.

When a trade entered at a bar would be stopped or taken depends on the bar, its side and the two
distances alone, not on the strategy.  A first-touch index over block minima and maxima of low and
high gives that for all bars of a chunk at once, shared by every signal; a strategy's trades then chain
from touch to next entry.  A chunk's end state is known without the past from the first bar on that
is flat or turns; only strategies that hold one side through a whole chunk wait for the chunk before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspan.functions import true_range

from .scan import CHUNK, framed, rolling
from .store import keep, repeated


@dataclass(frozen=True)
class Strategy:
    """A pair of averages, and the distances of stop and target from the entry in ATR (None: without)."""

    short_ma: int
    long_ma: int
    stop: float | None = None
    target: float | None = None


def average_strategies(shorts: list[int], longs: list[int], stops: list[float | None], targets: list[float | None]) -> list[Strategy]:
    return [Strategy(s, x, sl, tp) for s in shorts for x in longs for sl in stops for tp in targets]


def first_touch(low: np.ndarray, high: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """For each bar the first one from it on with low <= below or high >= above (NaN: never); len(low) where there is none.

    Minima and maxima of blocks of 1, 2, 4, ... bars are searched from the longest that fits down.
    """
    n = len(low)
    tables = [(low, high)]
    while 2 ** len(tables) <= n:
        a, b, half = *tables[-1], 2 ** (len(tables) - 1)
        tables.append((np.minimum(a[:-half], a[half:]), np.maximum(b[:-half], b[half:])))
    at = np.arange(n)
    # The distance to the touch in binary: each size is skipped once or not at all.
    for k in range(len(tables) - 1, -1, -1):
        mins, maxs = tables[k]
        start = np.minimum(at, len(mins) - 1)
        clear = (at + 2**k <= n) & ~(mins[start] <= below) & ~(maxs[start] >= above)
        at = np.where(clear, at + 2**k, at)
    return at


#: What a strategy carries over a chunk's border: its side (0: flat), entry, stop and target.
FLAT = (0, np.nan, np.nan, np.nan)


class Chunk:
    """Consecutive bars of one symbol, with what was known at the close before each."""

    def __init__(self, rows: pd.DataFrame, cost: float):
        self.open, self.high, self.low, self.next, self.atr = (rows[c].to_numpy(float) for c in ("open", "high", "low", "_next", "_atr"))
        self.final, self.n, self.cost = rows["_final"].to_numpy(bool), len(rows), cost
        self.touches: dict = {}

    def touch(self, side: int, sl: float | None, tp: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stops, targets and first touches of trades of one side entered at each bar."""
        if (side, sl, tp) not in self.touches:
            none = np.full(self.n, np.nan)
            stop = none if sl is None else self.open - side * sl * self.atr
            target = none if tp is None else self.open + side * tp * self.atr
            at = first_touch(self.low, self.high, *((stop, target) if side > 0 else (target, stop)))
            self.touches[side, sl, tp] = stop, target, at
        return self.touches[side, sl, tp]

    def walk(self, wants: np.ndarray, s: Strategy, start: int, carry: tuple) -> tuple[np.ndarray, tuple]:
        """Returns of the bars from `start` on, open to open, and the state after the last."""
        n, cost, ret = self.n, self.cost, np.zeros(self.n)
        needs = s.stop is not None or s.target is not None
        turns = np.flatnonzero(np.r_[True, wants[start + 1 :] != wants[start:-1]]) + start if start < n else []
        side, entry, stop, target = carry
        for a, b in zip(turns, [*turns[1:], n], strict=True):
            want, e = int(wants[a]), a
            if side and want != side:
                ret[a] -= cost / self.open[a]
                side = 0
            if side:  # held into this chunk: its stop and target are older than the chunk
                hit = (self.low[a:b] <= stop) | (self.high[a:b] >= target) if side > 0 else (self.high[a:b] >= stop) | (self.low[a:b] <= target)
                x = a + int(np.argmax(hit)) if hit.any() else n
                e = self._leg(ret, side, a, x, b, stop, target)
                side = side if x >= b else 0
            if want and not side:
                stops, targets, touch = self.touch(want, s.stop, s.target)
                while e < b:
                    if needs and not np.isfinite(self.atr[e]):
                        later = np.flatnonzero(np.isfinite(self.atr[e:b]))
                        if not len(later):
                            break
                        e += int(later[0])
                    ret[e] -= cost / self.open[e]
                    x, first = int(touch[e]), e
                    e = self._leg(ret, want, e, x, b, stops[e], targets[e])
                    if x >= b:
                        side, entry, stop, target = want, self.open[first], stops[first], targets[first]
                        break
        if side and n and self.final[-1]:
            ret[-1] -= cost / self.next[-1]
            side = 0
        return ret, (side, entry, stop, target) if side else FLAT

    def _leg(self, ret: np.ndarray, side: int, a: int, x: int, b: int, stop: float, target: float) -> int:
        """Returns of a trade held from bar a to its touch at x or to b; gives the first bar after it."""
        held = slice(a, min(x, b))
        ret[held] += side * (self.next[held] - self.open[held]) / self.open[held]
        if x >= b:
            return b
        stopped = self.low[x] <= stop if side > 0 else self.high[x] >= stop
        price = stop if stopped else target
        ret[x] += side * (price - self.open[x]) / self.open[x] - self.cost / max(abs(price), 1e-12)
        return x + 1


def stopped_returns(bars: DataFrame, strategies: list[Strategy], *, cost: float = 0.0, atr_bars: int = 14, key: str = "symbol", size: int = CHUNK) -> DataFrame:
    """key, strategy (its place in the list), row_pos, ret: each bar's return, open to open, under each strategy.

    The side is the sign of the difference of two averages of closes up to the bar before.  A bar
    opens in that side at its open if it is not held yet and, with a stop or target, the ATR before
    it is known; another side, or none, closes at the open.  Inside a bar a touched stop counts
    before a touched target, and the next bar may enter again.  cost is a price per side, relative to the
    price it is paid at.  The last bar only closes what is open; its cost falls on the bar before.
    bars: key, row_pos (gapless from 0), open, high, low, close.  Bars with null prices must be
    dropped before.
    """
    lengths = sorted({n for s in strategies for n in (s.short_ma, s.long_ma)})
    b = rolling(bars.select(key, "row_pos", "open", "high", "low", "close"), {"_tr": lambda w: true_range(F.lag("close").over(w))}, back=1, key=key, size=size)
    shapes = {f"_m{n}": framed(F.avg, F.col("close"), -n, -1) for n in lengths}
    shapes |= {"_atr": framed(F.avg, F.col("_tr"), -atr_bars, -1), "_next": lambda w: F.lead("open").over(w), "_final": lambda w: F.lead("open", 2).over(w).isNull()}
    b = rolling(b, shapes, back=max(*lengths, atr_bars), ahead=2, key=key, size=size)
    pairs = sorted({(s.short_ma, s.long_ma) for s in strategies})
    sign = lambda a, c: F.coalesce(F.signum(F.col(f"_m{a}") - F.col(f"_m{c}")).cast("tinyint"), F.lit(0).cast("tinyint"))
    wide = b.select(key, "row_pos", "open", "high", "low", "_next", "_atr", "_final", *[sign(a, c).alias(f"_w{a}_{c}") for a, c in pairs]).filter("_next is not null")
    kind = bars.schema[key].dataType.simpleString()
    cols = [f"_w{a}_{c}" for a, c in pairs]
    # The side wanted in the bar before tells where a chunk turns at its very first bar.
    wide = rolling(wide, {f"_b{c}": lambda w, c=c: F.lag(c).over(w) for c in cols}, back=1, key=key, size=size).withColumn("_chunk", F.floor(F.col("row_pos") / size))
    wide = keep(wide.repartition(key, "_chunk"), "bars")

    def known_from(rows: pd.DataFrame, s: Strategy) -> int:
        """The first bar whose state does not depend on the chunk before."""
        if rows["row_pos"].iloc[0] == 0:
            return 0
        wants, before = (rows[f"{c}_w{s.short_ma}_{s.long_ma}"].to_numpy(float) for c in ("", "_b"))
        sure = (wants == 0) | (wants != before)
        return int(np.argmax(sure)) if sure.any() else len(rows)

    state = "side int, entry double, stop double, target double"
    ends_schema = f"{key} {kind}, chunk bigint, strategy int, known boolean, {state}"

    def wants_of(rows: pd.DataFrame, s: Strategy) -> np.ndarray:
        return rows[f"_w{s.short_ma}_{s.long_ma}"].to_numpy(np.int8)

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_pos")
        chunk, out = Chunk(rows, cost), []
        for k, s in enumerate(strategies):
            start = known_from(rows, s)
            known = start < len(rows)
            carry = chunk.walk(wants_of(rows, s), s, start, FLAT)[1] if known else FLAT
            out.append((rows[key].iloc[0], int(rows["_chunk"].iloc[0]), k, known, *carry))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ends_schema.split(", ")]).astype({key: object})

    found = keep(wide.groupBy(key, "_chunk").applyInPandas(ends, ends_schema), "ends")
    columns = ["side", "entry", "stop", "target"]

    def onward(rows: pd.DataFrame, carries: pd.DataFrame) -> pd.DataFrame:
        """End states of strategies that held one side all through the chunk."""
        if not len(rows) or not len(carries):
            return pd.DataFrame([], columns=[c.split()[0] for c in ends_schema.split(", ")])
        rows = rows.sort_values("row_pos")
        chunk = Chunk(rows, cost)
        out = [(rows[key].iloc[0], int(rows["_chunk"].iloc[0]), int(c.strategy), True, *chunk.walk(wants_of(rows, strategies[int(c.strategy)]), strategies[int(c.strategy)], 0, (int(c.side), c.entry, c.stop, c.target))[1]) for c in carries.itertuples()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ends_schema.split(", ")]).astype({key: object})

    while not found.filter("not known").isEmpty():
        # As many rounds as the longest row of chunks that one strategy never turns in; only those chunks are read again.
        before = found.filter("known").select(key, (F.col("chunk") + 1).alias("_chunk"), "strategy", *columns)
        ready = found.filter("not known").select(key, F.col("chunk").alias("_chunk"), "strategy").join(before, [key, "_chunk", "strategy"])
        some = wide.join(ready.select(key, "_chunk").distinct(), [key, "_chunk"], "semi")
        more = some.groupBy(key, "_chunk").cogroup(ready.groupBy(key, "_chunk")).applyInPandas(onward, ends_schema)
        more = keep(more, "more")
        found = keep(found.join(more.select(key, "chunk", "strategy"), [key, "chunk", "strategy"], "anti").unionByName(more), "ends")

    starts = found.select(key, (F.col("chunk") + 1).alias("_chunk"), "strategy", *columns).filter("side <> 0")
    schema = f"{key} {kind}, strategy int, row_pos bigint, ret double"

    def returns(rows: pd.DataFrame, carries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({key: [], "strategy": [], "row_pos": [], "ret": []})
        rows = rows.sort_values("row_pos")
        chunk = Chunk(rows, cost)
        held = {int(c.strategy): (int(c.side), c.entry, c.stop, c.target) for c in carries.itertuples()}
        rets = [chunk.walk(wants_of(rows, s), s, 0, held.get(k, FLAT))[0] for k, s in enumerate(strategies)]
        n, many = len(rows), len(strategies)
        return pd.DataFrame({key: repeated(rows[key].iloc[0], n * many), "strategy": np.repeat(np.arange(many, dtype=np.int32), n), "row_pos": np.tile(rows["row_pos"].to_numpy(), many), "ret": np.concatenate(rets)})

    return wide.groupBy(key, "_chunk").cogroup(starts.groupBy(key, "_chunk")).applyInPandas(returns, schema)


def described(spark, strategies: list[Strategy]) -> DataFrame:
    """The list as a table: strategy, short_ma, long_ma, stop, target."""
    return spark.createDataFrame([(k, s.short_ma, s.long_ma, s.stop, s.target) for k, s in enumerate(strategies)], "strategy int, short_ma int, long_ma int, stop double, target double")
