"""Families of strategies as expressions over shared indicators, all parameter rows in one job.

A family names the indicators it reads, each with its reach, and the state that follows each state
at a bar.  Indicators of all rows are computed once, level by level, whatever the number of rows that
read them; the rows are then exploded, and one pass of three-state machines gives the signals of all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspan.functions import ratio, true_range

from .features import exponential_mean, span_alpha
from .positions import three_state
from .scan import CHUNK, framed, rolling
from .store import keep

c = F.col


@dataclass(frozen=True)
class Row:
    """One strategy: its family and parameters, a gate that new entries need, and the side it is held to (0: both)."""

    family: str
    params: tuple
    gate: tuple = ()
    side: int = 0

    @property
    def name(self) -> str:
        return "/".join([self.family, *map(str, self.params), *([":".join(map(str, self.gate))] if self.gate else []), *([{1: "long", -1: "short"}[self.side]] if self.side else [])])


@dataclass
class Needs:
    """Indicators by name: of the first level (over bars), of the second (over those) and exponential means by span."""

    first: dict[str, tuple[int, Callable]] = field(default_factory=dict)
    second: dict[str, tuple[int, Callable]] = field(default_factory=dict)
    spans: set[int] = field(default_factory=set)

    def mean(self, n: int) -> Column:
        self.first[f"_sma{n}"] = (n, framed(F.avg, c("close"), -(n - 1), 0))
        return c(f"_sma{n}")

    def deviation(self, n: int) -> Column:
        self.first[f"_sd{n}"] = (n, framed(F.stddev_samp, c("close"), -(n - 1), 0))
        return c(f"_sd{n}")

    def highest(self, n: int) -> Column:
        self.first[f"_hi{n}"] = (n, framed(F.max, c("high"), -n, -1))
        return c(f"_hi{n}")

    def lowest(self, n: int) -> Column:
        self.first[f"_lo{n}"] = (n, framed(F.min, c("low"), -n, -1))
        return c(f"_lo{n}")

    def exponential(self, n: int) -> Column:
        self.spans.add(n)
        return c(f"_ema{n}")

    def range_mean(self, n: int) -> Column:
        self.first["_tr"] = (1, lambda w: true_range(F.lag("close").over(w)))
        self.second[f"_atr{n}"] = (n, framed(F.avg, c("_tr"), -(n - 1), 0))
        return c(f"_atr{n}")

    def efficiency(self, n: int) -> Column:
        self.first["_step"] = (1, lambda w: F.abs(c("close") - F.lag("close").over(w)))
        self.second[f"_er{n}"] = (n, lambda w: ratio(F.abs(c("close") - F.lag("close", n).over(w)), framed(F.sum, c("_step"), -(n - 1), 0)(w)))
        return c(f"_er{n}")


def _sign(a: Column, b: Column) -> tuple[Column, Column, Column]:
    s = F.coalesce(F.signum(a - b).cast("int"), F.lit(0))
    return s, s, s


def _channel(need: Needs, entry: int, leave: int) -> tuple[Column, Column, Column]:
    """Enter beyond the long channel, leave beyond the short one; a close beyond both turns."""
    hi, lo, out_hi, out_lo = need.highest(entry), need.lowest(entry), need.highest(leave), need.lowest(leave)
    known, close = hi.isNotNull() & out_lo.isNotNull(), c("close")
    up, down = F.coalesce(close > hi, F.lit(False)), F.coalesce(close < lo, F.lit(False))
    short = F.when(~known, 0).when(close > out_hi, F.when(up, 1).otherwise(0)).otherwise(-1)
    long = F.when(~known, 0).when(close < out_lo, F.when(down, -1).otherwise(0)).otherwise(1)
    return short, F.when(known & up, 1).when(known & down, -1).otherwise(0), long


def _reversion(need: Needs, n: int, z_in: float, z_out: float) -> tuple[Column, Column, Column]:
    """Against a deviation beyond z_in until it is back within z_out; flat before the other side."""
    z = (c("close") - need.mean(n)) / F.nullif(need.deviation(n), F.lit(0.0))
    short = F.when(z.isNull() | (z <= z_out), 0).otherwise(-1)
    long = F.when(z.isNull() | (z >= -z_out), 0).otherwise(1)
    return short, F.when(z > z_in, -1).when(z < -z_in, 1).otherwise(0), long


FAMILIES: dict[str, Callable[..., tuple[Column, Column, Column]]] = {
    "sma_cross": lambda need, fast, slow: _sign(need.mean(fast), need.mean(slow)),
    "ema_cross": lambda need, fast, slow: _sign(need.exponential(fast), need.exponential(slow)),
    "channel": _channel,
    "reversion": _reversion,
}

#: Conditions that an entry from flat needs; `trend` stands beside them, as it also bears on turns.
GATES: dict[str, Callable[..., Column]] = {
    "calm": lambda need, n, most: ratio(need.range_mean(n), c("close")) < most,
    "efficient": lambda need, n, least: need.efficiency(n) >= least,
}


def signals(bars: DataFrame, rows: list[Row], *, key: str = "symbol", size: int = CHUNK) -> DataFrame:
    """bars' columns, strategy (a name) and sig for every row of the list.

    A gate holds back entries from flat only; the gate `trend` (n) allows those entries and turns
    whose side is that of the close against its mean of n bars, and what it denies is flat.  side keeps one
    side only.  Unknown indicators and gates count as no signal and a closed gate.
    """
    need = Needs()
    bases = {row: None for row in ((r.family, r.params) for r in rows)}
    made = []
    for k, (family, params) in enumerate(bases):
        bases[family, params] = k
        short, flat, long = FAMILIES[family](need, *params)
        made.append(F.struct(F.lit(k).alias("_base"), short.alias("_m"), flat.alias("_z"), long.alias("_p")))
    gates = list(dict.fromkeys(r.gate for r in rows))
    told = []
    for gate in gates:
        allowed, trend = F.lit(True), F.lit(None).cast("int")
        if gate and gate[0] == "trend":
            trend = F.coalesce(F.signum(c("close") - need.mean(*gate[1:])).cast("int"), F.lit(0))
        elif gate:
            allowed = F.coalesce(GATES[gate[0]](need, *gate[1:]), F.lit(False))
        told.append(F.struct(allowed.alias("ok"), trend.alias("trend")).cast("struct<ok:boolean,trend:int>"))
    # A base machine runs once for all gates, a gated one once for all sides; the list itself is a short table.
    listed = [(bases[r.family, r.params], gates.index(r.gate), r.side, r.name) for r in rows]
    table = bars.sparkSession.createDataFrame(listed, "_base int, _gate int, _side int, strategy string")
    b = bars
    for n in sorted(need.spans):
        # Every pass below reads its input twice (to chain chunks and to replay them), so inputs are tables.
        b = keep(exponential_mean(b, "close", span_alpha(n), least=n, out=f"_ema{n}", key=key), "means")
    for level in (need.first, need.second):
        if level:
            b = rolling(b, {k: make for k, (_, make) in level.items()}, back=max(n for n, _ in level.values()), key=key, size=size)
    long = keep(b.select(*bars.columns, F.array(*told).alias("_gates"), F.explode(F.array(*made)).alias("r")).select(*bars.columns, "_gates", "r.*"), "bases")
    base = three_state(long, c("_m"), c("_z"), c("_p"), keys=[key, "_base"], out="_want").drop("_m", "_z", "_p")
    pairs = F.broadcast(table.select("_base", "_gate").distinct())
    gated = keep(base.join(pairs, "_base").withColumn("_told", F.get("_gates", c("_gate"))).drop("_gates"), "gated")
    want, trend = c("_want"), c("_told.trend")
    turn = F.when(trend.isNotNull() & (want != trend), 0).otherwise(want)
    follow = lambda s: F.when(want == s, s).when(want == 0, 0).otherwise(turn)
    states = three_state(gated, follow(-1), F.when(want == 0, 0).when(~c("_told.ok"), 0).otherwise(turn), follow(1), keys=[key, "_base", "_gate"], out="sig")
    kept = F.when((c("_side") != 0) & (c("sig") != c("_side")), 0).otherwise(c("sig"))
    return states.join(F.broadcast(table), ["_base", "_gate"]).withColumn("sig", kept).select(*bars.columns, "strategy", "sig")
