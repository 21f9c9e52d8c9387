"""Signals, positions and trades over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import CHUNK, framed, ranked, rolling, running


def average_cross(bars: DataFrame, pairs: list[tuple[int, int]], *, keys: str | list[str] = "symbol") -> DataFrame:
    """Long table of sig in {-1, 0, 1}: the short average against the long one, for every pair.

    Each average is computed once, whatever the number of pairs.
    """
    lengths = sorted({n for p in pairs for n in p})
    b = rolling(bars, {f"_ma{n}": framed(F.avg, F.col("close"), -(n - 1), 0) for n in lengths}, back=max(lengths), key=keys)
    sign = lambda s, x: F.coalesce(F.signum(F.col(f"_ma{s}") - F.col(f"_ma{x}")).cast("int"), F.lit(0))
    rows = F.array(*[F.struct(F.lit(s).alias("short_ma"), F.lit(x).alias("long_ma"), sign(s, x).alias("sig")) for s, x in pairs])
    return b.select(*bars.columns, F.explode(rows).alias("p")).select(*bars.columns, "p.*")


def breakout(bars: DataFrame, n: int) -> DataFrame:
    """Stop-and-reverse: the last breakout of the n-bar channel before holds; 0 before the first."""
    upper, lower = framed(F.max, F.col("high"), -n, -1), framed(F.min, F.col("low"), -n, -1)
    b = rolling(bars, {"_up": upper, "_down": lower}, back=n)
    turn = F.when(F.col("close") > F.col("_up"), 1).when(F.col("close") < F.col("_down"), -1)
    b = running(b, {"sig": ("last", turn)}, keys=["symbol"])
    return b.withColumn("sig", F.coalesce("sig", F.lit(0))).drop("_up", "_down")


def three_state(bars: DataFrame, short: Column, flat: Column, long: Column, *, keys: list[str], chunk: int = 256, out: str = "sig") -> DataFrame:
    """Signal of a machine with states -1, 0, 1: the three columns say which state follows each of them at a bar.

    A bar is a map of the state before it to the state after it.  Maps are composed inside chunks,
    the composed maps are chained over a key's chunks, and each chunk is replayed from the state it
    starts in; the machine starts flat.
    """
    move = F.struct(short.cast("int").alias("m"), flat.cast("int").alias("z"), long.cast("int").alias("p"))
    b = bars.withColumns({"_move": move, "_c": F.floor(F.col("row_pos") / chunk)})
    rows = F.sort_array(F.collect_list(F.struct("row_pos", "_move", F.struct(*bars.columns).alias("row"))))
    chunks = b.groupBy(*keys, "_c").agg(rows.alias("rows"))
    after = lambda s, x: F.when(s == -1, x["m"]).when(s == 0, x["z"]).otherwise(x["p"])
    same = F.struct(F.lit(-1).alias("m"), F.lit(0).alias("z"), F.lit(1).alias("p"))
    compose = lambda s, r: F.struct(after(s["m"], r["_move"]).alias("m"), after(s["z"], r["_move"]).alias("z"), after(s["p"], r["_move"]).alias("p"))
    maps = chunks.select(*keys, "_c", F.aggregate("rows", same, compose).alias("map"))
    chain = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "map"))).alias("maps"))
    zero = F.struct(F.array().cast("array<struct<_c:bigint,s:int>>").alias("out"), F.lit(0).alias("s"))
    link = lambda s, r: F.struct(F.concat(s["out"], F.array(F.struct(r["_c"].alias("_c"), s["s"].alias("s")))).alias("out"), after(s["s"], r["map"]).alias("s"))
    starts = chain.select(*keys, F.explode(F.aggregate("maps", zero, link)["out"]).alias("x")).select(*keys, F.col("x._c").alias("_c"), F.col("x.s").alias("_s"))
    first = F.struct(F.array().cast("array<int>").alias("out"), F.col("_s").alias("s"))
    replay = lambda s, r: F.struct(F.concat(s["out"], F.array(after(s["s"], r["_move"]))).alias("out"), after(s["s"], r["_move"]).alias("s"))
    done = chunks.join(starts, [*keys, "_c"]).select(F.explode(F.arrays_zip("rows", F.aggregate("rows", first, replay)["out"].alias("sig"))).alias("x"))
    return done.select("x.rows.row.*", F.col("x.sig").alias(out))


def hysteresis(bars: DataFrame, up: Column, down: Column, stay_up: Column, stay_down: Column, *, keys: list[str], chunk: int = 256, out: str = "sig", flip: bool = True) -> DataFrame:
    """Three-state signal: enter +1 / -1 on up / down when flat, leave when the stay condition ends; flip: up and down also turn a position of the other side in one bar."""
    up, down, stay_up, stay_down = (F.coalesce(c, F.lit(False)) for c in (up, down, stay_up, stay_down))
    short, long = F.when(stay_down, -1).otherwise(0), F.when(stay_up, 1).otherwise(0)
    if flip:
        short, long = F.when(up, 1).otherwise(short), F.when(down, -1).otherwise(long)
    return three_state(bars, short, F.when(up, 1).when(down, -1).otherwise(0), long, keys=keys, chunk=chunk, out=out)


def positions_of(signals: DataFrame, keys: list[str], *, delay: int = 0, more: dict | None = None, ahead: int = 0, size: int = CHUNK) -> DataFrame:
    """pos: the signal of the bar before (and `delay` more); turnover: its change.

    row_pos counts each key's bars without gaps.  more holds further expressions over the same
    window, which reach back as far and `ahead` bars on.
    """
    held = lambda k: lambda w: F.coalesce(F.lag("sig", k + delay).over(w), F.lit(0))
    b = rolling(signals, {"pos": held(1), "_was": held(2), **(more or {})}, back=2 + delay, ahead=ahead, key=keys, size=size)
    return b.withColumn("turnover", F.abs(F.col("pos") - F.col("_was"))).drop("_was")


def bar_returns(signals: DataFrame, keys: list[str], *, cost: float = 0.0, size: int = CHUNK) -> DataFrame:
    """ret of each bar, close to close, of the position held into it, less cost per unit of turnover."""
    b = positions_of(signals, keys, more={"_move": lambda w: F.col("close") / F.lag("close").over(w) - 1}, size=size)
    return b.withColumn("ret", F.coalesce(F.col("pos") * F.col("_move"), F.lit(0.0)) - cost * F.col("turnover")).drop("_move")


def _runs(positions: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Add _run, the number of changes of the position up to each bar."""
    return running(positions, {"_run": ("sum", (F.col("turnover") > 0).cast("int"))}, keys=keys, size=size)


def trade_log(signals: DataFrame, keys: list[str], *, cost: float = 0.0, delay: int = 0, size: int = CHUNK) -> DataFrame:
    """One row per run of a position: entered at its first open, left at the next run's first open.

    The last run ends at the open of the period's last bar.
    """
    b = _runs(positions_of(signals, keys, delay=delay, more={"_next": lambda w: F.lead("open").over(w)}, ahead=1, size=size), keys, size)
    t = b.filter("pos <> 0").groupBy(*keys, "_run").agg(
        F.first("pos").alias("direction"), F.min("row_pos").alias("entry_pos"), F.max("row_pos").alias("exit_pos"), F.min_by("ts", "row_pos").alias("entry_ts"), F.max_by("ts", "row_pos").alias("exit_ts"),
        F.min_by("open", "row_pos").alias("entry_price"), F.max_by("_next", "row_pos").alias("_next"), F.max_by("open", "row_pos").alias("_last"),
    )
    leave = F.coalesce("_next", "_last")
    gross = F.col("direction") * (leave - F.col("entry_price"))
    reason = F.when(F.col("_next").isNull(), "period_end").otherwise("flip")
    return t.withColumns({"exit_price": leave, "gross": gross, "net": gross - cost, "bars": F.col("exit_pos") - F.col("entry_pos") + F.col("_next").isNotNull().cast("int"), "exit_reason": reason}).drop("_run", "_next", "_last")


def stopped_trades(signals: DataFrame, keys: list[str], *, stop: Column, target: Column, atr: str = "atr", size: int = CHUNK) -> DataFrame:
    """Trades with a stop and a target in units of ATR from the entry; null means none.

    Inside a run of one position a flat bar enters at its open if the ATR of the bar before is
    known or neither a stop nor a target needs it.  A touched stop counts before a touched target; after either, the next bar may enter
    again.  The run's end closes at the next run's first open, or the last close.  Runs are
    independent, so each is a fold of its own.
    """
    more = {"_next": lambda w: F.lead("open").over(w), "_atr": lambda w: F.lag(atr).over(w)}
    b = _runs(positions_of(signals, keys, more=more, ahead=1, size=size), keys, size)
    b = b.withColumns({"_sl": stop.cast("double"), "_tp": target.cast("double")})
    bars = F.sort_array(F.collect_list(F.struct("row_pos", "open", "high", "low", F.col("_atr").alias("atr"))))
    runs = b.filter("pos <> 0").groupBy(*keys, "_run").agg(F.first("pos").alias("d"), F.first("_sl").alias("sl"), F.first("_tp").alias("tp"), bars.alias("bars"), F.coalesce(F.max_by("_next", "row_pos"), F.max_by("close", "row_pos")).alias("final"), F.max("row_pos").alias("last"))
    none = F.lit(None).cast("double")
    zero = F.struct(F.array().cast("array<struct<entry_pos:bigint,exit_pos:bigint,entry:double,exit:double,why:string>>").alias("out"), none.alias("e"), none.alias("a"), F.lit(None).cast("bigint").alias("at"))

    def step(s: Column, r: Column) -> Column:
        enter = s["e"].isNull() & (r["atr"].isNotNull() | (F.col("sl").isNull() & F.col("tp").isNull()))
        e, a, at = F.when(enter, r["open"]).otherwise(s["e"]), F.when(enter, r["atr"]).otherwise(s["a"]), F.when(enter, r["row_pos"]).otherwise(s["at"])
        sl, tp = e - F.col("d") * F.col("sl") * a, e + F.col("d") * F.col("tp") * a
        hit_sl = F.coalesce(F.when(F.col("d") > 0, r["low"] <= sl).otherwise(r["high"] >= sl), F.lit(False))
        hit_tp = F.coalesce(F.when(F.col("d") > 0, r["high"] >= tp).otherwise(r["low"] <= tp), F.lit(False))
        done = hit_sl | hit_tp
        row = F.struct(at.alias("entry_pos"), r["row_pos"].alias("exit_pos"), e.alias("entry"), F.when(hit_sl, sl).otherwise(tp).alias("exit"), F.when(hit_sl, "stop").otherwise("target").alias("why"))
        return F.struct(F.when(done, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"), F.when(~done, e).alias("e"), F.when(~done, a).alias("a"), F.when(~done, at).alias("at"))

    end = F.struct(F.col("s.at").alias("entry_pos"), F.col("last").alias("exit_pos"), F.col("s.e").alias("entry"), F.col("final").alias("exit"), F.lit("run_end").alias("why"))
    folded = runs.withColumn("s", F.aggregate("bars", zero, step))
    out = folded.select(*keys, "d", F.explode(F.when(F.col("s.e").isNotNull(), F.concat("s.out", F.array(end))).otherwise(F.col("s.out"))).alias("t"))
    return out.select(*keys, F.col("d").alias("direction"), "t.*").withColumn("pnl", F.col("direction") * (F.col("exit") - F.col("entry")))


def segments(returns: DataFrame, keys: list[str], *, size: int = CHUNK) -> DataFrame:
    """One row per run of a position in a series of pos and ret: side, entry_pos, bars and the compounded pnl."""
    turns = rolling(returns, {"_turn": lambda w: (F.col("pos") != F.coalesce(F.lag("pos").over(w), F.lit(0))).cast("int")}, back=1, key=keys, size=size)
    runs = running(turns, {"_run": ("sum", F.col("_turn"))}, keys=keys, size=size).filter("pos <> 0")
    return runs.groupBy(*keys, "_run").agg(F.first("pos").alias("side"), F.min("row_pos").alias("entry_pos"), F.count("*").alias("bars"), (F.product(1 + F.col("ret")) - 1).alias("pnl")).drop("_run")


def streaks(trades: DataFrame, pnl: str, *, keys: list[str], order: str, size: int = CHUNK) -> DataFrame:
    """Longest losing streak, longest time under the equity peak in trades, recoveries, open drawdown.

    Places of the last gain and of the last peak are carried along, so no task needs a whole key.
    """
    t = ranked(trades.select(*keys, order, pnl), keys=keys, order=[order], out="row_pos", span=size).drop("n")
    place = F.col("row_pos")
    at = {"keys": keys, "size": size}
    t = running(t, {"_eq": ("sum", F.col(pnl)), "_gain": ("max", F.when(~F.coalesce(F.col(pnl) < 0, F.lit(False)), place))}, **at)
    t = running(t, {"_peak": ("max", F.col("_eq"))}, **at).withColumn("_fall", F.least(F.col("_eq") - F.greatest("_peak", F.lit(0.0)), F.lit(0.0)))
    t = running(t, {"_top": ("max", F.when(F.col("_fall") >= 0, place))}, **at)
    t = rolling(t, {"_back": lambda w: ((F.col("_fall") >= 0) & (F.lag("_fall").over(w) < 0)).cast("int")}, back=1, key=keys, size=size)
    since = lambda c: F.max(place - F.coalesce(F.col(c), F.lit(-1)))
    return t.groupBy(*keys).agg(since("_gain").alias("losing_streak"), since("_top").alias("underwater_trades"), F.sum(F.coalesce("_back", F.lit(0))).alias("recoveries"), (F.max_by("_fall", place) < 0).alias("open_underwater"), F.round(F.min("_fall"), 6).alias("max_drawdown"))
