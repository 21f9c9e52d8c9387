"""Rolling, expanding and exponential features of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.functions import ratio

from .scan import CHUNK, framed, range_running, ranked, rolling


def sigma_score(bars: DataFrame, n: int = 180, x: str = "ret", out: str = "sigma") -> DataFrame:
    """x in standard deviations of the n values before it, the current one excluded."""
    mean, sd = framed(F.avg, F.col(x), -n, -1), framed(F.stddev_samp, F.col(x), -n, -1)
    return rolling(bars, {out: lambda w: ratio(F.col(x) - mean(w), sd(w))}, back=n)


def percentile_rank(bars: DataFrame, n: int, least: int | None = None, x: str = "ret", out: str = "pct_rank") -> DataFrame:
    """Average-tie percentile rank of the last value among the last n non-null ones."""

    def make(w):
        frame = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
        below, same = F.size(F.filter(frame, lambda v: v < F.col(x))), F.size(F.filter(frame, lambda v: v == F.col(x)))
        return F.when(F.col(x).isNotNull() & (F.size(frame) >= (n if least is None else least)), (below + (same + 1) / 2) / F.size(frame))

    return rolling(bars, {out: make}, back=n)


def expanding_percentile(bars: DataFrame, x: str, *, least: int = 180, out: str = "exp_pct", key: str = "symbol", size: int = CHUNK) -> DataFrame:
    """Share of past and current non-null values at most the current one; null before `least` of them.

    Counts are dominance counts over dyadic blocks of places: a value at place p (counting
    values) meets, for every set bit of p, one complete block before it.  A row takes part in one
    block per level, so the work is n log n.  Blocks of more than `size` places are counted over
    ranges of their values, smaller ones each in a window of its own: no task needs a whole series.
    """
    valued = ranked(bars.filter(F.col(x).isNotNull()).select(key, "row_pos", F.col(x).alias("v")), keys=[key], order=["row_pos"], out="p", span=size)
    # As a query at level b when bit b of p is set: the block ((p >> b) - 1); as data: the block p >> b when it is even.
    levels = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(F.bin(F.col("n") - 1)) - 1)))
    rows = valued.select(key, "row_pos", "p", "v", levels.alias("b")).withColumn("block", F.expr("shiftright(p, b)"))
    rows = rows.withColumn("asks", (F.col("block") % 2).cast("int")).withColumn("block", F.col("block") - F.col("asks"))
    whole = F.expr(f"shiftleft(1L, b + 1) > {size}")
    w = Window.partitionBy(key, "b", "block").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    short = rows.filter(~whole).withColumn("k", F.sum(1 - F.col("asks")).over(w))
    long = range_running(rows.filter(whole), keys=[key, "b", "block"], order=["v", "asks", "row_pos"], x=1 - F.col("asks"), out="k")
    below = short.unionByName(long).filter("asks = 1")
    sums = below.groupBy(key, "row_pos").agg(F.sum("k").alias("k"))
    share = valued.join(sums, [key, "row_pos"], "left").select(key, "row_pos", ((F.coalesce("k", F.lit(0)) + 1) / (F.col("p") + 1)).alias("s"), "p")
    told = share.select(key, "row_pos", F.when(F.col("p") + 1 >= least, F.col("s")).alias(out))
    return bars.join(told, [key, "row_pos"], "left")


def slope(bars: DataFrame, x: str, n: int, out: str = "slope", least: int = 2) -> DataFrame:
    """Regression slope of the last n values on their places."""
    make = lambda w: F.when(F.count(x).over(w.rowsBetween(-(n - 1), 0)) >= least, F.regr_slope(x, F.col("row_pos").cast("double")).over(w.rowsBetween(-(n - 1), 0)))
    return rolling(bars, {out: make}, back=n)


def exponential_mean(bars: DataFrame, x: str, alpha: float, *, least: int = 1, out: str = "ema", key: str = "symbol", chunk: int = 256) -> DataFrame:
    """Recursive mean y = (1 - alpha) * y + alpha * x from the first non-null x; nulls hold y.

    Inside a chunk y is an affine function of what the chunk before ends with; the fold runs per
    chunk and a second, short fold carries the ends along.
    """
    whole = F.struct(*[F.col(c) for c in bars.columns]).alias("row")
    seq = F.sort_array(F.collect_list(F.struct("row_pos", F.col(x).cast("double").alias("x"), whole)))
    chunks = bars.withColumn("_c", F.floor(F.col("row_pos") / chunk)).groupBy(key, "_c").agg(seq.alias("rows"))
    # (weight of the carry, own part, values seen, first value): with no carry the first value starts the mean
    start = F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("add"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("solo"))

    def step(s: Column, v: Column) -> Column:
        none = v.isNull()
        return F.struct(
            F.when(none, s["keep"]).otherwise(s["keep"] * (1 - alpha)).alias("keep"),
            F.when(none, s["add"]).otherwise(s["add"] * (1 - alpha) + alpha * v).alias("add"),
            F.when(none, s["n"]).otherwise(s["n"] + 1).alias("n"),
            F.when(none, s["solo"]).otherwise(F.coalesce(s["solo"] * (1 - alpha) + alpha * v, v)).alias("solo"),
        )

    ends = chunks.withColumn("end", F.aggregate("rows", start, lambda s, r: step(s, r["x"])))
    join = lambda s, r: F.struct(F.coalesce(s["y"] * r["end"]["keep"] + r["end"]["add"], r["end"]["solo"], s["y"]).alias("y"), (s["n"] + r["end"]["n"]).alias("n"))
    zero = F.struct(F.array().cast("array<struct<_c:bigint,y:double,n:bigint>>").alias("out"), F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).cast("bigint").alias("n")).alias("at"))
    note = lambda s, r: F.struct(F.concat(s["out"], F.array(F.struct(r["_c"].alias("_c"), s["at"]["y"].alias("y"), s["at"]["n"].alias("n")))).alias("out"), join(s["at"], r).alias("at"))
    per_key = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_c", "end"))).alias("ends"))
    carries = per_key.select(key, F.explode(F.aggregate("ends", zero, note)["out"]).alias("c")).select(key, F.col("c._c").alias("_c"), F.struct("c.y", "c.n").alias("carry"))
    carried = chunks.join(carries, [key, "_c"])
    first = F.struct(F.array().cast("array<struct<y:double,n:bigint>>").alias("out"), F.col("carry.y").alias("y"), F.col("carry.n").alias("n"))

    def replay(s: Column, r: Column) -> Column:
        y = F.when(r["x"].isNull(), s["y"]).otherwise(F.coalesce(s["y"] * (1 - alpha) + alpha * r["x"], r["x"]))
        n = s["n"] + r["x"].isNotNull().cast("bigint")
        return F.struct(F.concat(s["out"], F.array(F.struct(y.alias("y"), n.alias("n")))).alias("out"), y.alias("y"), n.alias("n"))

    done = carried.select(F.explode(F.arrays_zip("rows", F.aggregate("rows", first, replay)["out"].alias("out"))).alias("r"))
    return done.select("r.rows.row.*", F.when(F.col("r.out.n") >= least, F.col("r.out.y")).alias(out))


def span_alpha(span: float) -> float:
    return 2 / (span + 1)


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's directional index: plus_di, minus_di, dx and adx."""
    up, down = (lambda w: F.col("high") - F.lag("high").over(w)), (lambda w: F.lag("low").over(w) - F.col("low"))
    prev = lambda w: F.lag("close").over(w)
    moves = rolling(
        bars,
        {
            "_plus": lambda w: F.when((up(w) > down(w)) & (up(w) > 0), up(w)).otherwise(0.0),
            "_minus": lambda w: F.when((down(w) > up(w)) & (down(w) > 0), down(w)).otherwise(0.0),
            "_tr": lambda w: F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev(w)), F.abs(F.col("low") - prev(w))),
        },
        back=1,
    )
    for x in ("_plus", "_minus", "_tr"):
        moves = exponential_mean(moves, x, 1 / n, least=n, out=f"{x}_mean")
    moves = moves.withColumns({"plus_di": 100 * ratio(F.col("_plus_mean"), F.col("_tr_mean")), "minus_di": 100 * ratio(F.col("_minus_mean"), F.col("_tr_mean"))})
    moves = moves.withColumn("dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return exponential_mean(moves, "dx", 1 / n, least=n, out="adx").drop("_plus", "_minus", "_tr", "_plus_mean", "_minus_mean", "_tr_mean")


def quantile_bucket(df: DataFrame, x: str, labels: list[str], *, keys: list[str] | None = None, out: str = "bucket") -> DataFrame:
    """Bucket by interpolated quantile edges, right-closed, duplicate edges dropped, ties together."""
    keys = keys or ["symbol"]
    q = len(labels)
    inner = [k / q for k in range(1, q)]
    edges = df.groupBy(*keys).agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(p) for p in [0.0, *inner, 1.0]]))).alias("_edges"))
    names = F.array(*[F.lit(v) for v in labels])
    at = F.size(F.filter(F.slice("_edges", 2, q), lambda e: e < F.col(x)))
    return df.join(edges, keys, "left").withColumn(out, F.when(F.col(x).isNotNull() & (F.size("_edges") > 1), F.element_at(names, at + 1))).drop("_edges")


def rolling_vwap(bars: DataFrame, n: int, z: int) -> DataFrame:
    """Typical price, rolling VWAP, relative deviation from it and its rolling z-score."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    b = bars.withColumn("typical", typical)
    pv, v = framed(F.sum, F.col("typical") * F.col("volume"), -(n - 1), 0), framed(F.sum, F.col("volume"), -(n - 1), 0)
    b = rolling(b, {"vwap": lambda w: ratio(pv(w), v(w))}, back=n).withColumn("deviation", ratio(F.col("close"), F.col("vwap")) - 1)
    mean, sd = framed(F.avg, F.col("deviation"), -(z - 1), 0), framed(F.stddev_samp, F.col("deviation"), -(z - 1), 0)
    return rolling(b, {"vwap_z": lambda w: ratio(F.col("deviation") - mean(w), sd(w))}, back=z)


def forward_paths(bars: DataFrame, h: int, *, lag: int = 1, entry: str = "open", leave: str = "close", leave_bar: int | None = None, last_bar: int | None = None, clamp: bool = False, log: bool = True, adverse_bps: float = 0.0) -> DataFrame:
    """Entry after `lag` bars, exit h bars after the signal, adverse and favourable excursions between.

    last_bar is the last bar of the path (h by default); leave_bar the one whose `leave` field is
    the exit price.  All is null where the path runs past the last bar.
    """
    last_bar, leave_bar = h if last_bar is None else last_bar, h if leave_bar is None else leave_bar
    reach = max(lag, last_bar, leave_bar)
    measure = (lambda a, b: F.log(a / b)) if log else (lambda a, b: a / b - 1)
    b = rolling(
        bars,
        {
            "entry_price": lambda w: (F.lead(entry, lag).over(w) if lag else F.col(entry)) * (1 + adverse_bps / 1e4),
            "exit_price": lambda w: F.lead(leave, leave_bar).over(w),
            "path_low": lambda w: F.min("low").over(w.rowsBetween(min(lag, last_bar) or 1, last_bar)),
            "path_high": lambda w: F.max("high").over(w.rowsBetween(min(lag, last_bar) or 1, last_bar)),
            "_whole": lambda w: F.lead("close", reach).over(w).isNotNull(),
        },
        ahead=reach,
    )
    e, whole = F.col("entry_price"), F.col("_whole")
    mae, mfe = measure(F.col("path_low"), e), measure(F.col("path_high"), e)
    if clamp:
        mae, mfe = F.least(mae, F.lit(0.0)), F.greatest(mfe, F.lit(0.0))
    return b.withColumns({"path_ret": F.when(whole, measure(F.col("exit_price"), e)), "mae": F.when(whole, mae), "mfe": F.when(whole, mfe)}).drop("_whole", "path_low", "path_high")


def valid_forward(bars: DataFrame, h: int, step_seconds: int, out: str = "valid_forward") -> DataFrame:
    """Whether each of the next h steps is exactly one interval."""
    t = F.unix_timestamp("ts")
    b = rolling(bars, {"_step": lambda w: F.unix_timestamp(F.lead("ts").over(w)) - t}, ahead=1)
    frame = lambda w: w.rowsBetween(0, h - 1)
    ok = lambda w: (F.count("_step").over(frame(w)) == h) & (F.min("_step").over(frame(w)) == step_seconds) & (F.max("_step").over(frame(w)) == step_seconds)
    return rolling(b, {out: ok}, ahead=h).drop("_step")
