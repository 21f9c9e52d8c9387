"""Sequential operators against plain loops, chunked scans against whole ones, readers and writers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan import sources
from barspan.operators import asof, events, features, positions, resample, scan, stats


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    rows = []
    for symbol, n in (("AAA", 700), ("BBB", 260), ("ONE", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for k in range(n):
            o = close[k - 1] if k else 100.0
            rows.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(hours=k), float(o), float(max(o, close[k]) * 1.004), float(min(o, close[k]) * 0.996), float(close[k]), float(rng.integers(1, 9)), k))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, row_pos bigint").cache()


def by_symbol(df, column):
    pdf = df.orderBy("symbol", "row_pos").toPandas()
    return {s: g[column].to_numpy() for s, g in pdf.groupby("symbol")}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(np.asarray(a[k], float), np.asarray(b[k], float), rtol=1e-9, atol=1e-12, equal_nan=True)


def pandas_of(bars, f):
    pdf = bars.orderBy("symbol", "row_pos").toPandas()
    return {s: f(g.reset_index(drop=True)).to_numpy() for s, g in pdf.groupby("symbol")}


@pytest.mark.parametrize("size", [32, 8192])
def test_rolling_is_the_same_in_chunks(bars, size):
    got = scan.rolling(bars, {"m": scan.framed(F.avg, F.col("close"), -19, 0, 5), "f": lambda w: F.lead("close", 7).over(w)}, back=20, ahead=7, size=size)
    same(by_symbol(got, "m"), pandas_of(bars, lambda g: g.close.rolling(20, min_periods=5).mean()))
    same(by_symbol(got, "f"), pandas_of(bars, lambda g: g.close.shift(-7)))


@pytest.mark.parametrize("size", [17, 8192])
def test_running_is_the_same_in_chunks(bars, size):
    got = scan.running(bars, {"s": ("sum", F.col("volume")), "x": ("max", F.col("close")), "l": ("last", F.when(F.col("volume") > 6, F.col("volume")))}, keys=["symbol"], size=size)
    same(by_symbol(got, "s"), pandas_of(bars, lambda g: g.volume.cumsum()))
    same(by_symbol(got, "x"), pandas_of(bars, lambda g: g.close.cummax()))
    same(by_symbol(got, "l"), pandas_of(bars, lambda g: g.volume.where(g.volume > 6).ffill()))


def test_positions_count_across_spans(bars):
    got = scan.positions(bars.drop("row_pos"), span="day")
    same(by_symbol(got, "row_pos"), pandas_of(bars, lambda g: g.row_pos))


def test_expanding_percentile_counts_all_before(bars):
    with_gaps = bars.withColumn("x", F.when(F.col("row_pos") % 7 != 3, F.round("close", 0)))
    got = features.expanding_percentile(with_gaps, "x", least=10)

    def loop(g):
        out, seen = [], []
        for v in g.x:
            if v != v:
                out.append(np.nan)
                continue
            seen.append(v)
            out.append(np.mean(np.array(seen) <= v) if len(seen) >= 10 else np.nan)
        return pd.Series(out)

    same(by_symbol(got, "exp_pct"), {s: loop(g.reset_index(drop=True)).to_numpy() for s, g in with_gaps.orderBy("symbol", "row_pos").toPandas().groupby("symbol")})


@pytest.mark.parametrize("chunk", [16, 256])
def test_exponential_mean_carries_over_chunks(bars, chunk):
    late = bars.withColumn("x", F.when(F.col("row_pos") >= 20, F.col("close")))
    got = features.exponential_mean(late, "x", 0.1, least=3, chunk=chunk)
    same(by_symbol(got, "ema"), pandas_of(late, lambda g: g.x.ewm(alpha=0.1, adjust=False, min_periods=3).mean()))


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_and_selection_are_greedy(spark, seed):
    rng = np.random.default_rng(seed)
    at = np.flatnonzero(rng.uniform(size=400) < 0.4)
    ev = spark.createDataFrame([("S", int(p), int(p + 1), int(p + 1 + rng.integers(1, 15))) for p in at], "symbol string, row_pos bigint, entry_pos bigint, exit_pos bigint")
    kept, last = [], None
    for p in at:
        if last is None or p - last >= 9:
            kept.append(p)
            last = p
    assert sorted(r.row_pos for r in events.cooldown(ev, 9).collect()) == kept
    chosen, until = [], -1
    for r in sorted(ev.collect(), key=lambda r: r.entry_pos):
        if r.entry_pos > until:
            chosen.append(r.entry_pos)
            until = r.exit_pos
    assert sorted(r.entry_pos for r in events.non_overlapping(ev, keys=["symbol"]).collect()) == chosen
    assert events.cooldown(ev.limit(0), 9).count() == 0


@pytest.mark.parametrize("chunk", [13, 256])
def test_hysteresis_matches_the_loop(bars, chunk):
    b = scan.rolling(bars, {"z": lambda w: F.col("close") / F.avg("close").over(w.rowsBetween(-9, 0)) - 1}, back=10)
    z = F.col("z")
    got = by_symbol(positions.hysteresis(b, z > 0.01, z < -0.01, z > 0.002, z < -0.002, keys=["symbol"], chunk=chunk), "sig")

    def loop(g):
        s, out = 0, []
        for v in g.z:
            up, down, su, sd = v > 0.01, v < -0.01, v > 0.002, v < -0.002
            s = (1 if up else -1 if sd else 0) if s == -1 else (1 if up else -1 if down else 0) if s == 0 else (-1 if down else 1 if su else 0)
            out.append(s)
        return pd.Series(out)

    same(got, pandas_of(b, loop))


@pytest.mark.parametrize("size", [3, 50])
def test_positions_and_trades_are_the_same_in_chunks(bars, size):
    ranged = bars.withColumn("atr", F.when(F.col("row_pos") > 20, F.col("high") - F.col("low")))
    signals = positions.average_cross(ranged, [(3, 9), (5, 20)])
    keys = ["symbol", "short_ma", "long_ma"]
    makers = [
        lambda n: positions.positions_of(signals, keys, delay=2, size=n).select(*keys, "row_pos", "pos", "turnover"),
        lambda n: positions.bar_returns(signals, keys, cost=0.001, size=n).select(*keys, "row_pos", "pos", "ret"),
        lambda n: positions.trade_log(signals, keys, cost=0.5, size=n),
        lambda n: positions.stopped_trades(signals, keys, stop=F.lit(1.5), target=F.lit(None), size=n),
        lambda n: positions.segments(positions.bar_returns(signals, keys), keys, size=n).withColumn("pnl", F.round("pnl", 10)),
    ]
    for make in makers:
        cut, whole = ([str(r) for r in make(n).collect()] for n in (size, 1 << 20))
        assert whole and sorted(cut) == sorted(whole)


def test_asof_joins_match_the_loop(spark):
    """Spans without side rows, ties of distance, exact matches, stale values, null keys and times."""
    rng, start = np.random.default_rng(8), dt.datetime(2021, 1, 1)
    at = lambda days: start + dt.timedelta(days=int(days))
    left = [(k, s, at(d)) for k, (s, d) in enumerate((s, d) for s in ("A", "B", "C") for d in rng.integers(0, 400, 40))]
    left += [(900, None, at(5)), (901, "A", None)]
    right = [(s, at(d), float(d)) for s in ("A", "B") for d in sorted(set(rng.integers(50, 350, 9).tolist()))]
    right += [(None, at(5), -1.0), ("A", None, -2.0)]
    lf = spark.createDataFrame(left, "id int, symbol string, ts timestamp")
    rt = spark.createDataFrame(right, "symbol string, side_ts timestamp, v double")
    limit = dt.timedelta(days=60)

    def want(s, t, nearest):
        sides = [(x, v) for k, x, v in right if None not in (s, t, x) and k == s and (nearest or x <= t)]
        best = min(sides, key=lambda r: (abs(r[0] - t), r[0]), default=None)
        return best[1] if best and abs(best[0] - t) <= limit else None

    for nearest, join in ((False, asof.asof_backward), (True, asof.asof_nearest)):
        got = {r["id"]: r["v"] for r in join(lf, rt, keys=["symbol"], values=["v"], tolerance=60 * 86400).collect()}
        assert got == {k: want(s, t, nearest) for k, s, t in left}

    ends = lf.withColumn("until", F.expr("ts + interval 45 days"))
    got = {r["id"]: r["interval_sum"] for r in asof.interval_sum(ends, rt, key="symbol", start="ts", end="until", ts="side_ts", value="v").collect()}
    total = lambda s, t: sum(v for k, x, v in right if x and k == s and t < x <= t + dt.timedelta(days=45))
    assert got == {k: total(s, t) if s in ("A", "B") and t else None for k, s, t in left}


def test_ols_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = [("k", float(rng.normal()), bool(rng.integers(2)), bool(rng.integers(2))) for _ in range(60)]
    got = {r.term: (r.coef, r.se) for r in stats.interaction_ols(spark.createDataFrame(rows, "k string, y double, a boolean, b boolean"), "y", F.col("a"), F.col("b"), keys=["k"]).collect()}
    y, a, b = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
    x = np.stack([np.ones(60), a, b, a * b], axis=1)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = ((y - x @ beta) ** 2).sum() / 56
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    for k, name in enumerate(("intercept", "a", "b", "a_x_b")):
        np.testing.assert_allclose(got[name], (beta[k], se[k]), rtol=1e-9)


def test_ruin_and_empty_groups(spark):
    t = spark.createDataFrame([("a", 0, 0.1), ("a", 1, -1.2), ("b", 0, None), ("c", 0, 0.5), ("c", 1, -0.5)], "k string, row_pos bigint, ret double")
    got = {r.k: r.max_drawdown for r in stats.max_drawdown(t, "ret", keys=["k"], order="row_pos", kind="compounded").collect()}
    assert got["a"] == -1.0 and got["b"] == 0.0 and abs(got["c"] + 0.5) < 1e-12


def test_block_sizes_follow_array_split(spark):
    r = spark.range(43).select(F.lit("s").alias("k"), F.col("id").alias("row_pos"), F.col("id").cast("double").alias("ret"))
    n = {x.block: x.n for x in resample.block_sums(r, strategy=["k"]).collect()}
    assert [n[k] for k in range(8)] == [len(x) for x in np.array_split(np.arange(43), 8)]


def test_readers_and_writers_round_trip(spark, tmp_path):
    (tmp_path / "USDJPY_60.csv").write_text("2020-01-01 00:00\t1\t2\t0.5\t1.5\t10\n2020-01-01 01:00\tx\t2\t1\t1\t\nbad\t1\t1\t1\t1\t1\n\n")
    got = sources.read_bars(spark, f"{tmp_path}/USDJPY_60.csv").orderBy("ingest_seq").collect()
    assert [r.symbol for r in got] == ["USDJPY"] * 3 and got[1].open is None and got[2].ts is None and got[0].close == 1.5
    raw = sources.read_bars(spark, f"{tmp_path}/USDJPY_60.csv", typed_columns=False)
    with pytest.raises(Exception, match="bad open"):
        sources.strict_bars(raw).collect()
    named = spark.createDataFrame([("2020.01.01", "00:00", "1", "2", "0", "1", "5")], "`<DATE>` string, `<TIME>` string, `<OPEN>` string, `<HIGH>` string, `<LOW>` string, `<CLOSE>` string, `<TICKVOL>` string")
    assert sources.map_columns(named).first().asDict() == {"timestamp": "2020.01.01 00:00", "open": "1", "high": "2", "low": "0", "close": "1", "volume": "5"}
    assert sources.map_columns(named.toDF(*[f"_c{k}" for k in range(7)])).first().timestamp == "2020.01.01 00:00"
    (tmp_path / "y.csv").write_text("Title row\n2020/1/6,0.1,-\n2020/1/7,-,0.3\n")
    assert [(r.tenor, r.yield_percent) for r in sources.read_yields(spark, f"{tmp_path}/y.csv", currency="JPY", tenors=["2Y", "10Y"]).orderBy("observation_date").collect()] == [("2Y", 0.1), ("10Y", 0.3)]
    ms = spark.createDataFrame([("1577836800999", "0.1"), ("1577836800999", "0.1")], "t string, rate string")
    assert sources.epoch_rows(ms, ms="t", out="ts", numbers=["rate"], keys=[]).count() == 1
    side = spark.createDataFrame([("A", dt.datetime(2020, 1, 1)), ("A", dt.datetime(2020, 2, 1))], "symbol string, ts timestamp")
    assert sources.coverage(side, ts="ts", symbols=["A"], start="2020-01-05", end="2020-01-06").first().covered
    assert not sources.coverage(side, ts="ts", symbols=["A", "B"], start="2020-01-05", end="2020-01-06").first().covered
    sources.write_results(side, f"{tmp_path}/out", partition_by=["symbol"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2
