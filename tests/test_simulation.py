"""Resampled paths, strategies with stops, thinning, range sums and p values against plain loops and known values."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspan import functions as fn
from barspan.operators import bars as B
from barspan.operators import events, features, montecarlo, positions, scan, stats, stops

CELLS = [*[(m, 1.0, 0.0) for m in montecarlo.METHODS], ("iid", 3.0, 0.002)]


def path_loop(net):
    equity, peak, worst, streak, longest, ruined = 1.0, 1.0, 1.0, 0, 0, False
    for r in net:
        ruined |= 1 + r <= 0
        equity *= max(1 + r, 0)
        peak = max(peak, equity)
        worst = min(worst, equity / peak)
        streak = streak + 1 if r < 0 else 0
        longest = max(longest, streak)
    return equity, worst, longest, ruined


@pytest.mark.parametrize("block", [1, 4, 1000])
@pytest.mark.parametrize("ruin", [False, True])
def test_path_summaries_merge(spark, block, ruin):
    rng = np.random.default_rng(block)
    nets = {k: rng.normal(0, 0.2, n) for k, n in (("a", 1), ("b", 37), ("c", 200))}
    nets["d"], nets["e"] = np.full(9, -0.1), np.full(9, 0.0)
    if ruin:
        nets["b"][20], nets["c"][0] = -1.5, -1.0
    rows = [(k, i, float(v)) for k, x in nets.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, pos bigint, x double").repartition(4)
    got = {r.k: r for r in montecarlo.summarise_paths(df, keys=["k"], order="pos", x="x", block=block).collect()}
    for k, x in nets.items():
        want = path_loop(x)
        np.testing.assert_allclose([got[k].equity, got[k].worst], want[:2], rtol=1e-12)
        assert (got[k].streak, got[k].ruined, got[k].n) == (*want[2:], len(x))


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(9)
    rows = [(g, t, ["calm", "wild", None][t % 3], float(rng.normal(0, 0.1))) for g, n in (("a", 1), ("b", 23), ("c", 60)) for t in range(n)]
    rows += [("b", 900, "calm", None), (None, 1, "calm", 0.1)]
    return spark.createDataFrame(rows, "g string, t bigint, state string, x double").repartition(3)


def test_arrays_and_joins_draw_the_same_paths(values):
    run = lambda **k: sorted(map(tuple, montecarlo.simulate(values, keys=["g"], x="x", order=["t"], cells=CELLS, runs=12, label="state", **k).select("g", "method", "leverage", "cost", "run", "streak", "ruined", "n", F.round("equity", 9), F.round("worst", 9)).collect()))
    whole = run()
    assert len(whole) == 3 * (1 + 6 * 12)
    assert run(most=0, span=7) == whole == run(most=30, task_values=100)


def test_original_and_shuffle_keep_every_value(values):
    paths = montecarlo.simulate(values, keys=["g"], x="x", order=["t"], cells=CELLS, runs=12, label="state").filter("cost = 0 and method in ('original', 'shuffle')").collect()
    held = {g: [r.x for r in sorted(values.filter(F.col("g") == g).collect(), key=lambda r: r.t) if r.x is not None] for g in "abc"}
    for r in paths:
        assert math.isclose(r.equity, math.prod(1 + v for v in held[r.g]), rel_tol=1e-9)
        if r.method == "original":
            np.testing.assert_allclose((r.equity, r.worst, r.streak), path_loop(held[r.g])[:3], rtol=1e-9)


def test_draws_are_even():
    d = montecarlo._draws("s", "k", np.arange(200), np.arange(500)) % np.uint32(10)
    share = np.bincount(d.ravel(), minlength=10) / d.size
    assert abs(share - 0.1).max() < 0.005 and len({tuple(r) for r in d.tolist()}) == 200


def returns_loop(o, h, lo, c, s, cost, n_atr=14):
    n = len(o)
    tr = [max(h[i] - lo[i], *(abs(x[i] - c[i - 1]) if i else 0 for x in (h, lo))) for i in range(n)]
    ma = lambda k, i: np.mean(c[i - k + 1 : i + 1]) if i >= k - 1 else math.nan
    ret, pos, entry_stop = np.zeros(n - 1), 0, (None, None)
    for i in range(n - 1):
        a, b = (ma(k, i - 1) if i else math.nan for k in (s.short_ma, s.long_ma))
        want = 0 if math.isnan(a) or math.isnan(b) else int(np.sign(a - b))
        atr = np.mean(tr[i - n_atr : i]) if i >= n_atr else math.nan
        if want != pos:
            if pos:
                ret[i] -= cost / o[i]
            pos = 0
            if want and not ((s.stop is not None or s.target is not None) and math.isnan(atr)):
                pos = want
                ret[i] -= cost / o[i]
                entry_stop = (None if s.stop is None else o[i] - pos * s.stop * atr, None if s.target is None else o[i] + pos * s.target * atr)
        if not pos:
            continue
        stop, target = entry_stop
        hit_stop = stop is not None and (lo[i] <= stop if pos > 0 else h[i] >= stop)
        hit_target = target is not None and (h[i] >= target if pos > 0 else lo[i] <= target)
        if hit_stop or hit_target:
            price = stop if hit_stop else target
            ret[i] += pos * (price - o[i]) / o[i] - cost / abs(price)
            pos = 0
        else:
            ret[i] += pos * (o[i + 1] - o[i]) / o[i]
    if pos:
        ret[-1] -= cost / o[-1]
    return ret


def price_rows(n, seed, drift=0.0):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(drift, 0.01, n)))
    o = np.r_[100.0, c[:-1]] * np.exp(rng.normal(0, 0.002, n))
    return o, np.maximum(o, c) * 1.004, np.minimum(o, c) * 0.996, c


@pytest.mark.parametrize("size", [16, 8192])
def test_stopped_returns_match_the_loop(spark, size):
    """Small chunks: trades and whole trends run over several of them."""
    made = {"walk": price_rows(300, 4), "trend": price_rows(200, 5, 0.02), "two": price_rows(2, 6), "one": price_rows(1, 7)}
    rows = [(k, i, *(float(x[i]) for x in v)) for k, v in made.items() for i in range(len(v[0]))]
    df = spark.createDataFrame(rows, "symbol string, row_pos bigint, open double, high double, low double, close double").repartition(3)
    grid = stops.average_strategies([2, 5], [9, 20], [None, 1.0], [None, 1.5])
    got = stops.stopped_returns(df, grid, cost=0.05, size=size).toPandas()
    for name, (o, h, lo, c) in made.items():
        for k, s in enumerate(grid):
            mine = got[(got["symbol"] == name) & (got["strategy"] == k)].sort_values("row_pos")
            assert mine["row_pos"].tolist() == list(range(len(o) - 1))
            np.testing.assert_allclose(mine["ret"], returns_loop(o, h, lo, c, s, 0.05) if len(o) > 1 else [], atol=1e-12)


def test_first_touch_matches_the_scan():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        low, high = rng.normal(0, 1, n), rng.normal(0, 1, n) + 1
        below, above = rng.normal(-1.5, 1, n), rng.normal(2.5, 1, n)
        below[::3], above[::4] = np.nan, np.nan
        want = [next((u for u in range(t, n) if low[u] <= below[t] or high[u] >= above[t]), n) for t in range(n)]
        assert stops.first_touch(low, high, below, above).tolist() == want


@pytest.mark.parametrize("size", [5, 64, 8192])
def test_thinning_is_greedy_in_any_chunks(spark, size):
    rng = np.random.default_rng(size)
    made = {s: np.flatnonzero(rng.uniform(size=500) < share).tolist() for s, share in (("dense", 0.95), ("thin", 0.05), ("one", 0.003))}
    made["one"] = made["one"][:1] or [3]
    leave = {(s, p): int(p + rng.integers(0, 40) * (rng.uniform() < 0.3)) for s, at in made.items() for p in at}
    rows = [(s, p, leave[s, p]) for s, at in made.items() for p in at]
    df = spark.createDataFrame([*rows, ("dense", None, 3), (None, 4, 9)], "symbol string, entry_pos bigint, exit_pos bigint").repartition(3)
    got, numbers = {}, {}
    for r in events.non_overlapping(df, keys=["symbol"], size=size).collect():
        got.setdefault(r.symbol, []).append(r.entry_pos)
        numbers[r.symbol, r.entry_pos] = r.trade_no
    cool = {}
    for r in events.cooldown(df, 7, order="entry_pos", size=size).collect():
        cool.setdefault(r.symbol, []).append(r.entry_pos)
    for s, at in made.items():
        kept, until, quiet, last = [], -1, [], None
        for p in at:
            if p > until:
                kept.append(p)
                until = leave[s, p]
            if last is None or p - last >= 7:
                quiet.append(p)
                last = p
        assert sorted(got[s]) == kept and [numbers[s, p] for p in kept] == list(range(1, len(kept) + 1))
        assert sorted(cool[s]) == quiet


def test_range_sums_spread_a_hot_key(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 20_000).alias("v"))
    got = scan.range_running(df, keys=["k"], order=["v"], x=F.lit(1), out="s")
    assert got.filter("s <> v + 1").count() == 0 and got.count() == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in df.repartitionByRange("k", "v").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * np.median(sizes)


@pytest.mark.parametrize("size", [8, 8192])
def test_expanding_percentile_cuts_long_blocks_by_value(spark, size):
    rng = np.random.default_rng(1)
    rows = [("A", k, None if k % 9 == 4 else float(rng.integers(0, 30))) for k in range(300)] + [("B", 0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, row_pos bigint, x double")
    got = {(r.symbol, r.row_pos): r.exp_pct for r in features.expanding_percentile(df, "x", least=5, size=size).collect()}
    seen = []
    for s, k, v in rows[:300]:
        seen += [] if v is None else [v]
        want = None if v is None or len(seen) < 5 else np.mean(np.array(seen) <= v)
        assert got[s, k] is None if want is None else math.isclose(got[s, k], want)
    assert got["B", 0] is None


def test_average_ranks_match_ties(spark):
    x = [3.0, 1.0, 3.0, 2.0, None, 3.0, 1.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)], "k string, i int, x double")
    got = {r.i: r.r for r in stats.average_ranks(df, ["k"], "x", "r").collect()}
    assert got == {0: 5.0, 1: 1.5, 2: 5.0, 3: 3.0, 4: None, 5: 5.0, 6: 1.5}


def test_anatomy_of_a_fall(spark):
    """A hand-worked series: peak at 1, trough at 4, worst step at 3; two bars under water at the end."""
    steps = [0.1, 0.2, -0.1, -0.3, -0.05, 0.5, -0.01, -0.02]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(steps)] + [("up", 0, 0.1), ("down", 0, -0.2), ("down", 1, None)], "k string, row_pos bigint, r double")
    got = {r.k: r for r in stats.drawdown_anatomy(df, "r", keys=["k"], order="row_pos").collect()}
    a = got["a"]
    assert (a.peak, a.trough, a.worst_at, a.under, a.still_under) == (1, 4, 3, 3, True)
    assert math.isclose(a.depth, math.exp(-0.45) - 1) and math.isclose(a.worst_step, math.exp(-0.3) - 1) and math.isclose(a.worst_share, 0.3 / 0.45)
    assert set(got) == {"a", "down"} and (got["down"].peak, got["down"].trough, got["down"].worst_share) == (-1, 0, 1.0)


@pytest.mark.parametrize("size", [3, 8192])
def test_streaks_match_the_loop(spark, size):
    rng = np.random.default_rng(4)
    made = {"a": rng.normal(0, 1, 60), "b": np.array([-1.0, -1.0]), "c": np.array([1.0, -0.5, 0.5, -2.0])}
    df = spark.createDataFrame([(k, int(3 * i), float(v)) for k, x in made.items() for i, v in enumerate(x)], "k string, at bigint, pnl double")
    got = {r.k: r for r in positions.streaks(df, "pnl", keys=["k"], order="at", size=size).collect()}
    for k, x in made.items():
        eq = np.cumsum(x)
        under = eq < np.maximum(np.maximum.accumulate(eq), 0)
        longest = lambda flags: max((len(r) for r in "".join("x" if f else " " for f in flags).split()), default=0)
        back = sum(bool(under[i - 1] and not under[i]) for i in range(1, len(x)))
        r = got[k]
        assert (r.losing_streak, r.underwater_trades, r.recoveries, r.open_underwater) == (longest(x < 0), longest(under), back, bool(under[-1]))


def test_p_values_and_quantiles_of_known_tables(spark):
    """Two-sided t tables, the normal distribution, and the incomplete beta function in closed form."""
    one = spark.range(1)
    at = lambda c: one.select(c.alias("v")).first().v
    for t, v, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 10_000, 0.05), (0.0, 5, 1.0), (-2.086, 20, 0.05)):
        assert abs(at(fn.t_p_value(F.lit(t), F.lit(v))) - p) < 1e-4
    assert at(fn.t_p_value(F.lit(1.0), F.lit(0))) is None
    assert math.isclose(at(fn.t_p_value(F.lit(3.0), F.lit(1))), 1 - 2 / math.pi * math.atan(3.0), rel_tol=1e-12)
    assert math.isclose(at(fn.beta_share(F.lit(2.0), F.lit(3.0), F.lit(0.4))), 6 * 0.4**2 * 0.6**2 + 4 * 0.4**3 * 0.6 + 0.4**4, rel_tol=1e-12)
    assert math.isclose(at(fn.log_gamma(F.lit(10.5))), math.lgamma(10.5), rel_tol=1e-12)
    for z in (-6.0, -1.0, 0.0, 0.3, 3.9, 4.1, 9.0, 30.0):
        assert math.isclose(at(fn.normal_tail(F.lit(z))), math.erfc(z / math.sqrt(2)) / 2, rel_tol=1e-9, abs_tol=1e-300)
    for p in (1e-9, 0.001, 0.3, 0.5, 0.9, 0.9999):
        assert math.isclose(at(fn.normal_quantile(F.lit(p))), NormalDist().inv_cdf(p), rel_tol=1e-7, abs_tol=1e-12)
    assert at(fn.normal_quantile(F.lit(1.0))) is None and at(fn.correlation_p_value(F.lit(0.5), F.lit(3))) is None
    assert math.isclose(at(fn.correlation_p_value(F.lit(0.3), F.lit(40))), math.erfc(abs(math.atanh(0.3)) * math.sqrt(37) / math.sqrt(2)), rel_tol=1e-10)


def test_coarser_bars_equal_bars_of_ticks(spark):
    start = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(3)
    ticks = spark.createDataFrame([("A", start + dt.timedelta(seconds=int(s)), float(p), k) for k, (s, p) in enumerate(zip(np.sort(rng.integers(0, 90_000, 400)), rng.uniform(1, 9, 400), strict=True))], "s string, t timestamp, p double, k int")
    of = lambda step: B.ticks_to_bars(ticks, symbol="s", ts="t", price="p", tie=["k"], step_seconds=step)
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    got = B.coarser(of(900), [3600, 14400])
    for step in (3600, 14400):
        assert sorted(map(tuple, got.filter(F.col("step") == step).select(cols).collect())) == sorted(map(tuple, of(step).select(cols).collect()))


def test_panels_and_blocked_correlations(spark):
    """More symbols than a block, gaps, a flat symbol and repeated rows, against pandas."""
    import pandas as pd

    from barspan.operators import panel

    rng = np.random.default_rng(8)
    names = [f"s{k:03d}" for k in range(20)]
    x = rng.normal(size=(60, 20))
    x[:, 3] = 1.5
    x[rng.uniform(size=x.shape) < 0.2] = np.nan
    x[7] = rng.normal(size=20)
    rows = [(names[k], t, float(x[t, k])) for t in range(60) for k in range(20) if not np.isnan(x[t, k])]
    df = spark.createDataFrame([*rows, rows[0], (None, 1, 2.0), ("s001", 3, None)], "symbol string, ts int, ret double").repartition(5)
    assert panel.symbols_of(df) == names
    whole = panel.panel(df, "ret", names=names).orderBy("ts").collect()
    assert [r.ts for r in whole] == [t for t in range(60) if not np.isnan(x[t]).any()] and np.allclose(whole[0]["values"], x[whole[0].ts])
    spread = panel.panel(df, "ret", names=names, whole=False).withColumn("g", F.when(F.col("ts") < 30, "a").otherwise("b"))
    got = {(r.g, r.i, r.j): r.r for r in panel.pair_correlations(spread, 20, group="g", block=6).collect()}
    for g, part in (("a", x[:30]), ("b", x[30:])):
        want = pd.DataFrame(part).corr(min_periods=2).to_numpy()
        for i in range(20):
            for j in range(i + 1, 20):
                assert got[g, i, j] is None if np.isnan(want[i, j]) else math.isclose(got[g, i, j], want[i, j], rel_tol=1e-9, abs_tol=1e-12)


def test_folds_come_from_the_data(spark):
    from barspan.operators import selection

    start = dt.datetime(2020, 1, 31, 5)
    days = spark.createDataFrame([(start + dt.timedelta(days=k),) for k in range(1200)], "ts timestamp")
    got = selection.month_folds(days).orderBy("fold").collect()
    assert [r.fold for r in got] == list(range(len(got))) and got[0].a == start and got[0].b == dt.datetime(2022, 1, 31, 5) and got[1].a == dt.datetime(2020, 4, 30, 5)
    assert all(r.d <= start + dt.timedelta(days=1199) for r in got) and len(got) == 3
    grown = selection.month_folds(days, expanding=True).orderBy("fold").collect()
    assert {r.a for r in grown} == {start} and [r.c for r in grown] == [r.c for r in got]
    assert selection.month_folds(days.limit(0)).count() == 0 == selection.month_folds(days.limit(5)).count()


def test_scores_need_trades_and_punish_drawdown(spark):
    from barspan.operators import selection

    cols = ["sharpe", "max_drawdown", "trades", "total", "profit_factor"]
    row = {"t_sharpe": 1.0, "t_max_drawdown": -0.1, "t_trades": 9, "t_total": -0.05, "t_profit_factor": 1.0, "v_sharpe": 3.0, "v_max_drawdown": -0.2, "v_trades": 2, "v_total": 0.1, "v_profit_factor": 9.0}
    score = lambda **k: spark.createDataFrame([tuple({**row, **k}.values())], list(row)).select(selection.selection_score({c: F.col(f"t_{c}") for c in cols}, {c: F.col(f"v_{c}") for c in cols}).alias("s")).first().s
    assert math.isclose(score(), 0.7 * 3 + 0.3 - 0.35 * 1 - 0.4 - 0.5 + 0.1 * math.log(5))
    assert score(t_trades=7) is None and score(v_trades=1) is None
    assert score(v_max_drawdown=-0.3) < score() < score(t_total=0.1)
