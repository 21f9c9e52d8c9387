"""Families of strategies and three-state machines against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspan.operators import families as Y
from barspan.operators import positions

ROWS = [Y.Row("sma_cross", (3, 9)), Y.Row("sma_cross", (3, 9), ("trend", 20), -1), Y.Row("ema_cross", (3, 9), ("efficient", 5, 0.4), 1), Y.Row("channel", (8, 4)), Y.Row("channel", (8, 4), ("calm", 5, 0.02)), Y.Row("reversion", (6, 1.0, 0.2)), Y.Row("reversion", (6, 1.0, 0.2), ("trend", 20))]


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(12)
    rows = []
    for s, n in (("A", 180), ("B", 5)):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(s, k, float(c[k] * 1.004), float(c[k] * 0.996), float(c[k])) for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, row_pos bigint, high double, low double, close double").repartition(3)


def loop(row, high, low, close):
    n = len(close)
    mean = lambda k, i: close[i - k + 1 : i + 1].mean() if i >= k - 1 else None

    def ema(k):
        out, y = [], None
        for i, x in enumerate(close):
            y = x if y is None else y + 2 / (k + 1) * (x - y)
            out.append(y if i >= k - 1 else None)
        return out

    sign = lambda a, b: 0 if a is None or b is None else int(np.sign(a - b))
    emas = {k: ema(k) for k in row.params[:2]} if row.family == "ema_cross" else {}
    want, state, out = 0, 0, []
    for i in range(n):
        p = row.params
        if row.family == "sma_cross":
            want = sign(mean(p[0], i), mean(p[1], i))
        elif row.family == "ema_cross":
            want = sign(emas[p[0]][i], emas[p[1]][i])
        elif row.family == "channel":
            if i < max(p):
                want = 0
            else:
                hi, lo, xhi, xlo = high[i - p[0] : i].max(), low[i - p[0] : i].min(), high[i - p[1] : i].max(), low[i - p[1] : i].min()
                c = close[i]
                if want == 0:
                    want = 1 if c > hi else -1 if c < lo else 0
                elif want == 1 and c < xlo:
                    want = -1 if c < lo else 0
                elif want == -1 and c > xhi:
                    want = 1 if c > hi else 0
        else:
            if i < p[0] - 1:
                want = 0
            else:
                z = (close[i] - mean(p[0], i)) / close[i - p[0] + 1 : i + 1].std(ddof=1)
                if want == 0:
                    want = -1 if z > p[1] else 1 if z < -p[1] else 0
                elif (want == 1 and z >= -p[2]) or (want == -1 and z <= p[2]):
                    want = 0
        ok, trend = True, None
        if row.gate and row.gate[0] == "trend":
            trend = sign(close[i], mean(row.gate[1], i))
        elif row.gate and row.gate[0] == "efficient":
            k = row.gate[1]
            ok = i >= k and abs(close[i] - close[i - k]) / np.abs(np.diff(close[i - k : i + 1])).sum() >= row.gate[2]
        elif row.gate:
            k = row.gate[1]
            tr = [max(high[j] - low[j], *([abs(high[j] - close[j - 1]), abs(low[j] - close[j - 1])] if j else [0])) for j in range(i - k + 1, i + 1)] if i >= k - 1 else None
            ok = tr is not None and np.mean(tr) / close[i] < row.gate[2]
        if want != state and want != 0 and ((state == 0 and not ok) or (trend is not None and want != trend)):
            state = 0
        else:
            state = want
        out.append(0 if row.side and state != row.side else state)
    return out


def test_families_match_the_loop(bars):
    got = {}
    for r in Y.signals(bars, ROWS).collect():
        got.setdefault((r.symbol, r.strategy), {})[r.row_pos] = r.sig
    for s in ("A", "B"):
        own = sorted(bars.filter(F.col("symbol") == s).collect(), key=lambda r: r.row_pos)
        high, low, close = (np.array([r[c] for r in own]) for c in ("high", "low", "close"))
        for row in ROWS:
            assert [got[s, row.name][k] for k in range(len(own))] == loop(row, high, low, close), row.name
    assert len({r.name for r in ROWS}) == len(ROWS) and any(v for v in got["A", ROWS[4].name].values())


def test_reversal_may_go_flat_first(spark):
    """Up, then down: with flip the machine turns in one bar, without it is flat for one."""
    df = spark.createDataFrame([("s", k, z) for k, z in enumerate([0.0, -2.0, 2.0, 2.0, -2.0, 0.0])], "symbol string, row_pos bigint, z double")
    z = F.col("z")
    run = lambda flip: [r.sig for r in positions.hysteresis(df, z < -1, z > 1, z < -0.5, z > 0.5, keys=["symbol"], chunk=2, flip=flip).orderBy("row_pos").collect()]
    assert run(True) == [0, 1, -1, -1, 1, 0] and run(False) == [0, 1, 0, -1, 0, 0]
