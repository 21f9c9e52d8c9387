"""Queries on families of strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan.operators import families as Y
from barspan.operators import positions as T

from .registry import query
from .tables import hourly, hourly_sql

P = "PARTITION BY symbol ORDER BY row_pos"
GATES = [(), ("calm", 20, 1.0), ("efficient", 20, 0.2), ("trend", 200)]
SMA, EMA = [(10, 60), (20, 60), (10, 120), (20, 120), (40, 120)], [(10, 60), (20, 60), (10, 120), (20, 120)]
CHANNELS, BANDS = [(20, 10), (40, 20), (60, 30), (90, 45), (120, 60)], [(n, z, 0.2) for n in (20, 50) for z in (1.5, 2.0, 2.5)]
GRID = [
    *[Y.Row(f, p, g, s) for f, pairs in (("sma_cross", SMA), ("ema_cross", EMA)) for p in pairs for g in GATES for s in (0, 1, -1)],
    *[Y.Row("channel", p, g) for p in CHANNELS for g in GATES],
    *[Y.Row("reversion", p, (), s) for p in BANDS for s in (0, 1, -1)],
]


def _map(names: list[int], make) -> str:
    return "MAP {" + ", ".join(f"{n}: {make(n)}" for n in names) + "}"


def _rows() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    out = []
    for r in GRID:
        p, g = (*r.params, None, None)[:3], (*r.gate, None, None, None)[:3]
        out.append(f"('{r.name}', '{r.family}', {p[0]}, {text(p[1])}::DOUBLE, {text(p[2])}::DOUBLE, {text(g[0])}, {text(g[1])}::INT, {text(g[2])}::DOUBLE, {r.side})")
    return ", ".join(out)


_mean = lambda n: f'CASE WHEN row_pos >= {n - 1} THEN avg("close") OVER ({P} ROWS {n - 1} PRECEDING) END'
_past = lambda f, x: lambda n: f"CASE WHEN row_pos >= {n} THEN {f}({x}) OVER ({P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
SPANS = sorted({n for p in EMA for n in p})
MEANS = sorted({n for p in SMA for n in p} | {n for n, _, _ in BANDS} | {200})
WIDTHS = sorted({n for p in CHANNELS for n in p})
#: One step a bar: the family's own state, then the gate's.
SIGNALS = f"""WITH RECURSIVE {hourly_sql()}, em AS (SELECT symbol, row_pos, {', '.join(f'"close" AS e{n}' for n in SPANS)} FROM bars WHERE row_pos = 0 UNION ALL SELECT b.symbol, b.row_pos, {', '.join(f'e{n} * (1 - 2 / {n + 1}) + b."close" * 2 / {n + 1}' for n in SPANS)} FROM em JOIN bars b ON b.symbol = em.symbol AND b.row_pos = em.row_pos + 1),
t AS (SELECT *, greatest(high - low, abs(high - lag("close") OVER ({P})), abs(low - lag("close") OVER ({P}))) AS tr, abs("close" - lag("close") OVER ({P})) AS step FROM bars),
x AS MATERIALIZED (SELECT t.symbol, t.row_pos, "close" AS cl, {_map(MEANS, _mean)} AS sma, {_map(sorted({n for n, _, _ in BANDS}), lambda n: f'CASE WHEN row_pos >= {n - 1} THEN stddev_samp("close") OVER ({P} ROWS {n - 1} PRECEDING) END')} AS sd,
  {_map(WIDTHS, _past('max', 'high'))} AS hi, {_map(WIDTHS, _past('min', 'low'))} AS lo, {_map(SPANS, lambda n: f'CASE WHEN row_pos >= {n - 1} THEN e{n} END')} AS ema, CASE WHEN row_pos >= 19 THEN avg(tr) OVER ({P} ROWS 19 PRECEDING) END / "close" AS calm, CASE WHEN row_pos >= 20 THEN abs("close" - lag("close", 20) OVER ({P})) / nullif(sum(step) OVER ({P} ROWS 19 PRECEDING), 0) END AS er
  FROM t JOIN em USING (symbol, row_pos)),
st(strategy, family, a, b, z_out, gate, gn, g, side) AS (VALUES {_rows()}),
s AS (SELECT DISTINCT symbol, strategy, family, a, b, z_out, gate, gn, g, side, -1::BIGINT AS row_pos, 0 AS want, 0 AS state FROM x, st
UNION ALL SELECT symbol, strategy, family, a, b, z_out, gate, gn, g, side, row_pos, now, CASE WHEN now = state THEN state WHEN now = 0 THEN 0 WHEN state = 0 AND NOT ok THEN 0 WHEN trend IS NOT NULL AND now <> trend THEN 0 ELSE now END
FROM (SELECT *, CASE family WHEN 'sma_cross' THEN coalesce(sign(m1 - m2)::INT, 0) WHEN 'ema_cross' THEN coalesce(sign(x1 - x2)::INT, 0)
  WHEN 'channel' THEN CASE WHEN h1 IS NULL OR l2 IS NULL THEN 0 WHEN want = 0 THEN CASE WHEN cl > h1 THEN 1 WHEN cl < l1 THEN -1 ELSE 0 END WHEN want = 1 THEN CASE WHEN cl < l2 THEN CASE WHEN cl < l1 THEN -1 ELSE 0 END ELSE 1 END ELSE CASE WHEN cl > h2 THEN CASE WHEN cl > h1 THEN 1 ELSE 0 END ELSE -1 END END
  ELSE CASE WHEN z IS NULL THEN 0 WHEN want = 0 THEN CASE WHEN z > b THEN -1 WHEN z < -b THEN 1 ELSE 0 END WHEN want = 1 THEN CASE WHEN z >= -z_out THEN 0 ELSE 1 END ELSE CASE WHEN z <= z_out THEN 0 ELSE -1 END END END AS now
FROM (SELECT s.symbol, strategy, family, a, b, z_out, gate, gn, g, side, x.row_pos, want, state, cl, sma[a] AS m1, sma[b::INT] AS m2, ema[a] AS x1, ema[b::INT] AS x2, hi[a] AS h1, lo[a] AS l1, hi[b::INT] AS h2, lo[b::INT] AS l2, (cl - sma[a]) / nullif(sd[a], 0) AS z,
  CASE gate WHEN 'calm' THEN coalesce(calm < g, false) WHEN 'efficient' THEN coalesce(er >= g, false) ELSE true END AS ok, CASE gate WHEN 'trend' THEN coalesce(sign(cl - sma[gn])::INT, 0) END AS trend FROM s JOIN x ON x.symbol = s.symbol AND x.row_pos = s.row_pos + 1))),
sg AS MATERIALIZED (SELECT symbol, strategy, row_pos, CASE WHEN side <> 0 AND state <> side THEN 0 ELSE state END AS sig FROM s WHERE row_pos >= 0)"""


@query("t01_families", f"""{SIGNALS}, ps AS (SELECT sg.*, coalesce(lag(sig) OVER q, 0) AS pos, coalesce(lag(sig, 2) OVER q, 0) AS was, cl / lag(cl) OVER q - 1 AS mv FROM sg JOIN x USING (symbol, row_pos) WINDOW q AS (PARTITION BY symbol, strategy ORDER BY row_pos))
SELECT symbol, strategy, count(*) FILTER (sig = 1) AS longs, count(*) FILTER (sig = -1) AS shorts, sum(abs(pos - was))::BIGINT AS turnover, round(sum(coalesce(pos * mv, 0) - 0.0005 * abs(pos - was)), 6) AS total FROM ps GROUP BY ALL""")
def t01_families(spark, sf):
    """Crosses of simple and exponential means, channels and reversion, gated by range, efficiency and trend and held to sides: all rows of the grid in one job."""
    s = Y.signals(hourly(spark, sf).select("symbol", "row_pos", "high", "low", "close"), GRID)
    r = T.bar_returns(s, ["symbol", "strategy"], cost=0.0005)
    n = lambda v: F.count_if(F.col("sig") == v)
    return r.groupBy("symbol", "strategy").agg(n(1).alias("longs"), n(-1).alias("shorts"), F.sum("turnover").cast("bigint").alias("turnover"), F.round(F.sum("ret"), 6).alias("total"))
