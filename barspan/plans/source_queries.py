"""Round trips through files: what is written is read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspan import sources as S
from barspan.operators.bars import clean
from barspan.operators.store import fresh_path

from .registry import query
from .tables import hourly, hourly_sql, table

H = hourly_sql()
PRICES = ("open", "high", "low", "close", "volume")


def _text_rows(spark, sf):
    """Hourly bars as text rows; every tenth row is written twice, first with another close."""
    b = hourly(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    return b.select("symbol", "row_pos", stamp, *[F.col(c).cast("string").alias(c) for c in PRICES])


@query("s01_bar_files", f"WITH {H} SELECT upper(symbol) AS symbol, epoch(ts)::BIGINT AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(\"close\", 6) AS \"close\", volume FROM bars")
def s01(spark, sf):
    """Headerless files by symbol; of repeated rows the one ingested last stays, in the order of files and rows."""
    rows = _text_rows(spark, sf)
    path = fresh_path(spark, "bar-files")
    old = rows.filter("row_pos % 10 = 0").withColumn("close", F.lit("1"))
    for part in (old, rows):  # two files a symbol, the second written later
        part.drop("row_pos").repartition("symbol").write.mode("append").option("sep", "\t").partitionBy("symbol").csv(path)
    b = clean(S.read_bars(spark, path, folders=True))
    return b.select("symbol", F.unix_timestamp("ts").alias("ts"), *[F.round(c, 6).alias(c) for c in PRICES[:4]], "volume")


@query("s02_tolerant_bars", f"WITH {H} SELECT symbol, count(*) AS rows, round(sum(CASE WHEN row_pos % 7 = 0 THEN 0 ELSE volume END), 6) AS volume, round(sum(\"close\"), 4) AS \"close\" FROM bars GROUP BY symbol")
def s02(spark, sf):
    """Blank and short rows go, missing volumes count as 0."""
    rows = _text_rows(spark, sf).withColumn("volume", F.when(F.col("row_pos") % 7 != 0, F.col("volume")))
    none = F.lit(None).cast("string")
    blank = rows.filter("row_pos % 5 = 0").withColumn("timestamp", F.lit("  "))
    short = rows.filter("row_pos % 5 = 1").withColumns({"close": none, "volume": none})
    b = S.strict_bars(rows.unionByName(blank).unionByName(short))
    return b.groupBy("symbol").agg(F.count("*").alias("rows"), F.round(F.sum("volume"), 6).alias("volume"), F.round(F.sum("close"), 4).alias("close"))


@query("s03_mapped_columns", f"WITH {H} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, round(\"close\", 6) AS \"close\" FROM bars")
def s03(spark, sf):
    """Columns under other names and a date apart from its time."""
    rows = _text_rows(spark, sf)
    out = None
    for name in ("purchase", "click", "view", "signup", "error"):
        own = rows.filter(F.col("symbol") == name)
        day, clock = F.split("timestamp", " ")[0], F.split("timestamp", " ")[1]
        named = own.select(day.alias("<DATE>"), clock.alias("<TIME>"), F.col("open").alias("O"), F.col("high").alias("H"), F.col("low").alias("L"), F.col("close").alias("C"), F.col("volume").alias("TickVol"))
        mapped = S.map_columns(named).select(F.lit(name).alias("symbol"), "timestamp", F.round(F.col("close").cast("double"), 6).alias("close"))
        out = mapped if out is None else out.unionByName(mapped)
    return out


@query("s04_side_coverage", """WITH m AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS t FROM events GROUP BY ALL), p AS (SELECT symbol, min(t) AS a, max(t) AS b FROM m WHERE symbol IN ('view', 'click') GROUP BY symbol)
SELECT count(*) AS symbols, coalesce(bool_and(a <= TIMESTAMP '2024-01-02' AND b >= TIMESTAMP '2024-01-10'), false) AS reach, count(*) = 2 AND coalesce(bool_and(a <= TIMESTAMP '2024-01-02' AND b >= TIMESTAMP '2024-01-10'), false) AS covered, (SELECT count(*) FROM m WHERE symbol IN ('view', 'click')) AS rows FROM p""")
def s04(spark, sf):
    """A headered side series of two symbols, read back, and whether it covers a range."""
    e = table(spark, sf, "events")
    side = e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").alias("t")).agg(F.avg("value").alias("rate"))
    path = fresh_path(spark, "side")
    S.write_results(side.withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss")), path)
    found = S.read_side_series(spark, path, ts="t", symbols=["view", "click"])
    told = S.coverage(found, ts="t", symbols=["view", "click"], start="2024-01-02", end="2024-01-10")
    return told.join(F.broadcast(found.agg(F.count("*").alias("rows"))), F.lit(True))


@query("s05_table_scan", f"WITH {H} SELECT symbol AS pair, count(*) AS n, round(sum(\"close\"), 4) AS total FROM bars WHERE symbol IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-05' GROUP BY symbol")
def s05(spark, sf):
    """A table by timeframe, pairs and first date; the filters reach the scan."""
    path = fresh_path(spark, "bars-table")
    hourly(spark, sf).withColumnRenamed("symbol", "pair").withColumn("timeframe", F.lit("60m")).write.parquet(path)
    return S.read_table(spark, path, timeframe="60m", pairs=["view", "click"], since="2024-01-05").groupBy("pair").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query("s06_yield_table", """WITH y AS (SELECT o_orderdate::DATE AS d, round(max(o_totalprice) FILTER (o_orderpriority < '2'), 2) AS a, round(max(o_totalprice) FILTER (o_orderpriority >= '5'), 2) AS b FROM orders GROUP BY d)
SELECT d::VARCHAR AS observation_date, tenor, v AS yield_percent FROM (SELECT d, unnest(['2Y', '10Y']) AS tenor, unnest([a, b]) AS v FROM y) WHERE v IS NOT NULL""")
def s06(spark, sf):
    """A yield table with '-' for missing values: one row for each date and tenor."""
    p, x = F.col("o_orderpriority"), F.col("o_totalprice")
    y = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.round(F.max(F.when(p < "2", x)), 2).alias("a"), F.round(F.max(F.when(p >= "5", x)), 2).alias("b"))
    path = fresh_path(spark, "yields")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    y.select(F.date_format("d", "yyyy/M/d"), text("a"), text("b")).write.csv(path)
    return S.read_yields(spark, path, currency="JPY", tenors=["2Y", "10Y"]).select(F.col("observation_date").cast("string").alias("observation_date"), "tenor", "yield_percent")


@query("s07_epoch_rows", "SELECT epoch(date_trunc('second', ts))::BIGINT AS t, count(DISTINCT event_type) AS n FROM events WHERE ts IS NOT NULL GROUP BY date_trunc('second', ts)")
def s07(spark, sf):
    """Epoch-millisecond text to whole seconds, one row per key."""
    e = table(spark, sf, "events").filter("ts is not null").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ms"), F.col("value").cast("string").alias("value"))
    return S.epoch_rows(e, ms="ms", out="at", numbers=["value"], keys=["event_type"]).groupBy(F.unix_timestamp("at").alias("t")).agg(F.count("*").alias("n"))


@query("s08_fixed_text", f"WITH {H} SELECT symbol, row_pos::VARCHAR AS row_pos, printf('%.4f', \"close\") AS \"close\" FROM bars")
def s08(spark, sf):
    """CSV files with fixed places and a byte order mark, read back as text."""
    path = fresh_path(spark, "fixed")
    S.write_results(hourly(spark, sf).select("symbol", "row_pos", "close"), path, digits=4, fixed=True, bom=True)
    return S.read_results(spark, path)


@query("s09_return_matrix", f"WITH {H}, r AS (SELECT symbol, ts, \"close\" / lag(\"close\") OVER (PARTITION BY symbol ORDER BY row_pos) - 1 AS ret FROM bars) SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(max(ret) FILTER (symbol = 'view'), 8) AS \"view\", round(max(ret) FILTER (symbol = 'click'), 8) AS click FROM r WHERE ret IS NOT NULL GROUP BY ts")
def s09(spark, sf):
    """The return matrix as gzip CSV, one column for each strategy."""
    from .profile_queries import returns

    r = returns(hourly(spark, sf), "simple").filter("ret is not null")
    path = fresh_path(spark, "matrix")
    S.export_wide(r.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("symbol").alias("strategy_id"), "ret"), path, ["view", "click"])
    return spark.read.option("header", True).csv(path).select("ts", *[F.round(F.col(c).cast("double"), 8).alias(c) for c in ("view", "click")])


@query("s10_json_summary", f"WITH {H} SELECT symbol, count(*) AS bars, round(min(low), 6) AS low, round(max(high), 6) AS high FROM bars GROUP BY symbol")
def s10(spark, sf):
    """A summary of nested results as JSON lines."""
    g = hourly(spark, sf).groupBy("symbol").agg(F.count("*").alias("bars"), F.struct(F.min("low").alias("low"), F.max("high").alias("high")).alias("range"))
    path = fresh_path(spark, "summary")
    S.write_json_summary(g, path)
    return spark.read.schema(g.schema).json(path).select("symbol", "bars", F.round("range.low", 6).alias("low"), F.round("range.high", 6).alias("high"))
