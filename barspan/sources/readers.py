"""Scans: declared schemas read as text first, so that what does not parse can be counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")
#: Other names of bar columns, in lower case.
ALIASES = {"time": "timestamp", "datetime": "timestamp", "date_time": "timestamp", "<date>": "date", "<time>": "clock", "o": "open", "h": "high", "l": "low", "c": "close", "vol": "volume", "tickvol": "volume", "<open>": "open", "<high>": "high", "<low>": "low", "<close>": "close", "<tickvol>": "volume"}
SIDE_ALIASES = {"fundingTime": "funding_time_ms", "fundingRate": "funding_rate", "markPrice": "funding_mark_price"}


def typed(raw: DataFrame, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy.MM.dd HH:mm")) -> DataFrame:
    """Text columns to ts and doubles; what does not parse is null."""
    stamp = F.coalesce(*[F.try_to_timestamp("timestamp", F.lit(f)) for f in formats])
    numbers = {c: F.expr(f"try_cast({c} as double)") for c in BAR_COLUMNS[1:] if c in raw.columns}
    return raw.withColumn("ts", stamp).withColumns(numbers).drop("timestamp")


def read_bars(spark: SparkSession, paths, *, sep: str = "\t", typed_columns: bool = True, folders: bool = False) -> DataFrame:
    """Headerless bar files; the symbol is the file's name up to the first dot or underscore digits, or that of its folder symbol=NAME.

    ingest_seq keeps the order of ingestion for deduplication: by the files' times, then their
    paths, then the place in a file.
    """
    schema = ", ".join(f"{c} string" for c in BAR_COLUMNS)
    raw = spark.read.schema(schema).option("sep", sep).csv(paths)
    name = F.upper(F.col("symbol").cast("string") if folders else F.regexp_extract("_metadata.file_name", r"^([A-Za-z]+)", 1))
    file = [F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start")]
    seq = F.struct(*file, F.monotonically_increasing_id().alias("row"))
    raw = raw.select(*BAR_COLUMNS, name.alias("symbol"), seq.alias("ingest_seq"))
    return typed(raw) if typed_columns else raw


def strict_bars(raw: DataFrame) -> DataFrame:
    """Drop blank and short rows, volume 0 where missing; a number that does not parse fails the job."""
    filled = raw.filter(F.trim(F.coalesce("timestamp", F.lit(""))) != "").filter("close is not null")
    number = lambda c: F.when(F.col(c).isNull(), F.lit(0.0) if c == "volume" else F.lit(None)).otherwise(F.coalesce(F.expr(f"try_cast({c} as double)"), F.raise_error(F.concat(F.lit(f"bad {c}: "), F.col(c))).cast("double")))
    return filled.withColumns({c: number(c) for c in BAR_COLUMNS[1:]})


def map_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Columns by known names, date and clock merged into timestamp; by position where no name is known."""
    names = {c: {**ALIASES, **(aliases or {})}.get(c.strip().lower(), c.strip().lower()) for c in df.columns}
    known = set(names.values()) & {*BAR_COLUMNS, "date", "clock"}
    if len(known) < 4:
        parts = len(df.columns)
        by_place = ["date", "clock", *BAR_COLUMNS[1:]] if parts >= 7 else list(BAR_COLUMNS)
        names = dict(zip(df.columns, by_place, strict=False))
    out = df.withColumnsRenamed(names)
    if "timestamp" not in out.columns and {"date", "clock"} <= set(out.columns):
        out = out.withColumn("timestamp", F.concat_ws(" ", "date", "clock")).drop("date", "clock")
    elif "timestamp" not in out.columns and "date" in out.columns:
        out = out.withColumnRenamed("date", "timestamp")
    return out.select(*[c for c in BAR_COLUMNS if c in out.columns])


def read_side_series(spark: SparkSession, paths, *, ts: str, symbols: list[str] | None = None) -> DataFrame:
    """Headered side series with ts parsed and the symbols asked for."""
    out = spark.read.option("header", True).csv(paths)
    out = out.withColumn(ts, F.try_to_timestamp(F.col(ts)))
    return out.filter(F.col("symbol").isin(symbols)) if symbols else out


def coverage(series: DataFrame, *, ts: str, symbols: list[str], start, end) -> DataFrame:
    """One row: whether every symbol is there and all reach over the range."""
    per = series.filter(F.col("symbol").isin(symbols)).groupBy("symbol").agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    whole = (F.col("a") <= F.lit(start).cast("timestamp")) & (F.col("b") >= F.lit(end).cast("timestamp"))
    return per.agg(F.count("*").alias("symbols"), F.coalesce(F.bool_and(whole), F.lit(False)).alias("reach")).withColumn("covered", (F.col("symbols") == len(symbols)) & F.col("reach"))


def read_table(spark: SparkSession, path: str, *, timeframe: str, pairs: list[str], since: str) -> DataFrame:
    """Rows of a table by timeframe, pair and first date; the filters reach the scan."""
    return spark.read.parquet(path).filter((F.col("timeframe") == timeframe) & F.col("pair").isin(pairs) & (F.col("ts") >= F.lit(since).cast("timestamp")))


def read_yields(spark: SparkSession, paths, *, currency: str, tenors: list[str], source: str = "file") -> DataFrame:
    """A yield table under a title row: '-' is null, one row for each date and tenor."""
    raw = spark.read.schema(", ".join(["d string", *[f"`{t}` string" for t in tenors]])).option("nullValue", "-").csv(paths)
    day = F.coalesce(F.try_to_timestamp("d", F.lit("yyyy/M/d")), F.try_to_timestamp("d", F.lit("yyyy-MM-dd"))).cast("date")
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tenor"), F.expr(f"try_cast(`{t}` as double)").alias("yield_percent")) for t in tenors])).alias("r")
    out = raw.withColumn("observation_date", day).filter("observation_date is not null").select("observation_date", rows).select("observation_date", "r.*")
    return out.filter("yield_percent is not null").withColumns({"currency": F.lit(currency), "source": F.lit(source), "quality_status": F.lit("official")})


def epoch_rows(rows: DataFrame, *, ms: str, out: str, numbers: list[str], keys: list[str]) -> DataFrame:
    """Epoch-millisecond rows: whole-second timestamps, numbers parsed, one row per key."""
    stamp = F.date_trunc("second", F.timestamp_millis(F.expr(f"try_cast({ms} as bigint)")))
    return rows.withColumn(out, stamp).withColumns({c: F.expr(f"try_cast({c} as double)") for c in numbers}).dropDuplicates([*keys, out])
