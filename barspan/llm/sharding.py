"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records uniformly into buckets of bounded memory by a seeded hash of their
identity.  Pass two gathers one bucket in each task, permutes it (Spark's shuffle() swaps
as Fisher and Yates do, seeded by the bucket) and writes it; a bucket's place in the whole order is the sum of the sizes
before it.  Dealing that order round the shards gives row counts that differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, read_table


def scatter_key(id_col: str, seed: int) -> Column:
    """Seeded hash of a record's id and, where its id tells it from too few others, of its own number."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col("_salt"))


def _salted(records: DataFrame, id_col: str, size: Column, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Records with _salt, and their bytes in all.

    Rows without an id, and rows of an id that fills more than a bucket, get numbers as _salt; they
    are written first, so that every later pass sees the same ones.  The others have null.
    """
    weights = cut(records.groupBy(F.col(id_col).alias("_id")).agg(F.sum(size).alias("bytes")).select("_id", "bytes", (F.col("_id").isNull() | (F.col("bytes") > bucket_bytes)).alias("odd")), "weights")
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    odd = weights.filter("odd").select("_id")
    plain = records.withColumn("_salt", F.lit(None).cast("bigint"))
    if odd.isEmpty():
        return plain, total
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    numbered = cut(records.join(odd, same, "semi").withColumn("_salt", F.monotonically_increasing_id()), "numbered")
    return plain.join(odd, same, "anti").unionByName(numbered), total


def shard(records: DataFrame, *, shards: int = 24, seed: int = 17, id_col: str = "doc_id", row_bytes: Column | None = None, bucket_bytes: int = 8 << 20, path: str | None = None) -> DataFrame:
    """Write every record into its shard, under path/shard=K, and read all back with shard (0..shards-1) and slot (gapless from 0 in each shard).

    Law `rows`: shard sizes differ by one row at most.  All columns are kept; row_bytes is an
    estimate of a record's size (64 where not given) that sets the number of buckets.  Null ids,
    repeated rows and ties are records like any other; an empty table gives an empty result.  Seed,
    rows and bucket_bytes decide the shards, not how the input is split or the number of shuffle
    partitions (but for rows without an id and those of an id that fills a bucket, which are numbered).
    Columns named shard or slot are replaced.  Without a path the shards lie in the shared folder;
    each file is ordered by slot and holds the rows of one or a few buckets.
    """
    spark = records.sparkSession
    records = records.drop("shard", "slot")
    size = F.coalesce(row_bytes.cast("bigint"), F.lit(0)) + 64 if row_bytes is not None else F.lit(64)
    salted, total = _salted(records, id_col, size, bucket_bytes)
    buckets = max(1, -(-total // bucket_bytes))
    key = scatter_key(id_col, seed)
    # Buckets follow from ids and written numbers alone, so sizes may be counted before the records move.
    sizes = salted.groupBy(F.pmod(key, F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))
    # Sums over spans of 1,024 buckets first, so that no task orders them all.
    spans = cut(sizes.withColumn("span", F.floor(F.col("bucket") / 1024)), "sizes")
    upto = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.groupBy("span").agg(F.sum("n").alias("all")).withColumn("start", upto(Window.orderBy("span"), "all"))
    inside = spans.withColumn("inside", upto(Window.partitionBy("span").orderBy("bucket"), "n"))
    places = cut(inside.join(starts, "span").select("bucket", (F.col("start") + F.col("inside")).alias("before")), "places")
    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    # Equal keys are put in order by the whole record, so that a bucket's order follows from what it holds.
    scattered = salted.select(F.struct(key.alias("key"), F.xxhash64(whole).alias("tie"), whole.alias("record")).alias("row"))
    scattered = scattered.withColumn("bucket", F.pmod(F.col("row.key"), F.lit(buckets)).cast("int")).repartitionById(buckets, "bucket")
    gathered = scattered.groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    first = lambda a, b, name, other: F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(other)
    in_order = F.array_sort("rows", lambda a, b: first(a, b, "key", first(a, b, "tie", F.lit(0))))
    shuffled = gathered.select("bucket", F.posexplode(F.shuffle(in_order, seed)).alias("rank", "row"))
    place = F.col("before") + F.col("rank")
    placed = shuffled.join(places, "bucket").withColumn("_place", place).select("row.record.*", F.floor(F.col("_place") / shards).cast("bigint").alias("slot"), F.pmod("_place", F.lit(shards)).cast("int").alias("shard"))
    # One pass writes the shards; what follows reads one attempt's output only.
    path = path or new_path(spark, "shards")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select(*[F.col(f"`{c}`") for c in records.columns], "shard", "slot")


def write_shards(sharded: DataFrame, path: str, *, rows_per_file: int = 1 << 20) -> None:
    """Write each shard as Parquet files ordered by slot, under path/shard=K."""
    files = max(1, -(-sharded.count() // rows_per_file))
    ranged = sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)


def op4_shuffle_shards(spark, sf_dir: str) -> DataFrame:
    """Whole documents go into the shards; sizes and digests are taken from what the shards hold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sharded = shard(docs, row_bytes=F.octet_length(text))
    return sharded.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
