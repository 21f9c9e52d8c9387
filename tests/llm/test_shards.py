"""Shards hold whole documents, and one repeated id does not fill a bucket alone."""

import glob
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.llm import common, sharding


def test_op4_writes_the_texts_into_shards(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "new_path", lambda s, name: f"file://{tmp_path}/{name}")
    rows = sharding.op4_shuffle_shards(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {}
    for file in glob.glob(f"{tmp_path}/shards/shard=*/*.parquet"):
        part = pd.read_parquet(file, partitioning=None)
        assert part["slot"].is_monotonic_increasing
        shard = int(file.split("shard=")[1].split("/")[0])
        held |= {(shard, r.slot): (r.doc_id, r.text) for r in part.itertuples()}
    assert len(held) == len(docs) == len(rows)
    assert all(held[r.shard, r.slot] == (r.doc_id, docs[r.doc_id]) for r in rows)


@pytest.mark.parametrize("repeated", [7, None])
def test_rows_of_one_id_are_split_over_buckets(spark, repeated, monkeypatch, tmp_path):
    ids = [repeated] * 400 + list(range(100, 200))
    rows = spark.createDataFrame([(k, f"text {n}") for n, k in enumerate(ids)], "doc_id bigint, text string")
    salted, total = sharding._salted(rows, "doc_id", F.lit(64), 2048)
    buckets = -(-total // 2048)
    per = salted.groupBy(F.pmod(sharding.scatter_key("doc_id", 17), F.lit(buckets))).count().collect()
    assert len(ids) == sum(r["count"] for r in per) and max(r["count"] for r in per) < 120
    got = sharding.shard(rows, shards=6, bucket_bytes=2048).collect()
    assert sorted(r.text for r in got) == sorted(f"text {n}" for n in range(500))
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(6)}
    assert all(x == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} <= {83, 84}


def test_cut_and_shards_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.shard(none).count() == 0 == common.cut(none, "none").count()


def test_shards_do_not_depend_on_how_the_input_is_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = F.octet_length("text")
    place = lambda rows: {(r.doc_id, r.shard, r.slot) for r in rows.collect()}
    one = place(sharding.shard(docs.repartition(1), row_bytes=size, bucket_bytes=1 << 16))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert place(sharding.shard(docs.repartition(5, "text"), row_bytes=size, bucket_bytes=1 << 16)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_query_digests_what_the_shards_hold(spark, sf_dir):
    rows = sharding.op4_shuffle_shards(spark, sf_dir).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {(i, len(t) + 8, zlib.crc32(t), "rows", None) for i, t in docs.items()}
    by = [sorted(r.slot for r in rows if r.shard == s) for s in range(24)]
    assert len(rows) == len(docs) and all(v == list(range(len(v))) for v in by) and max(map(len, by)) - min(map(len, by)) <= 1
