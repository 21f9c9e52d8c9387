"""Exact deduplication by a log-structured merge index of text digests.

Each task collects (digest, best id, count) in a memtable of bounded size and flushes it as
runs sorted by digest.  Runs are range-partitioned by digest prefix and compacted bucket by
bucket: a counting filter tells which digests can lie in two runs, only those are merged, and
the merge keeps one identifier per digest.  Digests met more than once set the bits of a hit
filter of fixed size; documents that pass it are grouped by their bytes, which verifies every
hit and separates texts whose digests collide.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table, texts_of

RUN_SCHEMA = "bucket int, size int, digests binary, ids array<bigint>, counts array<bigint>"


def _digest(norm: bytes, width: int) -> tuple[bytes, bytes]:
    full = hashlib.sha256(norm).digest()
    return full, full[:width]


def _positions(digests: list[bytes], bits: int, hashes: int = 2) -> np.ndarray:
    """Filter positions of each digest, from a second hash so that short digests spread too."""
    raw = b"".join(hashlib.blake2b(d, digest_size=4 * hashes).digest() for d in digests)
    return np.frombuffer(raw, "<u4").reshape(len(digests), hashes).astype(np.int64) % bits


def _better(a, b, largest: bool):
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


def _flush(memtable: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    """A memtable as one sorted run, cut at the bucket borders."""
    rows: dict[int, list] = {}
    for d in sorted(memtable):
        rows.setdefault(int.from_bytes(d[:4].ljust(4, b"\0"), "big") * buckets >> 32, []).append(d)
    if rows:
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(list(rows), pa.int32()),
                "size": pa.array([len(v) for v in rows.values()], pa.int32()),
                "digests": pa.array([b"".join(v) for v in rows.values()], pa.binary()),
                "ids": pa.array([[memtable[d][0] for d in v] for v in rows.values()], pa.list_(pa.int64())),
                "counts": pa.array([[memtable[d][1] for d in v] for v in rows.values()], pa.list_(pa.int64())),
            }
        )


def build_runs(keys: DataFrame, *, buckets: int, largest: bool, memtable_rows: int) -> DataFrame:
    """keys(id, digest) -> sorted digest runs, one row per run and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable: dict[bytes, list] = {}
        for batch in batches:
            for i, d in zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if (old := memtable.get(d)) is None:
                    memtable[d] = [i, 1]
                    if len(memtable) >= memtable_rows:
                        yield from _flush(memtable, buckets)
                        memtable = {}
                else:
                    old[0], old[1] = _better(old[0], i, largest), old[1] + 1
        yield from _flush(memtable, buckets)

    return keys.mapInArrow(run, RUN_SCHEMA)


def compact(runs: DataFrame, *, largest: bool, filter_bits: int) -> DataFrame:
    """Merge the runs of each bucket; returns digests met more than once.

    Columns: digest, keep_id, n and the two positions in the hit filter.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        segments = []
        for size, raw, ids, counts in zip(pdf["size"], pdf["digests"], pdf["ids"], pdf["counts"], strict=True):
            width = len(raw) // size
            ids = [None if i is None or i != i else int(i) for i in ids]
            segments.append(([raw[k * width : (k + 1) * width] for k in range(size)], ids, counts))
        bits = max(64, 16 * sum(len(s[0]) for s in segments))
        seen = np.zeros(bits, np.uint8)
        places = [_positions(s[0], bits) for s in segments]
        for p in places:
            at = np.unique(p)
            seen[at] = np.minimum(seen[at] + 1, 2)
        out, open_runs = [], []
        for (digests, ids, counts), p in zip(segments, places, strict=True):
            shared = (seen[p] > 1).all(axis=1)
            out += [(d, i, int(c)) for d, i, c, s in zip(digests, ids, counts, shared, strict=True) if not s and c > 1]
            open_runs.append([(d, i, int(c)) for d, i, c, s in zip(digests, ids, counts, shared, strict=True) if s])
        last = None
        for d, i, c in heapq.merge(*open_runs, key=lambda x: x[0]):
            if last is not None and last[0] == d:
                last = (d, _better(last[1], i, largest), last[2] + c)
            else:
                if last is not None and last[2] > 1:
                    out.append(last)
                last = (d, i, c)
        if last is not None and last[2] > 1:
            out.append(last)
        p = _positions([x[0] for x in out], filter_bits)
        return pd.DataFrame(
            {
                "digest": [x[0] for x in out],
                "keep_id": pd.array([x[1] for x in out], "Int64"),
                "n": np.array([x[2] for x in out], np.int64),
                "p0": p[:, 0],
                "p1": p[:, 1],
            }
        )

    return runs.groupBy("bucket").applyInPandas(merge, "digest binary, keep_id bigint, n bigint, p0 bigint, p1 bigint")


def hit_filter(dups: DataFrame, filter_bits: int) -> np.ndarray:
    """Words of the hit filter: at most filter_bits / 64 rows reach the driver, at any input size."""
    place = F.explode(F.array("p0", "p1")).alias("p")
    words = (
        dups.select(place)
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
        .toPandas()
    )
    out = np.zeros((filter_bits + 63) // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    digest_bytes: int = 32,
    memtable_rows: int = 1 << 17,
    bucket_rows: int = 1 << 16,
    filter_bits: int | None = None,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with the
    largest (or, keep="smallest", the smallest) id stays.  Null text counts as empty, so all
    null and empty texts form one group.  A null id never wins against an id; a group of null
    ids only has keep_id null and keeps its rows.  Rows that repeat an id and text count each
    in group_size and share its kept flag.  An empty table gives an empty result, and extra
    columns are not read.
    """
    largest = keep == "largest"
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_digest(t.lower(), digest_bytes) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), pa.array([b[1] for b in both], pa.binary()), pa.array([b[0].hex() for b in both], pa.string())],
                ["id", "digest", "text_sha256"],
            )

    keys = cut(slim.mapInArrow(digests, "id bigint, digest binary, text_sha256 string"), "exact-keys")
    rows = keys.count()
    buckets = max(1, -(-rows // bucket_rows))
    # Eight bits a document and more, up to 2**30 (128 MB): past some 10**8 repeated texts more rows pass it, and none too few.
    filter_bits = filter_bits or min(1 << 30, max(1 << 23, 1 << (8 * rows).bit_length()))
    runs = build_runs(keys.select("id", "digest"), buckets=buckets, largest=largest, memtable_rows=memtable_rows)
    words = hit_filter(compact(runs, largest=largest, filter_bits=filter_bits), filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            norms = [t.lower() for t in texts_of(batch.column("text"))]
            found = [_digest(t, digest_bytes)[1] for t in norms]
            if not found:
                continue
            p = _positions(found, filter_bits)
            ok = ((bits[p >> 6] >> (p & 63)) & 1).astype(bool).all(axis=1)
            at = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()).take(pa.array(at)), pa.array([found[k] for k in at], pa.binary()), pa.array([norms[k] for k in at], pa.binary())],
                ["id", "digest", "norm"],
            )

    hit = cut(slim.mapInArrow(hits, "id bigint, digest binary, norm binary"), "exact-hits")
    best = F.max("id") if largest else F.min("id")
    groups = cut(hit.groupBy("digest", "norm").agg(best.alias("keep_id"), F.count("*").alias("n")), "exact-groups")
    verified = groups.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("n").alias("n"))
    plain = (
        keys.join(verified, "digest", "left")
        .filter(F.col("texts").isNull() | (F.col("texts") == 1))
        .select(
            "id",
            F.when(F.col("texts").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
            "text_sha256",
        )
    )
    collided = verified.filter("texts > 1").select("digest")
    apart = (
        hit.join(collided, "digest")
        .join(groups, ["digest", "norm"])
        .select("id", "keep_id", F.col("n").alias("group_size"), F.sha2("norm", 256).alias("text_sha256"))
    )
    return plain.unionByName(apart).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
