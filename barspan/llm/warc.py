"""A deterministic sharded WARC writer and its reader.

Records are sorted by range of their key; a task writes the records of its range as gzip
members and rolls to a new file by compressed size.  Headers, record ids and digests are
regenerated from the record alone, range borders come from a hash sample of the keys, so the
same input gives the same files.  A file is written under a temporary name and renamed when
whole; the manifest, committed last, names the files that count, so that what failed or doubled
attempts leave behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read_table, texts_of

MANIFEST = "file string, part int, records bigint, bytes bigint, sha256 string"
RECORD = "page_id bigint, uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload string, intact boolean"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the public URL namespace
DATE = "1970-01-01T00:00:00Z"


def digest32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _uri(url: str | None) -> str:
    """A header value holds no control characters; they are percent-encoded.  Null: about:blank."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record_bytes(page_id, url, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def roles(pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """The response of every payload met more than once: key (SHA-1 of the payload) and best.

    Of records with equal payloads of at least min_revisit_bytes bytes the one with the largest
    page_id is the response.  A null page_id is never the largest; where no record of a group has
    an id all are responses.  Repeated page_ids with one payload share their role.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    heads = pages.select("page_id", F.sha1(raw).alias("key"), F.octet_length(raw).alias("size"))
    best = heads.filter(F.col("size") >= min_revisit_bytes).groupBy("key").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1 and best is not null")
    return best.select("key", "best")


def _places(ids: pd.Series, keys: pd.Series) -> np.ndarray:
    """Sortable 16-byte places: the id (null first), then the start of the payload's digest."""
    out = np.zeros((len(ids), 2), ">u8")
    known = ids.notna().to_numpy()
    out[known, 0] = ids[known].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = [int(k[:16], 16) for k in keys]
    return np.ascontiguousarray(out).view("S16").ravel()


def _borders(keyed: DataFrame, rows: int, parts: int, a_part: int = 64) -> np.ndarray:
    """Range borders from the records whose hash is under a bar: about a_part for each part, whatever the input."""
    scale = 1 << 30
    bar = min(scale, max(1, scale * parts * a_part // max(rows, 1)))
    found = keyed.select("page_id", "key").filter(F.pmod(F.xxhash64(F.lit(43), "page_id", "key"), F.lit(scale)) < bar).toPandas()
    places = np.sort(_places(found["page_id"], found["key"]))
    return np.unique(places[[len(places) * k // parts for k in range(1, parts)]]) if len(places) else places


def write_warc(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, roll_bytes: int = 16 << 20, part_bytes: int = 16 << 20, date: str = DATE, level: int = 6) -> DataFrame:
    """Write pages(page_id, url, html) as record-wise compressed WARC files; returns the manifest.

    Null html is an empty payload; a null url becomes about:blank; other columns are not read.
    Rows that repeat or lack a page_id are records each.  An empty table leaves an empty manifest.
    `path` is a folder that all machines share.  Parts are ranges of (page_id, payload digest) of
    about part_bytes, one for each task; the borders' sample grows with the number of parts.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    whole = pages.agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("rows")).first()
    parts = max(1, -(-(whole["bytes"] or 0) // part_bytes))
    # What a record refers to travels as a row of its own that sorts just before it, so payloads are shuffled once.
    keyed = pages.withColumn("key", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    best = roles(pages, min_revisit_bytes=min_revisit_bytes)
    borders = pages.sparkSession.sparkContext.broadcast(_borders(keyed, whole["rows"], parts) if parts > 1 else np.zeros(0, "S16"))

    parts = len(borders.value) + 1

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders.value, _places(ids, keys), side="right").astype(np.int32))

    marks = keyed.select("page_id", "key").join(best, "key").distinct().withColumn("payload", F.lit(0))
    both = keyed.withColumn("payload", F.lit(1)).unionByName(marks, allowMissingColumns=True).withColumn("part", part_of("page_id", "key"))
    ranged = both.repartitionById(parts, "part").sortWithinPartitions("part", "page_id", "key", "payload", "url")
    base = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        part, seq, done, temp, out, mark = None, 0, [], None, None, None

        def close():
            nonlocal out, seq
            out["stream"].close()
            name = f"part-{part:06d}-{seq:05d}.warc.gz"
            store.move(temp, f"{root}/{name}")
            done.append((name, part, out["records"], out["bytes"], out["sha"].hexdigest()))
            out, seq = None, seq + 1

        for batch in batches:
            payloads = texts_of(batch.column("html"))
            for p, i, url, best_id, digest, whole, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "url", "best", "key", "payload")), payloads, strict=True):
                if not whole:
                    mark = (i, digest, best_id)
                    continue
                refers = mark[2] if mark and mark[:2] == (i, digest) else None
                if out and (p != part or out["bytes"] >= roll_bytes):
                    close()
                if p != part:
                    part, seq = p, 0
                if out is None:
                    store.create_dir(f"{root}/_temporary", recursive=True)
                    temp = f"{root}/_temporary/{uuid.uuid4().hex}"
                    out = {"stream": store.open_output_stream(temp, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record_bytes(i, url, payload, refers, refers is not None and refers != i, date)
                member = squeeze.compress(raw) + squeeze.flush()
                out["stream"].write(member)
                out["sha"].update(member)
                out["records"] += 1
                out["bytes"] += len(member)
        if out:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))],
            ["file", "part", "records", "bytes", "sha256"],
        )

    ranged.select("part", "page_id", "url", "best", "key", "payload", "html").mapInArrow(write, MANIFEST).write.parquet(f"{base}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{base}/_manifest")


def parse_record(raw: bytes) -> tuple:
    """One record: the fields of RECORD.  `intact` says whether its digests hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    intact = fields["WARC-Block-Digest"] == f"sha1:{digest32(block)}" and (revisit or (len(payload) == size and digest32(payload) == digest))
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return (page and int(page), fields["WARC-Target-URI"], fields["WARC-Type"], size, digest, refers and int(refers), None if revisit else payload.decode(), intact)


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    data, inflate, out = b"", None, []
    while data or (data := stream.read(piece)):
        inflate = inflate or zlib.decompressobj(31)
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = None, []
        else:
            data = b""
    if inflate:
        raise ValueError("the archive ends within a record")


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """Records of the files that the manifest names; columns as in RECORD."""
    base = path.rstrip("/")
    manifest = spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for raw in members(stream):
                        row = parse_record(raw)
                        rows.append(row if with_payload else (*row[:6], None, row[7]))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    files = max(1, manifest.count())
    tasks = min(files, 10_000)
    return manifest.select("file", F.pmod(F.row_number().over(Window.orderBy("file")), F.lit(tasks)).alias("task")).repartitionById(tasks, "task").select("file").mapInArrow(read, RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, upper(sha1(html)) AS hex, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to, true AS intact
FROM d
"""
