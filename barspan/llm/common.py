"""Helpers shared by the operators: shared-folder tables, text buffers, word-chunk caches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests on local masters) a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="barspan-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there.

    The commit protocol keeps one attempt's output of each task, so what follows is
    deterministic even where the plan above was not, and survives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage, so that Spark's cleaner drops broadcasts and shuffle files of finished jobs.

    For operators of many short jobs: else these pile up until the driver's heap is full.
    """
    if jvm := getattr(spark.sparkContext, "_jvm", None):
        jvm.System.gc()


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on the session hands its Python workers batches of at most `most` bytes or little more.

    By default a batch has 10,000 rows whatever their length: of whole texts some 30 MB, which the executor
    holds outside its heap in buffers that double, and the worker as Arrow and as strings.  A smaller
    limit that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def _bytes(size: str) -> int:
    """Of Spark's writing of a size, as 64MB, 4m or 4194304."""
    digits, unit = re.fullmatch(r"(\d+)([a-z]?)[a-z]*", size.strip().lower()).groups()
    return int(digits) << 10 * " kmgtp".index(unit if unit and unit != "b" else " ")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo folds, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants); wraps modulo 2**64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ChunkCache(dict):
    """Bounded map from a white-space separated chunk to what `make` gives for it.

    Words repeat so often that most lookups are plain dict hits; when the cache is full it
    starts afresh, so memory stays bounded and results never depend on what it holds.
    """

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class ChunkRows:
    """Bounded map from chunk to a row of numbers, for sums over the chunks of a text.

    `make(chunk)` gives the row.  A text of any length is summed in slices, so the table holds
    at most `limit` rows and one slice's.
    """

    SLICE = 50_000

    def __init__(self, make, width: int, limit: int = 150_000):
        self.limit = limit
        self.table = table = np.zeros((limit + self.SLICE, width), np.float32)

        class Index(dict):
            def __missing__(self, chunk):
                at = self[chunk] = len(self)
                table[at] = make(chunk)
                return at

        self.index = Index()

    def slices(self, chunks: list[str]):
        """For each slice of the text: the places of its chunks in the table."""
        for s in range(0, len(chunks), self.SLICE):
            if len(self.index) > self.limit:
                self.index.clear()
            part = chunks[s : s + self.SLICE]
            yield np.fromiter(map(self.index.__getitem__, part), np.int64, len(part))

    def total(self, chunks: list[str]) -> np.ndarray:
        out = np.zeros(self.table.shape[1])
        for at in self.slices(chunks):
            out += self.table[at].sum(axis=0, dtype=np.float64)
        return out


def map_groups(df: DataFrame, key: str, fn: Callable[[dict[str, list]], list[tuple]], schema: str) -> DataFrame:
    """fn over the rows of each key, streamed from partitions sorted by key.

    fn gets one group at a time as lists by column name and returns rows of `schema`; a task
    holds one group and one batch, whatever the number of groups.
    """
    names = df.columns
    out_names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out, held = None, {n: [] for n in names}, [], 0

        def flush():
            nonlocal held
            if group[key]:
                found = fn(group)
                held += sum(len(v) for r in found for v in r if isinstance(v, bytes))
                out.extend(found)
                for n in names:
                    group[n] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], out_names)

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            keys = columns[key]
            start = 0
            for i, k in enumerate(keys):
                if k != at or (i == 0 and not group[key]):
                    if i > start:
                        for n in names:
                            group[n] += columns[n][start:i]
                    start = i
                    flush()
                    at = k
            for n in names:
                group[n] += columns[n][start:]
            if len(out) >= 5000 or held >= 16 << 20:
                yield batch_of(out)
                out, held = [], 0
        flush()
        yield batch_of(out)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def only_near(df: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows whose id may be among ids: a filter of `bits` bits, never more than bits / 64 rows to broadcast.

    It lets too many rows pass where ids are many, never too few; a join must follow.
    """
    place = F.pmod(F.xxhash64(F.lit(41), F.col(column).cast("bigint")), F.lit(bits))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("_bits"))
    marked = df.withColumns({"_word": F.shiftright(place, 6), "_bit": place.bitwiseAND(F.lit(63)).cast("int")})
    hit = marked.join(F.broadcast(words), "_word").filter(F.expr("(shiftright(_bits, _bit) & 1) = 1"))
    return hit.drop("_word", "_bit", "_bits")
