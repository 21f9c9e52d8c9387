"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every table projects vectors on a few Gaussian directions and cuts each projection into slots
of one width.  A query visits its own bucket and then perturbed ones, in the order of the
expected squared distance to the slot borders that a perturbation crosses.  Candidates of all
tables are merged and reranked by their exact measure on the original vectors.  For inner
products, vectors get one coordinate more that brings all to the largest norm, so that nearness
on the sphere is nearness by inner product.

Buckets are dealt to groups of bounded size; a bucket with more rows than that is cut into
blocks which all of its queries visit, so a vector that a third of all rows repeat is no hot
task.  Each group returns a query's best k, ties by id, which is all that the merge can need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, read_table


def probe_order(hashes: int, probes: int) -> np.ndarray:
    """The sets of perturbations to try, best first, over 2 * hashes of them sorted by distance.

    Row t says which of the sorted perturbations set t takes.  Expected squared distances of the
    sorted perturbations are those of order statistics of uniform offsets; perturbations j and
    2 * hashes - 1 - j move the same hash in opposite directions and exclude each other.
    """
    m = hashes
    j = np.arange(1, 2 * m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, near, far)
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        if len({min(x, 2 * m - 1 - x) for x in chosen}) == len(chosen):
            out.append(chosen)
        last = chosen[-1] + 1
        if last < 2 * m:
            heapq.heappush(heap, (score - cost[chosen[-1]] + cost[last], (*chosen[:-1], last)))
            heapq.heappush(heap, (score + cost[last], (*chosen, last)))
    table = np.zeros((len(out), 2 * m), np.int64)
    for t, chosen in enumerate(out):
        table[t, list(chosen)] = 1
    return table


class Hasher:
    """Seeded p-stable hash tables over vectors brought to norm `norm`."""

    def __init__(self, dim: int, norm: float, *, tables: int, hashes: int, width: float, probes: int, seed: int):
        rng = np.random.default_rng(seed)
        self.norm, self.tables, self.hashes, self.width = norm, tables, hashes, width * norm
        self.a = rng.normal(size=(tables, dim + 1, hashes))
        self.b = rng.uniform(0, self.width, size=(tables, 1, hashes))
        self.order = probe_order(hashes, probes)

    def slots(self, x: np.ndarray, query: bool) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            x, more = x * (self.norm / size), np.zeros_like(size)
        else:
            more = np.sqrt(np.maximum(self.norm**2 - size**2, 0))
        return (np.concatenate([x, more], axis=1) @ self.a + self.b) / self.width

    def codes(self, slots: np.ndarray, table: int) -> np.ndarray:
        out = np.full(slots.shape[:-1], table + 1, np.uint64)
        for j in range(self.hashes):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + slots[..., j].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(tables, n) bucket codes of base vectors."""
        return np.stack([self.codes(np.floor(s), t) for t, s in enumerate(self.slots(x, False))])

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """For each table the (n, probes) codes that each query visits, in order."""
        out = []
        for t, s in enumerate(self.slots(x, True)):
            home = np.floor(s)
            down = s - home
            distance = np.concatenate([down, 1 - down], axis=1)  # to the border below and above
            place = np.argsort(np.argsort(distance, axis=1), axis=1)
            chosen = self.order[:, place]  # (probes, n, 2 * hashes)
            moves = chosen[..., self.hashes :] - chosen[..., : self.hashes]
            out.append(self.codes(home[None] + moves, t).T)
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>) of vectors that take part: no null or non-finite component, not zero, id not null."""
    found = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return found.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda v: v != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def search(
    queries: DataFrame,
    base: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    tables: int = 8,
    hashes: int = 6,
    width: float = 1.5,
    probes: int = 160,
    group_rows: int = 4096,
    least_groups: int = 12,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (inner product in double precision): the k best found.

    A query's own id is no candidate; ties go to the smaller id.  Vectors that are null, zero or
    hold a null or non-finite component take no part, nor do those whose length is not the most
    frequent one.  Rows that repeat an id are one candidate with the better score.  No vectors or
    no queries: an empty result.  Every vector is indexed, in every table.
    """
    spark = base.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    points = usable(base, id_col, vec_col)
    dims = points.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)).alias("most")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], empty)
    dim, count = dims["d"], dims["n"]
    hasher = spark.sparkContext.broadcast(Hasher(dim, float(np.sqrt(dims["most"])) * (1 + 1e-9), tables=tables, hashes=hashes, width=width, probes=probes, seed=seed))
    groups = max(least_groups, -(-count // group_rows))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            codes = h.buckets(x)
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            for t in range(h.tables):
                tag = pa.array(np.full(len(x), t, np.int32))
                yield pa.RecordBatch.from_arrays([tag, pa.array(codes[t]), batch.column("id"), raw], ["tab", "bucket", "id", "raw"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for s in range(0, len(ids), 256):
                for t, codes in enumerate(h.probes(_matrix(batch.column("vec").slice(s, 256)))):
                    n, p = codes.shape
                    columns = [pa.array(np.full(n * p, t, np.int32)), pa.array(codes.ravel()), pa.array(np.repeat(ids[s : s + 256], p))]
                    yield pa.RecordBatch.from_arrays(columns, ["tab", "bucket", "query_id"])

    one_dim = F.size("vec") == dim
    asked = usable(queries, id_col, vec_col).filter(one_dim).dropDuplicates(["id"])
    indexed = cut(points.filter(one_dim).mapInArrow(index, "tab int, bucket bigint, id bigint, raw binary"), "ann-index")
    sizes = indexed.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("blocks"))
    # Small buckets share groups; a block of a large bucket is a group of its own.
    shared_group = F.xxhash64("tab", F.pmod("bucket", F.lit(groups)))
    placed = indexed.join(sizes, ["tab", "bucket"]).select(
        F.when(F.col("blocks") == 1, shared_group).otherwise(F.xxhash64("tab", "bucket", F.pmod(F.xxhash64("id"), "blocks").cast("int"))).alias("grp"), "bucket", "id", "raw"
    )
    visits = asked.mapInArrow(visit, "tab int, bucket bigint, query_id bigint").join(sizes, ["tab", "bucket"])
    visits = visits.select("tab", "bucket", "query_id", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    visits = visits.select(F.when(F.col("blocks") == 1, shared_group).otherwise(F.xxhash64("tab", "bucket", "b")).alias("grp"), "bucket", "query_id")
    visits = visits.groupBy("grp", "query_id").agg(F.collect_set("bucket").alias("buckets"))  # at most `probes` of them
    visits = visits.join(asked.select(F.col("id").alias("query_id"), "vec"), "query_id")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        x = np.frombuffer(b"".join(left["raw"]), np.float64).reshape(len(left), dim)
        ids, q, asking = left["id"].to_numpy(np.int64), np.stack(right["vec"].to_numpy()), right["query_id"].to_numpy(np.int64)
        names, inverse = np.unique(left["bucket"].to_numpy(np.int64), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        edges = np.searchsorted(inverse[order], np.arange(len(names) + 1))
        who = np.repeat(np.arange(len(right)), right["buckets"].map(len).to_numpy())
        where = np.searchsorted(names, np.concatenate(right["buckets"].to_numpy()))
        by_bucket = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[by_bucket], np.arange(len(names) + 1))
        found_q, found_v, found_s = [], [], []
        for b in range(len(names)):
            rows, qs = order[edges[b] : edges[b + 1]], who[by_bucket[cuts[b] : cuts[b + 1]]]
            for s in range(0, len(qs), 512):
                part = qs[s : s + 512]
                scores = q[part] @ x[rows].T
                if len(rows) > k + 1:  # the own id may be among the best
                    bar = np.partition(scores, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1]
                    keep = scores >= (bar - 1e-9 * (1 + np.abs(bar)))[:, None]
                    i, j = np.nonzero(keep)
                else:
                    i, j = np.divmod(np.arange(scores.size), len(rows))
                found_q.append(part[i])
                found_v.append(rows[j])
                found_s.append(scores[i, j])
        fq, fv, fs = np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)
        other = asking[fq] != ids[fv]
        fq, fv, fs = fq[other], fv[other], fs[other]
        # The k best of each query by rounded score and whatever ties with them, then exact scores.
        at = np.lexsort((-fs, fq))
        fq, fv, fs = fq[at], fv[at], fs[at]
        start = np.searchsorted(fq, fq)
        last = np.minimum(start + k, np.searchsorted(fq, fq, side="right")) - 1
        keep = fs >= fs[last] - 1e-9 * (1 + np.abs(fs[last]))
        fq, fv = fq[keep], fv[keep]
        exact = np.empty(len(fq))
        for s in range(0, len(fq), 8192):
            exact[s : s + 8192] = (q[fq[s : s + 8192]] * x[fv[s : s + 8192]]).sum(axis=1)
        at = np.lexsort((ids[fv], -exact, fq))
        fq, fv, exact = fq[at], fv[at], exact[at]
        best = np.arange(len(fq)) - np.searchsorted(fq, fq) < k
        return pd.DataFrame({"query_id": asking[fq[best]], "vec_id": ids[fv[best]], "score": exact[best]})

    found = placed.groupBy("grp").cogroup(visits.groupBy("grp")).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_multiprobe_ann(spark, sf_dir: str) -> DataFrame:
    base = read_table(spark, sf_dir, "embeddings")
    return search(base.filter("vec_id % 20 = 0"), base)
