"""Quality scores: random-indexing word vectors, pooled, and a small calibrated network.

Every token has a sparse random index vector (a few +1 and -1 at seeded places).  A token's
context vector is the sum of its neighbours' index vectors over the training sample; its word
vector joins both.  A document is the mean of its word vectors, beside the mean of the index
vectors of what holds for the whole document (length, repetition, case, symbols).  A network of
two layers scores it, and a temperature fitted on rows kept apart calibrates the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ChunkCache, ChunkRows, cut, held_out, read_table

OTHER = "<other>"
_RUNS = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")
FIELDS = 6  # counts kept for every chunk: chunks, tokens, upper-case letters, letters, symbols, characters


def tokens(chunk: str) -> list[str]:
    """A chunk's tokens: its lower-cased words, its shape and its runs of symbols."""
    out, shape = [], []
    for run in _RUNS.findall(chunk):
        if run[0].isalpha():
            out.append(run.lower())
            shape.append("A" if run.isupper() and len(run) > 1 else "Aa" if run[0].isupper() else "a")
        elif run[0].isdigit():
            shape.append("0" if len(run) < 4 else "00")
        else:
            out.append("<s>" + run[:3])
            shape.append(run[:3])
    return [*out, "<shape>" + "".join(shape)[:12]]


def index_vector(token: str, width: int, nonzero: int = 4) -> np.ndarray:
    """The token's seeded sparse ternary vector."""
    out, raw = np.zeros(width, np.float32), token.encode()
    for k in range(nonzero):
        h = zlib.crc32(raw, 0x9E37 + 7919 * k)
        h = (h * 2654435761 + k) & 0xFFFFFFFF
        out[(h >> 1) % width] += 1 if (h >> 20) & 1 else -1
    return out


def document_tokens(counts: np.ndarray, repeats: int, distinct: int, lines: int) -> list[str]:
    """What holds for a whole document, in classes."""
    chunks, words, upper, letters, symbols, chars = counts

    def level(x, y):
        return int(min(10, 10 * x / max(y, 1)))

    return [
        f"<chunks>{int(np.log2(chunks + 1) * 2)}",
        f"<repeats>{level(repeats, chunks)}",
        f"<distinct>{level(distinct, chunks)}",
        f"<upper>{level(upper, letters)}",
        f"<letters>{level(letters, chars)}",
        f"<symbols>{level(5 * symbols, chars)}",
        f"<lines>{int(np.log2(1 + chunks / max(lines, 1)) * 2)}",
        f"<size>{int(2 * chars / max(chunks, 1))}",
    ]


@dataclass
class QualityModel:
    """Word vectors, network and temperature; `prior` is the score where nothing was learned."""

    vocabulary: dict[str, int]
    vectors: np.ndarray
    network: dict[str, np.ndarray] | None
    temperature: float
    prior: float

    @property
    def width(self) -> int:
        return self.vectors.shape[1]

    def chunk_row(self, chunk: str) -> np.ndarray:
        """Sum of the chunk's word vectors, then its counts; words with one stop at most take a short way."""
        other = self.vocabulary[OTHER]
        stop = chunk[-1] if chunk[-1] in ",.;:!?" else ""
        word = chunk[:-1] if stop else chunk
        if word.isalpha() and not (stop and len(word) == 0):
            title = word[0].isupper()
            capital = title and len(word) > 1 and word.isupper()
            if not title and not word.islower() or title and not capital and not (word[1:].islower() or len(word) == 1):
                return self._any_row(chunk)
            shape = "<shape>" + (("A" if capital else "Aa" if title else "a") + stop)
            row = np.empty(self.width + FIELDS, np.float32)
            row[:-FIELDS] = self.vectors[self.vocabulary.get(word.lower(), other)]
            row[:-FIELDS] += self.vectors[self.vocabulary.get(shape, other)]
            if stop:
                row[:-FIELDS] += self.vectors[self.vocabulary.get("<s>" + stop, other)]
            row[-FIELDS:] = (1, 3 if stop else 2, len(word) if capital else int(title), len(word), len(stop), len(chunk))
            return row
        return self._any_row(chunk)

    def _any_row(self, chunk: str) -> np.ndarray:
        found = tokens(chunk)
        other = self.vocabulary[OTHER]
        row = np.zeros(self.width + FIELDS, np.float32)
        row[:-FIELDS] = self.vectors[[self.vocabulary.get(t, other) for t in found]].sum(axis=0)
        letters = sum(c.isalpha() for c in chunk)
        symbols = sum(not c.isalnum() for c in chunk)
        row[-FIELDS:] = (1, len(found), sum(c.isupper() for c in chunk), letters, symbols, len(chunk))
        return row

    def features(self, texts: list[str | None], rows: ChunkRows | None = None) -> np.ndarray:
        rows = rows or ChunkRows(self.chunk_row, self.width + FIELDS, 60_000)
        classes = ChunkCache(lambda t: index_vector(t, self.width), 10_000)
        out = np.zeros((len(texts), 2 * self.width), np.float32)
        for k, text in enumerate(texts):
            total, repeats, distinct = np.zeros(self.width + FIELDS), 0, 0
            for at in rows.slices((text or "").split()):
                total += rows.table[at].sum(axis=0, dtype=np.float64)
                repeats += int((at[1:] == at[:-1]).sum())
                distinct += len(set(at.tolist()))
            counts = total[-FIELDS:]
            out[k, : self.width] = total[:-FIELDS] / max(counts[1], 1)
            marks = document_tokens(counts, repeats, distinct, (text or "").count("\n") + 1)
            out[k, self.width :] = np.mean([classes[m] for m in marks], axis=0)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(features), self.prior)
        return 1 / (1 + np.exp(-np.clip(logits(self.network, features) / self.temperature, -30, 30)))


def logits(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    hidden = np.tanh((x - net["mean"]) / net["std"] @ net["w1"] + net["b1"])
    return (hidden @ net["w2"] + net["b2"]).astype(np.float64)


def fit_network(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 25, batch: int = 128, rate: float = 2e-3, decay: float = 1e-3, seed: int = 5) -> dict[str, np.ndarray]:
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = ((x - mean) / std).astype(np.float32)
    p = {
        "w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)).astype(np.float32),
        "b1": np.zeros(hidden, np.float32),
        "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32),
        "b2": np.float32(0),
    }
    m, v, step = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for s in range(0, len(z), batch):
            at, step = order[s : s + batch], step + 1
            h = np.tanh(z[at] @ p["w1"] + p["b1"])
            err = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - y[at]).astype(np.float32) / len(at)
            back = np.outer(err, p["w2"]) * (1 - h * h)
            grads = {"w1": z[at].T @ back + decay * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ err + decay * p["w2"], "b2": err.sum()}
            pace = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | {"mean": mean, "std": std}


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows kept apart."""
    if not len(z):
        return 1.0
    losses = {t: float(np.mean(np.logaddexp(0, z / t) - y * z / t)) for t in np.geomspace(0.25, 8, 41)}
    return float(min(losses, key=losses.get))


def _vocabulary(sample: DataFrame, size: int) -> dict[str, int]:
    """The tokens in most documents of the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = ChunkCache(lambda c: tuple(tokens(c)), 100_000), {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for t in {t for c in set((text or "").split()) for t in cache[c]}:
                    seen[t] = seen.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    found = sample.select("text").mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 2")
    best = [r["token"] for r in found.orderBy(F.desc("n"), "token").limit(size).collect()]
    return {t: k for k, t in enumerate([OTHER, *(t for t in best if t != OTHER)])}


def _context(sample: DataFrame, vocabulary: dict[str, int], index: np.ndarray, window: int = 2) -> np.ndarray:
    """Sums of neighbours' index vectors by token; each task sends one block of sums for every 256 tokens."""
    size, width = index.shape
    places = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :4]
    signs = np.take_along_axis(index, places, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache(lambda c: tuple(vocabulary.get(t, 0) for t in tokens(c)), 100_000)
        sums = np.zeros(size * width)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                at = np.array([t for c in (text or "").split() for t in cache[c]], np.int64)
                for gap in range(1, window + 1):
                    for a, b in ((at[gap:], at[:-gap]), (at[:-gap], at[gap:])):
                        if len(a):
                            flat = (a[:, None] * width + places[b]).ravel()
                            sums += np.bincount(flat, weights=signs[b].ravel(), minlength=size * width)
        blocks = sums.reshape(size, width).astype(np.float32)
        starts = list(range(0, size, 256))
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([blocks[s : s + 256].tobytes() for s in starts], pa.binary())], ["start", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.frombuffer(x, np.float32) for x in pdf["sums"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"start": [pdf["start"][0]], "sums": [whole.astype(np.float32).tobytes()]})

    out = np.zeros((size, width), np.float32)
    kinds = "start int, sums binary"
    for row in sample.select("text").mapInArrow(run, kinds).groupBy("start").applyInPandas(add, kinds).collect():
        part = np.frombuffer(row["sums"], np.float32).reshape(-1, width)
        out[row["start"] : row["start"] + len(part)] = part
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6_000, vocabulary_size: int = 6000, width: int = 64) -> QualityModel:
    """Fit on a bounded sample: about max_rows labelled rows, chosen by a hash of the id.

    Rows without id or label teach nothing; of several labels for an id the largest counts, of
    several texts the least.
    With no rows, or labels of one kind only, every score is the share of label 1 (or 0.5).
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null and y in (0, 1)")
    labels = labels.groupBy("id").agg(F.max("y").alias("y"))
    known = labels.count()
    scale = 1 << 30
    chosen = labels.filter(F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(scale)) < min(scale, scale * max_rows // max(known, 1)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The sample is bounded by max_rows whatever the input, so its ids may be broadcast.
    sample = cut(rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "quality-sample").repartition(8, "id")
    vocabulary = _vocabulary(sample, vocabulary_size)
    index = np.stack([index_vector(t, width) for t in vocabulary])
    context = _context(sample, vocabulary, index)
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-6
    model = QualityModel(vocabulary, (index / 2 + context).astype(np.float32), None, 1.0, 0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    found = sample.select(F.col("id").cast("bigint").alias("id"), "y", "text").mapInArrow(pool, "id bigint, y int, x binary").toPandas().sort_values("id")
    y = found["y"].to_numpy(float)
    if len(y):
        model.prior = float(y.mean())
    if 0 < y.sum() < len(y):
        x = np.stack([np.frombuffer(r, np.float32) for r in found["x"]])
        apart = np.arange(len(y)) % 5 == 0
        model.network = fit_network(x[~apart], y[~apart])
        model.temperature = fit_temperature(logits(model.network, x[apart]), y[apart])
    return model


def predict(spark, model: QualityModel, text: Column) -> Column:
    """Score of a whole text, between 0 and 1; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        rows = ChunkRows(model.chunk_row, model.width + FIELDS, 250_000)
        for texts in parts:
            yield pd.Series(model.scores(model.features(list(texts), rows)))

    return run(text.cast("string"))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **sizes) -> DataFrame:
    """Add held_out, score and predicted to docs; learns from labels of rows that are not held out.

    Columns of these names are replaced, all others kept.  A null id is held out.  Null and
    empty texts get a score too.  An empty table gives an empty result.
    """
    fold = F.coalesce(held_out(id_col), F.lit(True))
    docs = docs.drop("held_out", "score", "predicted").withColumn("held_out", fold)
    model = train(docs.filter(~F.col("held_out")), labels.filter(~fold), id_col=id_col, text_col=text_col, **sizes)
    found = docs.withColumn("score", predict(docs.sparkSession, model, F.col(text_col)))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    found = score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
