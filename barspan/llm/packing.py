"""Best-fit packing of token sequences with certified bin counts.

Pieces are spread over tasks of bounded size and packed by best-fit decreasing.  Lower bounds
from dual feasible functions certify a task's bin count: where the count equals the bound, no
packing of those pieces is better.  Tasks with a gap give the pieces of their emptiest bins to
a common pool of a few neighbouring tasks (certified tasks only their one emptiest bin), the
pool is packed again, until one pool is left or the rounds are used up.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PLAIN, PLAIN_WORDS, byte_symbols, chunks
from .common import ChunkCache, cut, mix64, read_table

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, spread bigint"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length (given in decreasing order): the fullest bin that still has room.

    Bit r of `free` says that some bin has r tokens of room left; the lowest bit at or above a
    length is the best fit.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins, out = 0, 0, np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        if fits := free >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            b, r, bins = bins, capacity, bins + 1
        out[k] = b
        if r > n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return out


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; histogram[n] counts the pieces of n tokens (0..capacity).

    The largest of: total size; the threshold functions (sizes under t count nothing, sizes
    over capacity - t count a whole bin) for every t; the rounding functions for k = 1..32.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    h = histogram.astype(np.int64)
    best = -(-int((h * sizes).sum()) // capacity)
    counts, tokens = np.cumsum(h), np.cumsum(h * sizes)
    t = np.arange(1, capacity // 2 + 1)
    middle = tokens[capacity - t] - tokens[t - 1]
    large = counts[capacity] - counts[capacity - t]
    if len(t):
        best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        # k * capacity times the function's value, so that all is whole numbers
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((h * value).sum()) // (k * capacity)))
    return best


#: The normaliser and pre-tokenizer that PLAIN and PLAIN_WORDS stand for.
_KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def text_encoder(tokenizer, limit: int = 300_000) -> Callable[[str], bytes]:
    """A function from a whole text to its ids by the library's tokenizer, as little-endian unsigned 32-bit integers.

    A plain text (ASCII and accented Latin letters, no special token) is cut into words here, and the
    library's BPE model encodes each word, once while a bounded cache holds it; the library's own way to
    the word, which keeps alignments, costs four times the model.  Other texts are cut at white
    space, which the file's normaliser and pre-tokenizer never join characters across; their plain
    chunks go the same way, all others through the whole tokenizer, both once while a second cache holds them.
    With another normaliser or pre-tokenizer no text is plain.
    """
    known = all(x and json.loads(x.__getstate__()) == y for x, y in zip((tokenizer.normalizer, tokenizer.pre_tokenizer), _KNOWN, strict=True))
    model, symbols = tokenizer.model, {b: s for b, s in enumerate(byte_symbols()) if b > 0x7F}
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def word_ids(word: str) -> bytes:
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(symbols)
        return struct.pack(f"<{len(ids := [t.id for t in model.tokenize(word)])}I", *ids)

    words = ChunkCache(word_ids, limit)

    def plain_ids(text: str) -> bytes | None:
        if not known or not PLAIN(text) or any(x in text for x in special):
            return None
        return b"".join(map(words.__getitem__, PLAIN_WORDS(text.lower())))

    def chunk_ids(chunk: str) -> bytes:
        if (found := plain_ids(chunk)) is not None:
            return found
        ids = tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    other = ChunkCache(chunk_ids, limit // 3)

    def encode(text: str) -> bytes:
        if (found := plain_ids(text)) is not None:
            return found
        return b"".join(map(other.__getitem__, chunks(text)))

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids (by the tokenizers library) followed by end_id.

    Columns: doc_id, piece, start, length, ids_crc32, spread (a number that deals rows evenly
    to tasks) and, on demand, ids.  Null text counts as empty: one piece holding end_id only.
    Rows that repeat an id, and null ids, give pieces each; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = None, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            if encode is None:
                from tokenizers import Tokenizer

                tokenizer = Tokenizer.from_file(tokenizer_path)
                tokenizer.no_truncation()
                tokenizer.no_padding()
                encode = text_encoder(tokenizer)
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            end = np.array([end_id], "<u4").tobytes()
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = encode(text or "") + end
                for p in range(0, len(raw), 4 * capacity):
                    part = raw[p : p + 4 * capacity]
                    out["doc_id"].append(i)
                    out["piece"].append(p // (4 * capacity))
                    out["start"].append(p // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            n = len(out["doc_id"])
            spread = mix64(np.arange(row, row + n, dtype=np.uint64)).view(np.int64)
            row += n
            columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")] + [pa.array(spread)]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "spread", *["ids"] * with_ids])

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


PACKED = PIECE + ", area bigint, bin bigint, fill bigint, leaves boolean"


def _pack_area(capacity: int, exchange_bins: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "spread"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        certified = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        emptiest = np.argsort(fill, kind="stable")[: 1 if certified else exchange_bins]
        leaves = np.zeros(len(fill), bool)
        leaves[emptiest[fill[emptiest] < capacity]] = True
        return pdf.assign(bin=bins, fill=fill[bins], leaves=leaves[bins])

    return pack


def pack(pieces: DataFrame, *, capacity: int = 4096, area_bins: int = 2000, exchange_bins: int = 256, merge: int = 16, rounds: int = 4, numbered: bool = False) -> DataFrame:
    """Add sequence_id and offset to pieces (columns as token_pieces gives them).

    Every piece lands in one sequence of at most `capacity` tokens; offsets are gapless from 0.
    Repeated rows and null ids are packed each; extra columns are not kept.  No pieces: an empty
    result.  numbered: keep spread too, by which `sequences` tells pieces apart.
    """
    pieces = cut(pieces.select(*(c.split()[0] for c in PIECE.split(", "))), "pieces")
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    histogram = np.zeros(capacity + 1, np.int64)
    for n, k in counted.items():
        histogram[n] = k
    bound = lower_bound(histogram, capacity)
    areas = max(1, -(-bound // area_bins))
    packer = _pack_area(capacity, exchange_bins)
    done: list[DataFrame] = []
    area = F.pmod("spread", F.lit(areas))
    for turn in range(rounds + 1):
        packed = cut(pieces.withColumn("area", area).drop("from_area").groupBy("area").applyInPandas(packer, PACKED), f"packed-{turn}")
        last = areas == 1 or turn == rounds
        stays = packed if last else packed.filter(~F.col("leaves"))
        done.append(stays.withColumn("turn", F.lit(turn)))
        if last:
            break
        pieces, areas = packed.filter("leaves").select(*(c.split()[0] for c in PIECE.split(", ")), F.col("area").alias("from_area")), -(-areas // merge)
        area = F.pmod(F.floor(F.col("from_area") / merge), F.lit(areas))
    every = reduce(DataFrame.unionByName, done)
    sequence = F.shiftleft(F.col("turn").cast("bigint"), 58).bitwiseOR(F.shiftleft("area", 24)).bitwiseOR(F.col("bin"))
    return _offsets(every.withColumn("sequence_id", sequence), numbered)


def _offsets(rows: DataFrame, numbered: bool) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "spread")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", before.cast("bigint").alias("offset"), *["spread"] * numbered)


def sequences(pieces_with_ids: DataFrame, plan: DataFrame, *, capacity: int = 4096, pad_id: int | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens and ids in order of offset.

    Pieces are told apart by spread, their number: pieces_with_ids must be a written table (so that
    it has the same numbers each time it is read) and plan what pack(..., numbered=True) made of it.
    Null ids and repeated rows are pieces like any other.  A sequence holds at most `capacity`
    tokens, so each group is bounded.
    """
    both = plan.select("spread", "sequence_id", "offset").join(pieces_with_ids.select("spread", "ids"), "spread")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = both.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
    out = out.withColumn("n_tokens", F.size("ids"))
    if pad_id is not None:
        out = out.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("ids"))))
    return out


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
