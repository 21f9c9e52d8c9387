"""Byte-pair encoding and decoding with a published vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds the merges of neighbouring
symbols by (rank, place).  Entries whose symbols have changed meanwhile are stale and skipped.
Decoding sets the vocabulary's strings apart by spaces.  Words repeat, so each task keeps the ids and
strings of those it has met in a bounded cache; what the cache holds never changes a result.  Plain texts
(ASCII and accented Latin letters, no special token) are cut into words as a whole; others at white
space first, and their chunks have a cache of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkCache, read_table

# White space as the vocabulary's pre-tokenizer knows it, and its pattern.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+"

_SPACES = re.compile(f"[{WHITE_SPACE}]+")

# In texts of these characters only white space and upper case change before the cut, and WORDS finds what
# the second pattern does.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
PLAIN_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-zß-öø-ÿ0-9\t\n\r ]+").findall


def chunks(text: str) -> list[str]:
    """The text between white space.  str.split() is the same but for four control characters."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [x for x in _SPACES.split(text) if x]
    return text.split()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file (lower-casing, byte symbols, word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.final = [self.vocab[s + self.suffix] for s in symbols]
        self.pattern = regex.compile(WORDS)
        self.cutter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = ChunkCache(self._word, 300_000)
        self.chunks = ChunkCache(self._chunk, 100_000)

    def encode_word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        size = len(ids)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        merges, queue = self.merges, []
        for i in range(size - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two symbols has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            if (k := before[i]) >= 0 and (found := merges.get((ids[k], new))):
                heapq.heappush(queue, (found[0], k, ids[k], new, found[1]))
        return tuple(x for x in ids if x >= 0)

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def _parts(self, chunk: str) -> Iterator[tuple[bytes, str]]:
        for part in self.cutter.split(chunk) if "<|" in chunk else (chunk,):
            if part in self.special:
                yield struct.pack("<I", self.special[part]), part
            elif part:
                norm = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                yield from map(self.words.__getitem__, self.pattern.findall(norm.lower()))

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        return self._joined([*self._parts(chunk)])

    @staticmethod
    def _joined(parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def decode(self, ids) -> str:
        """The strings of the ids, set apart by spaces, as a file without a decoder wants it."""
        return " ".join([self.strings[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if PLAIN(text) and not any(x in text for x in self.special):
            return self._joined([*map(self.words.__getitem__, PLAIN_WORDS(text.lower()))])
        return self._joined([p for p in map(self.chunks.__getitem__, chunks(text)) if p[0]])


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"),
) -> DataFrame:
    """Encode and decode every whole text; one row per input row.

    Null text counts as empty: no tokens, empty decoded text.  Null ids and repeated rows pass
    through.  Other columns are not read; an empty table gives an empty result.  tokenizer_path
    must exist on every machine.
    """
    kinds = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or WordBpe(tokenizer_path)
            rows = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            make = {
                "n_tokens": lambda: pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
                "ids": lambda: pa.array([list(struct.unpack(f"<{len(i) // 4}I", i)) for i, _ in rows], pa.list_(pa.int32())),
                "decoded": lambda: pa.array([d for _, d in rows], pa.string()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in rows], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(make[c]() for c in outputs)], ["id", *outputs])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} {kinds[c]}" for c in outputs)])).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of an array of ids; null stays null, an empty array gives ''."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBpe(tokenizer_path)
        for ids in parts:
            yield pd.Series([None if x is None else bpe.decode(x) for x in ids], dtype="object")

    return encoded.withColumn(out_col, run(F.col(ids_col)))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
