"""Phrase collocation mining: HAT-trie counts in tasks, merged per prefix partition by Spark.

A phrase is frequent only if the shorter ones inside it are.  Passes over ever longer phrases count
hashes (equal hashes of different phrases add up, so a frequent one is never missed) of those whose two
parts of one word less may be frequent, which a filter of bounded size tells: it lets some others pass
and never stops one.  The last pass counts the phrases themselves, of all lengths, that the filters pass.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, read_table

#: One byte each: breaks become a full stop, gaps a space, A-Z small letters.
BREAKS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
TABLE = bytes.maketrans((string.ascii_uppercase + BREAKS + GAPS).encode(), (string.ascii_lowercase + "." * len(BREAKS) + " " * len(GAPS)).encode())
SPACED = re.compile(rb"[ .]")
ID_BITS = 21
LONGEST = 64 // ID_BITS


class Words(dict):
    """Ids of words in order of appearance; 0 is the break between pieces."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.names, self.size = [b"."], 0
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.names)
        self.names.append(word)
        self.size += len(word)
        return at


class Container:
    """An open-addressing hash map from packed paths to counts, in two arrays."""

    def __init__(self, bits: int = 10):
        self.bits, self.n = bits, 0
        self.keys, self.counts = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys are distinct; all are probed at once, slot by slot."""
        while 5 * (self.n + len(keys)) > 3 << self.bits:
            old = self.run()
            self.__init__(self.bits + 1)
            self._put(*old)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            held = self.keys[at]
            free = held == -1
            self.keys[at[free]] = keys[free]  # of keys that claim one slot the last gets it
            here = self.keys[at] == keys
            self.counts[at[here]] += counts[here]
            self.n += int(np.count_nonzero(here & free))
            rest = ~here
            keys, counts, at = keys[rest], counts[rest], (at[rest] + 1) & mask

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """The paths in order, and their counts."""
        held = self.keys >= 0
        keys, counts = self.keys[held], self.counts[held]
        order = np.argsort(keys)
        return keys[order], counts[order]


class HatTrie:
    """Counts of id paths: nodes branch on five bits of the first word's id, then of the next; below them lie hash containers, and one that holds more than `burst` paths becomes a node."""

    DIGIT, PER_WORD = 5, 2

    def __init__(self, depth: int, burst: int = 1 << 16):
        self.depth, self.burst, self.entries = depth, burst, 0
        self.root: Container | list = Container()

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: distinct packed paths."""
        self.root = self._add(self.root, 0, keys, counts)

    def _add(self, at, level: int, keys: np.ndarray, counts: np.ndarray):
        if isinstance(at, Container):
            before = at.n
            at.add(keys, counts)
            self.entries += at.n - before
            if at.n <= self.burst or level >= self.depth * self.PER_WORD:
                return at
            self.entries -= at.n
            keys, counts = at.run()
            at = [None] * (1 << self.DIGIT)
        word, part = divmod(level, self.PER_WORD)
        digit = (keys >> (ID_BITS * (self.depth - 1 - word) + self.DIGIT * part) & ((1 << self.DIGIT) - 1)).astype(np.uint8)
        order = np.argsort(digit, kind="stable")
        ends = np.cumsum(np.bincount(digit, minlength=len(at)))
        for d, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if b > a:
                at[d] = self._add(at[d] or Container(), level + 1, keys[order[a:b]], counts[order[a:b]])
        return at

    def _size(self, at) -> int:
        return at.n if isinstance(at, Container) else sum(self._size(x) for x in at if x is not None)

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole subtrees of the root, the largest first, as sorted runs of paths and counts, until at most down_to entries are left."""
        top = [self.root] if isinstance(self.root, Container) else self.root
        for d in sorted((d for d, x in enumerate(top) if x is not None), key=lambda d: -self._size(top[d])):
            if self.entries <= down_to:
                break
            taken, stack = top[d], [top[d]]
            top[d] = None
            self.entries -= self._size(taken)
            while stack:
                x = stack.pop()
                if isinstance(x, Container):
                    if x.n:
                        yield x.run()
                else:
                    stack += [y for y in x if y is not None]
        if top[0] is None and len(top) == 1:
            self.root = Container()


def path_hash(parts: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of paths, given by the hashes of their words."""
    h = parts[0]
    for p in parts[1:]:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def places(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Counter:
    """Paths of some lengths of one language, counted over its pieces; what may pass is told by filters of paths of 1, 2, ... words."""

    def __init__(self, lang: str, lengths: list[int], filters: list[tuple[int, np.ndarray]], entries: int, names: int, name_bytes: int):
        self.lang, self.filters, self.most, self.names, self.name_bytes = lang, filters, entries, names, name_bytes
        self.words, self.tries = Words(), {m: HatTrie(m) for m in lengths}
        self._known = np.zeros(0, np.uint64), np.zeros(0, bool)

    @property
    def entries(self) -> int:
        return sum(t.entries for t in self.tries.values())

    def _facts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and whether it may be frequent."""
        hashes, ok = self._known
        new = self.words.names[len(hashes) :]
        if new:
            more = word_hash(self.lang, new) if self.filters else np.zeros(len(new), np.uint64)
            hashes, ok = np.append(hashes, more), np.append(ok, self._in(0, more) if self.filters else np.ones(len(new), bool))
            ok[0] = False
            self._known = hashes, ok
        return hashes, ok

    def _in(self, which: int, h: np.ndarray) -> np.ndarray:
        bits, held = self.filters[which]
        p = places(h, bits)
        return ((held[p >> 6] >> (p & 63)) & 1).astype(bool)

    def take(self, data: bytes, block: int = 1 << 19) -> Iterator[pa.RecordBatch]:
        data, start, carry = data.translate(TABLE), 0, np.zeros(0, np.int64)
        reach = max(self.tries) - 1
        while start < len(data):
            cut_at = SPACED.search(data, start + block)
            end = cut_at.start() if cut_at else len(data)
            found = data[start:end].replace(b".", b" . ").split()
            start = end
            ids = np.concatenate([carry, np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))])
            self._count(ids, len(carry))
            carry = ids[len(ids) - min(len(ids), reach) :]
            full = len(self.words.names) > self.names or self.words.size > self.name_bytes
            if full or self.entries > self.most:
                yield from self.runs(0 if full else self.most // 2)
            if full:
                kept = [self.words.names[k] for k in carry]
                self.words.reset()
                self._known = np.zeros(0, np.uint64), np.zeros(0, bool)
                carry = np.array([self.words[w] for w in kept], np.int64)

    def _count(self, ids: np.ndarray, old: int) -> None:
        hashes, ok = self._facts()
        good, keys = ok[ids], ids
        for m in range(1, max(self.tries) + 1):
            if len(ids) < m:
                return
            if m > 1:
                good = good[:-1] & good[1:]
                keys = keys[:-1] << ID_BITS | ids[m - 1 :]
                if m <= len(self.filters):
                    at = np.flatnonzero(good)
                    good[at] = self._in(m - 1, path_hash([hashes[ids[at + k]] for k in range(m)]))
            trie = self.tries.get(m)
            if trie is not None:
                new = max(0, old - m + 1)  # paths that end in what was carried over are counted already
                found = keys[new:][good[new:]]
                if m == 1:
                    counts = np.bincount(found)
                    some = np.flatnonzero(counts)
                    trie.add(some, counts[some])
                elif len(found):
                    trie.add(*np.unique(found, return_counts=True))

    def runs(self, down_to: int = 0) -> Iterator[pa.RecordBatch]:
        """Sorted runs of whole subtrees; of several tries each keeps its share of down_to."""
        every, named = max(1, self.entries), self._named()
        for m, trie in self.tries.items():
            for keys, counts in trie.spill(down_to * trie.entries // every):
                yield self.batch([keys >> (ID_BITS * k) & ((1 << ID_BITS) - 1) for k in reversed(range(m))], counts, named)

    def _named(self):
        return pa.array(self.words.names, pa.binary()).cast(pa.string())

    def batch(self, path: list[np.ndarray], counts: np.ndarray, named) -> pa.RecordBatch:
        names = [named.take(pa.array(ids)) for ids in path]
        phrase = names[0] if len(names) == 1 else pc.binary_join_element_wise(*names, " ")
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(counts), pa.string()), phrase, pa.array(counts, pa.int64())], ["lang", "phrase", "f"])


class HashCounter(Counter):
    """Gives hashes in place of phrases: short rows, to tell which phrases may be frequent."""

    def _named(self):
        return self._facts()[0]

    def batch(self, path: list[np.ndarray], counts: np.ndarray, named) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(path_hash([named[ids] for ids in path]).view(np.int64)), pa.array(counts, pa.int64())], ["h", "f"])


def count_phrases(texts: DataFrame, lengths: list[int], filters: list, *, hashed: bool = False, entries: int = 1_500_000, names: int = 200_000, name_bytes: int = 16 << 20) -> DataFrame:
    """texts(lang, text) -> (lang, phrase, f), or hashed (h, f): occurrences of phrases of these lengths, of all that pass the filters.

    Each task spills sorted runs of whole subtrees; Spark merges them by whole path, which parts
    the prefixes so that a frequent one is spread and no phrase has more rows than runs.
    """
    kind = HashCounter if hashed else Counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        tables = [(bits, shared.value) for bits, shared in filters]
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                langs, texts = part.column("lang").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()
                for lang in dict.fromkeys(langs):
                    counter = held.get(lang)
                    if counter is None:
                        counter = held[lang] = kind(lang, lengths, tables, entries, names, name_bytes)
                    yield from counter.take(b".".join(t for t, x in zip(texts, langs, strict=True) if x == lang))
                while sum(c.entries for c in held.values()) > entries or sum(len(c.words.names) for c in held.values()) > names or len(held) > 64:
                    largest = max(held, key=lambda x: (held[x].entries, len(held[x].words.names)))
                    yield from held.pop(largest).runs()
        for counter in held.values():
            yield from counter.runs()

    keys = ["h"] if hashed else ["lang", "phrase"]
    return texts.mapInArrow(run, "h bigint, f bigint" if hashed else "lang string, phrase string, f bigint").groupBy(*keys).agg(F.sum("f").alias("f"))


def hashes_of(words: DataFrame) -> DataFrame:
    """(lang, phrase) of one word each -> h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()
            for lang in dict.fromkeys(langs):
                yield pa.RecordBatch.from_arrays([pa.array(word_hash(lang, [p.encode() for p, x in zip(phrases, langs, strict=True) if x == lang]).view(np.int64))], ["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h bigint")


def may_be(hashes: DataFrame, most_bits: int) -> tuple[int, object]:
    """A filter of hashes h: 16 bits for each, 2**most_bits at most (16 MB), for all tasks to read.

    Past some 10**7 phrases more others pass, and none too few; the driver gets at most 2**most_bits / 64 numbers.
    """
    spark = hashes.sparkSession
    bits = max(12, min(most_bits, (16 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("held"))
    found = words.toArrow()
    out = np.zeros(1 << max(0, bits - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("held").to_numpy()
    return bits, spark.sparkContext.broadcast(out)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, max_words: int = 3, top: int = 2000, inside_percent: int = 50, filter_bits: int = 27) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only), cut into pieces at full stops, commas, semicolons, colons,
    exclamation and question marks and line ends, and pieces into words at spaces and tabs.
    n counts a language's words, a, l and r the occurrences of a phrase of 2 to max_words words and
    of its two parts at the cut with the least floor(1000000 a a / (l r)), of equal ones the
    first.  Phrases need a >= least, and go if 100 f(longer) >= inside_percent * a for a longer
    candidate round them.  Order: score, a falling, then phrase by UTF-8 bytes.

    Null languages count as und; null and empty texts have no words; repeated rows count each;
    texts and words of any length are whole (words are ids of a bounded table in the tasks); an
    empty table gives an empty result and other columns are not read.
    """
    if not 2 <= max_words <= LONGEST:
        raise ValueError(f"max_words must be 2 to {LONGEST}")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    words = cut(count_phrases(texts, [1], []), "words")
    totals = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("f").alias("n"))
    often = words.filter(F.col("f") >= least)
    filters = [may_be(cut(hashes_of(often), "hashes-1"), filter_bits)]
    for m in range(2, max_words):
        counted = count_phrases(texts, [m], filters, hashed=True).filter(F.col("f") >= least).select("h")
        filters.append(may_be(cut(counted, f"hashes-{m}"), filter_bits))
    longer = cut(count_phrases(texts, list(range(2, max_words + 1)), filters).filter(F.col("f") >= least), "phrases")
    known = often.unionByName(longer)

    part = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(part) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(part, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(part, k + 1, F.size(part) - k), " ").alias("right")))
    sides = longer.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    of = lambda side, name: known.select(F.col("lang").alias(f"_{name}lang"), F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    met = sides.join(of("left", "l"), (F.col("lang") == F.col("_llang")) & (F.col("left") == F.col("_l"))).join(of("right", "r"), (F.col("lang") == F.col("_rlang")) & (F.col("right") == F.col("_r")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = met.withColumns({"top": wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)"), "low": wide("l") * wide("r")}).withColumn("score", F.expr("top div low"))
    best = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size(part) - 1), lambda w: F.transform(F.sequence(F.lit(1), F.size(part) - w + 1), lambda s: F.array_join(F.slice(part, s, w), " "))))
    around = longer.filter(F.size(part) > 2).select(F.col("lang").alias("_lang"), F.explode(spans).alias("_phrase"), "f").groupBy("_lang", "_phrase").agg(F.max("f").alias("round"))
    kept = best.join(around, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").filter(F.col("round").isNull() | (100 * F.col("round") < inside_percent * F.col("a"))).drop("_lang", "_phrase", "round")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are first ranked in 64 parts, so that its last ranking orders 64 * top rows at most.
    some = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
k AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lefts, array_to_string(ws[k + 1:], ' ') AS rights
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lefts JOIN f y ON y.lang = k.lang AND y.phrase = k.rights),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(a) AS f FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE m = 3
    UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE m = 3) GROUP BY ALL),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
