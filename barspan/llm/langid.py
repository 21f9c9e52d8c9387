"""Language identification: known words first, then shorter and shorter character n-grams.

A word that the model knows adds its log frequency in each language.  An unseen word is tiled
from left to right by the longest n-grams that the model knows and adds their mean log
frequency.  The language with the largest sum wins; the score is its share of the posterior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ChunkRows, held_out, read_table

UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


class Table:
    """A row of numbers for each item, all rows in one array: little more than half the memory that an array for each row takes."""

    def __init__(self, places: dict[str, int], rows: np.ndarray):
        self.places, self.rows = places, rows

    def get(self, item: str) -> np.ndarray | None:
        return None if (at := self.places.get(item)) is None else self.rows[at]


@dataclass
class LanguageModel:
    """Tables of log frequencies (words are runs of letters, Unicode category L); `grams` holds n-grams of words set between ^ and $."""

    languages: list[str]
    words: Table | dict[str, np.ndarray]
    grams: Table | dict[str, np.ndarray]
    longest: int

    def word_row(self, word: str) -> np.ndarray:
        if (known := self.words.get(word)) is not None:
            return known
        marked, at, parts, total = f"^{word}$", 0, 0, np.zeros(len(self.languages), np.float32)
        while at < len(marked):
            for n in range(min(self.longest, len(marked) - at), 0, -1):
                if (known := self.grams.get(marked[at : at + n])) is not None:
                    total += known
                    parts += 1
                    break
            at += max(1, n)
        return total / parts if parts else total

    def chunk_row(self, chunk: str) -> np.ndarray:
        """The sums over a chunk's words, and at the end the number of its words."""
        out = np.zeros(len(self.languages) + 1, np.float32)
        for word in _LETTERS.findall(chunk.lower()):
            out[:-1] += self.word_row(word)
            out[-1] += 1
        return out


def _table(counts: pd.DataFrame, languages: list[str], smooth: float = 0.05) -> Table:
    """Log relative frequencies by language, in nearest float32, from rows (lang, item, n)."""
    at = {x: k for k, x in enumerate(languages)}
    items = {x: k for k, x in enumerate(dict.fromkeys(counts["item"]))}
    n = np.full((len(items), len(languages)), smooth)
    np.add.at(n, ([items[x] for x in counts["item"]], [at[x] for x in counts["lang"]]), counts["n"].to_numpy(float))
    rows = np.log(n / n.sum(axis=0, keepdims=True)).astype(np.float32) if len(items) else n
    return Table(items, rows)


def train(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 1500,
    words_per_language: int = 15_000,
    grams_per_language: int = 15_000,
    longest: int = 5,
    most_languages: int = 500,
) -> LanguageModel:
    """Fit on a bounded sample: about docs_per_language rows of each language, chosen by a hash of the id.

    Rows with a null language, text or id teach nothing.  The model holds the words_per_language and
    grams_per_language most frequent items of a language (ties by the item) and the most_languages
    languages with most rows.  Without usable rows it has no languages and predicts `und`.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("id is not null and text is not null and lang is not null")
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not known:
        return LanguageModel([], {}, {}, longest)
    languages = sorted(known)
    scale = 1 << 30
    bars = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(scale, docs_per_language * scale // known[lang]))])
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(scale)) < bars[F.col("lang")])
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("item")
    words = sample.select("lang", word).filter("item <> ''").groupBy("lang", "item").agg(F.count("*").alias("n")).persist()

    def top(counts: DataFrame, k: int) -> pd.DataFrame:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
        return counts.withColumn("place", place).filter(F.col("place") <= k).select("lang", "item", "n").toPandas()

    marked = F.concat(F.lit("^"), "item", F.lit("$"))
    each = words.filter(F.length("item") <= 64).select("lang", "n", marked.alias("w")).select("lang", "n", "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k"))
    starts = F.sequence(F.lit(1), F.length("w") - F.col("k") + 1)
    grams = each.filter(F.length("w") >= F.col("k")).select("lang", "n", F.explode(F.transform(starts, lambda s: F.substring("w", s, F.col("k")))).alias("item"))
    grams = grams.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    out = LanguageModel(languages, _table(top(words, words_per_language), languages), _table(top(grams, grams_per_language), languages), longest)
    words.unpersist()
    return out


def predict(spark, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a whole text; `und` and 0 if it is null or has no letter."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        rows = ChunkRows(model.chunk_row, len(model.languages) + 1)
        for texts in parts:
            langs, scores = [], []
            for text in texts:
                total = rows.total(text.split()) if text else np.zeros(1)
                if total[-1] == 0 or not model.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(total[:-1].argmax())
                langs.append(model.languages[best])
                scores.append(1.0 / sum(math.exp(max(-700.0, x - total[best])) for x in total[:-1]))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return run(text.cast("string"))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sizes) -> DataFrame:
    """Add held_out, lang_pred and score to docs; learns from the rows that are not held out.

    Columns of these names are replaced, all others kept.  A null id is held out.  An empty
    table gives an empty result.
    """
    docs = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", F.coalesce(held_out(id_col), F.lit(True)))
    model = train(docs.filter(~F.col("held_out")), id_col=id_col, text_col=text_col, lang_col=lang_col, **sizes)
    return docs.select("*", predict(docs.sparkSession, model, F.col(text_col)).alias("lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns], "lang_pred.lang_pred", "lang_pred.score")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
