"""Phrase counts against a plain count, whatever memory the tries have, and the query against SQL."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from barspan.llm import phrases
from tests.test_queries import rows as plain_rows

SCHEMA = "doc_id bigint, lang string, text string, phrase string, f string, rank string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = ["a", "b", "the", "The", "é", "x" * 300, "new", "york", "city", "...", "ö ü"]
    rows = [(k, ["en", "de", None][k % 3], " ".join(rng.choice(words, 40)) + ["", ". ", ";", "\n", "\t"][k % 5] + " new york city", "p", "f", "r") for k in range(60)]
    rows += [(100 + k, "hot", "same passage of words, again and again", None, None, None) for k in range(200)]
    rows += [(900, "en", None, None, None, None), (901, None, "", None, None, None), (902, "en", " \t ..;;\n", None, None, None), (None, "de", "one", None, None, None), (903, "en", "w" * 2_000_000, None, None, None), (904, "en", "new york " * 50_000, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def count(docs, longest=3):
    out = {m: Counter() for m in range(1, longest + 1)}
    for r in docs.collect():
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            for m in out:
                for k in range(len(w) - m + 1):
                    out[m][r.lang or "und", " ".join(w[k : k + m])] += 1
    return out


@pytest.fixture(scope="module")
def counted(docs):
    return count(docs)


@pytest.mark.parametrize("limits", [{}, {"entries": 40, "names": 15, "name_bytes": 500}, {"entries": 3}])
@pytest.mark.parametrize("m", [1, 2, 3])
def test_counts_are_whole_under_any_memory(docs, counted, m, limits):
    from pyspark.sql import functions as F

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # A filter that lets all pass counts every phrase.
    spark = docs.sparkSession
    all_pass = (12, spark.sparkContext.broadcast(np.full(64, -1, np.int64)))
    got = {(r.lang, r.phrase): r.f for r in phrases.count_phrases(texts, [m], [all_pass] * (m - 1), **limits).collect()}
    assert got == dict(counted[m])
    both = phrases.count_phrases(texts, [m, 3], [all_pass] * 2, **limits).agg(F.sum("f")).first()[0]
    assert both == sum(sum(counted[k].values()) for k in {m, 3})
    hashed = phrases.count_phrases(texts, [m], [all_pass] * max(1, m - 1), hashed=True, **limits).collect()
    assert sorted(r.f for r in hashed) == sorted(counted[m].values())


def test_blocks_of_any_size_count_the_same():
    data = "A b c. d e f, b c a a a;a b".encode() * 50

    def runs(size):
        c, out = phrases.Counter("en", [2], [(12, np.full(64, -1, np.int64))], 1000, 1000, 1 << 20), Counter()
        for b in [*c.take(data, size), *c.runs()]:
            out.update(dict(zip(b.column("phrase").to_pylist(), b.column("f").to_pylist(), strict=True)))
        return out

    assert runs(1) == runs(7) == runs(1 << 20)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_trie_bursts_and_spills_whole_subtrees(depth):
    trie, rng, want = phrases.HatTrie(depth, burst=40), np.random.default_rng(1), Counter()
    spilled = Counter()

    def spill(down_to):
        for k, c in trie.spill(down_to):
            assert (np.diff(k) > 0).all()
            spilled.update(dict(zip(k.tolist(), c.tolist(), strict=True)))

    for _ in range(40):
        keys = np.zeros(300, np.int64)
        for d in range(depth):
            keys = keys << phrases.ID_BITS | rng.integers(0, [2000, 1500, 40][d], 300)
        keys, n = np.unique(keys, return_counts=True)
        trie.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        if trie.entries > 3000:
            spill(1000)
            assert trie.entries <= 1000
    assert isinstance(trie.root, list)
    spill(0)
    assert trie.entries == 0 and spilled == want
    trie.add(np.array([5]), np.array([2]))
    assert [(k.tolist(), c.tolist()) for k, c in trie.spill(0)] == [([5], [2])]


def brute(counted, least, top, inside):
    n = Counter()
    for (lang, _), f in counted[1].items():
        n[lang] += f
    f = {(lang, p): c for m in counted for (lang, p), c in counted[m].items()}
    found = {k: c for m in (2, 3) for k, c in counted[m].items() if c >= least}
    out = {}
    for (lang, p), a in found.items():
        w = p.split(" ")
        if len(w) == 2 and any(100 * c >= inside * a for (x, q), c in found.items() if x == lang and len(q.split(" ")) == 3 and p in (" ".join(q.split(" ")[:2]), " ".join(q.split(" ")[1:]))):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    return {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1)}


@pytest.mark.parametrize("least, top, bits", [(3, 2000, 27), (2, 5, 27), (3, 2000, 6)])
def test_collocations_match_the_loop(docs, counted, least, top, bits):
    got = {tuple(r) for r in phrases.collocations(docs, least=least, top=top, filter_bits=bits).collect()}
    assert got == brute(counted, least, top, 50) and got


def test_empty_table_and_bad_length(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(none, max_words=4)


def test_query_matches_sql(spark, sf_dir):
    db = duckdb.connect()
    for file in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    assert plain_rows(phrases.op11_phrase_mining(spark, sf_dir).toPandas()) == plain_rows(db.sql(phrases.ORACLE).df())
