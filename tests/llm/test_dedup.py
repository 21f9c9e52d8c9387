import collections
import re

import pytest

from barspan.llm import exact, neardup
from barspan.llm.components import components


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("digest_bytes,memtable,bucket", [(32, 1 << 17, 1 << 16), (1, 3, 4), (2, 5, 2)])
def test_exact_groups_equal_texts(spark, odd_docs, digest_bytes, memtable, bucket):
    got = exact.dedup(odd_docs, digest_bytes=digest_bytes, memtable_rows=memtable, bucket_rows=bucket).collect()
    rows = [(r.doc_id, lower(r.text)) for r in odd_docs.collect()]
    size, best = collections.Counter(t for _, t in rows), {}
    for i, t in rows:
        if i is not None:
            best[t] = max(i, best.get(t, i))
    want = sorted((str(i), str(best.get(t)), size[t], i == best.get(t)) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == want


def test_exact_keeps_smallest_on_demand_and_takes_empty_tables(spark, odd_docs, no_docs):
    got = {r.doc_id: r.keep_id for r in exact.dedup(odd_docs, keep="smallest").collect()}
    assert got[2] == 1 and got[6] == 6 and got[10] == 9
    assert exact.dedup(no_docs).count() == 0


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, sf_dir, width, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width=width, percent=percent).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], width, percent)


def family(spark, size):
    """One text in many versions: chains of edits, so that near copies link over several steps."""
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(size):
        own = list(words)
        for k in range(i % 23):
            own[(7 * k + i) % 200] = f"x{i % 5}-{k}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"z{i}-{k % 9}" for k in range(40))) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


@pytest.mark.parametrize("leaf,block", [(64, 256), (6, 8)])
def test_large_groups_of_near_copies_match_brute_force(spark, leaf, block):
    docs, rows = family(spark, 160)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width=3, percent=85, leaf=leaf, block=block).collect()}
    assert got == brute(rows, 3, 85)


def test_near_duplicates_take_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in neardup.near_duplicates(odd_docs).collect() if r.doc_id is not None}
    assert got[2].component_id == 1 and got[6].component_id == 5 and got[10].component_id == 9
    assert got[3].n_shingles == 0 and got[3].component_id == 3 and got[3].kept
    assert neardup.near_duplicates(odd_docs).count() == odd_docs.count()
    assert neardup.near_duplicates(no_docs).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.u: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140))
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
