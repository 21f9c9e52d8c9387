"""Links at the rim of a large family of drifting copies."""

from math import comb

import numpy as np
import pytest

from barspan.llm import neardup


#: Words with which several rim members agreed with the pivot in fewer than ten of the smallest hashes.
SALT = 77


def drifting(spark, salt):
    """700 copies of a text, 250 that have drifted to J = 0.62 together, and for each of these one that drifted on alone."""
    rng, rows = np.random.default_rng(5), []
    core = [f"w{salt}-{k}" for k in range(600)]
    away = core[:465] + [f"a{salt}-{k}" for k in range(135)]
    for i in range(700):
        own = list(core)
        own[480 + int(rng.integers(115))] = f"c{i}"
        rows.append((i, own))
    for i in range(250):
        own = list(away)
        own[480 + int(rng.integers(115))] = f"d{i}"
        rows.append((1000 + i, own))
        far, at = list(own), int(rng.integers(380))
        far[at : at + 58] = [f"e{i}-{k}" for k in range(58)]
        rows.append((2000 + i, far))
    rows = [(i, " ".join(w)) for i, w in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def brute(rows, width, percent):
    vocabulary, sets = {}, []
    for _, text in rows:
        w = text.split()
        sets.append({vocabulary.setdefault(tuple(w[k : k + width]), len(vocabulary)) for k in range(len(w) - width + 1)})
    holds = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, x in enumerate(sets):
        holds[i, list(x)] = 1
    both, size = holds @ holds.T, holds.sum(axis=1)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.array([i for i, _ in rows])
    while True:
        low = np.array([label[x].min() for x in near])
        if (low == label).all():
            return {i: int(c) for (i, _), c in zip(rows, label, strict=True)}
        label = low


def test_many_drifting_copies_match_brute_force(spark):
    docs, rows = drifting(spark, SALT)
    want = brute(rows, 5, 80)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=5, percent=80).collect()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_the_ring_bar_misses_few_at_the_least_similarity(percent):
    p = (3 * percent - 200) / 100
    assert sum(comb(32, k) * p**k * (1 - p) ** (32 - k) for k in range(neardup.ring_bar(percent))) <= neardup.RING_TAIL
