"""The near-duplicate groups of one family grow in proportion to it."""

import numpy as np

from barspan.llm import neardup


def star(spark, size):
    """Copies of one text with words replaced at random: most link to it, the others lie in its ring."""
    rng, core = np.random.default_rng(3), [f"w{k}" for k in range(150)]
    rows = []
    for i in range(size):
        own = list(core)
        for k in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4, "doc_id")


def test_group_rows_grow_in_proportion(spark, monkeypatch):
    seen, cut = [], neardup.cut

    def counting(df, name):
        out = cut(df, name)
        if "groups" in name or name == "leaves":
            seen.append(out.count())
        return out

    monkeypatch.setattr(neardup, "cut", counting)
    rows = {}
    for size in (1200, 4800):
        seen.clear()
        found = neardup.near_duplicates(star(spark, size), width=5, percent=80)
        assert found.count() == size
        rows[size] = sum(seen)
    assert rows[4800] <= 1.2 * 4 * rows[1200]
