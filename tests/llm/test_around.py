"""Pivots meet the members of their nodes in one join a turn, whose rows grow in proportion to a family."""

from test_growth import star

from barspan.llm import neardup


def test_pivots_meet_their_nodes_once_and_in_proportion(spark, monkeypatch):
    plans, rows, cut = [], {}, neardup.cut

    def looking(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = cut(df, name)
        if name.startswith("around"):
            rows[size] = rows.get(size, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "cut", looking)
    for size in (600, 2400):
        plans.clear()
        assert neardup.near_duplicates(star(spark, size), width=5, percent=80).count() == size
        met = sum(p.count("NOT (rep#") for p in plans)
        assert 1 <= met <= neardup.FAMILY_TURNS
    assert rows[2400] <= 1.2 * 4 * rows[600]
