"""What near-duplicate detection joins goes into tables that are read, not joined again in each job that uses them."""

from test_growth import star

from barspan.llm import neardup


def test_groups_are_made_from_tables(spark, monkeypatch):
    joins, cut = {}, neardup.cut

    def counting(df, name):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return cut(df, name)

    monkeypatch.setattr(neardup, "cut", counting)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")
    assert neardup.near_duplicates(star(spark, 600), width=5, percent=80).count() == 600
    # 25 in ring-groups and in leaves when these were joined anew.
    assert max(n for name, n in joins.items() if "groups" in name or name == "leaves") <= 6, joins
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
