import re

from pyspark.sql import functions as F

import corpus_pipeline
from barspan.llm import common
from barspan.llm.common import cut, small_batches


def test_stages_keep_the_columns_and_their_decisions(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, sf_dir), name)
            assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]


def test_run_packs_what_the_stages_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = cut(stage(spark, kept, sf_dir), "kept")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 0 < len(ids) < docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == ids


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_duplicate_stages_match_brute_force_row_by_row(spark, sf_dir):
    """Null and repeated ids, repeated rows and columns named as the operators' results."""
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w30", "x")
    rows = [(1, base, 1.0, "a"), (2, base.upper(), 2.0, "b"), (2, base.upper(), 2.0, "b"), (None, base, 3.0, "c"), (None, near, 4.0, "d"), (3, near + " y", 5.0, "e"), (3, "else altogether", 6.0, "f")]
    rows += [(None, "only null ids", 7.0, "g"), (None, "only null ids", 7.0, "g"), (4, None, 8.0, "h"), (5, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, row string").withColumn("number", F.lit(1)).withColumn("kept", F.lit(True)).withColumn("component_id", F.lit("z"))
    columns = docs.columns
    exact = cut(corpus_pipeline.exact_duplicates(spark, docs, sf_dir), "exact")
    best = {}
    for i, text, score, tag in rows:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        best[key] = max(best.get(key, (False, 0, 0.0, "")), (i is not None, i or 0, score or 0.0, tag or ""))
    assert exact.columns == columns
    assert sorted((r.doc_id or 0, r.score or 0.0, r.row or "") for r in exact.collect()) == sorted(v[1:] for v in best.values())
    kept = corpus_pipeline.near_duplicates(spark, exact, sf_dir)
    sets = {(r.doc_id, r.row): {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(r.text)) else set() for r in exact.collect()}
    linked = lambda a, b: sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    order = sorted(sets, key=lambda x: (x[0] is None, x[0] or 0))
    want = [x for n, x in enumerate(order) if not any(linked(x, y) for y in order[:n])]
    assert kept.columns == columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.row)) for r in kept.collect())


def test_stages_bound_the_batches_of_python_workers(spark, sf_dir, no_docs):
    """Long texts reach a worker a few at a time, not 10,000 rows whatever their length."""
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            stage(spark, no_docs.select("doc_id", "text", "lang", "source", "n_chars"), sf_dir)
            long = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
            assert max(r.n for r in long.mapInArrow(sizes, "n bigint").collect()) < 5 << 20
        for own, most in (("1m", 1 << 20), ("1024", 1024), ("64MB", 4 << 20)):
            spark.conf.set(name, own)
            small_batches(spark)
            assert common._bytes(spark.conf.get(name)) == most
    finally:
        spark.conf.set(name, before)
