import numpy as np

from barspan.llm import ann, langid, quality


def test_language_of_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = langid.op5_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_takes_odd_rows(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == 13 and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert set(odd_docs.columns) < set(rows[0].asDict())
    assert langid.identify(no_docs).count() == 0
    unlabelled = langid.identify(odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 1)).filter("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_backoff_prefers_the_longest_known_gram():
    row = {"^ab": np.array([1.0, 0.0], np.float32), "c": np.array([0.0, 4.0], np.float32), "$": np.array([2.0, 2.0], np.float32)}
    model = langid.LanguageModel(["x", "y"], {}, row, 3)
    assert model.word_row("abc").tolist() == [1.0, 2.0]
    assert model.word_row("zz").tolist() == [2.0, 2.0]


def test_quality_of_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = quality.op6_quality(spark, big).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_takes_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (6, 0), (7, 1), (9, 0), (9, 1), (None, 1), (10, None)], "doc_id bigint, quality int")
    rows = quality.score(odd_docs, labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(no_docs, labels).count() == 0


def test_network_learns_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.fit_network(x, y, epochs=60, rate=1e-2, decay=0)
    assert np.mean((quality.logits(net, x) > 0) == y) > 0.9
    z = rng.normal(size=4000) * 3
    truth = (rng.uniform(size=4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert 2.2 < quality.fit_temperature(3 * z, truth) < 4.2


def exact_neighbours(ids, x, k):
    out = {}
    for a, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[a]
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[int(i)] = [int(ids[j]) for j in order]
    return out


def test_search_recall_and_scores(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = ann.op1_multiprobe_ann(spark, sf_dir).collect()
    table = {r.vec_id: np.array(r.embedding, float) for r in base.collect()}
    ids = np.array(sorted(table))
    want = exact_neighbours(ids, np.stack([table[i] for i in ids]), 20)
    got = {q: [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9
    for r in rows:
        assert abs(r.score - table[r.query_id] @ table[r.vec_id]) < 1e-12


def test_search_ties_hot_vectors_and_odd_rows(spark):
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(0, 90)] + [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [float("nan"), 0.0, 1.0]), (180, [1.0]), (None, [1.0, 0.0, 0.0]), (200, [-1.0, 0.0, 0.0])]
    base = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(base.filter("vec_id % 20 = 0"), base, k=5, group_rows=16, probes=12).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert by[0] == [1, 2, 3, 4, 5] and by[20] == [0, 1, 2, 3, 4] and not {100, 120, 140, 160, 180} & set(by)
    assert ann.search(base.limit(0), base.limit(0)).count() == 0


def test_only_letters_are_words(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("½ ² Ⅷ ① 7", None), ("und das ist ein haus", "de"), ("the house is a home", "en"), ("½ house", None)] * 5)], "doc_id bigint, text string, lang string")
    got = {r.text: r.lang_pred for r in langid.identify(docs).collect()}
    assert got["½ ² Ⅷ ① 7"] == "und" and got["½ house"] == "en"


def test_a_worker_holds_the_tables_of_a_language_model_once():
    """A worker's copy of 60,000 rows takes little more than their names."""
    import pickle
    import tracemalloc

    import pandas as pd

    counts = pd.DataFrame({"lang": ["a", "b"] * 30_000, "item": [f"w{k}" for k in range(60_000)], "n": 1})
    sent = pickle.dumps(langid._table(counts, ["a", "b"]))
    tracemalloc.start()
    table = pickle.loads(sent)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 11 << 20 and table.get("w7").tolist() == table.get("w9").tolist() and table.get("w60000") is None


def test_rows_of_chunks_go_with_their_last_use():
    import gc
    import weakref

    from barspan.llm.common import ChunkRows

    gc.disable()
    try:
        rows = ChunkRows(lambda c: np.ones(2), 2, 10)
        assert rows.total(["a", "b", "a"]).tolist() == [3, 3]
        gone = weakref.ref(rows)
        del rows
        assert gone() is None
    finally:
        gc.enable()
