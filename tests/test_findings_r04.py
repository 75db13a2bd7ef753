"""Findings of round 4: work that many mentions share is done once, in few passes over the table."""
import numpy as np
from pyspark.sql import functions as F

from entlink.operators import byquery as BQ
from entlink.operators import embed as EM
from entlink.plans import link as LK
from entlink.session import persist_table


def _linking(spark, n_contexts=40):
    """Twelve mention vectors with many contexts each; the rows of a text are copies of one vector."""
    rng = np.random.default_rng(4)
    kinds = rng.integers(-3, 4, size=(12, 4)).astype(float) + [0, 0, 0, 9]
    rows = [(f"E{i}", "p", f"o{i % 12}", "L", [float(t) for t in kinds[i % 12]], i) for i in range(600)]
    vectors = persist_table(spark.createDataFrame(rows, "sub string, pred string, obj string, type_obj string, embedding array<float>, vec_id long").repartition(3), "v")
    ms = [(i, f"E{i % 700}" if i % 3 else "none", [float(t) for t in kinds[i % 12]], [float(t) for t in rng.integers(-3, 4, size=4)]) for i in range(12 * n_contexts)]
    return vectors, spark.createDataFrame(ms, "idx long, y_true string, mention_vec array<float>, ctx array<float>")


def test_a_mention_vector_is_searched_once_for_all_contexts(spark, monkeypatch):
    """one row leaves the search for each query and kind of candidate, whatever the copies in the table."""
    vectors, mentions = _linking(spark)
    out = []
    real = BQ.nearest_rows
    monkeypatch.setattr(BQ, "nearest_rows", lambda *a, **kw: (out.append(persist_table(real(*a, **kw), "nearest")), out[-1])[1])
    want = {(r.idx, r.d) for r in LK.predictions(mentions.where("idx < 200"), vectors, 5, contexts={"d": "ctx"}).collect()}
    assert not out
    got = {(r.idx, r.d) for r in LK.predictions(mentions, vectors, 5, contexts={"d": "ctx"}).collect()}
    assert want and want <= got and len(got) == mentions.count()
    assert out[0].count() == out[0].select("_q", "_range").distinct().count() <= 2 * mentions.count()


def test_a_small_query_set_has_no_more_tasks_than_run_at_once(spark):
    rows = spark.range(300).select(F.col("id").alias("_q"), F.array(F.col("id").cast("double")).alias("_qv"))
    assert BQ.spread(rows, 300).select(F.spark_partition_id()).distinct().count() <= spark.sparkContext.defaultParallelism


def test_means_by_key(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i % 7}" if i % 5 else "hub", [float(t) for t in rng.normal(size=3)] if i % 11 else None) for i in range(300)] + [(None, [1.0, 2.0, 3.0]), (None, None), ("empty", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        got = {r.s: (r.embedding, r.n_rows) for r in EM.mean_by_key(spark.createDataFrame(rows, "s string, embedding array<double>").repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {k for k, _ in rows}
    for k in got:
        own = [v for s, v in rows if s == k]
        there = [v for v in own if v is not None]
        assert got[k][1] == len(own) and (got[k][0] is None if not there else np.allclose(got[k][0], np.mean(there, axis=0)))
    plan = EM.mean_by_key(spark.createDataFrame(rows, "s string, embedding array<double>"))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1


def test_entities_without_key_and_labels_of_equal_rank(spark):
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    rows = [(None, label, "a", [1.0]), (None, "p", "b", [3.0]), ("x", label, "b", [2.0]), ("x", label, None, [4.0]), ("x", "p", "z", [6.0]), ("y", "p", "z", [5.0])]
    got = {r.s: (r.embedding, r.n_rows) for r in EM.entity_embeddings(spark.createDataFrame(rows, "s string, p string, o string, embedding array<double>")).collect()}
    assert got == {None: ([1.5], 2), "x": ([4.0], 3), "y": ([5.0], 1)}


def test_a_text_is_encoded_once(spark, monkeypatch):
    """a question is cleaned and encoded once for all of its mentions; equal keys and texts that are null stay as they were."""
    from entlink.functions import encoders as EN
    texts, real = [], EN.hash_embed
    monkeypatch.setattr(EN, "hash_embed", lambda df, *a, **kw: (texts.append(df), real(df, *a, **kw))[1])
    rows = [(i, f"Word{i % 3}", f"u{i}", f"what is word{i % 2} of that?") for i in range(40)] + [(50, None, "u", None), (50, "Word1", "v", "")]
    got = LK.prepare_text_mentions(spark.createDataFrame(rows, "idx long, label string, uri string, question string"), dim=16).collect()
    assert [df.count() for df in texts] == [4, 4]
    assert len([r for r in got if r.idx != 50]) == 40 and len([r for r in got if r.idx == 50]) == 4
    by = {}
    for r in got:
        by.setdefault((r.idx % 3, r.idx % 2) if r.idx < 50 else (r.idx, tuple(r.mention_vec)), set()).add((tuple(r.mention_vec), tuple(r.context_vec)))
    assert all(len(v) == 1 for v in by.values()) and len(by) == 8
