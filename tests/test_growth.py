"""Figures that must not grow faster than the input: shuffled rows, workers' memory, tasks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from entlink.operators import byquery as BQ
from entlink.operators import linking as L
from entlink.operators import search as S
from entlink.plans import link as LK
from entlink.session import persist_table


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_neighbourhood_pairs_arise_after_the_last_shuffle(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_VALUES", 7)
    rng = np.random.default_rng(5)
    edges = [("Hub", f"X{j}") for j in range(60)] + [(f"Page{i}", f"X{j}") for i in range(4) for j in rng.choice(60, 20, replace=False)] \
        + [("page1", "x3"), (None, "X1"), ("X7", "Page2"), ("X8", "X8")]
    dis = spark.createDataFrame(edges, "s string, o string")
    golds = [f"X{i}" for i in range(60)] + ["Hub", "nowhere", None, "X1"]
    got = L.disambig_neighbourhood(spark.createDataFrame([(g,) for g in golds], "y_true string"), dis)
    ends = edges + [(o, s) for s, o in edges]
    low = lambda x: x if x is None else x.lower()
    want = set()
    for y in set(golds) - {None}:
        direct = {b for a, b in ends if a == y}
        want |= {(y, low(e)) for e in direct} | {(y, low(b)) for a, b in ends if a is not None and a.lower() in {low(e) for e in direct}}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 60 * 60
    assert "HashAggregate" not in plan(got) and plan(got).count(") Generate\n") == 2
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def searched(spark, n=700, m=60, dim=5):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, dim)).round(2)
    x[100:300] = x[100]          # copies: ties everywhere
    x[7] = 0.0
    q = rng.normal(size=(m, dim)).round(2)
    q[1], q[2], q[3] = x[100], 0.0, q[4]
    rows = [(f"S{i % 23}", "p", f"o{i % 9}", "E" if i % 5 else "L", i if i % 50 else i + 1, [float(t) for t in r], f"g{i % 3}") for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "sub string, pred string, obj string, type_obj string, vec_id long, embedding array<float>, grp string")
    ms = [(i, f"S{i % 23}" if i % 4 else "s3" if i % 8 else "none", [float(t) for t in r], [float(t) for t in r[::-1]], f"g{i % 4}") for i, r in enumerate(q)]
    # stored: of rows in the driver's memory Spark doesn't know the size, which decides how a table is searched
    return persist_table(v.repartition(6), "searched"), spark.createDataFrame(ms, "idx long, y_true string, mention_vec array<float>, ctx array<float>, grp string")


def same_both_ways(monkeypatch, run):
    """``run()`` gives equal rows searched by vector and searched by query, in small blocks and chunks."""
    got = []
    for least in (10 ** 9, 0):
        monkeypatch.setattr(BQ, "LEAST_QUERIES", least)
        got.append(sorted(tuple(round(x, 9) if isinstance(x, float) else repr(x) for x in r) for r in run().collect()))
        for name, size in (("CHUNK_QUERIES", 7), ("MOST_PAIRS", 500), ("OUT_ROWS", 50), ("CHUNK_ROWS", 300), ("LEAST_TASKS", 5)):
            monkeypatch.setattr(BQ, name, size)
    assert got[0] and got[0] == got[1]


@pytest.mark.parametrize("metric", S.METRICS)
def test_search_by_query(spark, monkeypatch, metric):
    v, m = searched(spark)
    for kw in ({}, {"max_distance": 1.2}, {"group": "grp"}, {"also": {"d": "ctx"}}):
        same_both_ways(monkeypatch, lambda kw=kw: S.knn_join(m, v, 40, metric, payload=["sub", "vec_id", "obj"], **kw))


def test_candidates_by_query(spark, monkeypatch):
    v, m = searched(spark)
    v = v.drop("grp")
    monkeypatch.setattr(S, "RANGE_LIMIT", 90)
    same_both_ways(monkeypatch, lambda: S.candidates(m, v, 5, payload=["sub", "vec_id", "obj"]))
    payload = ["sub", "pred", "obj", "type_obj", "vec_id"]
    one = persist_table(v.dropDuplicates(["sub", "vec_id"]), "searched")
    same_both_ways(monkeypatch, lambda: S.with_payload(LK.candidates_with_fallback(m, one, 5, payload=payload), one, payload)
                   .select("idx", *payload, F.round("distance", 6)))
    near = lambda: L.tied_candidates(LK.candidates_with_fallback(m, v, 5, contexts={"d_ctx": "ctx"}, nearest=1), v)
    same_both_ways(monkeypatch, near)


def test_predictions_by_query(spark, monkeypatch):
    v, m = searched(spark)
    for group in (None, "grp"):
        vs = persist_table(v.withColumn("sub", F.concat("grp", F.lit("|"), "sub")), "searched") if group else v.drop("grp")
        ms = m.withColumn("y_true", F.concat("grp", F.lit("|"), "y_true")) if group else m
        same_both_ways(monkeypatch, lambda vs=vs, ms=ms, group=group: LK.predictions(ms, vs, 5, contexts={"a": "ctx", "b": "mention_vec"}, group=group))


def test_range_search_by_query_shuffles_no_result(spark, monkeypatch):
    v, m = searched(spark)
    monkeypatch.setattr(BQ, "LEAST_QUERIES", 10)
    top = S.range_search(m, v, payload=["sub", "vec_id"])
    assert "Window" not in plan(top) and "distance" not in " ".join(re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)", plan(top)))
    cands = LK.candidates_with_fallback(m, v.drop("grp"), payload=["sub", "pred", "obj", "type_obj", "vec_id"])
    assert "distance" not in " ".join(re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)", plan(cands)))


def test_conll_sentences_stay_with_their_document(spark, tmp_path):
    from entlink.sources.datasets import read_conll
    text = "head\n-DOCSTART- (1 a\nJoe\tB\tJoe\tx\ten.wikipedia.org/wiki/Joe\t0\t0\nruns\n\n\nJoe\tB\tJoe\tx\ten.wikipedia.org/wiki/Joe_2\t0\t0\nJoe\tB\tJoe\tx\ten.wikipedia.org/wiki/Joe_3\t0\t0\nsits" \
        "\n-DOCSTART- (1 a\n\n-DOCSTART- (2 b\nlast\n"
    (tmp_path / "f.conll").write_text(text)
    sentences, mentions, documents = read_conll(spark, str(tmp_path))
    got = sorted((r.record, r.doc_key, r.sid, r.text) for r in sentences.collect())
    assert [g[1:] for g in got] == [(" (1 a", 0, "Joe runs "), (" (1 a", 1, ""), (" (1 a", 2, "Joe Joe sits "), (" (1 a", 0, ""), (" (1 a", 1, ""), (" (2 b", 0, "last ")]
    assert sorted((r.sid, r.m_pos, r.label, r.uri) for r in mentions.collect()) == [(0, 0, "Joe", "http://dbpedia.org/resource/Joe"), (2, 0, "Joe", "http://dbpedia.org/resource/Joe_3")]
    assert sorted((r.doc_key, r.text) for r in documents.collect()) == [(" (1 a", "Joe runs Joe Joe sits "), (" (2 b", "last ")]
    assert "Exchange" not in plan(sentences) and "Exchange" not in plan(documents) and "Window" not in plan(mentions)


def test_cells_by_query(spark, monkeypatch):
    v, m = searched(spark, n=300, m=20)
    v = persist_table(v.drop("grp").unionByName(v.drop("grp")), "searched")      # every row twice
    lists, cents = S.ivf_index(v, 6)
    twice = m.unionByName(m.where("idx < 3"))
    same_both_ways(monkeypatch, lambda: S.range_search(twice, v, limit=40, payload=["sub", "vec_id"]))
    same_both_ways(monkeypatch, lambda: LK.predictions(twice, v, 5, contexts={"a": "ctx"}))
    m = twice
    same_both_ways(monkeypatch, lambda: S.ivf_search(m, lists, cents, 30, probes=4, payload=["sub", "pred", "obj", "vec_id"]))
