import math

from pyspark.sql import functions as F

from entlink.operators import counting as CT
from entlink.operators import embed as EM
from entlink.operators import linking as L
from entlink.operators import metrics as M

LBL = "http://www.w3.org/2000/01/rdf-schema#label"


def test_literal_count_ci_and_nulls(spark):
    df = spark.createDataFrame([("a", "p", "English"), ("b", "p", "english"), ("c", "p", "Other"), ("d", "p", None)],
                               "s string, p string, o string")
    got = {r.s: r["count"] for r in CT.with_literal_count(df).collect()}
    assert got == {"a": 2, "b": 2, "c": 1}
    exact = {r.s: r["count"] for r in CT.with_literal_count(df, exact=True).collect()}
    assert exact == {"a": 1, "b": 1, "c": 1}


def test_top_n_grouped_superset_of_simple(spark):
    rows = [("e", "p", f"o{i}", c) for i, c in enumerate([1, 1, 2, 3, 3, 5])]
    df = spark.createDataFrame(rows, "s string, p string, o string, count long")
    simple = CT.top_n(df, 2, "SIMPLE").collect()
    grouped = CT.top_n(df, 2, "GROUPED").collect()
    assert sorted(r.o for r in simple) == ["o0", "o1"]
    assert sorted(r.o for r in grouped) == ["o0", "o1", "o2"]
    assert {r.o for r in simple} <= {r.o for r in grouped}


def test_mean_of_equal_vectors_is_the_vector(spark):
    df = spark.createDataFrame([("e", [0.5, -1.0])] * 4, "s string, embedding array<float>")
    r = EM.mean_embedding(df).collect()[0]
    assert r.embedding == [0.5, -1.0] and r.n_rows == 4


def test_label_blend(spark):
    df = spark.createDataFrame([("e", LBL, "Name", [1.0, 1.0]), ("e", "p2", "x", [3.0, 3.0]),
                                ("f", LBL, "Only", [2.0, 0.0])],
                               "s string, p string, o string, embedding array<float>")
    got = {r.s: r.embedding for r in EM.entity_embeddings(df).collect()}
    assert got["e"] == [1.5, 1.5]      # mean(mean=[2,2], label=[1,1])
    assert got["f"] == [2.0, 0.0]      # single row: no blend


def test_concat_literals(spark):
    df = spark.createDataFrame([("e", "http://b", "beta"), ("e", LBL, "Name"), ("e", "http://a", "alpha")],
                               "s string, p string, o string")
    r = EM.concat_literals(df).collect()[0]
    assert r.text == "alpha. beta. Name" and r.label == "Name"


def test_metrics_micro_f1_equals_accuracy(spark):
    df = spark.createDataFrame([(1, "A", "a"), (2, "A", "B"), (3, "B", "B"), (4, "C", "A")],
                               "idx int, y_true string, y_pred string")
    m = M.metrics(df).collect()[0]
    assert math.isclose(m.accuracy, 0.5) and math.isclose(m.micro_f1, m.accuracy)
    # classes a, b, c: P = (1/2, 1/2, 0), R = (1/2, 1, 0)
    assert math.isclose(m.macro_precision, 1 / 3) and math.isclose(m.macro_recall, 0.5)


def test_disambiguation_forgiveness(spark):
    dis = spark.createDataFrame([("Page", "X1"), ("Page", "X2"), ("Other", "Z")], "s string, o string")
    preds = spark.createDataFrame([(1, "X1", "x2"), (2, "X1", "Z"), (3, "X1", "x1"), (4, "X1", "page")],
                                  "idx int, y_true string, y_pred string")
    st = {r.idx: r.status for r in L.apply_disambiguation(preds, dis).collect()}
    assert st == {1: "Disambiguated", 2: "Error", 3: "Correct", 4: "Disambiguated"}
    nbr = {(r.y_true, r.e) for r in L.disambig_neighbourhood(preds, dis).collect()}
    assert nbr == {("X1", "page"), ("X1", "x1"), ("X1", "x2")}


def test_rerank_ties_go_to_earlier_candidate(spark):
    c = spark.createDataFrame([(1, "B", "o", 0.2, 1.0), (1, "A", "o", 0.3, 1.0), (1, "C", "o", 0.1, 2.0)],
                              "idx int, sub string, obj string, distance double, d_ctx double")
    r = L.rerank(c).collect()[0]
    assert r.y_pred == "B"


def test_rank_vote(spark):
    c = spark.createDataFrame([(1, "A", "o1", 1, 0.1), (1, "B", "o2", 2, 0.1), (1, "B", "o3", 3, 0.2),
                               (1, "A", "o4", 4, 0.9)], "idx int, sub string, obj string, vec_id int, distance double")
    r = L.rank_vote(c).collect()[0]
    # ranks: 0, 0, 1, 2 -> A: 1 + 1/3, B: 1 + 1/2
    assert r.y_pred == "b" and math.isclose(r.score, 1.5)


def test_with_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    out = L.with_index(df, ["k"]).collect()
    assert sorted((r["index"], r.k) for r in out) == [(i, i) for i in range(1000)]


def test_sample_mentions_counts_present_only(spark):
    m = spark.range(0, 100).withColumnRenamed("id", "idx")
    present = m.where(F.col("idx") % 2 == 0)
    s = L.sample_mentions(m, present, n=10, seed=448)
    rows = s.collect()
    assert sum(1 for r in rows if r.idx % 2 == 0) == 10
    again = L.sample_mentions(m.repartition(7), present, n=10, seed=448).collect()
    assert sorted(r.idx for r in rows) == sorted(r.idx for r in again)
    assert L.sample_mentions(m, present, n=60).count() == 100           # fewer are present: all stay
    assert L.sample_mentions(m, m.where("idx < 0"), n=10).count() == 100


def test_zero_vectors_do_not_hide_others(spark):
    from entlink.operators import search as S
    v = spark.createDataFrame([(i, [float(i % 5), 1.0] if i else [0.0, 0.0]) for i in range(20)], "vid int, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)] + [(9, [0.0, 0.0])], "idx int, mention_vec array<float>")
    got = S.knn_join(q, v, 30, payload=["vid"]).collect()
    assert sorted((r.idx, r.vid) for r in got) == [(i, j) for i in range(3) for j in range(1, 20)]
    same = S.knn_join(q, q.select(F.col("idx").alias("vid"), F.col("mention_vec").alias("embedding")), 1, "l2", payload=["vid"]).collect()
    assert all(r.idx == r.vid and r.distance == 0.0 for r in same)


def test_hot_key_and_hub_entity_stay_exact(spark):
    # one literal text holds a third of all rows; one entity holds a third of all rows
    rows = [(f"e{i % 50}", "p", "English" if i % 3 == 0 else f"t{i}", i) for i in range(3000)]
    rows += [("hub", "p", f"h{i}", 10000 + i) for i in range(1500)]
    df = spark.createDataFrame(rows, "s string, p string, o string, vid int").repartition(16)
    c = CT.with_literal_count(df)
    assert c.where(F.col("o") == "English").select("count").distinct().collect()[0][0] == 1000
    assert c.count() == 4500
    top = CT.top_n(c, 3, "SIMPLE", tie_break=["vid"])
    assert top.where(F.col("s") == "hub").count() == 3
    g = CT.top_n(c, 1, "GROUPED")
    assert g.where(F.col("s") == "hub").count() == 1500     # all hub literals share count 1
