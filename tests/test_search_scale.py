"""Search and linking where they must hold at scale: bounded workers, two merge
levels, no vector in a shuffle, heavy keys, resume, missing predictions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from entlink.operators import embed as EM
from entlink.operators import linking as L
from entlink.operators import metrics as M
from entlink.operators import search as S
from entlink.plans import link as LK
from entlink.plans.fixtures import load

SF = "/root/testdata/sf0.001"
PAYLOAD = ["sub", "pred", "obj", "type_obj", "vec_id"]


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchanged(text: str) -> str:
    """What shuffles of a formatted plan carry."""
    return " ".join(re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)", text))


def vectors_and_queries(spark, n=900, m=23, dim=5):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    x[100:400] = x[100]          # a third of all rows are copies: ties everywhere
    x[7] = 0.0
    q = rng.normal(size=(m, dim))
    q[1] = x[100]
    v = spark.createDataFrame([(f"s{i % 40}", i, [float(t) for t in r]) for i, r in enumerate(x)], "sub string, vec_id long, embedding array<float>")
    m = spark.createDataFrame([(i, [float(t) for t in r], [float(t) for t in r[::-1]]) for i, r in enumerate(q)], "idx long, mention_vec array<float>, ctx array<float>")
    return x.astype(np.float32).astype(float), q.astype(np.float32).astype(float), v, m


def same_top(got, x, q, k, metric="cosine"):
    """Each row's distance is right, and each query's distances are the k smallest."""
    found = {}
    for i, row in enumerate(q):
        d = -x @ row if metric == "dot" else np.linalg.norm(x - row, axis=1) if metric == "l2" else 1 - (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]) @ (row / np.linalg.norm(row))
        if metric == "cosine":
            d[np.linalg.norm(x, axis=1) == 0] = np.inf
        own = sorted((r.distance, r.vec_id) for r in got if r.idx == i)
        assert len({j for _, j in own}) == len(own) and np.allclose([e for e, _ in own], d[[j for _, j in own]], atol=1e-6)
        assert np.allclose([e for e, _ in own], sorted(d[np.isfinite(d)])[:k], atol=1e-6)
        found[i] = len(own)
    return sum(found.values()) == len(got)


@pytest.mark.parametrize("metric", S.METRICS)
def test_bounds_blocks_and_two_levels_change_nothing(spark, metric, monkeypatch):
    x, q, v, m = vectors_and_queries(spark)
    monkeypatch.setattr(S, "SLICE_ROWS", 16)
    for kw in ({}, {"salts": 6, "sample": 0.4, "query_chunk": 4}, {"salts": 3, "sample": 0.0, "query_chunk": 1}):
        got = S.knn_join(m, v.repartition(9), 20, metric, payload=["vec_id"], **kw).collect()
        assert same_top(got, x, q, 20, metric)


def test_five_hundred_partitions(spark):
    x, q, v, m = vectors_and_queries(spark)
    got = S.knn_join(m, v.repartition(500), 7, payload=["vec_id"], salts=22, sample=0.2, query_chunk=5)
    assert len(re.findall(r"\) Window\n", plan(got))) == 2 and same_top(got.collect(), x, q, 7)


def test_a_worker_holds_one_chunk_of_queries(spark):
    _, _, _, m = vectors_and_queries(spark)
    qs = S.stage_queries(m.repartition(6), "idx", "mention_vec")
    S._QCACHE.clear()
    chunks = list(S.query_chunks(qs.path, 5, qs.n))
    assert [c.num_rows for c in chunks] == [5, 5, 5, 5, 3] and not S._QCACHE
    assert sorted(i for c in chunks for i in c.column("_q").to_pylist()) == list(range(23))
    assert [c.num_rows for c in S.query_chunks(qs.path, 100, qs.n)] == [23] and len(S._QCACHE) == 1


def test_expansion_of_hub_subjects(spark, monkeypatch):
    x, q, v, m = vectors_and_queries(spark)
    monkeypatch.setattr(S, "HELD_ROWS", 64)
    hub = v.withColumn("sub", F.when(F.col("vec_id") % 3 == 0, "hub").otherwise(F.col("sub")))
    own = m.select(F.col("idx").alias("_q"), F.col("mention_vec").cast("array<double>").alias("_qv"), "ctx",
                   F.when(F.col("idx") % 2 == 0, F.array(F.lit("hub"), F.lit("s1"), F.lit("none"))).otherwise(F.array(F.lit("s2"))).alias("_subs"))
    got = {(r.idx, r.vec_id): (r.distance, r.d) for r in S.expand(own, hub.repartition(7), ["vec_id"], {"d": "ctx"}).collect()}
    subs = {r.vec_id: r["sub"] for r in hub.collect()}
    want = {(i, j) for i in range(len(q)) for j in range(len(x)) if subs[j] in (("hub", "s1") if i % 2 == 0 else ("s2",))}
    assert set(got) == want
    for (i, j), (d, ctx) in got.items():
        assert abs(ctx - np.linalg.norm(x[j] - q[i][::-1])) < 1e-6
        assert d is None if not x[j].any() else abs(d - (1 - x[j] @ q[i] / np.linalg.norm(x[j]) / np.linalg.norm(q[i]))) < 1e-6


def test_linking_shuffles_no_vector_and_reads_the_table_four_times(spark, monkeypatch):
    vectors, mentions, disambig = load(spark, SF, "vectors", "mentions", "disambig")
    path = S.scratch_path(spark, "vector-table-under-test")
    vectors.write.parquet(path)
    vectors = spark.read.parquet(path)
    plans = []
    keep = lambda df, name, real=LK.persist_table: (plans.append(plan(df)), real(df, name))[1]
    for module in (LK, S):
        monkeypatch.setattr(module, "persist_table", keep)
    monkeypatch.setattr("entlink.session.persist_table", keep)
    staged = S.stage_queries
    log = LK.link_mentions(mentions, vectors, disambig)
    plans.append(plan(log))
    assert log.count() == mentions.count() and S.stage_queries is staged
    assert not any(re.search(r"\bembedding#", exchanged(p)) for p in plans)
    scans = re.findall(rf"Location: InMemoryFileIndex \[[^\]]*{path.rsplit('/', 1)[1]}", "\n".join(plans))
    assert 2 <= len(scans) <= 4


def test_presence_by_bloom_filter(spark, monkeypatch):
    vectors = spark.range(0, 20_000).select(F.concat(F.lit("http://E/"), "id").alias("sub"))
    mentions = spark.range(0, 3000).select(F.col("id").alias("idx"), F.when(F.col("id") % 10 == 9, None).otherwise(F.concat(F.lit("HTTP://e/"), F.col("id") * 11)).alias("y_true"))
    keys = mentions.where("y_true is not null").select(F.lower("y_true").alias("_k"))
    bloom = L.key_filter(keys, 3000)
    subs = vectors.select(F.lower("sub").alias("_k"))
    passed = L.might_be_in(subs, bloom, 3000)
    true = subs.join(keys, "_k", "left_semi").count()
    assert true == passed.join(keys, "_k", "left_semi").count() and passed.count() < true + 0.2 * 20_000
    exact = [sorted(r.idx for r in d.collect()) for d in L.split_present(mentions, vectors, n_rows=3000)]
    monkeypatch.setattr(S, "BROADCAST_BYTES", 8192)
    assert L._found_keys(mentions, vectors, "y_true", "sub", 3000).count() == true
    assert [sorted(r.idx for r in d.collect()) for d in L.split_present(mentions, vectors, n_rows=3000)] == exact
    assert len(exact[0]) == true and len(exact[0]) + len(exact[1]) == 3000


def test_resume_keeps_finished_rows(spark):
    vectors, mentions, disambig = load(spark, SF, "vectors", "mentions", "disambig")
    whole = {tuple(r) for r in LK.link_mentions(mentions, vectors, disambig).collect()}
    first = min(r[0] for r in whole)
    done = spark.createDataFrame([(first, "g", "http://kept", "Error"), (first, "g", "http://kept", "Error"), (-77, "g", None, "Error")],
                                 "idx int, y_true string, y_pred string, status string")
    got = LK.link_mentions(mentions, vectors, disambig, done=done)
    assert got.columns == ["idx", "y_true", "y_pred", "y_pred_dis", "status"]
    assert {tuple(r) for r in got.collect()} == {r for r in whole if r[0] != first} | {(first, "g", "http://kept", "http://kept", "Error")}
    assert {tuple(r) for r in LK.link_mentions(mentions, vectors, disambig, done=done.limit(0)).collect()} == whole


def test_popular_target_is_split(spark):
    links = spark.range(0, 4000).select(F.concat(F.lit("e"), F.col("id") % 500).alias("s"), F.when(F.col("id") % 2 == 0, F.lit("hub")).otherwise(F.concat(F.lit("e"), F.col("id") % 333)).alias("o"))
    links = links.distinct().repartition(8)
    vecs = spark.range(0, 500).select(F.concat(F.lit("e"), "id").alias("s"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding")) \
        .union(spark.createDataFrame([("hub", [5.0, 0.0])], "s string, embedding array<double>"))
    plain = EM.neighbour_rows(vecs, links)
    split = EM.neighbour_rows(vecs, links, heavy_degree=100)
    rows = lambda df: sorted((r.s, r.nb, tuple(r.embedding)) for r in df.collect())
    assert rows(plain) == rows(split)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in EM.neighbour_rows(vecs, links, heavy_degree=100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < sum(sizes) / 4
        heavy, bound = EM.heavy_targets(links, 100, 100)
        assert [r["_o"] for r in heavy.collect()] == ["hub"] and bound == 100
        a, b = (sorted((r.s, [round(x, 9) for x in r.embedding], r.n_rows) for r in EM.neighbourhood_embedding(vecs, links, heavy_degree=h).collect()) for h in (None, 100))
        assert a == b
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_cells_are_balanced_and_pruned(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 6))
    x[:1000] = [1, 2, 3, 4, 5, 6]          # a third of all rows in one place
    rows = [(i, [float(t) for t in r]) for i, r in enumerate(x)] + [(-1, [0.0] * 6), (-2, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    lists, cents = S.ivf_index(v, 12)
    sizes = [r["count"] for r in lists.groupBy("cell").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 12
    assert {r.vec_id for r in lists.select("vec_id").distinct().collect()} == set(range(3000))
    q = spark.createDataFrame([(i, [float(t) for t in x[1000 + 90 * i]]) for i in range(20)], "idx long, mention_vec array<float>")
    exact = S.cosine_top_k(q, v, 10, payload=["vec_id"]).select("idx", "vec_id")
    near = S.ivf_search(q, lists, cents, 10, probes=8, per_cell=30, payload=["vec_id"])
    assert "dynamicpruning" in plan(near)
    assert exact.join(near, ["idx", "vec_id"]).count() >= 0.9 * exact.count()


def test_missing_predictions_are_errors(spark):
    df = spark.createDataFrame([("a", "A"), ("b", None), ("c", None), ("d", "x")], "y_true string, y_pred string")
    m = M.metrics(df).first()
    assert (m.n, m.accuracy, m.micro_precision, m.micro_recall) == (4, 0.25, 0.5, 0.25)
    assert M.accuracy(df).first().asDict() == {"accuracy": 0.25, "n": 4}
    counts = {r.cls: (r.tp, r.fp, r.fn) for r in M.per_class_counts(df).collect()}
    assert counts == {"a": (1, 0, 0), "b": (0, 0, 1), "c": (0, 0, 1), "d": (0, 0, 1), "x": (0, 1, 0)}


def test_rank_vote_by_text(spark):
    c = spark.createDataFrame([(1, "A", "t", 1, 0.1), (1, "B", "t", 2, 0.2), (1, "B", "u", 3, 0.2), (1, "A", "t", 4, 0.9)],
                              "idx int, sub string, obj string, vec_id int, distance double")
    by_text = L.rank_vote(c, by="obj").first()      # ranks 0, 0, 1, 2: the text changes where the distance doesn't, and back
    assert by_text.y_pred == "b" and abs(by_text.score - 1.5) < 1e-9
    by_distance = L.rank_vote(c).first()            # ranks 0, 1, 1, 2
    assert by_distance.y_pred == "a" and abs(by_distance.score - (1 + 1 / 3)) < 1e-9


def test_factorised_neighbourhood(spark):
    rng = np.random.default_rng(3)
    edges = [(f"Page{i}", f"X{j}") for i in range(6) for j in rng.choice(60, 25, replace=False)] + [("page1", "x3"), (None, "X1"), ("X7", "Page2")]
    dis = spark.createDataFrame(edges, "s string, o string")
    preds = spark.createDataFrame([(i, f"X{i % 50}", v) for i, v in enumerate([f"x{int(k)}" for k in rng.integers(0, 70, 300)] + ["PAGE1", None])], "idx int, y_true string, y_pred string")
    n = L.neighbourhood(preds, dis)
    want = {tuple(r) for r in L.disambig_neighbourhood(preds, dis.where("s is not null")).collect()}
    assert {tuple(r) for r in n.flat().collect()} == want
    assert {r.idx for r in n.contains(preds).collect()} == {r.idx for r in preds.collect() if r.y_pred and (r.y_true, r.y_pred.lower()) in want}
    assert n.direct.count() + n.members.count() <= 4 * len(edges) < n.flat().count()
    sizes = {r.y_true: (r.n_direct, r.n_paths) for r in n.sizes().collect()}
    assert all(d >= 1 and d + p >= sum(y == t for y, _ in want) for t, (d, p) in sizes.items())


def test_a_chunk_holds_few_more_pairs_than_its_answers(tmp_path, monkeypatch):
    """Of a block's pairs only those are held that can be answers, ties and copies included."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from entlink.operators import byquery as BQ

    rng, n, k = np.random.default_rng(3), 6000, 10
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[100:140], x[7] = x[50], 0.0
    pq.write_table(pa.table({"_row": np.arange(n), "_x": pa.array(list(x), pa.list_(pa.float32()))}), str(tmp_path / "part-0.parquet"), row_group_size=1000)
    q = np.concatenate([rng.normal(size=(127, 8)), x[50:51].astype(float)])
    measured, plain = [], BQ.S._pair_l2
    monkeypatch.setattr(BQ.S, "_pair_l2", lambda xs, qs, rows, cols: measured.append(len(rows)) or plain(xs, qs, rows, cols))
    for metric in ("l2", "cosine"):
        rows, cols, dist = BQ.top_of_store(str(tmp_path), q, None, k, metric)
        d = np.linalg.norm(x.astype(float)[:, None] - q[None], axis=2) if metric == "l2" else BQ.S._block_distance(x.astype(float), q, metric)
        for i in range(len(q)):
            want = np.lexsort((np.arange(n), np.round(d[:, i], 9)))[:k]
            own = rows[cols == i]
            assert sorted(own) == sorted(want) and np.allclose(np.sort(dist[cols == i]), np.sort(d[want, i]))
    assert measured and max(measured) <= len(q) * k + BQ.FEW_PAIRS
