"""Publish-once sinks, packing of long texts, CONCAT vectors in parts."""

import os
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from entlink.functions import text as TX
from entlink.operators import embed as EM
from entlink.plans import encode as EC
from entlink.sinks import stage as ST

LBL = "http://www.w3.org/2000/01/rdf-schema#label"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="entlink-sinks-", dir="/tmp")


def test_reruns_add_nothing(spark, folder):
    df = spark.range(0, 50)
    target = f"{folder}/table"
    assert ST.published(spark, target) is None
    assert ST.publish(df, target, "a") and not ST.publish(df, target, "a") and ST.publish(df, target, "b/../b")
    assert ST.published(spark, target).count() == 100


def test_a_writer_that_stopped_or_came_second_leaves_no_rows(spark, folder, monkeypatch):
    target = f"{folder}/table"
    df = spark.range(0, 50)
    df.write.parquet(f"{target}/data/stopped")          # rows without a manifest
    ST.publish(df, target, "a")
    assert ST.published(spark, target).count() == 50
    # two writers of one run: both saw no manifest, the second finds the first one's when it commits
    real, seen = ST._path, []

    def late(sp, path):
        p, fs = real(sp, path)
        if path.endswith(".json") and not seen:
            seen.append(path)
            ST.publish(df, target, "race")
            return p, type("Fs", (), {"exists": lambda self, x, n=iter([False, True]): next(n), "create": fs.create, "rename": fs.rename})()
        return p, fs

    monkeypatch.setattr(ST, "_path", late)
    assert not ST.publish(df, target, "race")
    assert ST.published(spark, target).count() == 100
    assert len(os.listdir(f"{target}/data")) == 4        # the late one's folder is there, but no table has it


def test_evaluation_outputs_agree(spark, folder):
    log = spark.createDataFrame([(1, "a", "a", "a", "Correct"), (2, "b", "x", "x", "Error"), (3, "c", None, None, "Not present"), (4, "d", "y", "d", "Disambiguated")],
                                "idx long, y_true string, y_pred string, y_pred_dis string, status string")
    metrics = spark.createDataFrame([(4, 0.25)], "n long, accuracy double")
    for run in ("one", "one", "two"):
        ST.write_eval(log, metrics, folder, run)
    counts = {n: ST.published(spark, f"{folder}/{n}").where("run = 'one'").count() for n in ("log", "errors", "disambiguations", "missing", "results")}
    assert counts == {"log": 4, "errors": 1, "disambiguations": 1, "missing": 1, "results": 1}
    assert ST.published(spark, f"{folder}/log").count() == 8


def test_cut_to_widths(spark):
    row = ST.cut_to_widths(spark.createDataFrame([("s" * 300, "p" * 300, "o" * 500), (None, None, "x")], "sub string, pred string, obj string")).collect()
    assert [len(x) for x in row[0]] == [255, 255, 384] and row[1]["sub"] is None


def greedy(parts, n):
    out, buf = [], ""
    for s in parts:
        if len(buf) + len(s) <= n or buf == "":
            buf += s + " "
        else:
            out.append(buf)
            buf = s
    return out + [buf] if buf else out


def test_packing_equals_the_greedy_rule():
    rng = np.random.default_rng(1)
    for n in (1, 5, 20, 60):
        for _ in range(200):
            parts = ["é" * int(k) for k in rng.integers(1, 30, rng.integers(0, 40))]
            assert TX.packed(parts, n) == greedy(parts, n)


def test_packing_of_a_million_sentences_is_linear(spark):
    parts = ["Some words here."] * 1_000_000
    began = time.time()
    assert len(TX.packed(parts, 384)) == len(greedy(parts, 384))
    assert time.time() - began < 20
    got = spark.range(1).select(F.size(TX.chunk_text(F.repeat(F.lit("Some words. "), 100_000), 384)).alias("n")).first()["n"]
    assert got == len(greedy(["Some words."] * 100_000, 384))
    odd = spark.createDataFrame([(None,), ("",), ("!!!" * 300,)], "t string").select(TX.chunk_text("t", 20).alias("c")).collect()
    assert [r["c"] for r in odd] == [[None], [""], []]


def test_concat_pieces_have_the_texts_tokens(spark):
    rng = np.random.default_rng(2)
    rows = [(f"e{int(e)}", str(rng.choice([LBL, "http://a", "http://z"])), str(rng.choice(["Alpha one", "beta", "gamma 3", "", "Beta", "x."]))) for e in rng.integers(0, 40, 300)]
    rows += [("only", LBL, "Name"), ("twice", LBL, "Same"), ("twice", LBL, "Same"), ("twice", "http://z", "end"), ("none", "http://a", None)]
    df = spark.createDataFrame(rows, "s string, p string, o string").where("o is not null or s = 'none'")
    whole = {r.s: (r.text, r.label) for r in EM.concat_literals(df.where("o is not null")).collect()}
    tok = lambda t: sorted(x for x in "".join(c if c.isalnum() and c.isascii() else " " for c in t.lower()).split())
    pieces = EM.concat_pieces(df).groupBy("s").agg(F.collect_list(F.when(~F.col("is_label"), F.col("piece"))).alias("t"), F.max(F.when(F.col("is_label"), F.col("piece"))).alias("label")).collect()
    got = {r.s: (tok(" ".join(r.t)), r.label) for r in pieces}
    assert {s: (tok(t), lab) for s, (t, lab) in whole.items()} == {s: v for s, v in got.items() if s != "none"}


def test_a_hub_is_no_single_tasks_text(spark):
    hub = spark.range(0, 200_000).select(F.lit("hub").alias("s"), F.lit("http://a").alias("p"), F.concat(F.lit("word"), F.col("id") % 997).alias("o"))
    df = hub.unionByName(spark.createDataFrame([("hub", LBL, "Hub"), ("small", LBL, "Small")], "s string, p string, o string")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = EM.concat_pieces(df.where("p = 'http://a'").dropDuplicates()).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(counted) > 1 and max(r["count"] for r in counted) < 0.75 * 997
    got = {r.s: r.embedding for r in EC.concat_vectors(df).collect()}
    assert abs(np.linalg.norm(got["small"]) - 1) < 1e-9 and 0 < np.linalg.norm(got["hub"]) < 1


def test_scratch_tables_can_be_dropped(spark):
    from entlink.session import drop_scratch, local_path, persist_table, scratch_path

    kept = persist_table(spark.range(5), "kept")
    root = os.path.dirname(local_path(scratch_path(spark, "x")))
    assert kept.count() == 5 and os.listdir(root)
    assert drop_scratch(spark) and not os.path.exists(root)
    assert persist_table(spark.range(3), "again").count() == 3
