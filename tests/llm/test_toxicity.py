import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from entlink.llm import queries as Q
from entlink.llm import toxicity as tox


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_risk_corrects_for_hidden_positives():
    rng = np.random.default_rng(1)
    n, prior = 6000, 0.3
    hidden = rng.random(n) < prior
    x_u = np.column_stack([np.where(hidden, rng.random(n) < 0.7, rng.random(n) < 0.05), rng.random(n) < 0.5]).astype(np.int8)
    x_p = np.column_stack([rng.random(1500) < 0.7, rng.random(1500) < 0.5]).astype(np.int8)
    w, bias = tox.nnpu(x_p, x_u, prior)
    score = lambda a: 1 / (1 + np.exp(-(bias + np.array(a) @ w)))
    bayes = lambda f: prior * f[0] / (prior * f[0] + (1 - prior) * f[1])
    assert abs(score([1, 0]) - bayes((0.7, 0.05))) < 0.1 and abs(score([0, 0]) - bayes((0.3, 0.95))) < 0.1 and abs(w[1]) < 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in Q.QUERIES["op8_toxicity"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [(got[i]["predicted"], t) for i, t in labels.items() if held_out(i)]
    assert all(r["held_out"] == held_out(i) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    found = sum(p and t for p, t in test)
    print("precision", found / sum(p for p, _ in test), "recall", found / sum(t for _, t in test))
    # 359 toxic labels, a fifth of them in each of three languages with words of their own
    assert found / sum(p for p, _ in test) > 0.7 and found / sum(t for _, t in test) > 0.85


def test_edges(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.2
        rows.append((i, " ".join(rnd.choice(["tree", "house", "sky"]) for _ in range(20)) + (" BAD," if bad else ""), "x"))
        if rnd.random() < 0.6:
            labels.append((i, int(bad)))
    rows += [(None, "bad bad", "x"), (None, None, "x"), (601, "", "x"), (3, rows[3][1], "x"), (602, "bad " + "tree " * 100000, "x")]
    labels += [(None, 1), (602, None), (7777, 0), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tox.score(docs, tox.train(docs, marks)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["score"])
    assert all((by[i][0] >= 0.3) == ("BAD" in t) for i, t, _ in rows[:600])
    assert by[602][0] >= 0.3 and by[601][0] < 0.3 and sorted(x >= 0.3 for x in by[None]) == [False, True]
    for few in (marks.limit(0), marks.filter("toxic = 0"), marks.filter("toxic = 1")):
        assert tox.score(docs, tox.train(docs, few)).count() == len(rows)
    assert tox.score(docs.limit(0), tox.train(docs.limit(0), marks)).count() == 0


def test_samples_are_bounded_in_rows_and_frequencies_cover_all(spark, monkeypatch):
    import re
    from collections import Counter

    rows = [(7 if i % 2 else i, f"words of number {i} here Toxicwordy" if i % 2 else f"clean text {i % 10} {'x' * (i % 9)}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = next(i for i in range(7, 99) if not held_out(i))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 7, hot).otherwise(F.col("doc_id")))
    labels = spark.createDataFrame([(hot, 1)] + [(i, 0) for i in range(100, 140)], "doc_id long, toxic int")
    data = tox.learnable(docs, labels, "doc_id", "text")
    assert tox.samples(data, 10, 50).count() <= 60 and tox.samples(data, 10, 50).filter("positive").count() == 1

    # frequencies and z values by plain loops over every learnable row
    mine = [(r["doc_id"], r["text"]) for r in docs.collect() if not held_out(r["doc_id"])]
    tally, n = (Counter(), Counter()), Counter()
    for i, t in mine:
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
        own = words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}
        n[i == hot] += 1
        tally[i == hot].update(own)

    def z(w):
        p, u, rate = tally[1][w], tally[0][w], (tally[1][w] + tally[0][w] + 1) / (n[True] + n[False] + 2)
        return abs(p / n[True] - u / n[False]) / (rate * (1 - rate) * (1 / n[True] + 1 / n[False])) ** 0.5

    want = sorted((w for w in tally[0].keys() | tally[1].keys() if z(w) >= 4), key=lambda w: (-z(w), w.encode()))[:30]
    for bound in (tox.BROADCAST_BYTES, 8):
        monkeypatch.setattr(tox, "BROADCAST_BYTES", bound)
        assert [w.decode() for w in tox.choose_words(tox.marked(data), 30, 4.0)] == want and "toxicwordy" in want
    classifier = tox.train(docs, labels)
    weight = dict(zip(classifier.words, classifier.weights))
    for r in tox.score(docs, classifier).limit(50).collect():
        text = next(t for i, t in ((x["doc_id"], x["text"]) for x in docs.collect()) if i == r["id"]) if r["id"] != hot else None
        if text is not None:
            assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(classifier.bias + sum(weight.get(w, 0) for w in tox.features_of(text)), -40, 40)))) < 1e-9
