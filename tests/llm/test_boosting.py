import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from entlink.llm import boosting as gb
from entlink.llm import queries as Q


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def statistics_brute(text):
    """The statistics by plain loops."""
    data = (text or "").encode()
    words = re.findall(rb"[^ \t-\r]+", data)
    lines = [x for x in data.split(b"\n") if re.search(rb"[^ \t-\r]", x)]
    if not words:
        return [math.log(1 + len(data))] + [0] * 26
    n = len(words)
    ink = sum(map(len, words))
    mean = ink / n
    run = best = 0
    for i in range(len(data)):
        run = run + 1 if i and data[i] == data[i - 1] else 1
        best = max(best, run)
    windows = [tuple(words[i:i + 3]) for i in range(n - 2)]
    chars = lambda kind: len(re.findall(kind, data)) / ink
    pairs = Counter((a, b) for a, b in zip(words, words[1:]))
    return [math.log(1 + len(data)), math.log(1 + n), math.log(1 + len(lines)), mean, math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n),
            math.log(1 + max(map(len, words))), len(data) / len(lines), chars(rb"[A-Z]"), chars(rb"[0-9]"), chars(rb"[#*$%&<>]"), chars(rb"[.,;:?]"),
            chars(rb"!"), chars(rb"\|"), chars(rb"[\"'()+\-/=@\[\\\]^_`{}~]"), chars(rb"[\x80-\xff]"), len(set(words)) / n, max(Counter(words).values()) / n,
            max(pairs.values(), default=0) / n, sum(windows.count(w) > 1 for w in windows) / n, 1 - len(set(lines)) / len(lines),
            sum(a == b for a, b in zip(words, words[1:])) / n, sum(bool(re.search(rb"[.,;:!?#*$%&|<>]$", w)) for w in words) / n, sum(len(w) == 1 for w in words) / n,
            -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()), len(set(data)) / 256, math.log(1 + best),
            (len(re.findall(rb"http", data)) + len(re.findall(rb"www\.", data))) / n]


def test_statistics_equal_plain_loops():
    rnd = random.Random(1)
    texts = [None, "", " \n", "a", "www.x http://y HELLO!! 1 2 a|b", "ß é 🙂🙂🙂 ~`x", "x\n\nx\n y"]
    texts += ["".join(rnd.choice(["the ", "A", "\n", "a b c ", "!!", "|", "$", "9", "é", "-", "ooo"]) for _ in range(rnd.randint(1, 200))) for _ in range(80)]
    for t in texts:
        assert np.allclose(gb.statistics_of(t), statistics_brute(t)) and len(gb.statistics_of(t)) == len(gb.STATISTICS)


def walk(trees, row):
    """A row's margin, tree by tree and node by node."""
    total = trees.bias
    for feature, edge, leaf in zip(trees.feature, trees.edge, trees.leaf):
        i = 0
        while i < len(feature):
            i = 2 * i + 1 + (row[feature[i]] > edge[i])
        total += leaf[i - len(feature)]
    return total


def test_trees():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(900, 5)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    trees = gb.grow(x, y, trees=30, depth=3)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.98
    odd = np.vstack([x[:50], [[np.inf, -np.inf, 0, 1e300, -1e300]]])
    assert np.allclose(trees.margin(odd), [walk(trees, r) for r in odd])
    assert trees.margin(x[:0]).shape == (0,)
    # the first split is the best of all
    y = (x[:, 1] + 0.2 * rng.normal(size=900) > 0.5).astype(float)
    one = gb.grow(x, y, trees=1, depth=1)
    g, h = y.mean() - y, np.full(len(y), y.mean() * (1 - y.mean()))
    gain = lambda f, e: sum(g[m].sum() ** 2 / (h[m].sum() + gb.DECAY) for m in (x[:, f] <= e, x[:, f] > e) if h[m].sum() >= gb.MIN_HESSIAN)
    best = max(gain(f, e) for f, es in enumerate(gb.bin_edges(x, gb.BINS)) for e in es)
    assert np.isclose(gain(one.feature[0, 0], one.edge[0, 0]), best)
    assert np.allclose(one.leaf[0], [-gb.RATE * g[m].sum() / (h[m].sum() + gb.DECAY) for m in (x[:, one.feature[0, 0]] <= one.edge[0, 0], x[:, one.feature[0, 0]] > one.edge[0, 0])])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in Q.QUERIES["op11_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [(got[i]["predicted"], q) for i, q in labels.items() if held_out(i)]
    assert all(r["held_out"] == held_out(i) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in got.items())
    good, bad = ([p for p, q in test if q == k] for k in (1, 0))
    print("good kept", sum(good) / len(good), "bad kept", sum(bad) / len(bad), len(test))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_edges(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        bad = rnd.random() < 0.4
        rows.append((i, " ".join(rnd.choice(["tree", "house", "sky"]) + ("$$" if bad else "") for _ in range(20)), "x"))
        labels.append((i, int(not bad)))
    rows += [(None, "tree$$ sky$$", "x"), (None, None, "x"), (601, "", "x"), (3, rows[3][1], "x"), (602, "tree " * 100_000, "x")]
    rows += [(4, "tree house", "x")] * 2000  # an id with many rows is one row of the fit
    labels += [(None, 1), (602, None), (7777, 0), labels[0], (5, 0), (5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    fit = gb.training_rows(docs, marks).collect()
    want = {i for i in range(500) if not held_out(i)}
    assert {r["id"] for r in fit} == want and len(fit) == len(want)
    assert len(gb.training_rows(docs, marks, max_rows=50).collect()) <= 50
    got = gb.score(docs, gb.train(docs, marks)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["score"])
    assert all((by[i][0] >= 0.7) == ("$" not in t) for i, t, _ in rows[:500] if i not in (4, 5))
    assert len(by[None]) == 2 and all(0 <= s <= 1 for s in by[None] + by[601] + by[602])
    for few in (marks.limit(0), marks.filter("quality = 0"), marks.filter("quality = 1")):
        assert gb.score(docs, gb.train(docs, few)).count() == len(rows)
    assert gb.score(docs.limit(0), gb.train(docs.limit(0), marks)).count() == 0
