import numpy as np
import math
import random
from collections import Counter

import pytest

from entlink.llm import ngram


def brute(train, texts, order):
    """Interpolated modified Kneser-Ney over strings."""
    toks = [ngram.tokens_of(t) for t in train]
    grams = [None, *[Counter() for _ in range(order)]]
    raw = Counter(w for t in toks for w in t)
    for t in toks:
        padded = [ngram.BEGIN] * (order - 1) + t
        for i in range(len(t)):
            grams[order][tuple(padded[i:i + order])] += 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    disc = [None, *[ngram.discounts([sum(c == i for c in grams[k].values()) for i in (1, 2, 3, 4)]) for k in range(1, order + 1)]]
    n, v = sum(raw.values()), len(raw)

    def p(g):
        if not g:
            return 1 / (v + 1)
        k = len(g)
        same = [c for x, c in grams[k].items() if x[:-1] == g[:-1]]
        lower = p(g[1:])
        if not same:
            return lower
        d = disc[k]
        c = grams[k][g]
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in same) * lower) / sum(same)

    out = []
    for text in texts:
        t = ngram.tokens_of(text)
        padded = [ngram.BEGIN] * (order - 1) + t
        out.append((len(t), sum(raw[w] > 0 for w in t), sum(math.log10((raw[w] + .5) / (n + .5 * (v + 1))) for w in t),
                    sum(math.log10(p(tuple(padded[i:i + order]))) for i in range(len(t)))))
    return n, out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(ngram, "SHARD_BYTES", 2000)
    rnd = random.Random(order)
    words = [f"W{int(rnd.paretovariate(0.7))}" for _ in range(60)] + ["é", "🙂,"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(80)] + [None, "", "never seen words", texts_long(rnd, words)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    model = ngram.train(df.filter("doc_id % 3 <> 0"), order)
    n, want = brute([t for i, t in enumerate(texts) if i % 3], texts, order)
    assert model.train_tokens == n
    got = {r["id"]: r for r in ngram.score(df, model).collect()}
    for i, (tokens, known, base, score) in enumerate(want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"]) == (tokens, known)
        assert r["base_score"] == pytest.approx(base, abs=1e-8) and r["score"] == pytest.approx(score, abs=1e-8)


def texts_long(rnd, words):
    return " ".join(rnd.choice(words) for _ in range(20000))


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a b", "c", "a a b c d"]
    model = ngram.train(spark.createDataFrame([(t,) for t in texts], "text string"), 2)
    scorer = ngram.Scorer(model)
    import numpy as np

    for before in (b"a", b"b", b"zzz", ngram.BEGIN):
        vocabulary = [b"a", b"b", b"c", b"d", ngram.END, b"unknown"]
        h = np.array([scorer.hashes[w] for w in vocabulary], np.uint64)
        p, _ = scorer.probabilities(h, [np.full(len(h), scorer.hashes[before], np.uint64)])
        assert p.sum() == pytest.approx(1)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = ngram.train(empty)
    assert ngram.score(empty, model).count() == 0
    r = ngram.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), model).first()
    assert (r["id"], r["n_tokens"], r["n_known"], r["score"]) == (None, 3, 0, 0.0)


def test_query_of_order_three(spark, tmp_path):
    from entlink.llm import queries as Q

    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 20)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    trained = {r["doc_id"] for r in ngram.training_rows(docs).collect()}
    n, want = brute([t for i, t in rows if i in trained], [t for _, t in rows], 3)
    got = {r["doc_id"]: r for r in Q.QUERIES["op9_lm_scoring_order3"](spark, str(tmp_path)).collect()}
    for (i, _), (tokens, known, base, score) in zip(rows, want):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in trained, tokens, known, n)
        assert r["base_score"] == pytest.approx(base, abs=1e-8) and r["score"] == pytest.approx(score, abs=1e-8)


def test_words_and_contexts_are_dealt_over_all_shards():
    from entlink.llm import ngram

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    shards = ngram.shard_of(np.zeros(len(keys), np.uint64), keys, 64)
    assert set(shards.tolist()) == set(range(64)) and np.bincount(shards).max() < 2 * len(keys) / 64
    one = ngram.shard_of(np.full(len(keys), 12345 << 30, np.uint64), keys, 64)
    assert len(set(one.tolist())) == ngram.SPREAD


def test_few_maps_give_the_same_scores(spark, monkeypatch):
    from entlink.llm import ngram

    monkeypatch.setattr(ngram, "SHARD_BYTES", 200)
    docs = spark.createDataFrame([(i, f"some words of {i % 7} and a few more words {i}") for i in range(60)], "doc_id long, text string")
    model = ngram.train(docs, 2)
    texts = [r["text"] for r in docs.collect()]
    want = ngram.Scorer(model).score(texts)
    monkeypatch.setattr(ngram, "MAX_MAPS", 2)
    few = ngram.Scorer(model)
    assert few.score(texts) == want and len(few.maps) <= 2 and model.shards > ngram.SPREAD
