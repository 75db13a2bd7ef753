import os

import pytest

from entlink.llm import queries as Q
from entlink.llm.token_counts import Counter, drops_white_space, read_cache, token_counts
from entlink.session import scratch_path

WORDS = Q.tokenizer_file("word_bpe_49k.json")
TEXTS = ["", None, "a", "It's  the\tdog's\n\n12 33 !!!???", "<|endoftext|> x<|startoftext|>y <|EndOfText|>", "\x0b\x0c\x1c\x1f\x85\xa0 é é ́x",
         "日本語 テキスト 🙂🙂 ﬁ Ⅳ", "word " * 3000, "x" * 30000, "a b​c﻿d", " ́̀ İI ſ K", "\x00\x01 a\x00b"]


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_counter_equals_library_on_odd_texts():
    assert drops_white_space(WORDS) and not drops_white_space(Q.tokenizer_file("byte_bpe_50k.json"))
    for path in (WORDS, Q.tokenizer_file("byte_bpe_50k.json")):
        assert Counter(path).count([x or "" for x in TEXTS]) == library(path, TEXTS)
    every = "".join(f"a{chr(c)}b{chr(c)}{chr(c)}7" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert Counter(WORDS).count([every, *(f"a{chr(c)}b" for c in range(0x3100))]) == library(WORDS, [every, *(f"a{chr(c)}b" for c in range(0x3100))])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_cache_and_edges(spark, tmp_path, name):
    path = Q.tokenizer_file(name)
    rows = [(i, t, "n", b"x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "n", b"x"), (None, "null id", "n", b"x"), (None, "null id", "n", b"x"), (99, "a", "m", b"y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, content binary")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts(docs, path, cache).collect()
        want = sorted(((r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, library(path, [r[1] for r in rows]))), key=repr)
        assert sorted(map(tuple, got), key=repr) == want
    n = read_cache(spark, cache).count()
    assert n == read_cache(spark, cache).select("content").distinct().count()
    token_counts(docs.limit(0), path, cache).collect()
    assert read_cache(spark, cache).count() == n
    more = spark.createDataFrame([(1, "a"), (2, "brand new")], "doc_id long, text string")
    assert sorted(map(tuple, token_counts(more, path, cache).collect())) == [(1, 1, 1), (2, 9, library(path, ["brand new"])[0])]
    assert read_cache(spark, cache).count() == n + 1


def test_query_counts_like_the_library(spark):
    sf = os.environ.get("ENTLINK_TEST_SF", "/root/testdata/sf0.001")
    got = {r["doc_id"]: r for r in Q.QUERIES["op1_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for d, n in zip(docs, library(WORDS, [d["text"] for d in docs])):
        assert (got[d["doc_id"]]["n_tokens"], got[d["doc_id"]]["over_limit"]) == (n, n > 2048)
    assert len(got) == len(docs)


def test_empty_cache_folder(spark):
    assert read_cache(spark, scratch_path(spark, "none")).count() == 0


def test_two_writers_and_repeated_rows(spark, tmp_path):
    path = Q.tokenizer_file("word_bpe_49k.json")
    rows = [(1, "some words here"), (1, "some words here"), (2, "other words"), (None, "null id"), (None, "null id"), (3, None), (4, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cache = str(tmp_path / "cache")
    want = sorted((tuple(r) for r in token_counts(docs, path, cache).collect()), key=repr)
    assert [(i, n) for i, _, n in want] == sorted(((i, n) for (i, t), n in zip(rows, library(path, [t or "" for _, t in rows]))), key=repr)
    assert spark.read.parquet(cache).count() == 4                       # one row a distinct content
    spark.read.parquet(cache).write.parquet(cache + "-copy")
    spark.read.parquet(cache + "-copy").write.mode("append").parquet(cache)      # a second writer of the same digests
    assert sorted((tuple(r) for r in token_counts(docs, path, cache).collect()), key=repr) == want
