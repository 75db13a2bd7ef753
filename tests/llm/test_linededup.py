import random

import pytest
from pyspark.sql import functions as F

from entlink.llm import linededup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit(rnd, s, n):
    s = list(s)
    for _ in range(n):
        at = rnd.randrange(len(s) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            s.insert(at, rnd.choice("abé🙂"))
        elif s and kind == 1:
            s.pop(min(at, len(s) - 1))
        elif s:
            s[min(at, len(s) - 1)] = rnd.choice("abcé")
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    rnd = random.Random(tau)
    pairs = []
    while len(pairs) < 400:
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14)))
        b = edit(rnd, a, rnd.randint(0, tau + 2))
        if abs(len(a) - len(b)) <= tau:
            pairs.append((a, b))
    chars = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    df = spark.createDataFrame(pairs, "s string, t string").select("s", "t", chars("s").alias("a"), chars("t").alias("b"))
    for r in df.select("s", "t", ld.banded_distance("a", "b", tau).alias("d")).collect():
        want = distance(r["s"], r["t"])
        assert r["d"] == want if want <= tau else r["d"] > tau, (r, want)


def brute(rows, tau, exact, fuzzy):
    places = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n") if t else []):
            if len(line) >= exact:
                places.setdefault(line, set()).add((i, n))
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first = {t: min(p, key=key) for t, p in places.items()}
    out = []
    for t, p in places.items():
        links = [u for u in places if u != t and min(len(u), len(t)) >= fuzzy and abs(len(u) - len(t)) <= tau and distance(u, t) <= tau]
        cls = min([first[t], *(first[u] for u in links)], key=key)
        out += [(i, n, *cls, len(links), (i, n) == first[t] == cls) for i, n in p]
    return sorted(set(out), key=repr)


@pytest.mark.parametrize("tau,exact,fuzzy", [(2, 4, 6), (1, 3, 3), (3, 8, 10)])
def test_classes_equal_brute_force(spark, tau, exact, fuzzy):
    rnd = random.Random(11 * tau)
    seeds = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(3, 24))) for _ in range(25)]
    rows = [(i if i % 13 else None, "\n".join(edit(rnd, rnd.choice(seeds), rnd.randint(0, 3)) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n")]
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None][:1]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    got = ld.line_classes(docs, tau, exact, fuzzy)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, tau, exact, fuzzy)


def test_hot_line_and_cleaning(spark):
    hot = "this very line stands in each of the documents"
    rows = [(i, f"{hot}\nline {i * 7919 % 1000003:09d} of its own with other words {i}{i}{i}", "c") for i in range(300)] + [(1000, hot, "c"), (1001, "", "c"), (1002, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string")
    out = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
    assert ld.dedup_lines(docs).columns == docs.columns
    assert 1000 not in out and out[1001] == "" and out[1002] is None
    assert sum(hot in (t or "") for t in out.values()) == 1 and out[0] == rows[0][1]
    assert ld.dedup_lines(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, hot + "\n" + hot + "!", "c")], "doc_id long, text string, cut string")
    assert ld.dedup_lines(twice).first()["text"] == hot


def test_short_lines(spark):
    rnd = random.Random(5)
    seeds = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 12))) for _ in range(30)]
    rows = [(i, "\n".join(edit(rnd, rnd.choice(seeds), rnd.randint(0, 2)) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    rows += [(100, "All rights reserved.\n \n\t"), (101, "All rights reserved\nLes.\nok\n "), (102, "Les.\nok\nLos.")]
    got = ld.all_line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute([(i, "\n".join(x if x.strip(" \t") else "" for x in t.split("\n"))) for i, t in rows], 2, 1, 3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_query_of_all_lines_on_the_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r[0], "\n".join(x for x in (r[1] or "").split("\n") if len(x) < 40)) for r in docs.select("doc_id", "text").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from entlink.llm import queries as Q

    got = sorted((tuple(r) for r in Q.QUERIES["op5_line_dedup_all"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute([(i, "\n".join(x if x.strip(" \t\r\x0b\x0c") else "" for x in t.split("\n"))) for i, t in rows], 2, 1, 3)
    assert len(got) > 200 and any(r[4] for r in got)


def test_cleaning_of_short_variants(spark):
    docs = spark.createDataFrame([(1, "All rights reserved\nLes.\nsome words of one"), (2, "All rights reserved.\nLes.\nanother kind of line"),
                                  (3, "fifteen letters\nwords that stand here only once"), (4, "fifteen letters.\nother words in their own place"), (5, "fifteen letters"),
                                  (6, "  "), (7, "              \n               ")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
    want = {r["doc_id"]: r["text"] for r in docs.collect()} | {2: "Les.\nanother kind of line", 4: "other words in their own place"}
    assert got == want


def test_within_equals_the_distance(spark):
    rnd = random.Random(8)
    pairs = [("", "ab"), ("a", "abc"), ("same", "same"), ("x" * 200, "x" * 199 + "y"), ("é" * 70 + "abc", "é" * 70 + "bc"), ("q" * 40, "w" * 40)]
    for _ in range(500):
        a = "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 40)))
        pairs.append((a, edit(rnd, a, rnd.randint(0, 4))))
    for tau in (1, 2, 3):
        df = spark.createDataFrame([p for p in pairs if abs(len(p[0]) - len(p[1])) <= tau], "a string, b string")
        ok = ld.within(F.col("a"), F.col("b"), F.char_length("a"), F.char_length("b"), tau)
        for r in df.select("a", "b", ok.alias("ok")).collect():
            assert r["ok"] == (distance(r["a"], r["b"]) <= tau), (r, tau)


def group_of_variants(n):
    rnd = random.Random(6)
    base = "one template of a line that stands in many documents with number 00000 in it and an end"
    return [(i, base.replace("00000", f"{rnd.randrange(60):02d}{'x' * (i % 3)}") if i % 2 else f"own line {i * 7919 % 10007} of document {i} without a partner") for i in range(n)]


@pytest.mark.parametrize("few,block", [(16, 256), (0, 7), (1, 64)])
def test_crowded_keys_give_the_same_classes(spark, monkeypatch, few, block):
    monkeypatch.setattr(ld, "FEW", few)
    monkeypatch.setattr(ld, "BLOCK", block)
    rows = group_of_variants(240)
    got = ld.all_line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2, 1, 3)


def test_rows_with_one_id_lose_nothing(spark):
    shared = "a line that stands in two of these documents"
    rows = [(1, f"{shared}\nfirst own line of words"), (7, f"{shared}\nsecond own line of words"), (7, "a line that stands nowhere else at all\nthird own line of words"),
            (None, f"{shared}\nfourth own line here"), (None, "fifth text with words of its own\nsixth line"), (None, None), (7, "a line that stands nowhere else at all\nthird own line of words")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in ld.dedup_lines(docs).collect())
    want = [(-1, ""), (-1, rows[4][1]), (-1, rows[3][1]), (1, "first own line of words"), (7, rows[2][1]), (7, rows[2][1]), (7, "second own line of words")]
    assert got == sorted(want)


def test_cuts_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"line number one that every document has\nwords of document {i * 7919} alone") for i in range(200)] + [(500, "no line of this one is cut")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in ld.dedup_lines(docs).collect())
    monkeypatch.setattr(ld, "BROADCAST_BYTES", 100)
    assert sorted(tuple(r) for r in ld.dedup_lines(docs).collect()) == want and 100 < len(want) <= 201


def test_search_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_BYTES", 100)
    rows = group_of_variants(120)
    got = ld.all_line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2, 1, 3)
