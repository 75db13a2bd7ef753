import hashlib
import random
import re

import duckdb
import numpy as np

from entlink.llm import fim
from entlink.llm import queries as Q


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, *out, len(p), len(m)


def odd_texts():
    rnd = random.Random(2)
    out = [None, "", "a", " ", "\n\x00\t", "<P>", "a<S>b", "x <M", "P>S>M><", "<", "é🙂日本", "z" * 70_000, " " * 5000, ("w" * 900 + " ") * 40 + "! " * 3000]
    return out + ["".join(rnd.choice(["the", "A", " ", "\n", "1", "<", "P>", "S>", "🙂", "é", "zz" * 300]) for _ in range(rnd.randint(0, 400))) for _ in range(200)]


def test_index_is_exact_and_small():
    rng = np.random.default_rng(3)
    for steps in (np.ones(10_000, int), rng.integers(1, 9, 50_000), rng.geometric(0.01, 20_000), np.tile([1, 5000], 300), np.zeros(0, int)):
        offsets = np.append(0, np.cumsum(steps))
        for error in (1, 64, 126):
            index = fim.RankIndex.fit(offsets, error)
            assert (index[np.arange(len(offsets))] == offsets).all() and np.abs(index.residual).max() <= error + 1
            assert (index.predict(np.arange(len(offsets))) != offsets).any() or error == 1 or len(set(steps)) < 2
    assert len(fim.RankIndex.fit(np.arange(100_000) * 4).rank) == 1
    assert len(fim.RankIndex.fit(np.append(0, np.cumsum(rng.integers(1, 9, 50_000)))).rank) < 1000


def test_rows_and_edges(spark):
    rows = [(None if i % 11 == 0 else i // 2, t, 1, "x") for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, output string")
    got = fim.transform(docs, draws=(1, 2)).collect()
    assert len(got) == 2 * len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    first = sorted(((r["id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["restored"]) for r in got if r["draw"] == 1), key=repr)
    assert first == sorted(((i, *brute(i, t), t or "") for i, t, *_ in rows), key=repr)
    assert any(r["draw"] == 2 and r["restored"] not in ("", r["output"]) for r in got)
    assert fim.transform(docs.limit(0)).count() == 0
    stored = {r["id"]: r for r in fim.indexes(docs.filter("doc_id = 9")).collect()}[9]
    index = fim.RankIndex(*(np.array(stored[c]) for c in ("rank", "offset", "slope")), np.frombuffer(stored["residual"], np.int8))
    assert any((index[np.arange(index.units + 1)] == fim.boundaries(t)).all() for i, t, *_ in rows if i == 9 and len(fim.boundaries(t)) == index.units + 1)


def test_query_equals_duckdb_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in Q.QUERIES["op12_fill_in_middle"](spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(Q.ORACLE["op12_fill_in_middle"]).fetchall())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    want = [(i, brute(i, t)) for i, t in docs]
    assert [(r[0], *r[1:5], r[5]) for r in got] == sorted((i, b[0], b[1], b[3], b[4], sha(b[2])) for i, b in want)
