import random

import pytest
from xxhash import xxh64_intdigest

from entlink.llm import simhash as sh
from entlink.llm.components import components


def brute_fp(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh_ = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxh64_intdigest(s, 42) for s in sh_]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, radius):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_masks_cover_every_pair():
    rnd = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = sh.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            diff = sum(1 << p for p in rnd.sample(range(64), rnd.randint(0, radius)))
            assert any(not diff & m for m in masks)


def test_fingerprint_equals_brute_force():
    rnd = random.Random(2)
    for t in [None, "", " \n", "One", "one two", "A b C", "É é \x1c\x85 x", "x " * 999, *(" ".join(rnd.choice("abcdef") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))) for _ in range(100))]:
        assert sh.fingerprint(t) == brute_fp(t)
    long = " ".join(str(i % 7919) for i in range(230_000))
    assert sh.fingerprint(long) == brute_fp(long)


@pytest.mark.parametrize("block", [3, 1024])
def test_links_equal_brute_force(spark, block):
    rnd = random.Random(block)
    nodes = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 15)):
            nodes.add(x)
            x ^= sum(1 << p for p in rnd.sample(range(64), rnd.randint(1, 4)))
    hub = rnd.getrandbits(64)
    nodes |= {hub ^ (1 << p) for p in range(40)}
    fps = spark.createDataFrame([(sh.signed(n),) for n in nodes], "fp long")
    got = {r["node"]: r["label"] for r in components(sh.near_links(fps, 3, block)).collect()}
    want = brute_components(sorted(nodes), 3)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({n: got.get(sh.signed(n), sh.signed(n)) for n in nodes}) == groups(want)


def test_long_chain_of_components(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(n + 1)} | {(1000, 1000), (1001, 1000)}


def test_near_duplicates_edges_and_stage(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200 ", "")
    rows = [(5, base), (3, base.upper()), (9, near), (4, "something else entirely here"), (7, None), (8, ""), (None, base), (4, "something else entirely here"), (11, "x")]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((tuple(r) for r in sh.near_duplicates(docs).collect()), key=repr)
    fps = {sh.signed(brute_fp(t)) for _, t in rows}
    label = {sh.signed(k): v for k, v in brute_components(sorted(f % 2**64 for f in fps), 3).items()}
    first = {}
    for i, t in rows:
        if i is not None:
            k = label[sh.signed(brute_fp(t))]
            first[k] = min(first.get(k, i), i)
    assert got == sorted(((i, sh.signed(brute_fp(t)), first[label[sh.signed(brute_fp(t))]]) for i, t in rows), key=repr)
    kept = sh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == sorted(set(first.values()))
    assert sh.near_duplicates(docs.limit(0)).count() == 0 and sh.drop_near_duplicates(docs.limit(0)).count() == 0


def test_drops_beyond_the_broadcast_bound(spark, monkeypatch):
    from entlink.llm import simhash as sh

    words = "some words that make a text of their own kind with number"
    rows = [(i, f"{words} {i // 3} {i // 3 * 7919} {'abc'[i // 3 % 3] * 5} {i // 3 % 17}", i) for i in range(90)] + [(5, "two rows share this id", 1), (5, "two rows share this id too", 2), (None, "null id", 3), (None, "null id", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int")
    want = sorted((tuple(r) for r in sh.drop_near_duplicates(docs).collect()), key=repr)
    assert sh.drop_near_duplicates(docs).columns == docs.columns and sum(r[0] is None for r in want) == 2
    monkeypatch.setattr(sh, "BROADCAST_BYTES", 10)
    assert sorted((tuple(r) for r in sh.drop_near_duplicates(docs).collect()), key=repr) == want
    assert sh.drop_near_duplicates(docs.limit(0)).count() == 0
