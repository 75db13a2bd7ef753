import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from entlink.llm import crossalign as ca
from entlink.llm import queries as Q

FILE_A, FILE_B = Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model")


def brute(texts):
    """The contract's columns of each text, by plain loops over spans."""
    a_tok, b_tok = Tokenizer.from_file(FILE_A), sentencepiece.SentencePieceProcessor(model_file=FILE_B)
    a_tok.encode_special_tokens = True
    byte = ca.byte_of_character()
    assert sorted(byte.values()) == list(range(256))
    per_text, count = [], Counter()
    for t in texts:
        whole = b" " + (t or "").encode()
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        bytes_a = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_tok.id_to_piece(i)[1:-1], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            per_text.append((0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            end = min(ends[0][i], ends[1][j])
            i, j = i + (ends[0][i] == end), j + (ends[1][j] == end)
        both = sorted(set(ends[0]) & set(ends[1]))
        sides = [[[] for _ in both] for _ in range(2)]
        for side, ids, es in zip(sides, (a, b), ends):
            for x, e in zip(ids, es):
                side[bisect.bisect_left(both, e)].append(str(x))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides)]
        count.update(links)
        per_text.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, g, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), h) for n_a, n_b, g, links, h in per_text]


def odd_texts():
    rnd = random.Random(3)
    out = [None, "", " ", "\n", "▁", "a▁b", "<|endoftext|>", "<s> </s> <unk>", "x <|endoftext|> y", "\t\x00é", "日本語🙂x", "é" * 500, "the " * 3000, "<0x41>", "�"]
    out += ["".join(rnd.choice(["the", "in", " er", "ing ", "0", "ß", "--", "\n", "日", "🙂", " ", "E"]) for _ in range(rnd.randint(0, 200))) for _ in range(150)]
    return out + out[20:40] + [out[20]] * 30


def test_merging_by_id_equals_the_library():
    fast = ca.TokenizerA(FILE_A)
    assert fast.ranked is not None
    rnd = random.Random(7)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 37 == 0)]
    texts = [f"a{c}b {c}1{c} {c}{c}  {c}\n" for c in chars] + [t for t in odd_texts() if t]
    texts += ["".join(rnd.choice(" \n\t'sdtélR1!") for _ in range(300)) for _ in range(300)] + [" " * 70_000, "a" * 70_000 + "\n" * 9000, "x " * 600_000]
    assert fast.encode(texts) == fast._library([" " + t for t in texts])
    odd = {"model": {"type": "BPE", "vocab": {"a": 0}, "merges": [["a", "b"]]}, "pre_tokenizer": {"type": "ByteLevel"}}
    assert fast._ranked(odd) is None


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_rows_and_edges(spark):
    texts = odd_texts()
    want = brute(texts)
    rows = [(None if i % 7 == 0 else i // 2, t, 1, "x", 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run int, pairs string, seq int").repartition(5)
    want = sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    for small in ({}, {"run_bytes": 400, "fan_in": 3, "radixes": 5}, {"run_bytes": 1, "fan_in": 200}):
        got = ca.align(docs, FILE_A, FILE_B, **small)
        assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect()), key=repr) == want
    assert ca.align(docs.limit(0), FILE_A, FILE_B).count() == 0
    assert ca.align(docs.filter("text is null"), FILE_A, FILE_B).count() == 1


def test_merge_of_runs_in_windows(monkeypatch):
    monkeypatch.setattr(ca, "FRAME", 4)
    rnd = np.random.default_rng(5)
    runs, want = [], Counter()
    for _ in range(9):
        pair = np.unique(rnd.integers(0, 300, rnd.integers(1, 120)))
        count = rnd.integers(1, 70_000, len(pair))
        want.update(dict(zip(pair.tolist(), count.tolist())))
        runs.append(tuple(map(list, zip(*[(ca.pack_sorted(p), ca.pack(c)) for p, c in ca.framed(pair, count)]))))
    windows = list(ca.by_side(ca.merged(runs), 50))
    assert all(len(p) <= 50 + 4 * 9 for p, _ in windows) and len(windows) > 3
    got = [x for p, c in windows for x in zip(p.tolist(), c.tolist())]
    assert got == sorted(want.items())
    marks = [x for p, c in windows for x in ca.highest(p, c, 50).tolist()]
    assert marks == [n == max(m for q, m in want.items() if q // 50 == p // 50) for p, n in got]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in Q.QUERIES["op13_cross_tokenizer_alignment"](spark, sf).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(docs, brute([r["text"] for r in docs]))}
