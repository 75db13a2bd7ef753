import random

import sentencepiece

from entlink.llm import queries as Q
from entlink.llm import spiece

FILE = Q.tokenizer_file("piece_bpe_32k.model")


def odd_texts():
    rnd = random.Random(1)
    out = ["", " ", "  ", " " * 5, "\n", "a\n b", "日本語🙂x", "▁▁ a", "\t\x00é", "thethethe" * 2000, "a" * 5000, " " * 3001, "abc" * 3000 + "é" * 900]
    out += [" " * k + "x" + " " * k for k in range(70)]
    out += ["".join(rnd.choice("aaabcdeEthin  ▁é日🙂\n") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    return out + ["".join(rnd.choice(["the", "in", "er", "ing", "0", "00", "--", "===", "==", "__", "_", "�"]) for _ in range(200)) for _ in range(200)]


def test_ids_equal_the_library():
    model, library = spiece.Model(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    for t in odd_texts():
        ids = model.encode(t).tolist()
        assert ids == library.encode(t)
        assert model.decode(ids) == t.replace("▁", " ")


def test_commits_early_in_bounded_memory():
    model = spiece.Model(FILE)
    seen = []

    class Chars(str):
        def __getitem__(self, i):
            seen.append(i)
            return str.__getitem__(self, i)

    pieces = model.search(Chars("international" * 500))
    next(pieces)
    assert max(seen) < 6 * model.longest  # the first piece is final long before the end


def test_stretches_hold_the_text_and_join_no_kinds():
    model = spiece.Model(FILE)
    for t in odd_texts():
        t = t.replace(" ", spiece.SPACE)
        assert "".join(model.stretches.findall(t)) == t
    assert model.stretches.findall("▁▁the.!!▁42\n▁") == ["▁▁the", ".!!", "▁42\n", "▁"]


def test_pairs_are_judged_as_the_merges_judge():
    model, rnd = spiece.Model(FILE), random.Random(2)
    pieces = [p for p in list(model.ids)[:4000] if not p.startswith("▁")] + ["日", "🙂"]
    for _ in range(20000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        assert model._judge({}, a, b) == (model.merge(a + b) == [a, b])


def test_a_worker_keeps_the_model_and_what_it_remembers(monkeypatch):
    assert spiece.model_of(FILE) is spiece.model_of(FILE)
    monkeypatch.setattr(spiece, "MEMO", 8)
    model, words = spiece.Model(FILE), [f"{a}{b}" for a in "abcdefg" for b in "hijkl"]
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    text = " ".join(words + words[::-1])
    assert model.encode(text).tolist() == library.encode(text)
    assert 0 < len(model.memo) <= 4 and len(model.older) <= 4


def test_a_boundary_needs_few_steps():
    """A search step looks back no further than to the piece that ends there."""
    model, looked = spiece.Model(FILE), []

    class Chars(str):
        def __getitem__(self, i):
            looked.append(i)
            return str.__getitem__(self, i)

    text = "▁themselvesunderstandinginternational" * 50
    list(model.search(Chars(text)))
    assert len(looked) < 4 * len(text)


def test_rows_and_edges(spark):
    rows = [(i, t, 1) for i, t in enumerate(odd_texts()[:40])] + [(None, "null id", 1), (3, None, 1), (3, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = spiece.encode(docs, FILE)
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    got = sorted(((r["id"], r["n_chars"], r["ids"], r["round_trip"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, len(t or ""), library.encode(t or ""), "▁" not in (t or "")) for i, t, _ in rows), key=repr)
    back = sorted((tuple(r) for r in spiece.decode(out, FILE).collect()), key=repr)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t, _ in rows), key=repr)
    assert spiece.encode(docs.limit(0), FILE).count() == 0


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.QUERIES["op4_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts) and all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["round_trip"] for r in got)
