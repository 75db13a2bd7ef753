"""run() against a brute-force version of its stages, on a small table with planted cases."""

import random

import sentencepiece

import corpus_pipeline
from entlink.llm import queries as Q
from entlink.llm.decontam import remove_spans, words_of
from entlink.llm.quality import PRODUCTION, RULES
from .tests_llm_brute import decontam_brute, fingerprint_groups, line_verdicts, quality_brute


def fixture_rows():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    item = sentence(30)
    texts = ["\n".join(sentence(rnd.randint(6, 14)) for _ in range(rnd.randint(2, 5))) for _ in range(40)]
    boiler = "All of the rights in this text are reserved by its owner."
    texts += [texts[0], texts[1].replace(".", "!", 1), texts[2] + "\n" + boiler, texts[3] + "\n" + boiler + "?", sentence(12) + " " + item + " " + sentence(25), item.upper(),
              "too short", "", None, "x | y $ # " * 20, "again and again and again " * 9, "SHOUTING!! AT!! ALL!! TIMES!! " * 5, sentence(60), "日本語 é " + sentence(20)]
    near = sentence(300)
    texts += [near, near.replace(" ", "  ", 3) + " end"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], [(7, item), (8, None)]


def brute_run(rows, bench):
    model = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_file("piece_bpe_32k.model"))
    docs = {r[0]: r[1] for r in rows}
    docs = {i: t for i, t in docs.items() if not any(eval(r.fails, {}, quality_brute(t)) and PRODUCTION.mask >> r.bit & 1 for r in RULES)}
    cut = line_verdicts(docs, 2, 16, 32)
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut.get(i, ())) for i, t in docs.items()}
    docs = {i: t for i, t in left.items() if i not in cut or t.split()}
    docs = {i: docs[i] for i, first in fingerprint_groups(docs).items() if i == first}
    out = {}
    for i, t in docs.items():
        spans = decontam_brute(words_of(t), [words_of(x) for _, x in bench], 10)
        if sum(e - s for s, e in spans) > 0.8 * len(words_of(t)):
            continue
        t = remove_spans(t, [{"start": s, "end": e} for s, e in spans]) if spans else t
        out[i] = (model.encode(t), True)
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, bench = fixture_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute_run(rows, bench)
    assert 30 < len(want) < 50
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    nulls = spark.createDataFrame([(None, None, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls, sf).count() <= 1, name
