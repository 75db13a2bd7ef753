import json
import os
import tempfile

from pyspark.sql import functions as F

from entlink.sources import datasets as D

CONLL = (
    "-DOCSTART- (doc1\n"
    "Paris\tB\tParis\tParis\ten.wikipedia.org/wiki/Paris\t000\t000\n"
    "is\n"
    "nice\n"
    "\n"
    "\n"
    "Paris\tB\tParis\tParis\ten.wikipedia.org/wiki/Paris_first\t000\t000\n"
    "and\n"
    "Paris\tB\tParis\tParis\thttp://en.wikipedia.org/wiki/Paris_last\t000\t000\n"
    "\n"
    "-DOCSTART- (doc2\n"
    "tail\n"
    "words\n"
)


def _tmp(name, text):
    d = tempfile.mkdtemp(prefix="entlink-src-", dir="/tmp")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_conll_rules(spark):
    sentences, mentions, docs = D.read_conll(spark, _tmp("x.conll", CONLL))
    s = sorted((r.doc_key, r.sid, r.text) for r in sentences.collect())
    assert s == [(" (doc1", 0, "Paris is nice "), (" (doc1", 1, ""), (" (doc1", 2, "Paris and Paris "),
                 (" (doc1", 3, ""), (" (doc2", 0, "tail words ")]
    m = sorted((r.doc_key, r.sid, r.m_pos, r.label, r.uri) for r in mentions.collect())
    # per sentence one mention per label: position of the first, value of the last
    assert m == [(" (doc1", 0, 0, "Paris", "http://dbpedia.org/resource/Paris"),
                 (" (doc1", 2, 0, "Paris", "http://dbpedia.org/resource/Paris_last")]
    d = {r.doc_key: r.text for r in docs.collect()}
    assert d[" (doc1"] == "Paris is nice Paris and Paris " and d[" (doc2"] == "tail words "


def test_qald_ingest_expands_prefixes(spark):
    raw = {"questions": [{"id": 7, "question": [{"language": "de", "string": "Wer?"},
                                                 {"language": "en", "string": "Who?"}],
                          "query": {"sparql": "PREFIX dbo: <http://dbpedia.org/ontology/> "
                                              "PREFIX res: <http://dbpedia.org/resource/> "
                                              "SELECT ?x WHERE { res:Berlin dbo:mayor ?x . }"}}]}
    q = D.ingest_qald(spark, _tmp("q.json", json.dumps(raw))).collect()[0]
    assert q.question == "Who?" and q.id == "7"
    assert q.sparql_query == ("SELECT ?x WHERE { <http://dbpedia.org/resource/Berlin> "
                              "<http://dbpedia.org/ontology/mayor> ?x . }")
    assert q["entity mapping"][0].uri == ""


def test_read_qa_and_eval_log(spark):
    items = [{"question": "Is Rome big?", "id": "1", "sparql_query": "",
              "entity mapping": [{"label": "Rome", "uri": "http://dbpedia.org/resource/Rome"}],
              "predicate mapping": [{"label": "", "uri": ""}]}]
    it, m = D.read_qa(spark, _tmp("a.json", json.dumps(items)))
    assert [(r.id, r.m_pos, r.label) for r in m.collect()] == [("1", 0, "Rome")]
    log = ("setting\nIndex|y_true|y_pred|Status\nIndex:0|A|B|Error\n"
           "Index:1|C|Empty|Not present at database\nIndex:2|D|d|Correct\n")
    rows = sorted(tuple(r) for r in D.read_eval_log(spark, _tmp("log.txt", log)).collect())
    assert rows == [(0, "A", "B", "Error"), (1, "C", None, "Not present"), (2, "D", "d", "Correct")]


def test_prepare_text_mentions_averages_contexts(spark):
    from entlink.plans.link import prepare_text_mentions
    m = spark.createDataFrame([(1, "Rome", "http://x/Rome", "d1")], "idx long, label string, uri string, doc_key string")
    docs = spark.createDataFrame([("d1", "Rome is old. " * 40 + "Nothing here. Rome again!")],
                                 "doc_key string, text string")
    p = prepare_text_mentions(m, docs, max_len=50).collect()[0]
    assert p.mention == "Rome" and p.y_true == "http://x/Rome"
    assert len(p.mention_vec) == 64 and len(p.context_vec) == 64
    assert abs(sum(x * x for x in p.mention_vec) - 1.0) < 1e-6


def test_conll_files_with_equal_keys_and_a_preface(spark):
    import os
    import tempfile
    d = tempfile.mkdtemp(prefix="entlink-test-", dir="/tmp")
    for name, word in (("a.conll", "foo"), ("b.conll", "bar")):
        with open(os.path.join(d, name), "w") as f:
            f.write(f"a preface\nof two lines\n-DOCSTART- (1\n{word}\n\nshort\ten.wikipedia.org/wiki/X\n")
    sentences, mentions, docs = D.read_conll(spark, d)
    assert sorted(r.text for r in docs.collect()) == ["bar short ", "foo short "]
    assert sorted(r.text for r in sentences.collect()) == ["bar ", "foo ", "short ", "short "]
    assert [(r.label, r.uri) for r in mentions.collect()] == [(None, None)] * 2


def test_qald_question_without_the_language(spark):
    import json
    import os
    import tempfile
    p = os.path.join(tempfile.mkdtemp(prefix="entlink-test-", dir="/tmp"), "q.json")
    q = [{"id": "1", "question": [{"language": "de", "string": "Was?"}], "query": {"sparql": "SELECT 1"}},
         {"id": "2", "question": [{"language": "en", "string": "What?"}], "query": {"sparql": "SELECT 2"}}]
    with open(p, "w") as f:
        json.dump({"questions": q}, f)
    assert {(r.id, r.question) for r in D.ingest_qald(spark, p).collect()} == {("1", None), ("2", "What?")}


def test_conll_documents_with_equal_keys_in_one_file(spark, tmp_path):
    from entlink.sources.datasets import read_conll
    (tmp_path / "a.conll").write_text("-DOCSTART- (7 Same\nOne\nword\n\n-DOCSTART- (7 Same\nTwo\n\nthree\n\n-DOCSTART- (8 Other\nx\n\n")
    sentences, _, docs = read_conll(spark, str(tmp_path))
    assert sorted(r.text for r in docs.collect()) == ["One word ", "Two three ", "x "]
    assert sorted((r.doc_key, r.sid, r.text) for r in sentences.collect() if r.text) == [(" (7 Same", 0, "One word "), (" (7 Same", 0, "Two "), (" (7 Same", 1, "three "), (" (8 Other", 0, "x ")]
