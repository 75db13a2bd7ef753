import hashlib
import random

from entlink.llm import decontam
from entlink.llm.decontam import Automaton, decontaminate, matches, merge_spans, report, words_of


def brute(words, items, window):
    hit, who = set(), set()
    for item, w in items:
        k = min(len(w), window)
        wins = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i:i + k]) in wins:
                hit.update(range(i, i + k))
                who.add(item)
    return hit, who


def test_automaton_equals_brute_force():
    rnd = random.Random(3)
    for trial in range(300):
        alphabet = [b"a", b"b", b"c", b"d"][: rnd.randint(1, 4)]
        items = [(str(j), [rnd.choice(alphabet) for _ in range(rnd.randint(0, 9))]) for j in range(rnd.randint(0, 6))]
        window = rnd.randint(1, 5)
        a = Automaton.build([x for x in items if x[1]], window)
        words = [rnd.choice([*alphabet, b"z"] if rnd.random() < 0.2 else alphabet) for _ in range(rnd.randint(0, 40))]
        spans, who = a.scan(words)
        assert ({p for s, e in spans for p in range(s, e)}, who) == brute(words, items, window)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words string")


def test_edges_blocks_and_cleaning(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Short Item"), (3, None), (4, "!!"), (10, "ten eleven")], "item_id long, text string")
    rows = [(0, None), (1, ""), (2, "x " + item.upper() + " y"), (2, "x " + item.upper() + " y"), (3, "a short-item, b"), (None, "clean text only"),
            (5, "one two three four five six seven eight nine"), (6, "w " * 50000 + item)]
    docs = docs_of(spark, [(i, t, "s", "n") for i, t in rows])
    items = [(str(i), words_of(t)) for i, t in [(1, item), (2, "Short Item"), (10, "ten eleven")]]

    def check():
        got = sorted((tuple(r) for r in report(matches(docs, bench)).collect()), key=repr)
        want = []
        for i, t in rows:
            hit, who = brute(words_of(t), items, 10)
            want.append((i, len(words_of(t)), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
        assert got == sorted(want, key=repr)

    check()
    cleaned = decontaminate(docs, bench, max_coverage=0.9)
    assert cleaned.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["spans"], r["n_words"]) for r in cleaned.collect()), key=repr)
    want = [(0, None), (1, ""), (2, "x  y"), (2, "x  y"), (3, "a , b"), (None, "clean text only"), (5, rows[6][1]), (6, "w " * 50000)]
    assert got == sorted(((i, t, "s", "n") for i, t in want), key=repr)
    assert decontaminate(docs, bench, max_coverage=0.5).count() == len(rows) - 2  # more than half covered: both copies go
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 5)  # several blocks of items, same result
    check()
    assert sorted(((r["doc_id"], r["text"], r["spans"], r["n_words"]) for r in decontaminate(docs, bench, max_coverage=0.9).collect()), key=repr) == got
    assert report(matches(docs.limit(0), bench)).count() == 0
    assert report(matches(docs, bench.limit(0))).filter("contaminated").count() == 0


def test_merge_spans():
    assert merge_spans([(5, 7), (0, 2), (2, 3), (6, 9)]) == [(0, 3), (5, 9)]
