import random
import re

from entlink.llm import quality as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    rep = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep), "n_upper": len(re.findall("[A-Z]", text)), "n_bangs": text.count("!")}


def texts():
    rnd = random.Random(5)
    out = [None, "", " \t\n\x0b\x0c\r", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "a a a a a", "\x1c\x85 \xa0x　y\x00", "é🙂 #*$%&|<>\n\n é🙂 #*$%&|<>", "x" * 100000,
           "line\nline\n line\n\n\nline", "NO SHOUTING!! " * 30, " leading and trailing \n"]
    for _ in range(150):
        out.append("".join(rnd.choice(["a", "b", "cc", "D!"]) + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(rnd.randint(0, 60))))
    return out


def test_ledger_equals_brute_force(spark):
    rows = [(i if i != 7 else None, t, 1) for i, t in enumerate(texts())]
    rows += rows[:4]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = q.ledger(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: r for r in got}
    for i, t, _ in rows:
        want = brute(t)
        assert {k: by_id[i][k] for k in want} == want, t
        bits = sum(1 << r.bit for r in q.RULES if eval(r.fails, {}, want))
        assert by_id[i]["fail_bits"] == bits
    assert q.ledger(docs.limit(0)).count() == 0


def test_long_repetitive_text(spark):
    text = " ".join(["w%d" % (i % 50) for i in range(60000)])
    r = q.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_repeat_words"]) == (60000, 60000)


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    book = [r.asDict() for r in q.ledger(docs).collect()]
    got = {(r["policy"], r["version"], r["rule"]): (r["n_failing"], r["n_rejected"], r["n_only_this_rule"]) for r in q.ablation(q.ledger(docs)).collect()}
    want = {}
    for p in q.POLICIES:
        for r in q.RULES:
            if p.mask >> r.bit & 1:
                f = [b["fail_bits"] & p.mask for b in book]
                want[p.name, p.version, r.name] = (sum(x >> r.bit & 1 for x in f), sum(x != 0 for x in f), sum(x == 1 << r.bit for x in f))
    assert got == want


def test_filter_keeps_columns(spark):
    good = "These are plainly ten different words of an ordinary clean sentence."
    docs = spark.createDataFrame([(1, good, "x"), (1, good, "x"), (None, good, None), (2, None, "y"), (3, "short", "z")], "doc_id long, text string, fail_bits string")
    kept = q.filter_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, good, "x"), (1, good, "x"), (None, good, None)], key=repr)
