"""Findings of round 3: the work stays where its rows arise, and is done once."""
import random

from pyspark.sql import functions as F

from entlink.operators import linking as L
from entlink.operators import search as S
from entlink.plans import link as LK
from entlink.session import persist_table


def _tables(spark, n_mentions=300, n_rows=700):
    rnd = random.Random(5)
    vec = lambda: [float(rnd.randint(-3, 3)) for _ in range(3)] + [1.0]
    rows = [(f"E{i % 7}" if i % 5 else f"e{i % 7}", f"p{i % 3}", None if i % 11 == 0 else f"text {i % 13}", "L", [0.0] * 4 if i % 97 == 0 else vec(), i // 2)
            for i in range(n_rows)]
    vectors = persist_table(spark.createDataFrame(rows, "sub string, pred string, obj string, type_obj string, embedding array<float>, vec_id long"), "v")
    mentions = spark.createDataFrame([(i, f"E{i % 9}", vec()) for i in range(n_mentions)], "idx long, y_true string, mention_vec array<float>")
    return vectors, mentions


def test_votes_of_many_mentions_leave_no_candidate(spark):
    """candidates are ranked in the task that found them, with the window's result."""
    vectors, mentions = _tables(spark)
    for by in ("obj", "distance"):
        cands = S.with_payload(LK.candidates_with_fallback(mentions, vectors, 20, payload=LK.VEC_PAYLOAD), vectors, LK.VEC_PAYLOAD)
        want = L.vote_scores(cands, by=by)
        got = LK.vote_scores(mentions, vectors, by, 20)
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        key = lambda df: sorted(map(tuple, df.select("idx", "entity", F.round("score", 9), "_first").collect()))
        assert key(got) == key(want)
        best = lambda df: sorted(map(tuple, L.rank_vote(df).select("idx", "y_pred").collect()))
        assert best(got) == best(want) and len(best(got)) == 300


def test_mentions_of_one_key_vote_together(spark):
    vectors, mentions = _tables(spark)
    twice = mentions.unionByName(mentions.where("idx < 3").withColumn("mention_vec", F.reverse("mention_vec")))
    cands = S.with_payload(LK.candidates_with_fallback(twice, vectors, 20, payload=LK.VEC_PAYLOAD), vectors, LK.VEC_PAYLOAD)
    key = lambda df: sorted(map(tuple, L.rank_vote(df, by="obj").select("idx", "y_pred", F.round("score", 9)).collect()))
    assert key(LK.vote_scores(twice, vectors, "obj", 20)) == key(cands)


LINES = ['<s> <p> "a b"@en .', '<s> <p> "x" .', '<s> <p> <http://o> .', '<s> <p> "5"^^<http://int> .', '<s> <p> "q \\"in\\" it"@en-GB .', '<s> <p> "t"^^<a"b> .',
         '<s> <p> "" .', '<s> <p> "u"@en"v" .', '# no', '', 'x <s> <p> "a" .', '<s> <p> "a"^^<i> . <z> .', '<s> <p> "a@en" .', '<s> <p> "a"^^<x>@en .', '  <s>\t<p>  "tab"@de  .  ',
         '<s> <p> "l m"@en .', '<s> <p> "ä中\U0001F600"@en .', '<s> <p> "a" "b" .', '<s> <p> "a"^^<> .', '<s> <p> "x"@en-1- .', '<s> <p> <> .', '<s> <p> "a"^^<i"@en> .']


def test_a_line_is_parsed_once(spark):
    """F8: filters on the parsed columns don't repeat the patterns, and the columns are the patterns'."""
    import re
    from entlink.sources import rdf
    lines = spark.createDataFrame([(x,) for x in [*LINES, None]], "value string")
    got = rdf.parse_ntriples(lines)
    gated = rdf.lang_gate(got).where("o_lit is not null or o_iri like 'http%'")
    plan = gated._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(f"regexp_extract(value#{n}") for n in re.findall(r"regexp_extract\(value#(\d+)", plan)[:1]) == 1
    v, o = F.col("value"), F.col("_o")
    part = lambda n: F.regexp_extract(o, rdf.LITERAL_PATTERN, n)
    lit = lambda c: F.when(~o.startswith("<"), c)
    empty = lambda c: F.when(c != "", c)
    want = lines.select(F.regexp_extract(v, rdf.LINE_PATTERN, 1).alias("s"), F.regexp_extract(v, rdf.LINE_PATTERN, 2).alias("p"), F.regexp_extract(v, rdf.LINE_PATTERN, 3).alias("_o")) \
        .where("_o <> ''").select("s", "p", F.when(o.startswith("<"), F.expr("substring(_o, 2, length(_o) - 2)")).alias("o_iri"),
                                  lit(F.replace(part(1), F.lit('\\"'), F.lit('"'))).alias("o_lit"), lit(empty(part(2))).alias("lang"), lit(empty(part(3))).alias("dtype"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 12


def test_splits_of_a_scan_are_bounded_inside_only(spark):
    from entlink.session import split_bytes
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    with split_bytes(spark, 1 << 20):
        assert spark.conf.get(name) == str(1 << 20)
    assert spark.conf.get(name) == before


def test_concat_reads_its_literals_once(spark, monkeypatch):
    """the given rows are read by one scan, and a vector's norm isn't worked out for each element."""
    from entlink.functions import encoders as EN
    from entlink.plans.encode import encode_concat
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    rows = [("a", label, "One two"), ("a", "p", "three, two"), ("a", "p", "three, two"), ("b", "p", "x"), ("c", label, None), (None, "p", "y"), ("d", "p", "!!")]
    seen = spark.sparkContext.accumulator(0)
    lits = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(lambda r: (seen.add(1), r)[1]), "s string, p string, o string")
    out = {r["s"]: r["embedding"] for r in encode_concat(lits).collect()}
    assert seen.value == len(rows)
    texts = spark.createDataFrame([("a", "One twothree, two. three, two. "), ("l", "One two"), ("b", "x. ")], "s string, t string")
    v = {r["s"]: r["embedding"] for r in EN.hash_embed(texts, ["s"], "t").collect()}
    assert set(out) == {"a", "b", "c", "d"} and max(out["c"]) == max(out["d"]) == 0
    assert all(abs(x - (t + w) / 2) < 1e-6 for x, t, w in zip(out["a"], v["a"], v["l"])) and all(abs(x - y) < 1e-6 for x, y in zip(out["b"], v["b"]))
