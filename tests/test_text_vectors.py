import math

from pyspark.sql import functions as F

from entlink.functions import text as TX
from entlink.functions import vectors as V


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_clean_literal_variants(spark):
    rows = [('"Hello, World!"@en .',), ("café # 1+2 [x]",), (None,), ('"   "',)]
    enc = _one(spark, TX.clean_literal("t"), rows, "t string")
    ev = _one(spark, TX.clean_eval("t"), rows, "t string")
    assert enc[0] == "Hello, World!"
    assert enc[1] == "caf  12 x"           # '#', '+', 'é', '[', ']' removed
    assert ev[1] == "caf # 1+2 x"         # '#', '+' kept by the wider class
    assert enc[2] is None and enc[3] == ""


def test_strip_suffix_and_camel(spark):
    assert _one(spark, TX.strip_lang_suffix("t"), [('"x"@en .',)], "t string") == ['"x"']
    assert _one(spark, TX.camel_split("t"), [("camelCaseX9Y",)], "t string") == ["camel Case X9 Y"]


def test_normalise_uri(spark):
    got = _one(spark, TX.normalise_uri("t"), [("en.wikipedia.org/wiki/Paris",), ("http://en.wikipedia.org/wiki/X",)],
               "t string")
    assert got == ["http://dbpedia.org/resource/Paris", "http://dbpedia.org/resource/X"]


def _chunks_py(text, n):
    import re
    if len(text) <= n:
        return [text]
    sents = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*", text) if s.strip()]
    out, buf = [], ""
    for s in sents:
        if len(buf + s) <= n or buf == "":
            buf += s + " "
        else:
            out.append(buf)
            buf = s
    if buf != "":
        out.append(buf)
    return out


def test_chunk_text_matches_greedy_rule(spark):
    texts = ["Short.", "One two. Three four five! Six? Seven eight nine ten. " * 3, "x" * 50 + ". y.", ""]
    got = _one(spark, TX.chunk_text("t", 20), [(t,) for t in texts], "t string")
    assert got == [_chunks_py(t, 20) for t in texts]


def test_mention_window(spark):
    df = spark.createDataFrame([("a b c d e f g".split(), ["d"]), ("a b c".split(), ["z"]),
                                ("x a b a y".split(), ["a", "b"])], "t array<string>, m array<string>")
    got = [r[0] for r in df.select(TX.mention_window("t", "m", 2)).collect()]
    # hits in mention-token order: a -> 2, 4; b -> 3; left = 2, right = 3 (the last hit)
    assert got == ["b c d e f", None, "x a b a y"]


def test_setting_name_and_log_index(spark):
    df = spark.createDataFrame([("ST", False, "AVG", None, None, True, "qald-7"),
                                ("USE", True, "AVG", 2, "GROUPED", False, "msnbc")],
                               "m string, w boolean, s string, n int, way string, c boolean, d string")
    got = [r[0] for r in df.select(TX.setting_name("m", "w", "s", "n", "way", "c", "d")).collect()]
    assert got == ["ST_NotWGT_AVG_TopNone_ContWithMention_qald-7", "USE_WGT_AVG_Top2Grouped_ContWithoutMention_msnbc"]
    assert _one(spark, TX.log_index("t"), [("Index:12|a|b|Correct",), ("i: 7",), ("none",)], "t string") == [12, 7, None]


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    r = df.select(V.cosine_distance("a", "b"), V.l2_distance("a", "b"), V.dot("a", "b"),
                  V.mean_vectors("a", "b")).collect()
    assert math.isclose(r[0][0], 1.0) and math.isclose(r[0][1], math.sqrt(2)) and r[0][2] == 0.0
    assert abs(r[1][0]) < 1e-12 and r[1][1] == 0.0 and r[1][2] == 25.0 and r[1][3] == [3.0, 4.0]
    p = spark.createDataFrame([("[1.5, 2]",)], "t string").select(V.parse_vector("t")).collect()[0][0]
    assert p == [1.5, 2.0]
