"""Query catalogue: one Spark query per operator plus its DuckDB oracle.

Every query reads the driver tables of ``sf_dir`` (through the fixture views
of ``fixtures.py``) and runs the library operators over the whole tables.
Floating-point outputs are rounded to 4 places in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.functions import encoders as EN
from entlink.functions import text as TX
from entlink.functions import vectors as V
from entlink.operators import counting as CT
from entlink.operators import embed as EM
from entlink.operators import linking as L
from entlink.operators import metrics as M
from entlink.operators import search as S
from entlink.operators import stats as ST
from entlink.operators import triples as TR
from entlink.plans import link as LK
from entlink.plans.fixtures import load, table, with_views
from entlink.session import persist_table, split_bytes
from entlink.sources import rdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VEC_PAYLOAD = ["sub", "pred", "obj", "type_obj", "vec_id"]


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views or [], sql)
        return fn
    return deco


def _r(c, places: int = 4):
    """Rounded double with negative zero folded to zero (same in DuckDB: ``round(x, 4) + 0.0``)."""
    return F.round(c, places) + F.lit(0.0)


def _long(df: DataFrame, keys: list[str], vec: str = "embedding") -> DataFrame:
    return EM.explode_vector(df, keys, vec, 4, "v")


# ---------------------------------------------------------------- vectors --

@query("mean_embedding")
def q_mean_embedding(spark, sf):
    lit = load(spark, sf, "emb_literals")
    return _long(EM.mean_embedding(lit, "s"), ["s", "n_rows"])


ORACLE["mean_embedding"] = with_views(["emb_literals"], """
SELECT s, n_rows, i, round(avg(x), 4) + 0.0 AS v
FROM (SELECT s, count(*) OVER (PARTITION BY s) AS n_rows,
             generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x
      FROM emb_literals) u
GROUP BY s, n_rows, i
""")


@query("entity_embedding_blend", ["emb_literals"], """
WITH u AS (
  SELECT s, p, o, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x FROM emb_literals),
m AS (SELECT s, i, avg(x) AS mx, count(*) AS n FROM u GROUP BY s, i),
lab AS (
  SELECT s, i, x AS lx FROM (
    SELECT u.*, dense_rank() OVER (PARTITION BY s ORDER BY p, o) AS r
    FROM u WHERE p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://xmlns.com/foaf/0.1/name')) t
  WHERE r = 1)
SELECT m.s, m.s AS o, 'E' AS typeObject, m.n AS n_rows, m.i,
       round(CASE WHEN lab.lx IS NOT NULL AND m.n > 1 THEN (m.mx + lab.lx) / 2.0 ELSE m.mx END, 4) + 0.0 AS v
FROM m LEFT JOIN lab ON lab.s = m.s AND lab.i = m.i
""")
def q_entity_embedding_blend(spark, sf):
    lit = load(spark, sf, "emb_literals")
    return _long(EM.entity_embeddings(lit, blend=True), ["s", "o", "typeObject", "n_rows"])


@query("cosine_topk", ["vectors", "mentions"], """
SELECT idx, sub, pred, obj, type_obj, vec_id, round(distance, 4) + 0.0 AS distance FROM (
  SELECT m.idx, v.sub, v.pred, v.obj, v.type_obj, v.vec_id,
         list_cosine_distance(v.embedding::DOUBLE[], m.mention_vec::DOUBLE[]) AS distance,
         row_number() OVER (PARTITION BY m.idx ORDER BY list_cosine_distance(v.embedding::DOUBLE[], m.mention_vec::DOUBLE[]),
                            v.sub, v.pred, v.obj, v.type_obj, v.vec_id) AS rn
  FROM mentions m CROSS JOIN vectors v) t
WHERE rn <= 100
""")
def q_cosine_topk(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    top = S.cosine_top_k(mentions, vectors, S.TOP_K, payload=VEC_PAYLOAD)
    return top.withColumn("distance", _r("distance"))


@query("candidate_expand", ["vectors", "mentions"], """
WITH top AS (
  SELECT idx, sub FROM (
    SELECT m.idx, v.sub, row_number() OVER (PARTITION BY m.idx ORDER BY
             list_cosine_distance(v.embedding::DOUBLE[], m.mention_vec::DOUBLE[]), v.sub, v.pred, v.obj, v.type_obj, v.vec_id) AS rn
    FROM mentions m CROSS JOIN vectors v) t WHERE rn <= 100)
SELECT DISTINCT t.idx, v.sub, v.pred, v.obj, v.type_obj, v.vec_id,
       round(list_cosine_distance(v.embedding::DOUBLE[], m.mention_vec::DOUBLE[]), 4) + 0.0 AS distance
FROM (SELECT DISTINCT idx, sub FROM top) t
JOIN vectors v ON v.sub = t.sub
JOIN mentions m ON m.idx = t.idx
""")
def q_candidate_expand(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    c = S.candidates(mentions, vectors, S.TOP_K, payload=VEC_PAYLOAD)
    return c.select("idx", *VEC_PAYLOAD, _r("distance").alias("distance"))


# ----------------------------------------------------------------- ingest --

def _parsed(spark, sf):
    return TR.distinct_triples(rdf.parse_ntriples(load(spark, sf, "kg_lines")))


@query("parse_ntriples", ["triples"], "SELECT * FROM triples")
def q_parse_ntriples(spark, sf):
    return _parsed(spark, sf)


@query("lang_gate_strict", ["kg_lines"], """
SELECT regexp_extract(value, '^<[^>]*> <([^>]*)>', 1) AS p, count(*) AS n
FROM kg_lines WHERE instr(value, '@') = 0 OR instr(value, '@en') > 0
GROUP BY 1
""")
def q_lang_gate_strict(spark, sf):
    lines = rdf.lang_gate_strict(load(spark, sf, "kg_lines"))
    return rdf.parse_ntriples(lines).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("lang_gate", ["triples"], """
SELECT p, lang, count(*) AS n FROM triples
WHERE lang IS NULL OR lower(lang) = 'en' OR lower(lang) LIKE 'en-%'
GROUP BY 1, 2
""")
def q_lang_gate(spark, sf):
    return rdf.lang_gate(_parsed(spark, sf)).groupBy("p", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("literals_en", ["literals"], "SELECT * FROM literals")
def q_literals_en(spark, sf):
    return TR.literals(_parsed(spark, sf))


@query("links_http", ["links"], "SELECT * FROM links")
def q_links_http(spark, sf):
    return TR.links(_parsed(spark, sf), cluster_by_subject=True)


# a scan's task holds the distinct triples of its split, each many times as long as its row in the file
TRIPLE_SPLIT = 16 << 20
_SMALL_PARTS = "SELECT concat('http://kg.example/part/', p_partkey) AS s FROM part WHERE p_size <= 10"
_HOP_PREDS = ["http://kg.example/suppliedBy", "http://kg.example/madeBy"]


@query("one_hop_whitelist", ["links"], f"""
SELECT l.* FROM links l
WHERE l.s IN ({_SMALL_PARTS}) AND l.p IN ('http://kg.example/suppliedBy', 'http://kg.example/madeBy')
""")
def q_one_hop_whitelist(spark, sf):
    links = load(spark, sf, "links")
    with split_bytes(spark, TRIPLE_SPLIT):
        return persist_table(TR.one_hop(links, spark.sql(_SMALL_PARTS), _HOP_PREDS), "one-hop")


@query("entity_literals", ["triples"], f"""
SELECT s, p, o_lit AS o FROM triples
WHERE s IN ({_SMALL_PARTS}) AND lower(lang) = 'en'
""")
def q_entity_literals(spark, sf):
    triples = load(spark, sf, "triples")
    with split_bytes(spark, TRIPLE_SPLIT):
        return persist_table(TR.entity_literals(triples, spark.sql(_SMALL_PARTS)), "entity-literals")


# ------------------------------------------------------------------- text --

def _sql_clean(col: str, cls: str) -> str:
    return (f"trim(regexp_replace(regexp_replace({col}, '\\r?@en .', '', 'g'), "
            f"'{cls}', '', 'g'), '[\" ]')")


_CLS_ENC = """[^a-zA-Z0-9()''".,:<>?!@$%&|\\s]+"""
_CLS_EVAL = """[^a-zA-Z0-9()''"-.,:<>?!@$%&|\\s]+"""


@query("clean_literal", [], f"""
SELECT doc_id, length(c) AS n_chars, md5(c) AS md5 FROM (SELECT doc_id, {_sql_clean('text', _CLS_ENC)} AS c FROM documents) t
""")
def q_clean_literal(spark, sf):
    c = TX.clean_literal("text")
    return table(spark, sf, "documents").select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("md5"))


@query("clean_eval", [], f"""
SELECT doc_id, length(c) AS n_chars, md5(c) AS md5 FROM (SELECT doc_id, lower({_sql_clean('text', _CLS_EVAL)}) AS c FROM documents) t
""")
def q_clean_eval(spark, sf):
    c = F.lower(TX.clean_eval("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("md5"))


@query("clean_suffix", ["literals"], """
SELECT s, p, regexp_replace(o || '@en .', '\\r?@en .', '', 'g') AS o FROM literals
""")
def q_clean_suffix(spark, sf):
    lits = load(spark, sf, "literals")
    return lits.select("s", "p", TX.strip_lang_suffix(F.concat("o", F.lit("@en ."))).alias("o"))


@query("camel_split", [], """
SELECT doc_id, md5(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS md5 FROM documents
""")
def q_camel_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(TX.camel_split("text")).alias("md5"))


@query("uri_normalise", [], """
SELECT page_id, replace(CASE WHEN instr(url, 'http://') = 0 THEN 'http://' || url ELSE url END,
                        'en.wikipedia.org/wiki', 'dbpedia.org/resource') AS uri FROM pages
""")
def q_uri_normalise(spark, sf):
    return table(spark, sf, "pages").select("page_id", TX.normalise_uri("url").alias("uri"))


@query("mention_window", [], """
WITH t AS (
  SELECT conv_id, turn, string_split(text, ' ') AS tk FROM conversations),
m AS (
  SELECT conv_id, turn, tk, [tk[(len(tk) + 1) // 2], tk[len(tk)]] AS mt FROM t),
h AS (
  SELECT *, list_concat(list_filter(range(1, len(tk) + 1), lambda i: tk[i] = mt[1]),
                        list_filter(range(1, len(tk) + 1), lambda i: tk[i] = mt[2])) AS hits FROM m),
b AS (
  SELECT *, hits[1] AS l, hits[len(hits)] AS r FROM h)
SELECT conv_id, turn,
       array_to_string(list_concat(tk[greatest(l - 3, 1):l - 1], mt, tk[r + 1:least(r + 3, len(tk))]), ' ') AS window
FROM b
""")
def q_mention_window(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("tk"))
    mt = F.array(F.element_at("tk", ((F.size("tk") + 1) / 2).cast("int")), F.element_at("tk", -1))
    return c.select("conv_id", "turn", TX.mention_window(F.col("tk"), mt, 3).alias("window"))


@query("chunk_literals", [], f"""
WITH RECURSIVE d AS (SELECT doc_id, {_sql_clean('text', _CLS_ENC)} AS lit FROM documents),
sen AS (SELECT doc_id, lit, list_filter(list_transform(regexp_extract_all(lit, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS s
        FROM d WHERE length(lit) > 384),
-- P[k]: characters of the first k sentences, with a space each
pre AS (SELECT doc_id, list(total ORDER BY k) AS P FROM (
          SELECT doc_id, k, sum(length(s[k]) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS total
          FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM sen) AS a) AS b GROUP BY doc_id),
walk AS (
  SELECT doc_id, 0 AS chunk_no, CAST(1 AS BIGINT) AS i, 1 + len(list_filter(P[2:], lambda t: t - 1 <= 384)) AS j, len(P) AS n FROM pre
  UNION ALL
  SELECT w.doc_id, w.chunk_no + 1, w.j + 1, w.j + 1 + len(list_filter(P[w.j + 2:], lambda t: t - P[w.j] - 2 <= 384)), w.n
  FROM walk AS w JOIN pre ON pre.doc_id = w.doc_id WHERE w.j < w.n),
chunks AS (
  SELECT w.doc_id, w.chunk_no, s[i] || CASE WHEN i = 1 THEN ' ' ELSE '' END || array_to_string(list_transform(s[i + 1:j], lambda x: x || ' '), '') AS chunk
  FROM walk AS w JOIN sen ON sen.doc_id = w.doc_id
  UNION ALL SELECT doc_id, 0, lit FROM d WHERE lit <> '' AND length(lit) <= 384)
SELECT doc_id, chunk_no, CAST(length(chunk) AS INT) AS chunk_len, md5(chunk) AS md5 FROM chunks
""")
def q_chunk_literals(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", TX.clean_literal("text").alias("lit")) \
        .where(F.col("lit") != "")
    return d.select("doc_id", F.posexplode(TX.chunk_text("lit", 384)).alias("chunk_no", "chunk")) \
        .select("doc_id", "chunk_no", F.length("chunk").alias("chunk_len"), F.md5("chunk").alias("md5"))


@query("hash_embed", [], """
WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS tok FROM documents),
b AS (SELECT doc_id, ('0x' || substring(md5(tok), 1, 4))::INT % 64 AS bucket, count(*) AS cnt
      FROM t WHERE tok <> '' GROUP BY 1, 2)
SELECT doc_id, bucket, cnt, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)), 4) AS weight FROM b
""")
def q_hash_embed(spark, sf):
    d = table(spark, sf, "documents")
    return EN.hash_bucket_counts(d, ["doc_id"], "text").withColumn("weight", F.round("weight", 4))


@query("doc_text", [], """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS doc FROM conversations GROUP BY conv_id
""")
def q_doc_text(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return g.select("conv_id", F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("doc"))


# --------------------------------------------------------------- counting --

@query("literal_count_ci", ["literals"],
       "SELECT s, p, o, count(*) OVER (PARTITION BY lower(o)) AS count FROM literals WHERE o IS NOT NULL")
def q_literal_count_ci(spark, sf):
    return CT.with_literal_count(load(spark, sf, "literals"))


@query("literal_count_exact", ["literals"],
       "SELECT s, p, o, count(*) OVER (PARTITION BY o) AS count FROM literals WHERE o IS NOT NULL")
def q_literal_count_exact(spark, sf):
    return CT.with_literal_count(load(spark, sf, "literals"), exact=True)


_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"


@query("pending_literals", ["emb_literals"], f"""
SELECT s, p, o, vec_id FROM emb_literals e
WHERE NOT EXISTS (SELECT 1 FROM emb_literals d WHERE d.p = '{_LABEL}' AND d.s = e.s AND d.p = e.p AND d.o = e.o)
""")
def q_pending_literals(spark, sf):
    e = load(spark, sf, "emb_literals")
    done = e.where(F.col("p") == _LABEL)
    return CT.pending_literals(e.select("s", "p", "o", "vec_id"), done)


@query("pending_entities", ["emb_literals"], f"""
SELECT s, p, o, vec_id FROM emb_literals
WHERE s NOT IN (SELECT s FROM emb_literals WHERE p = '{_LABEL}' AND o LIKE 'Lit%')
""")
def q_pending_entities(spark, sf):
    e = load(spark, sf, "emb_literals")
    done = e.where((F.col("p") == _LABEL) & F.col("o").startswith("Lit"))
    return CT.pending_entities(e.select("s", "p", "o", "vec_id"), done)


_EMB_COUNT = "(SELECT s, p, o, vec_id, embedding, count(*) OVER (PARTITION BY lower(o)) AS count FROM emb_literals)"


@query("topn_simple", ["emb_literals"], f"""
SELECT s, p, o, vec_id, count, top_n FROM (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY count, p, o, vec_id) AS top_n FROM {_EMB_COUNT} c) t
WHERE top_n <= 2
""")
def q_topn_simple(spark, sf):
    e = CT.with_literal_count(load(spark, sf, "emb_literals").select("s", "p", "o", "vec_id"))
    return CT.top_n(e, 2, "SIMPLE", tie_break=["vec_id"])


@query("topn_grouped", ["emb_literals"], f"""
SELECT s, p, o, vec_id, count, top_n FROM (
  SELECT *, dense_rank() OVER (PARTITION BY s ORDER BY count) AS top_n FROM {_EMB_COUNT} c) t
WHERE top_n <= 2
""")
def q_topn_grouped(spark, sf):
    e = CT.with_literal_count(load(spark, sf, "emb_literals").select("s", "p", "o", "vec_id"))
    return CT.top_n(e, 2, "GROUPED")


@query("weighted_embedding", ["emb_literals"], f"""
SELECT vec_id, i - 1 AS i, round(x / count, 4) + 0.0 AS v FROM (
  SELECT vec_id, count, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM {_EMB_COUNT} c) t
""")
def q_weighted_embedding(spark, sf):
    e = CT.with_literal_count(load(spark, sf, "emb_literals").select("vec_id", "o", "embedding"))
    return _long(EM.weight_by_count(e), ["vec_id"])


@query("concat_text", ["literals"], """
WITH r AS (SELECT s, p, o, row_number() OVER (PARTITION BY s ORDER BY p, o) AS pos FROM literals),
lab AS (SELECT s, min(pos) AS lpos FROM r
        WHERE p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://xmlns.com/foaf/0.1/name') GROUP BY s)
SELECT r.s, string_agg(CASE WHEN r.pos = lab.lpos THEN regexp_replace(o, '\\r?@en .', '', 'g')
                            ELSE regexp_replace(o, '\\r?@en .', '', 'g') || '. ' END, '' ORDER BY r.pos) AS text,
       max(CASE WHEN r.pos = lab.lpos THEN regexp_replace(o, '\\r?@en .', '', 'g') END) AS label
FROM r LEFT JOIN lab ON lab.s = r.s GROUP BY r.s
""")
def q_concat_text(spark, sf):
    return EM.concat_literals(load(spark, sf, "literals"))


@query("neighbour_mean", ["emb_literals", "ent_links"], """
WITH r AS (
  SELECT s, embedding FROM emb_literals
  UNION ALL
  SELECT l.s, m.embedding FROM ent_links l JOIN emb_literals m ON m.s = l.o
  WHERE l.s IN (SELECT s FROM emb_literals))
SELECT s, s AS o, 'E' AS typeObject, n_rows, i, round(avg(x), 4) + 0.0 AS v FROM (
  SELECT s, count(*) OVER (PARTITION BY s) AS n_rows, generate_subscripts(embedding, 1) - 1 AS i,
         unnest(embedding::DOUBLE[]) AS x FROM r) u
GROUP BY s, n_rows, i
""")
def q_neighbour_mean(spark, sf):
    e, links = load(spark, sf, "emb_literals", "ent_links")
    return _long(EM.neighbourhood_embedding(e.select("s", "embedding"), links), ["s", "o", "typeObject", "n_rows"])


# ----------------------------------------------------------------- search --

def _sql_topk(dist: str, k: int = 100, where: str = "") -> str:
    return f"""
SELECT idx, sub, pred, obj, type_obj, vec_id, round(distance, 4) + 0.0 AS distance FROM (
  SELECT m.idx, v.sub, v.pred, v.obj, v.type_obj, v.vec_id, {dist} AS distance,
         row_number() OVER (PARTITION BY m.idx ORDER BY {dist}, v.sub, v.pred, v.obj, v.type_obj, v.vec_id) AS rn
  FROM mentions m CROSS JOIN vectors v {where}) t
WHERE rn <= {k}
"""


_COS = "list_cosine_distance(v.embedding::DOUBLE[], m.mention_vec::DOUBLE[])"
_L2 = "list_distance(v.embedding::DOUBLE[], m.mention_vec::DOUBLE[])"
_DOT = "(- list_dot_product(v.embedding::DOUBLE[], m.mention_vec::DOUBLE[]))"


@query("l2_topk", ["vectors", "mentions"], _sql_topk(_L2))
def q_l2_topk(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    return S.knn_join(mentions, vectors, S.TOP_K, "l2", payload=VEC_PAYLOAD).withColumn("distance", _r("distance"))


@query("dot_topk", ["vectors", "mentions"], _sql_topk(_DOT))
def q_dot_topk(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    return S.knn_join(mentions, vectors, S.TOP_K, "dot", payload=VEC_PAYLOAD).withColumn("distance", _r("distance"))


@query("range_search", ["vectors", "mentions"], _sql_topk(_COS, 10000, f"WHERE {_COS} < 1.0"))
def q_range_search(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    return S.range_search(mentions, vectors, payload=VEC_PAYLOAD).withColumn("distance", _r("distance"))


@query("vector_from_text", ["vectors"], """
SELECT vec_id, len(e) AS dims, round(list_sum(e), 4) + 0.0 AS total
FROM (SELECT vec_id, CAST(CAST(embedding::DOUBLE[] AS VARCHAR) AS DOUBLE[]) AS e FROM vectors) t
""")
def q_vector_from_text(spark, sf):
    v = load(spark, sf, "vectors")
    e = V.parse_vector(V.vector_to_text(F.col("embedding").cast("array<double>")))
    return v.select("vec_id", F.size(e).alias("dims"),
                    _r(F.aggregate(e, F.lit(0.0), lambda a, x: a + x)).alias("total"))


# ---------------------------------------------------------------- linking --

_LINK_CTE = """
WITH vt AS MATERIALIZED (SELECT * FROM vectors), mt AS MATERIALIZED (SELECT * FROM mentions),
present AS MATERIALIZED (SELECT * FROM mt WHERE lower(y_true) IN (SELECT lower(sub) FROM vt)),
scored AS MATERIALIZED (
  SELECT p.idx, v.sub, v.pred, v.obj, v.type_obj, v.vec_id,
         list_cosine_distance(v.embedding::DOUBLE[], p.mention_vec::DOUBLE[]) AS distance,
         list_distance(v.embedding::DOUBLE[], list_transform(range(1, len(p.mention_vec) + 1),
               lambda i: (p.mention_vec[i]::DOUBLE + p.ctx_vec[i]::DOUBLE) / 2.0)) AS d_ctx
  FROM present p CROSS JOIN vt v),
ranked AS MATERIALIZED (
  SELECT idx, vec_id, sub, distance, row_number() OVER (PARTITION BY idx ORDER BY distance, sub, pred, obj, type_obj, vec_id) AS rn
  FROM scored WHERE NOT isnan(distance)),
hitsub AS MATERIALIZED (SELECT DISTINCT idx, sub FROM ranked WHERE rn <= 100),
need AS MATERIALIZED (SELECT p.idx FROM present p WHERE NOT EXISTS (SELECT 1 FROM hitsub h WHERE h.idx = p.idx AND h.sub = p.y_true)),
allk AS MATERIALIZED (
  SELECT s.idx, s.vec_id FROM scored s JOIN hitsub h ON h.idx = s.idx AND h.sub = s.sub
  UNION SELECT idx, vec_id FROM ranked WHERE distance < 1.0 AND rn <= 10000 AND idx IN (SELECT idx FROM need)),
dc AS MATERIALIZED (SELECT s.* FROM scored s JOIN allk a ON a.idx = s.idx AND a.vec_id = s.vec_id),
pr AS (SELECT idx, sub AS y_pred, d_ctx FROM (
         SELECT *, row_number() OVER (PARTITION BY idx ORDER BY d_ctx, distance, sub, pred NULLS FIRST, obj, vec_id) AS r
         FROM dc) t WHERE r = 1),
lg AS (SELECT p.idx, p.y_true, pr.y_pred FROM present p LEFT JOIN pr ON pr.idx = p.idx),
eg AS (SELECT DISTINCT y_true FROM lg WHERE lower(y_pred) <> lower(y_true)),
dd AS (SELECT eg.y_true, g.o AS e FROM eg JOIN disambig g ON g.s = eg.y_true
       UNION SELECT eg.y_true, g.s FROM eg JOIN disambig g ON g.o = eg.y_true),
nbr AS (SELECT y_true, e FROM dd
        UNION SELECT dd.y_true, g.o FROM dd JOIN disambig g ON lower(g.s) = lower(dd.e)
        UNION SELECT dd.y_true, g.s FROM dd JOIN disambig g ON lower(g.o) = lower(dd.e)),
st AS (SELECT lg.idx, lg.y_true, lg.y_pred,
              CASE WHEN lower(lg.y_pred) = lower(lg.y_true) THEN 'Correct'
                   WHEN n.y_true IS NOT NULL THEN 'Disambiguated' ELSE 'Error' END AS status
       FROM lg LEFT JOIN (SELECT DISTINCT y_true, lower(e) AS e FROM nbr) n
         ON n.y_true = lg.y_true AND n.e = lower(lg.y_pred)),
log AS (SELECT idx, y_true, y_pred, CASE WHEN status = 'Disambiguated' THEN y_true ELSE y_pred END AS y_pred_dis, status
        FROM st
        UNION ALL
        SELECT idx, y_true, NULL, NULL, 'Not present' FROM mt
        WHERE lower(y_true) NOT IN (SELECT lower(sub) FROM vt))
"""
_LINK_VIEWS = ["vectors", "mentions", "disambig"]


def _link_tables(spark, sf):
    """The linking tables; the vector table is a stored one (K6), as in use."""
    vectors, mentions, disambig = load(spark, sf, "vectors", "mentions", "disambig")
    return persist_table(vectors, "vector-table"), mentions, disambig


def _link_parts(spark, sf, nearest=None):
    vectors, mentions, disambig = _link_tables(spark, sf)
    present = L.present_mentions(mentions, vectors)
    cands = LK.candidates_with_fallback(LK.with_context(present, True), vectors, contexts={"d_ctx": "context_vec"}, nearest=nearest)
    return vectors, mentions, disambig, present, cands


@query("candidates_fallback", _LINK_VIEWS, _LINK_CTE + """
SELECT idx, sub, pred, obj, type_obj, vec_id, round(distance, 4) + 0.0 AS distance FROM dc
""")
def q_candidates_fallback(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    present = L.present_mentions(mentions, vectors)
    c = S.with_payload(LK.candidates_with_fallback(present, vectors, payload=VEC_PAYLOAD), vectors, VEC_PAYLOAD)
    return c.select("idx", *VEC_PAYLOAD, _r("distance").alias("distance"))


@query("context_vector", ["mentions"], """
SELECT idx, i - 1 AS i, round((a + b) / 2.0, 4) + 0.0 AS v FROM (
  SELECT idx, generate_subscripts(mention_vec, 1) AS i, unnest(mention_vec::DOUBLE[]) AS a,
         unnest(ctx_vec::DOUBLE[]) AS b FROM mentions) t
""")
def q_context_vector(spark, sf):
    m = load(spark, sf, "mentions")
    return _long(L.context_vector(m), ["idx"], "context_vec")


@query("rerank_predict", _LINK_VIEWS, _LINK_CTE + "SELECT idx, y_pred, round(d_ctx, 4) + 0.0 AS d_ctx FROM pr")
def q_rerank_predict(spark, sf):
    *_, scored = _link_parts(spark, sf, 1)
    return L.rerank(scored).withColumn("d_ctx", _r("d_ctx"))


@query("tied_candidates", _LINK_VIEWS, _LINK_CTE + """
SELECT idx, count(*) AS n_tied, count(*) FILTER (WHERE type_obj = 'E') AS n_tied_entities FROM (
  SELECT *, rank() OVER (PARTITION BY idx ORDER BY d_ctx) AS rk FROM dc) t
WHERE rk = 1 GROUP BY idx
""")
def q_tied_candidates(spark, sf):
    vectors, *_, scored = _link_parts(spark, sf, 1)
    return L.tied_candidates(scored, vectors)


@query("error_report", _LINK_VIEWS, _LINK_CTE + """
SELECT t.idx, m.mention, t.y_true, t.y_pred, rank, sub, obj, round(d_ctx, 4) + 0.0 AS d_ctx FROM (
  SELECT dc.*, log.y_true, log.y_pred,
         row_number() OVER (PARTITION BY dc.idx ORDER BY d_ctx, distance, sub, pred NULLS FIRST, obj, vec_id) AS rank
  FROM dc JOIN log ON log.idx = dc.idx WHERE log.status = 'Error') t
JOIN mt m ON m.idx = t.idx
WHERE rank <= 25
""")
def q_error_report(spark, sf):
    vectors, mentions, disambig, present, cands = _link_parts(spark, sf, L.ERROR_REPORT_ROWS)
    errors = LK.link_mentions(mentions, vectors, disambig).where(F.col("status") == L.STATUS_ERROR)
    return L.error_report(cands, errors, vectors, mentions.select("idx", "mention")).withColumn("d_ctx", _r("d_ctx"))


@query("link_status", _LINK_VIEWS, _LINK_CTE + "SELECT * FROM log")
def q_link_status(spark, sf):
    vectors, mentions, disambig = _link_tables(spark, sf)
    return LK.link_mentions(mentions, vectors, disambig)


@query("link_resume", _LINK_VIEWS, _LINK_CTE + "SELECT * FROM log")
def q_link_resume(spark, sf):
    """An evaluation that stops after half of the mentions: its log is written as
    text (K7), read back (S11), and the rest is linked. The result is the whole log."""
    from entlink.sources.datasets import eval_log_lines, read_eval_log
    vectors, mentions, disambig = _link_tables(spark, sf)
    half = LK.link_mentions(mentions.where(F.col("idx") % 2 == 0), vectors, disambig)
    path = _scratch(spark, "half-log")
    eval_log_lines(half, "half").select("value").write.text(path)
    return LK.link_mentions(mentions, vectors, disambig, done=read_eval_log(spark, path))


@query("status_counts", _LINK_VIEWS, _LINK_CTE + "SELECT status, count(*) AS n FROM log GROUP BY status")
def q_status_counts(spark, sf):
    vectors, mentions, disambig = load(spark, sf, "vectors", "mentions", "disambig")
    return M.status_counts(LK.link_mentions(mentions, vectors, disambig))


@query("missing_entities", ["mentions", "vectors"],
       "SELECT idx, y_true FROM mentions WHERE lower(y_true) NOT IN (SELECT lower(sub) FROM vectors)")
def q_missing_entities(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    return L.missing_entities(mentions, vectors).select("idx", "y_true")


@query("present_mentions", ["mentions", "vectors"],
       "SELECT idx, y_true FROM mentions WHERE lower(y_true) IN (SELECT lower(sub) FROM vectors)")
def q_present_mentions(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    return L.present_mentions(mentions, vectors).select("idx", "y_true")


_NBR_CTE = """
WITH d AS (
  SELECT y.y_true, g.o AS e FROM (SELECT DISTINCT y_true FROM preds) y JOIN disambig g ON g.s = y.y_true
  UNION SELECT y.y_true, g.s FROM (SELECT DISTINCT y_true FROM preds) y JOIN disambig g ON g.o = y.y_true),
nbr AS (
  SELECT * FROM d
  UNION SELECT d.y_true, g.o FROM d JOIN disambig g ON lower(g.s) = lower(d.e)
  UNION SELECT d.y_true, g.s FROM d JOIN disambig g ON lower(g.o) = lower(d.e))
"""


@query("disambig_neighbourhood", ["preds", "disambig"], _NBR_CTE + "SELECT DISTINCT y_true, lower(e) AS e FROM nbr")
def q_disambig_neighbourhood(spark, sf):
    preds, disambig = load(spark, sf, "preds", "disambig")
    return L.disambig_neighbourhood(preds, disambig)


@query("disambig_sizes", ["preds", "disambig"], """
WITH ed AS (SELECT s AS a, o AS b FROM disambig UNION SELECT o, s FROM disambig),
direct AS (SELECT DISTINCT p.y_true, lower(ed.b) AS page FROM preds p JOIN ed ON ed.a = p.y_true),
members AS (SELECT DISTINCT lower(a) AS page, lower(b) AS member FROM ed),
degree AS (SELECT page, count(*) AS d FROM members GROUP BY page)
SELECT y_true, count(*) AS n_direct, coalesce(sum(d), 0)::BIGINT AS n_paths FROM direct LEFT JOIN degree ON degree.page = direct.page GROUP BY y_true
""")
def q_disambig_sizes(spark, sf):
    preds, disambig = load(spark, sf, "preds", "disambig")
    return L.neighbourhood(preds, disambig).sizes()


@query("disambig_contains", ["preds", "disambig"], _NBR_CTE + """
SELECT p.idx, p.y_true, p.y_pred FROM preds p
WHERE EXISTS (SELECT 1 FROM nbr n WHERE n.y_true = p.y_true AND lower(n.e) = lower(p.y_pred))
""")
def q_disambig_contains(spark, sf):
    preds, disambig = load(spark, sf, "preds", "disambig")
    return L.neighbourhood(preds, disambig).contains(preds).select("idx", "y_true", "y_pred")


@query("disambig_forgive", ["preds", "disambig"], _NBR_CTE + """
SELECT CASE WHEN lower(p.y_pred) = lower(p.y_true) THEN 'Correct'
            WHEN n.y_true IS NOT NULL THEN 'Disambiguated' ELSE 'Error' END AS status, count(*) AS n
FROM preds p
LEFT JOIN (SELECT DISTINCT y_true, lower(e) AS e FROM nbr) n
  ON n.y_true = p.y_true AND n.e = lower(p.y_pred)
GROUP BY 1
""")
def q_disambig_forgive(spark, sf):
    preds, disambig = load(spark, sf, "preds", "disambig")
    return M.status_counts(L.apply_disambiguation(preds, disambig))


@query("rank_vote", _LINK_VIEWS, _LINK_CTE + """
, rk AS (SELECT s.idx, s.sub, s.obj, s.vec_id, s.distance,
                dense_rank() OVER (PARTITION BY s.idx ORDER BY s.distance) - 1 AS r,
                row_number() OVER (PARTITION BY s.idx ORDER BY s.distance, s.sub, s.obj, s.vec_id) AS pos
         FROM scored s JOIN allk a ON a.idx = s.idx AND a.vec_id = s.vec_id),
sc AS (SELECT idx, lower(sub) AS entity, sum(1.0 / (r + 1)) AS score, min(pos) AS first FROM rk GROUP BY 1, 2)
SELECT idx, entity AS y_pred, round(score, 4) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, first) AS w FROM sc) t WHERE w = 1
""")
def q_rank_vote(spark, sf):
    vectors, mentions, _ = _link_tables(spark, sf)
    present = L.present_mentions(mentions, vectors)
    return L.rank_vote(LK.vote_scores(present, vectors)).withColumn("score", _r("score"))


@query("rank_vote_text", _LINK_VIEWS, _LINK_CTE + """
, ch AS (SELECT idx, sub, obj, vec_id, distance,
                CASE WHEN obj IS DISTINCT FROM lag(obj) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS change
         FROM dc WINDOW w AS (PARTITION BY idx ORDER BY distance, sub, obj, vec_id)),
rk AS (SELECT *, sum(change) OVER (PARTITION BY idx ORDER BY distance, sub, obj, vec_id ROWS UNBOUNDED PRECEDING) AS r,
              row_number() OVER (PARTITION BY idx ORDER BY distance, sub, obj, vec_id) AS pos FROM ch),
sc AS (SELECT idx, lower(sub) AS entity, sum(1.0 / (r + 1)) AS score, min(pos) AS first FROM rk GROUP BY 1, 2)
SELECT idx, entity AS y_pred, round(score, 4) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, first) AS w FROM sc) t WHERE w = 1
""")
def q_rank_vote_text(spark, sf):
    vectors, mentions, _ = _link_tables(spark, sf)
    present = L.present_mentions(mentions, vectors)
    return L.rank_vote(LK.vote_scores(present, vectors, by="obj")).withColumn("score", _r("score"))


# ---------------------------------------------------------------- metrics --

def _sql_classes(src: str, yt: str = "y_true", yp: str = "y_pred") -> str:
    hit = f"CASE WHEN lower({yt}) = lower({yp}) THEN 1 ELSE 0 END"
    return f"""cls AS (
  SELECT c, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
    SELECT lower({yt}) AS c, {hit} AS tp, 0 AS fp, 1 - {hit} AS fn FROM {src}
    UNION ALL SELECT lower({yp}), 0, 1 - {hit}, 0 FROM {src}) t
  WHERE c IS NOT NULL GROUP BY c),
tot AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cls),
mac AS (SELECT avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) AS macro_precision,
               avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) AS macro_recall,
               avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro_f1 FROM cls)"""


@query("accuracy", ["class_preds"], """
SELECT count(*) AS n, round(avg(CASE WHEN lower(y_true) = lower(y_pred) THEN 1.0 ELSE 0.0 END), 4) AS accuracy
FROM class_preds
""")
def q_accuracy(spark, sf):
    return M.accuracy(load(spark, sf, "class_preds")).select("n", _r("accuracy").alias("accuracy"))


@query("macro_prf", ["class_preds"], "WITH " + _sql_classes("class_preds") + """
SELECT round(macro_precision, 4) AS macro_precision, round(macro_recall, 4) AS macro_recall,
       round(macro_f1, 4) AS macro_f1 FROM mac
""")
def q_macro_prf(spark, sf):
    m = M.metrics(load(spark, sf, "class_preds"))
    return m.select(*[_r(c).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


@query("micro_prf", ["class_preds"], "WITH " + _sql_classes("class_preds") + """
SELECT round(tp / (tp + fp), 4) AS micro_precision, round(tp / (tp + fn), 4) AS micro_recall,
       round(2 * tp / (2 * tp + fp + fn), 4) AS micro_f1 FROM tot
""")
def q_micro_prf(spark, sf):
    m = M.metrics(load(spark, sf, "class_preds"))
    return m.select(*[_r(c).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1")])


def _sql_link_metrics(cte: str) -> str:
    """Both metric series over the evaluated mentions of the linking log."""
    return cte + ", ev AS (SELECT * FROM log WHERE status <> 'Not present'), " + _sql_classes("ev") + ", " \
        + _sql_classes("ev", yp="y_pred_dis").replace("cls AS", "cls2 AS").replace("FROM cls)", "FROM cls2)") \
        .replace("tot AS", "tot2 AS").replace("mac AS", "mac2 AS") + """
SELECT 'plain' AS series, CAST(tot.tp + tot.fn AS BIGINT) AS n, round(tot.tp / (tot.tp + tot.fn), 4) AS accuracy, round(macro_f1, 4) AS macro_f1,
       round(2 * tot.tp / (2 * tot.tp + tot.fp + tot.fn), 4) AS micro_f1 FROM tot, mac
UNION ALL
SELECT 'disambiguated', CAST(tot2.tp + tot2.fn AS BIGINT), round(tot2.tp / (tot2.tp + tot2.fn), 4), round(mac2.macro_f1, 4),
       round(2 * tot2.tp / (2 * tot2.tp + tot2.fp + tot2.fn), 4) FROM tot2, mac2
"""


def _link_metrics(vectors, mentions, disambig):
    log = persist_table(LK.link_mentions(mentions, vectors, disambig).where(F.col("status") != L.STATUS_NOT_PRESENT), "link-log")
    plain = M.metrics(log).withColumn("series", F.lit("plain"))
    dis = M.metrics(log, y_pred="y_pred_dis").withColumn("series", F.lit("disambiguated"))
    return plain.unionByName(dis).select("series", "n", *[_r(c).alias(c) for c in ("accuracy", "macro_f1", "micro_f1")])


@query("link_metrics", _LINK_VIEWS, _sql_link_metrics(_LINK_CTE))
def q_link_metrics(spark, sf):
    return _link_metrics(*_link_tables(spark, sf))


@query("link_metrics_gaps", _LINK_VIEWS, _sql_link_metrics(_LINK_CTE.replace(
    "SELECT * FROM mentions)", """SELECT * FROM mentions
  UNION ALL SELECT -1 - idx, mention, y_true, list_transform(mention_vec, lambda x: 0.0::FLOAT), ctx_vec FROM mentions WHERE idx % 2 = 0)""")))
def q_link_metrics_gaps(spark, sf):
    """Beside the mentions some whose vector is zero: they have no candidate and
    no prediction, and count as errors."""
    vectors, mentions, disambig = _link_tables(spark, sf)
    gaps = mentions.where(F.col("idx") % 2 == 0).withColumn("idx", -1 - F.col("idx")) \
        .withColumn("mention_vec", F.transform("mention_vec", lambda x: F.lit(0.0).cast("float")))
    return _link_metrics(vectors, mentions.unionByName(gaps), disambig)



# ------------------------------------------------------------------ stats --

@query("literals_per_entity", ["literals"], "SELECT s, count(*) AS n_literals FROM literals GROUP BY s")
def q_literals_per_entity(spark, sf):
    return ST.literals_per_entity(load(spark, sf, "literals"))


@query("mean_literals", ["literals"], """
SELECT round(avg(n), 4) AS mean_literals FROM (SELECT s, count(*) AS n FROM literals GROUP BY s) t
""")
def q_mean_literals(spark, sf):
    return ST.mean_literals(ST.literals_per_entity(load(spark, sf, "literals"))) \
        .select(_r("mean_literals").alias("mean_literals"))


@query("literal_stats", ["literals", "preds"], """
WITH c AS (SELECT s, count(*) AS n FROM literals GROUP BY s),
g AS (SELECT 'all' AS grp, n FROM c
      UNION ALL SELECT 'in_sample', n FROM c WHERE s IN (SELECT y_true FROM preds)
      UNION ALL SELECT 'errors', n FROM c WHERE s IN (SELECT y_true FROM preds WHERE lower(y_pred) <> lower(y_true)))
SELECT grp, count(n) AS count, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS stddev,
       min(n) AS min, max(n) AS max FROM g GROUP BY grp
""")
def q_literal_stats(spark, sf):
    lits, preds = load(spark, sf, "literals", "preds")
    c = ST.literals_per_entity(lits)
    errs = preds.where(F.lower("y_pred") != F.lower("y_true")).select(F.col("y_true").alias("s"))
    sample = preds.select(F.col("y_true").alias("s"))
    g = c.withColumn("grp", F.lit("all")).unionByName(TR.restrict_to(c, errs).withColumn("grp", F.lit("errors"))) \
        .unionByName(TR.restrict_to(c, sample).withColumn("grp", F.lit("in_sample")))
    d = ST.describe_literals(g, group="grp")
    return d.select("grp", "count", _r("mean").alias("mean"), _r("stddev").alias("stddev"), "min", "max")


_BUCKETS = """
WITH c AS (SELECT s, count(*) AS n FROM literals GROUP BY s),
r AS (SELECT y_true AS e, CASE WHEN lower(y_pred) <> lower(y_true) THEN 1 ELSE 0 END AS err FROM preds)
"""


@query("accuracy_by_literal_count", ["literals", "preds"], _BUCKETS + """
SELECT least(c.n, 8) AS bucket, count(*) AS total, sum(err) AS errors,
       round((count(*) - sum(err)) / count(*), 4) AS accuracy
FROM (SELECT e, max(err) AS err FROM r GROUP BY e) x JOIN c ON c.s = x.e GROUP BY 1
""")
def q_accuracy_by_literal_count(spark, sf):
    lits, preds = load(spark, sf, "literals", "preds")
    return ST.accuracy_by_literal_count(preds, lits).withColumn("accuracy", _r("accuracy"))


@query("accuracy_by_literal_count_weighted", ["literals", "preds"], _BUCKETS + """
SELECT least(c.n, 8) AS bucket, count(*) AS total, sum(err) AS errors,
       round((count(*) - sum(err)) / count(*), 4) AS accuracy
FROM r JOIN c ON c.s = r.e GROUP BY 1
""")
def q_accuracy_by_literal_count_weighted(spark, sf):
    lits, preds = load(spark, sf, "literals", "preds")
    return ST.accuracy_by_literal_count(preds, lits, weighted=True).withColumn("accuracy", _r("accuracy"))


@query("literal_count_confusion", ["literals", "preds"], """
WITH c AS (SELECT s, count(*) AS n FROM literals GROUP BY s)
SELECT t.n AS true_count, p.n AS pred_count, count(*) AS n
FROM preds x JOIN c t ON t.s = x.y_true JOIN c p ON p.s = x.y_pred
WHERE lower(x.y_pred) <> lower(x.y_true)
GROUP BY 1, 2
""")
def q_literal_count_confusion(spark, sf):
    lits, preds = load(spark, sf, "literals", "preds")
    return ST.literal_count_confusion(preds, lits)


FLAGSHIP = "link_status"


# --------------------------------------------------------------- datasets --

def _scratch(spark, name):
    from entlink.session import scratch_path
    return scratch_path(spark, name)


_CAP = "^[A-Z][a-z]+$"


def conll_from_conversations(spark, sf) -> str:
    """Write CoNLL entity-disambiguation files derived from ``conversations``:
    one document per conversation, one sentence per turn, capitalised words
    as mention tokens. Returns the directory."""
    from entlink.sources.datasets import DOC_MARKER
    c = table(spark, sf, "conversations")
    toks = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    line = lambda t: F.when(t.rlike(_CAP), F.concat_ws(
        "\t", t, F.lit("B"), t, t, F.concat(F.lit("en.wikipedia.org/wiki/"), t), F.lit("000"), F.lit("000"))
    ).otherwise(t)
    block = F.concat(F.array_join(F.transform(toks, lambda t: F.concat(line(t), F.lit("\n"))), ""), F.lit("\n"))
    per_turn = c.select("conv_id", "turn", block.alias("blk"))
    docs = per_turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "blk"))).alias("_b"))
    body = F.array_join(F.transform("_b", lambda x: x["blk"]), "")
    # the writer ends each record with a newline: drop ours so a document ends
    # like in the published files (last sentence, blank line, next marker)
    text = F.concat(F.lit(DOC_MARKER + " (conv_"), F.col("conv_id").cast("string"), F.lit("\n"),
                    F.expr("substring(_body, 1, length(_body) - 1)"))
    path = _scratch(spark, "conll")
    docs.select("conv_id", body.alias("_body")).select(text.alias("value")).write.text(path)
    return path


_CONLL_SQL = """
WITH t AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sid,
         list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS tk FROM conversations)
"""


@query("conll_documents", [], _CONLL_SQL + """
SELECT ' (conv_' || conv_id AS doc_key,
       string_agg(array_to_string(list_transform(tk, lambda x: x || ' '), ''), '' ORDER BY turn) AS text
FROM t GROUP BY conv_id
""")
def q_conll_documents(spark, sf):
    from entlink.sources.datasets import read_conll
    return read_conll(spark, conll_from_conversations(spark, sf))[2].drop("file", "record")


@query("conll_sentences", [], _CONLL_SQL + """
SELECT ' (conv_' || conv_id AS doc_key, sid, array_to_string(list_transform(tk, lambda x: x || ' '), '') AS text FROM t
UNION ALL
SELECT ' (conv_' || conv_id, count(*), '' FROM t GROUP BY conv_id
""")
def q_conll_sentences(spark, sf):
    from entlink.sources.datasets import read_conll
    return read_conll(spark, conll_from_conversations(spark, sf))[0].drop("file", "record")


@query("conll_mentions", [], _CONLL_SQL + """
SELECT ' (conv_' || conv_id AS doc_key, sid, label, 'http://dbpedia.org/resource/' || label AS uri, min(p) AS m_pos
FROM (SELECT conv_id, sid, unnest(tk) AS label, generate_subscripts(tk, 1) - 1 AS p FROM t) u
WHERE regexp_matches(label, '^[A-Z][a-z]+$')
GROUP BY 1, 2, 3, 4
""")
def q_conll_mentions(spark, sf):
    from entlink.sources.datasets import read_conll
    return read_conll(spark, conll_from_conversations(spark, sf))[1].drop("file", "record")


FILE_ITEMS = 500   # items per generated JSON dataset file

_QALD_PREFIXES = ("PREFIX kg: <http://kg.example/> "
                  "PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> ")


def qald_from_parts(spark, sf) -> str:
    """Raw QALD files derived from ``part``: one multilingual question per
    part, grouped into a few JSON documents ``{"questions": [...]}``."""
    p = table(spark, sf, "part")
    sparql = F.concat(F.lit(_QALD_PREFIXES + 'SELECT ?x WHERE { ?x rdfs:label "'), F.col("p_name"),
                      F.lit('" . ?x kg:brand "'), F.col("p_brand"), F.lit('" }'))
    q = F.struct(F.col("p_partkey").cast("string").alias("id"),
                 F.array(F.struct(F.lit("fr").alias("language"), F.col("p_type").alias("string")),
                         F.struct(F.lit("en").alias("language"),
                                  F.concat(F.lit("Which parts are named "), F.col("p_name"), F.lit("?"))
                                  .alias("string"))).alias("question"),
                 F.struct(sparql.alias("sparql")).alias("query"))
    # one JSON document per id range of FILE_ITEMS questions: bounded group size
    g = p.select(F.floor(F.col("p_partkey") / FILE_ITEMS).alias("bucket"), q.alias("q")).groupBy("bucket") \
        .agg(F.to_json(F.struct(F.collect_list("q").alias("questions"))).alias("value"))
    path = _scratch(spark, "qald")
    g.write.partitionBy("bucket").text(path)
    return path


@query("qald_ingest", [], r"""
SELECT 'Which parts are named ' || p_name || '?' AS question, CAST(p_partkey AS VARCHAR) AS id,
       regexp_replace(
         replace(replace(regexp_replace(sq, 'PREFIX\s+\w+:\s+<[^>]+> ', '', 'g'),
                         'kg:', 'http://kg.example/'), 'rdfs:', 'http://www.w3.org/2000/01/rdf-schema#'),
         '((?:(?:https?|ftp):\/\/)?[\w/\-?=%.]+\.[\w/\-&?=%:#]+)', '<\1>', 'g') AS sparql_query
FROM (SELECT *, 'PREFIX kg: <http://kg.example/> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> '
                || 'SELECT ?x WHERE { ?x rdfs:label "' || p_name || '" . ?x kg:brand "' || p_brand || '" }' AS sq
      FROM part) t
""")
def q_qald_ingest(spark, sf):
    from entlink.sources.datasets import ingest_qald
    return ingest_qald(spark, qald_from_parts(spark, sf)).select("question", "id", "sparql_query")


def qa_from_documents(spark, sf) -> str:
    """Annotated question files (JSON arrays) derived from ``documents``:
    question = the whole text, entity mapping = its capitalised words."""
    d = table(spark, sf, "documents")
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike(_CAP))
    item = F.struct(F.col("text").alias("question"), F.col("doc_id").cast("string").alias("id"),
                    F.lit("").alias("sparql_query"),
                    F.transform(words, lambda w: F.struct(w.alias("label"), F.concat(
                        F.lit("http://dbpedia.org/resource/"), w).alias("uri"))).alias("entity mapping"),
                    F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("uri"))).alias("predicate mapping"))
    g = d.select(F.floor(F.col("doc_id") / FILE_ITEMS).alias("bucket"), item.alias("it")).groupBy("bucket") \
        .agg(F.to_json(F.collect_list("it")).alias("value"))
    path = _scratch(spark, "qa")
    g.write.partitionBy("bucket").text(path)
    return path


@query("qa_mentions", [], r"""
SELECT CAST(doc_id AS VARCHAR) AS id, m_pos, label, 'http://dbpedia.org/resource/' || label AS uri FROM (
  SELECT doc_id, unnest(w) AS label, generate_subscripts(w, 1) - 1 AS m_pos FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '^[A-Z][a-z]+$')) AS w
    FROM documents) t) u
""")
def q_qa_mentions(spark, sf):
    from entlink.sources.datasets import read_qa
    return read_qa(spark, qa_from_documents(spark, sf))[1]


@query("eval_log_parse", ["preds", "disambig"], _NBR_CTE + """
SELECT p.idx, p.y_true, p.y_pred,
       CASE WHEN lower(p.y_pred) = lower(p.y_true) THEN 'Correct'
            WHEN n.y_true IS NOT NULL THEN 'Disambiguated' ELSE 'Error' END AS status
FROM preds p
LEFT JOIN (SELECT DISTINCT y_true, lower(e) AS e FROM nbr) n ON n.y_true = p.y_true AND n.e = lower(p.y_pred)
""")
def q_eval_log_parse(spark, sf):
    from entlink.sources.datasets import eval_log_lines, read_eval_log
    preds, disambig = load(spark, sf, "preds", "disambig")
    log = L.apply_disambiguation(preds, disambig)
    path = _scratch(spark, "evallog")
    eval_log_lines(log, "fixture_setting").orderBy("_h", "_order").select("value").write.text(path)
    return read_eval_log(spark, path).select("idx", "y_true", "y_pred", "status")


# ------------------------------------------------------------ sinks, i/o --

@query("triples_csv_roundtrip", ["literals"], "SELECT * FROM literals")
def q_triples_csv_roundtrip(spark, sf):
    from entlink.sinks.stage import write_triples_csv
    path = _scratch(spark, "triples-csv")
    write_triples_csv(TR.literals(_parsed(spark, sf)), path)
    return rdf.read_triples_csv(spark, path)


@query("embeddings_json_roundtrip", ["emb_literals"], """
SELECT s, p, o, typeObject, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total
FROM emb_literals
""")
def q_embeddings_json_roundtrip(spark, sf):
    from entlink.sinks.stage import write_embeddings
    path = _scratch(spark, "emb-json")
    write_embeddings(load(spark, sf, "emb_literals").select("s", "p", "o", "typeObject", "embedding"), path, "json")
    e = rdf.read_embeddings(spark, path, "json")
    return e.select("s", "p", "o", "typeObject", F.size("embedding").alias("dims"),
                    _r(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x))
                    .alias("total"))


@query("stage_once", ["literals"], "SELECT s, p, o, 1 AS writes FROM literals")
def q_stage_once(spark, sf):
    from entlink.sinks.stage import materialize
    path = _scratch(spark, "stage")
    lits = load(spark, sf, "literals")
    first, w1 = materialize(spark, lambda: lits, path)
    second, w2 = materialize(spark, lambda: lits, path)   # already complete: no write
    return second.withColumn("writes", F.lit(int(w1) + int(w2)))


DUMP_SPLIT = 8 << 20   # bytes of a compressed file in one task: its lines take far more, and all their time


def dump_files(spark, sf) -> list[str]:
    """N-Triples dump files derived from the driver tables: the KG lines, and
    a disambiguation dump whose path names it as such."""
    kg, dis = load(spark, sf, "kg_lines", "disambig")
    base = _scratch(spark, "dump")
    with split_bytes(spark, DUMP_SPLIT):
        kg.write.option("compression", "bzip2").text(base + "/kg_en")
    dis.select(F.concat(F.lit("<"), "s", F.lit("> <http://kg.example/disambiguates> <"), "o", F.lit("> ."))
               .alias("value")).write.text(base + "/disambiguations_en")
    return [base + "/kg_en", base + "/disambiguations_en"]


@query("ingest_dump", ["literals", "links", "disambig"], """
SELECT 'literal' AS kind, count(*) AS n FROM literals
UNION ALL SELECT 'link', (SELECT count(*) FROM links) + (SELECT count(*) FROM (SELECT DISTINCT * FROM disambig) d)
UNION ALL SELECT 'disambiguation', count(*) FROM (SELECT DISTINCT * FROM disambig) d
""")
def q_ingest_dump(spark, sf):
    # a triple counts once over all files; each split of the dump is read once for all three kinds
    t = rdf.read_ntriples(spark, dump_files(spark, sf))
    from_marked = F.max(F.col("file_path").contains("disambiguation") & F.col("o_iri").isNotNull()).alias("marked")
    with split_bytes(spark, DUMP_SPLIT):
        t = persist_table(t.groupBy("s", "p", "o_iri", "o_lit", "lang", "dtype").agg(from_marked), "dump")
    lits = TR.literals(t).select(F.lit("literal").alias("kind"))
    links = TR.links(t).select(F.lit("link").alias("kind"))
    dis = t.where("marked").select(F.lit("disambiguation").alias("kind"))
    return lits.unionByName(links).unionByName(dis).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- encode --

_HASHED = f"""
WITH l AS (SELECT s, p, o, count(*) OVER (PARTITION BY lower(o)) AS count, {_sql_clean('o', _CLS_ENC)} AS c
           FROM literals WHERE o IS NOT NULL),
l2 AS (SELECT * FROM l WHERE c <> ''),
t AS (SELECT s, p, o, unnest(string_split_regex(lower(c), '[^a-z0-9]+')) AS tok FROM l2),
b AS (SELECT s, p, o, ('0x' || substring(md5(tok), 1, 4))::INT % 64 AS i, count(*) AS n FROM t WHERE tok <> '' GROUP BY ALL),
v AS (SELECT s, p, o, i, n / sqrt(sum(n * n) OVER (PARTITION BY s, p, o)) AS x FROM b)
"""


@query("encode_literals", ["literals"], _HASHED + """
SELECT l2.s, l2.p, l2.c AS o, l2.count, v.i, round(v.x, 4) AS v FROM l2 JOIN v ON v.s = l2.s AND v.p = l2.p AND v.o = l2.o
""")
def q_encode_literals(spark, sf):
    from entlink.plans.encode import encode_literals
    e = encode_literals(load(spark, sf, "literals"))
    return EM.explode_vector(e, ["s", "p", "o", "count"]).where("v <> 0")


@query("encode_entities", ["literals"], _HASHED + """
, e AS (SELECT s, count(*) AS n_rows FROM l2 GROUP BY s),
lab AS (SELECT s, min(struct_pack(p := p, o := o)) AS f FROM l2
        WHERE p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://xmlns.com/foaf/0.1/name') GROUP BY s),
x AS (SELECT e.s, e.n_rows, v.i, sum(v.x) / any_value(e.n_rows) AS mx,
             coalesce(sum(v.x) FILTER (WHERE v.p = lab.f.p AND v.o = lab.f.o), 0) AS lx, any_value(lab.f) IS NOT NULL AS has
      FROM e JOIN v ON v.s = e.s LEFT JOIN lab ON lab.s = e.s GROUP BY e.s, e.n_rows, v.i)
SELECT s, n_rows, i, round(CASE WHEN has AND n_rows > 1 THEN (mx + lx) / 2 ELSE mx END, 4) AS v FROM x
""")
def q_encode_entities(spark, sf):
    from entlink.plans.encode import encode_entities, encode_literals
    ents = encode_entities(encode_literals(load(spark, sf, "literals")))
    return EM.explode_vector(ents, ["s", "n_rows"]).where("v <> 0")


@query("vector_table", ["emb_literals"], """
WITH u AS (
  SELECT s, p, o, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x FROM emb_literals),
m AS (SELECT s, i, avg(x) AS mx, count(*) AS n FROM u GROUP BY s, i),
lab AS (SELECT s, i, x AS lx FROM (
          SELECT u.*, dense_rank() OVER (PARTITION BY s ORDER BY p, o) AS r FROM u
          WHERE p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://xmlns.com/foaf/0.1/name')) t WHERE r = 1),
e AS (SELECT m.s, sum(CASE WHEN lab.lx IS NOT NULL AND m.n > 1 THEN (m.mx + lab.lx) / 2.0 ELSE m.mx END) AS total,
             count(*) AS dims
      FROM m LEFT JOIN lab ON lab.s = m.s AND lab.i = m.i GROUP BY m.s)
SELECT s AS sub, p AS pred, o AS obj, 'L' AS type_obj,
       len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM emb_literals
UNION ALL
SELECT s, NULL, s, 'E', dims, round(total, 4) + 0.0 FROM e
""")
def q_vector_table(spark, sf):
    from entlink.sinks.stage import build_vector_table, shape_vector_rows
    lits = load(spark, sf, "emb_literals").select("s", "p", "o", "typeObject", "embedding")
    ents = EM.entity_embeddings(lits)
    vt = shape_vector_rows(build_vector_table(lits, ents), as_float=False)
    return vt.select("sub", "pred", "obj", "type_obj", F.size("embedding").alias("dims"),
                     _r(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("setting_names", ["literals"], """
SELECT s, n_literals, 'HASH_' || CASE WHEN n_literals % 2 = 0 THEN 'WGT' ELSE 'NotWGT' END || '_AVG_Top'
       || CASE WHEN n_literals % 3 = 0 THEN 'None' ELSE n_literals || CASE WHEN n_literals % 3 = 1 THEN 'Grouped' ELSE 'Simple' END END
       || '_Cont' || CASE WHEN n_literals % 4 = 0 THEN 'WithMention' ELSE 'WithoutMention' END || '_' || s AS setting
FROM (SELECT s, count(*) AS n_literals FROM literals GROUP BY s) c
""")
def q_setting_names(spark, sf):
    """C14 over settings that follow from the number of an entity's literals."""
    c = ST.literals_per_entity(load(spark, sf, "literals"))
    n = F.col("n_literals")
    name = TX.setting_name(F.lit("HASH"), n % 2 == 0, F.lit("AVG"), F.when(n % 3 != 0, n), F.when(n % 3 == 1, "GROUPED").otherwise("SIMPLE"),
                           n % 4 == 0, F.col("s"))
    return c.select("s", "n_literals", name.alias("setting"))


@query("vectors_published", ["vectors"], """
SELECT sub, pred, obj, type_obj, vec_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM vectors
""")
def q_vectors_published(spark, sf):
    """K6: the table is loaded in two runs, and each of them runs again."""
    from entlink.sinks.stage import published, write_vectors
    v = load(spark, sf, "vectors")
    target = _scratch(spark, "vectors-published")
    for run in ("even", "odd", "even", "odd"):
        write_vectors(v.where((F.col("vec_id") % 2 == 0) == (run == "even")), target, run_id=run)
    out = published(spark, target)
    return out.select("sub", "pred", "obj", "type_obj", "vec_id", F.size("embedding").alias("dims"),
                      _r(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("eval_outputs", ["preds", "disambig"], _NBR_CTE + """
, st AS (SELECT p.idx, p.y_true, p.y_pred, CASE WHEN lower(p.y_pred) = lower(p.y_true) THEN 'Correct'
                WHEN n.y_true IS NOT NULL THEN 'Disambiguated' ELSE 'Error' END AS status
         FROM preds p LEFT JOIN (SELECT DISTINCT y_true, lower(e) AS e FROM nbr) n ON n.y_true = p.y_true AND n.e = lower(p.y_pred))
SELECT 'log' AS output, status, count(*) AS n, sum(idx)::BIGINT AS total FROM st GROUP BY status
UNION ALL SELECT 'errors', status, count(*), sum(idx)::BIGINT FROM st WHERE status = 'Error' GROUP BY status
UNION ALL SELECT 'disambiguations', status, count(*), sum(idx)::BIGINT FROM st WHERE status = 'Disambiguated' GROUP BY status
UNION ALL SELECT 'results', 'accuracy', count(*), round(10000 * avg(CASE WHEN status = 'Correct' THEN 1.0 ELSE 0.0 END))::BIGINT FROM st
""")
def q_eval_outputs(spark, sf):
    """K7: the outputs of an evaluation, written twice under one run id and read back."""
    from entlink.sinks.stage import published, write_eval
    preds, disambig = load(spark, sf, "preds", "disambig")
    log = L.apply_disambiguation(preds, disambig)
    path = _scratch(spark, "eval-outputs")
    for _ in range(2):
        write_eval(log, M.metrics(preds), path, "fixture")
    parts = [published(spark, f"{path}/{name}").groupBy("status").agg(F.count("*").alias("n"), F.sum("idx").alias("total"))
             .select(F.lit(name).alias("output"), "status", "n", "total") for name in ("log", "errors", "disambiguations")]
    results = published(spark, f"{path}/results").select(F.lit("results").alias("output"), F.lit("accuracy").alias("status"), "n",
                                                         F.round(F.col("accuracy") * 10000).cast("bigint").alias("total"))
    return TR.union_tables([*parts, results])


# --------------------------------------------------------- sample, ivf, ctx --

@query("sample_mentions", ["preds", "literals"], f"""
WITH pr AS (SELECT idx, md5('{L.SAMPLE_SEED}:' || idx) AS h FROM preds WHERE y_true IN (SELECT s FROM literals)),
cut AS (SELECT h, row_number() OVER (ORDER BY h, idx) AS r FROM pr),
last AS (SELECT max(h) AS h FROM cut WHERE r = {L.SAMPLE_SIZE}),
kept AS (SELECT idx, y_true, y_pred FROM preds, last WHERE last.h IS NULL OR md5('{L.SAMPLE_SEED}:' || idx) <= last.h)
SELECT idx, y_true, y_pred, row_number() OVER (ORDER BY idx) - 1 AS position FROM kept
""")
def q_sample_mentions(spark, sf):
    preds, lits = load(spark, sf, "preds", "literals")
    present = preds.join(lits.select(F.col("s").alias("y_true")).distinct(), "y_true", "left_semi")
    s = L.sample_mentions(preds, present)
    return L.with_index(s.select("idx", "y_true", "y_pred"), ["idx"], "position")


@query("ivf_search")
def q_ivf_search(spark, sf):
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    assigned, cents = S.ivf_index(vectors, n_cells=16)
    return S.ivf_search(mentions, assigned, cents, S.TOP_K, probes=10, payload=VEC_PAYLOAD) \
        .withColumn("distance", _r("distance"))


@query("ivf_search_exhaustive", ["vectors", "mentions"], _sql_topk(_COS, 100))
def q_ivf_search_exhaustive(spark, sf):
    """Every cell probed: the same rows as the exact top-k."""
    vectors, mentions = load(spark, sf, "vectors", "mentions")
    assigned, cents = S.ivf_index(vectors, n_cells=16)
    return S.ivf_search(mentions, assigned, cents, S.TOP_K, probes=16, payload=VEC_PAYLOAD) \
        .withColumn("distance", _r("distance"))


@query("ivf_recall", ["vectors", "mentions"], """
SELECT 10 AS probes, (SELECT count(*) FROM vectors) AS n_indexed, (SELECT count(*) FROM mentions) * 10 AS n_exact, true AS recall_reached, true AS cells_balanced
""")
def q_ivf_recall(spark, sf):
    """Blocked search against the exact top 10: every vector is indexed, ten of
    sixteen cells with 30 rows of each give a recall of 0.9 or more, and the
    largest cell is below twice the mean."""
    vectors, mentions, _ = _link_tables(spark, sf)
    assigned, cents = S.ivf_index(vectors, n_cells=16)
    exact = S.cosine_top_k(mentions, vectors, 10, payload=["vec_id"]).select("idx", "vec_id")
    found = S.ivf_search(mentions, assigned, cents, 10, probes=10, payload=["vec_id"], per_cell=S.IVF_PER_CELL)
    hits = exact.join(found.withColumn("hit", F.lit(1)), ["idx", "vec_id"], "left").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_hit"))
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n") < 2 * F.sum("n") / 16)
    return hits.select(F.lit(10).alias("probes"), assigned.agg(F.count_distinct("vec_id")).scalar().alias("n_indexed"), "n_exact",
                       (F.col("n_hit") >= 0.9 * F.col("n_exact")).alias("recall_reached"), sizes.scalar().alias("cells_balanced"))


@query("context_sentences", [], _CONLL_SQL + f"""
, docs AS (
  SELECT ' (conv_' || conv_id AS doc_key,
         string_agg(array_to_string(list_transform(tk, lambda x: x || ' '), ''), '' ORDER BY turn) AS text
  FROM t GROUP BY conv_id),
m AS (
  SELECT DISTINCT ' (conv_' || conv_id AS doc_key, sid, label FROM (
    SELECT conv_id, sid, unnest(tk) AS label FROM t) u WHERE regexp_matches(label, '^[A-Z][a-z]+$')),
d AS (SELECT doc_key, {_sql_clean('text', _CLS_EVAL)} AS doc FROM docs)
SELECT m.doc_key, m.sid, m.label, unnest(
  CASE WHEN length(d.doc) > 384 THEN
    list_filter(list_filter(list_transform(regexp_extract_all(d.doc, '[^.!?]+[.!?]*'), lambda x: trim(x)),
                            lambda x: x <> ''),
                lambda x: length(x) >= 3 AND instr(lower(x), lower(m.label)) > 0)
  ELSE [d.doc] END) AS context
FROM m JOIN d ON d.doc_key = m.doc_key
""")
def q_context_sentences(spark, sf):
    from entlink.sources.datasets import read_conll
    _, mentions, docs = read_conll(spark, conll_from_conversations(spark, sf))
    m = mentions.select("doc_key", "sid", F.col("label").alias("mention"))
    ctx = L.context_sentences(m, docs, 384, key="doc_key", mention="mention")
    return ctx.select("doc_key", "sid", F.col("mention").alias("label"), "context")


@query("settings_grid")
def q_settings_grid(spark, sf):
    from entlink.plans.grid import link_grid
    emb, mentions, disambig = load(spark, sf, "emb_literals", "mentions", "disambig")
    g = link_grid(emb, mentions, disambig)
    return g.select("setting", "series", "n", *[_r(c).alias(c) for c in ("accuracy", "macro_f1", "micro_f1")])


_TREE = [("HASH64", "AVG", False, None, None, True, "names"), ("HASH64", "AVG", False, None, None, False, "names"),
         ("HASH64", "AVG", False, None, None, True, "brands"), ("HASH64", "AVG", True, 2, "GROUPED", True, "names"),
         ("HASH64", "CONCAT", False, None, None, True, "names"), ("HASH128", "AVG", False, None, None, True, "names")]
_TREE_NAMES = [f"{e}_{'WGT' if w else 'NotWGT'}_{st}_Top{'None' if n is None else f'{n}{way.title()}'}_Cont{'With' if c else 'Without'}Mention_{d}"
               for e, st, w, n, way, c, d in _TREE]


@query("settings_tree", [], f"""
SELECT setting, series, (SELECT count(*) FROM part) AS n
FROM (SELECT unnest({_TREE_NAMES}) AS setting) AS a CROSS JOIN (SELECT unnest(['plain', 'disambiguated']) AS series) AS b
UNION ALL SELECT * FROM (VALUES ('built', 'literals', 3), ('built', 'vectors', 4), ('built', 'mentions', 4), ('built', 'log', 6), ('built again', 'any', 0)) AS t(setting, series, n)
""")
def q_settings_tree(spark, sf):
    """U5 over the part graph: two encoders, both strategies, two datasets. Each
    shared stage is built once, and a second run of the grid builds none."""
    from entlink.plans.stages import Encoder, TreeSetting, link_tree
    lits, disambig = load(spark, sf, "literals", "disambig")
    part = table(spark, sf, "part")
    uri = F.concat(F.lit("http://kg.example/part/"), F.col("p_partkey").cast("string"))
    text = {"names": ("p_name", "p_type"), "brands": ("p_brand", "p_name")}
    datasets = {d: part.select(F.col("p_partkey").alias("idx"), F.col(m).alias("label"), uri.alias("uri"), F.col(q).alias("question")) for d, (m, q) in text.items()}
    settings = [TreeSetting(e, d, st, w, n, way, c) for e, st, w, n, way, c, d in _TREE]
    store = _scratch(spark, "settings-tree")
    grid = lambda: link_tree(lits, datasets, disambig, settings, [Encoder("HASH64", 64), Encoder("HASH128", 128)], store, sf)
    (_, built), (metrics, again) = grid(), grid()
    counts = [("built", k, built.count(k)) for k in ("literals", "vectors", "mentions", "log")] + [("built again", "any", len(again))]
    return metrics.select("setting", "series", "n").unionByName(spark.createDataFrame(counts, "setting string, series string, n long"))


@query("triples_by_count", ["literals"], """
SELECT s, count(*) AS n_literals FROM literals GROUP BY s
UNION ALL
SELECT s, count(*) FROM literals WHERE p = 'http://www.w3.org/2000/01/rdf-schema#label' GROUP BY s
""")
def q_triples_by_count(spark, sf):
    lits = load(spark, sf, "literals")
    parts = [ST.literals_per_entity(lits),
             ST.literals_per_entity(lits.where(F.col("p") == _LABEL))]
    return ST.order_by_literal_count(TR.union_tables(parts), descending=True)


@query("concat_embedding", ["literals"], """
WITH r AS (SELECT s, p, o, row_number() OVER (PARTITION BY s ORDER BY p, o) AS pos FROM literals),
lab AS (SELECT s, min(pos) AS lpos FROM r
        WHERE p IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://xmlns.com/foaf/0.1/name') GROUP BY s),
txt AS (SELECT r.s, string_agg(CASE WHEN r.pos = lab.lpos THEN regexp_replace(o, '\r?@en .', '', 'g')
                            ELSE regexp_replace(o, '\r?@en .', '', 'g') || '. ' END, '' ORDER BY r.pos) AS text,
       max(CASE WHEN r.pos = lab.lpos THEN regexp_replace(o, '\r?@en .', '', 'g') END) AS label
  FROM r LEFT JOIN lab ON lab.s = r.s GROUP BY r.s),
tok AS (SELECT s, label IS NOT NULL AS has, false AS lab, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS t FROM txt
        UNION ALL SELECT s, true, true, unnest(string_split_regex(lower(label), '[^a-z0-9]+')) FROM txt WHERE label IS NOT NULL),
b AS (SELECT s, has, lab, ('0x' || substring(md5(t), 1, 4))::INT % 64 AS i, count(*) AS n FROM tok WHERE t <> '' GROUP BY ALL),
x AS (SELECT s, has, lab, i, n / sqrt(sum(n * n) OVER (PARTITION BY s, lab)) AS v FROM b)
SELECT s, i, round(sum(v) / CASE WHEN has THEN 2 ELSE 1 END, 4) AS v FROM x GROUP BY s, has, i
""")
def q_concat_embedding(spark, sf):
    from entlink.plans.encode import encode_concat
    return EM.explode_vector(encode_concat(load(spark, sf, "literals")), ["s"]).where("v <> 0")


def _word_kg(spark, sf):
    """A small KG derived from ``conversations``: one entity per distinct
    capitalised word, with the word as its label literal."""
    c = table(spark, sf, "conversations")
    w = c.select(F.explode(F.filter(F.split("text", r"\s+"), lambda x: x.rlike(_CAP))).alias("w")).distinct()
    return w.select(F.concat(F.lit("http://dbpedia.org/resource/"), "w").alias("s"),
                    F.lit(_LABEL).alias("p"), F.col("w").alias("o"))


def qa_from_conversations(spark, sf) -> str:
    """Annotated question files derived from ``conversations``: every turn is a
    question, its capitalised words are the entity mapping."""
    c = table(spark, sf, "conversations")
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike(_CAP))
    item = F.struct(F.col("text").alias("question"),
                    F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
                    F.lit("").alias("sparql_query"),
                    F.transform(words, lambda w: F.struct(w.alias("label"), F.concat(
                        F.lit("http://dbpedia.org/resource/"), w).alias("uri"))).alias("entity mapping"),
                    F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("uri"))).alias("predicate mapping"))
    g = c.select(F.floor(F.col("conv_id") / FILE_ITEMS).alias("bucket"), item.alias("it")).groupBy("bucket") \
        .agg(F.to_json(F.collect_list("it")).alias("value"))
    path = _scratch(spark, "qa-conv")
    g.write.partitionBy("bucket").text(path)
    return path


@query("link_qa")
def q_link_qa(spark, sf):
    """U2 -> U3 -> K4 -> U4 over data derived from ``conversations``: encode
    the word KG, build its vector table, link every annotated mention with its
    question as context, and report status counts."""
    from entlink.plans.encode import encode_entities, encode_literals
    from entlink.sinks.stage import build_vector_table, shape_vector_rows
    from entlink.sources.datasets import read_qa
    dim = 512       # 64 buckets don't tell the words apart
    lits = encode_literals(_word_kg(spark, sf), dim=dim)
    vt = shape_vector_rows(build_vector_table(lits.drop("o_raw"), encode_entities(lits)))
    # a stored table (K6), as in use: every scan of it would encode the KG again
    vt = persist_table(vt.withColumn("vec_id", F.xxhash64("sub", "pred", "obj", "type_obj")), "vector-table")
    items, mentions = read_qa(spark, qa_from_conversations(spark, sf))
    m = mentions.join(items.select("id", "question"), "id") \
        .withColumn("idx", F.xxhash64("id", "m_pos"))
    prepared = LK.prepare_text_mentions(m, dim=dim)
    log = LK.link_mentions(prepared, vt, spark.createDataFrame([], "s string, o string"))
    return M.status_counts(log)
