"""U4: link all mentions at once.

mentions (idx, mention, y_true, mention_vec, context...) + vector table +
disambiguation links -> eval log ``(idx, y_true, y_pred, y_pred_dis, status)``.

Plan: present / absent split (one scan of the subjects, stored), one staged
query set, cosine top-k (T1), expansion of the hit subjects with both distances
worked out in the scan (T2, T5), gold-recall fallback range search for the
mentions that need it (T3, T4), re-rank by the context distance, disambiguation
forgiveness (G1, G2). Candidates travel as ``(mention, subject, vec_id,
distances)``; no vector of the table is shuffled and no driver loop runs. A
finished log can be given: its mentions are not linked again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.operators import byquery as BQ
from entlink.operators import linking as L
from entlink.operators import search as S
from entlink.session import persist_table

VEC_PAYLOAD = ["sub", "pred", "obj", "type_obj", "vec_id"]


@dataclass
class Found:
    """The parts of a candidate search: mentions with the keys of their distinct
    vectors (``_ck``: mention and context vectors), the rows of their hit
    subjects, the mentions that fall back, and the rows of their range search.
    Rows are ``(_ck, row id..., distance, contexts...)``."""
    mentions: DataFrame
    rows: DataFrame
    back: DataFrame | None = None
    range_rows: DataFrame | None = None


def _prepared(present: DataFrame, vectors: DataFrame, key: str, gold: str, qvec: str, contexts: dict[str, str], group: str | None):
    """The stored mentions with keys of their distinct vectors, the table with its group column named, that name, and the contexts' columns."""
    v = F.col(qvec).cast("array<double>")
    ctx = {n: F.col(c).cast("array<double>").alias(f"_c_{n}") for n, c in contexts.items()}
    gcols = [F.col(group).alias("_grp")] if group else []
    # the key of a distinct vector (and group): 128 bits of hash and the length (null elements have no distance, wherever they stand)
    digest = lambda *vs: F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), *vs)) for seed in (0, 1)], *[F.size(x).cast("string") for x in vs])
    vk = F.concat_ws("|", digest(v), *([F.col(group).cast("string")] if group else []))
    ck = F.concat_ws("|", vk, *[digest(F.col(c).cast("array<double>")) for c in contexts.values()])
    pm = persist_table(present.select(key, gold, *gcols, vk.alias("_vk"), ck.alias("_ck"), v.alias("_v"), *ctx.values()), "mentions")
    vecs = vectors.withColumnRenamed(group, "_grp") if group else vectors
    return pm, vecs, "_grp" if group else None, {n: f"_c_{n}" for n in contexts}


def _by_query(pm: DataFrame, vecs: DataFrame, gq: str | None, k: int, gold_fallback: bool, gold: str, extra: list[str]) -> tuple[BQ.Store, DataFrame, DataFrame]:
    """The stored table, the hit subjects, and the mentions ``(..., _subs, _wide)``: whether the mention falls back."""
    own = S.row_id(vecs)
    store = BQ.stage_store(vecs, list(dict.fromkeys([*own, *extra])), own, group=gq)
    qs = S.stage_queries(pm.select("_vk", "_v", *([gq] if gq else [])).dropDuplicates(["_vk"]), "_vk", "_v", gq)
    hits = S.hit_subjects(qs, vecs, k, group=gq, store=store if BQ.chosen(qs.n, vecs) else None)
    hits = persist_table(hits.withColumnRenamed("_q", "_vk"), "hits")
    reached = F.coalesce(F.array_contains("_subs", F.col(gold)), F.lit(False))
    return store, hits, pm.join(hits, "_vk", "left").withColumn("_wide", ~reached if gold_fallback else F.lit(False))


def _as_queries(rows: DataFrame, name: str, gq: str | None, also: dict[str, str]) -> DataFrame:
    return rows.select(F.col(name).alias("_q"), F.col("_v").alias("_qv"), "_subs", "_wide", *([F.col(gq).cast("string").alias("_g")] if gq else []),
                       *[F.col(c).alias(f"_v_{n}") for n, c in also.items()]).where("_qv is not null")


def find(prepared: tuple, k: int, gold_fallback: bool, gold: str, nearest: int | None = None) -> Found:
    """The search runs once per distinct mention vector, the expansion and the
    range search once per distinct mention and context vectors (mentions of a
    dataset repeat). With ``nearest``, rows that can't be among a mention's first
    so many by context distance may be missing."""
    pm, vecs, gq, also = prepared
    own = S.row_id(vecs)
    qs = S.stage_queries(pm.select("_vk", "_v", *([gq] if gq else [])).dropDuplicates(["_vk"]), "_vk", "_v", gq)
    hits = persist_table(S.hit_subjects(qs, vecs, k, group=gq).withColumnRenamed("_q", "_vk"), "hits")
    queries = pm.dropDuplicates(["_ck"]).join(hits, "_vk").select(F.col("_ck").alias("_q"), F.col("_v").alias("_qv"), "_subs", *also.values())
    rows = S.expand(queries, vecs, own, also, key="_ck", nearest=nearest)
    if not gold_fallback:
        return Found(pm, rows)
    reached = F.coalesce(F.array_contains("_subs", F.col(gold)), F.lit(False))
    need = persist_table(pm.join(hits, "_vk", "left").where(~reached).drop("_subs"), "fallback")
    qs2 = S.stage_queries(need.dropDuplicates(["_ck"]), "_ck", "_v", gq, {f"_v_{n}": F.col(c) for n, c in also.items()})
    if qs2.n == 0:
        return Found(pm, rows)
    return Found(pm, rows, need, S.range_search(qs2, vecs, key="_ck", payload=own, also=also, group=gq))


def candidates_with_fallback(present: DataFrame, vectors: DataFrame, k: int = S.TOP_K,
                             gold_fallback: bool = True, key: str = "idx", gold: str = "y_true",
                             qvec: str = "mention_vec", contexts: dict[str, str] | None = None,
                             group: str | None = None, nearest: int | None = None, payload: list[str] | None = None) -> DataFrame:
    """T2 + T4 + T11: candidate rows ``(idx, row id..., distance, contexts...)``.

    ``contexts`` maps result columns to vector columns of ``present``: each is
    the L2 distance of the candidate to that vector. The payload of a row is
    joined after the candidates have been cut (``search.with_payload``). When
    ``gold_fallback`` is on (reference behaviour; it reads the gold answer) a
    mention whose gold URI (exact case) is not among its candidate subjects also
    gets the range-search rows (distance < 1.0, nearest 10,000), united without
    duplicates. A mention without candidates has no row. ``nearest``: see ``find``.
    Many mentions are searched by query (``byquery``): a mention's rows arise in one
    task, with the columns ``payload`` where given, and none is shuffled.
    """
    own, contexts = S.row_id(vectors), contexts or {}
    pm, vecs, gq, also = _prepared(present, vectors, key, gold, qvec, contexts, group)
    n = pm.count()
    if BQ.chosen(n, vectors):
        payload = list(dict.fromkeys([*own, *(payload or [])]))
        store, _, rows = _by_query(pm, vecs, gq, k, gold_fallback, gold, payload)
        # of equal mentions that fall back one counts: their rows are united without duplicates
        rows = rows.withColumn("_copy", F.when(F.col("_wide"), -1).otherwise(F.monotonically_increasing_id())).dropDuplicates([key, "_ck", "_copy"])
        cands = BQ.candidate_rows(_as_queries(rows, key, gq, also), n, store, pm.schema[key].dataType, payload, also, nearest, own=tuple(own))
        return cands.withColumnRenamed("_q", key).select(key, *payload, "distance", *contexts)
    found = find((pm, vecs, gq, also), k, gold_fallback, gold, nearest)
    cols = [key, *own, "distance", *contexts]
    if found.back is None:
        return found.mentions.select(key, "_ck").join(found.rows, "_ck").select(*cols)
    rows = persist_table(found.rows, "candidates")
    cands = found.mentions.select(key, "_ck").join(rows, "_ck").select(*cols)
    extra = found.back.select(key, "_ck").join(found.range_rows, "_ck").select(*cols)
    # union distinct on the row identity (mention and row); distances are equal. Only the mentions
    # that fall back are de-duplicated: another mention's gold doesn't change a mention's candidates.
    back = found.back.select(key)
    both = cands.join(back, key, "left_semi").unionByName(extra).dropDuplicates([key, *own])
    return cands.join(back, key, "left_anti").unionByName(both)


def vote_scores(present: DataFrame, vectors: DataFrame, by: str = "distance", k: int = S.TOP_K, gold_fallback: bool = True,
                key: str = "idx", gold: str = "y_true", qvec: str = "mention_vec") -> DataFrame:
    """The ``linking.vote_scores`` of each mention's candidates (T2 + T4 + T11).

    A mention's candidates are most of a table whose entities are few, so their number
    grows with mentions times vectors. Many mentions are searched by query: a mention's
    candidates arise in one task, which ranks them there, and only the scores of its
    entities leave it. The table is stored with its entities and texts as numbers, and
    its rows numbered in the order that breaks ties."""
    pm, vecs, gq, also = _prepared(present, vectors, key, gold, qvec, {}, None)
    n = pm.count()
    # mentions of one key are ranked together
    if not BQ.chosen(n, vectors) or pm.agg(F.count_distinct(key)).first()[0] < n:
        payload = [c for c in VEC_PAYLOAD if c in vectors.columns]
        return L.vote_scores(S.with_payload(candidates_with_fallback(present, vectors, k, gold_fallback, key, gold, qvec, payload=payload), vectors, payload), key, by)
    ties = [F.col(c).asc() for c in ("sub", "obj", "vec_id") if c in vecs.columns]
    vecs = persist_table(vecs.orderBy(*ties).withColumn("_place", F.monotonically_increasing_id()), "vectors-placed")
    entities = _numbered(vecs.select(F.lower("sub").alias("entity")), "_entity")
    vecs = vecs.join(entities, F.lower("sub").eqNullSafe(F.col("entity"))).drop("entity")
    if by != "distance":
        texts = _numbered(vecs.select(F.col(by).alias("_text")), "_by")
        vecs = vecs.join(texts, F.col(by).eqNullSafe(F.col("_text"))).drop("_text")
    payload = ["_place", "_entity", *(["_by"] if by != "distance" else [])]
    store, _, rows = _by_query(pm, vecs, gq, k, gold_fallback, gold, payload)
    scores = BQ.candidate_rows(_as_queries(rows, key, gq, also), n, store, pm.schema[key].dataType, payload, also,
                               own=tuple(S.row_id(vectors)), votes="_by" if by != "distance" else by)
    return scores.join(entities, "_entity").select(F.col("_q").alias(key), "entity", "score", "_first")


def _numbered(values: DataFrame, name: str) -> DataFrame:
    """The distinct values of a column, each with a number of its own, stored."""
    return persist_table(values.distinct().withColumn(name, F.monotonically_increasing_id()), name.strip("_"))


def predictions(present: DataFrame, vectors: DataFrame, k: int = S.TOP_K, gold_fallback: bool = True, key: str = "idx",
                gold: str = "y_true", qvec: str = "mention_vec", contexts: dict[str, str] | None = None,
                group: str | None = None) -> DataFrame:
    """T5: ``(idx, <context>...)``, for each of ``contexts`` the subject of the
    candidate nearest to it, null without candidates. Candidates are cut where
    they arise: a task returns each query's nearest row, the nearest of all tasks
    is one row for each distinct vector, and only that meets the mentions."""
    contexts = contexts or {}
    pm, vecs, gq, also = _prepared(present, vectors, key, gold, qvec, contexts, group)
    n = pm.agg(F.count_distinct("_ck")).first()[0]
    if BQ.chosen(n, vectors):
        return _predictions_by_query(pm, vecs, gq, also, n, k, gold_fallback, key, gold)
    found = find((pm, vecs, gq, also), k, gold_fallback, gold, nearest=1)
    tie = [c for c in ("distance", "sub", "pred", "obj", "vec_id") if c in found.rows.columns]
    best = lambda rows, mark: rows.groupBy("_ck").agg(*[F.min(F.struct(n, *tie)).alias(f"{mark}{n}") for n in contexts])
    out = found.mentions.select(key, "_ck").join(best(found.rows, "_a_"), "_ck", "left")
    if found.back is None:
        return out.select(key, *[F.col(f"_a_{n}")["sub"].alias(n) for n in contexts])
    wide = found.back.select(key, "_ck").join(best(found.range_rows, "_b_"), "_ck").drop("_ck")
    return out.join(wide, key, "left").select(key, *[F.least(f"_a_{n}", f"_b_{n}")["sub"].alias(n) for n in contexts])


def _predictions_by_query(pm: DataFrame, vecs: DataFrame, gq: str | None, also: dict[str, str], n: int, k: int, gold_fallback: bool,
                          key: str, gold: str) -> DataFrame:
    """``predictions`` for many mentions: a distinct mention vector meets the table in one task,
    which returns the row nearest to each context of its mentions (``byquery.nearest_rows``).
    Subjects and mention vectors are stored once for each distinct vector: beside each mention
    there are only its contexts."""
    own = S.row_id(vecs)
    store = BQ.stage_store(vecs, own, own, group=gq)
    qs = S.stage_queries(pm.select("_vk", "_v", *([gq] if gq else [])).dropDuplicates(["_vk"]), "_vk", "_v", gq)
    hits = persist_table(S.hit_subjects(qs, vecs, k, group=gq, store=store if BQ.chosen(qs.n, vecs) else None), "hits")
    flags = pm.select(key, "_vk", "_ck", F.col(gold).alias("_gold"))
    if gold_fallback:
        reached = hits.select(F.col("_q").alias("_hit"), F.explode("_subs").alias("_sub"))
        flags = flags.join(reached, (F.col("_vk") == F.col("_hit")) & (F.col("_gold") == F.col("_sub")), "left").withColumn("_wide", F.col("_hit").isNull())
    else:
        flags = flags.withColumn("_wide", F.lit(False))
    flags = persist_table(flags.select(key, "_vk", "_ck", "_wide"), "fallback")
    ranged = flags.groupBy(F.col("_vk").alias("_q")).agg(F.bool_or("_wide").alias("_far"))
    path = BQ.stage_vectors(qs.df(vecs.sparkSession).join(hits, "_q", "left").join(ranged, "_q").withColumnRenamed("_q", "_vk"))
    queries = pm.where("_v is not null").select(F.col("_ck").alias("_q"), "_vk", *([F.col(gq).cast("string").alias("_g")] if gq else []),
                                                *[F.col(c).alias(f"_v_{name}") for name, c in also.items()])
    cands = BQ.nearest_rows(queries, n, qs.dim, store, path, pm.schema["_ck"].dataType, list(also), own)
    tie = [c for c in ("distance", "sub", "pred", "obj", "vec_id") if c in cands.columns]
    best = cands.groupBy(F.col("_q").alias("_ck")).agg(*[F.min(F.when((F.col("_range") == far) & F.col(c).isNotNull(), F.struct(c, *tie))).alias(f"{mark}{c}")
                                                         for mark, far in (("_a_", False), ("_b_", True)) for c in also])
    best = persist_table(best, "nearest")
    out = flags.select(key, "_ck").join(best, "_ck", "left")
    found = F.greatest(*[F.col(f"_b_{c}").isNotNull() for c in also], F.lit(False))
    wide = flags.where("_wide").select(key, "_ck").join(best.where(found), "_ck").select(key, *[F.col(f"_b_{c}").alias(f"_w_{c}") for c in also])
    return out.join(wide, key, "left").select(key, *[F.least(f"_a_{c}", f"_w_{c}")["sub"].alias(c) for c in also])


def link_mentions(mentions: DataFrame, vectors: DataFrame, disambig: DataFrame, k: int = S.TOP_K,
                  with_mention: bool = True, gold_fallback: bool = True, key: str = "idx",
                  done: DataFrame | None = None) -> DataFrame:
    """U4: eval log for every mention; absent gold URIs get status 'Not present'.

    ``done``: the log ``(idx, y_true, y_pred, status)`` of an evaluation that
    stopped (as ``read_eval_log`` returns it). Its mentions keep their rows, the
    others are linked, and the result is the log of all. Of equal keys in
    ``done`` one row counts, the smallest by status and prediction; keys that
    are no mention's are left out.

    The mention count (one small action) bounds every broadcast of
    mention-sized data; the vector table is only scanned, never shuffled."""
    log_columns = [key, "y_true", "y_pred", "y_pred_dis", "status"]
    if done is not None:
        first = F.min(F.struct("status", "y_pred", "y_true")).alias("_l")
        old = done.select(F.col(key).cast(mentions.schema[key].dataType).alias(key), "y_true", "y_pred", "status").groupBy(key).agg(first)
        old = persist_table(old.join(mentions.select(key), key, "left_semi").select(key, "_l.*"), "finished-log")
        mentions = mentions.join(old.select(key), key, "left_anti")
        dis = F.when(F.col("status") == L.STATUS_DISAMBIGUATED, F.col("y_true")).otherwise(F.col("y_pred"))
        old = old.withColumn("y_pred_dis", dis).select(*log_columns)
    mentions = persist_table(mentions, "link-mentions")
    n = mentions.count()
    present, absent = L.split_present(mentions, vectors, n_rows=n)
    preds = predictions(with_context(present, with_mention), vectors, k, gold_fallback, key, contexts={"d_ctx": "context_vec"})
    log = _finish(present, absent, preds.withColumnRenamed("d_ctx", "y_pred"), disambig, key, n)
    return log if done is None else log.select(*log_columns).unionByName(old)


def with_context(present: DataFrame, with_mention: bool) -> DataFrame:
    """``context_vec`` of each mention: its own (``prepare_text_mentions``), or C11 of two vectors."""
    return present if "context_vec" in present.columns else L.context_vector(present, with_mention=with_mention)


def _finish(present: DataFrame, absent: DataFrame, preds: DataFrame, disambig: DataFrame, key: str,
            n_rows: int | None = None) -> DataFrame:
    # a present mention without candidates (a zero mention vector) stays, without a prediction: an error
    preds = persist_table(present.select(key, "y_true").join(preds.select(key, "y_pred"), key, "left"), "predictions")
    linked = L.apply_disambiguation(preds, disambig, key, n_rows) \
        .select(key, "y_true", "y_pred", "y_pred_dis", "status")
    missing = absent.select(key, "y_true", F.lit(None).cast("string").alias("y_pred"),
                            F.lit(None).cast("string").alias("y_pred_dis"),
                            F.lit(L.STATUS_NOT_PRESENT).alias("status"))
    return linked.unionByName(missing)


def prepare_text_mentions(mentions: DataFrame, docs: DataFrame | None = None, key: str = "idx",
                          label: str = "label", uri: str = "uri", question: str = "question",
                          doc_key: str = "doc_key", max_len: int = 384, with_mention: bool = True,
                          dim: int | None = None, model_factory=None) -> DataFrame:
    """Gold mentions of a text dataset -> ``(idx, mention, y_true, mention_vec, context_vec)``.

    The mention text is cleaned (evaluation cleaner) and lower-cased before
    encoding. Context: for document datasets the sentences that contain the
    mention (F9; whole document when short), else the cleaned question. The
    context vector is the mean over the mention vector and all context
    vectors (C11), so several contexts are averaged per mention.
    """
    from entlink.functions import encoders as EN
    from entlink.functions.text import clean_eval
    dim = dim or EN.HASH_DIM

    def enc(rows: DataFrame, clean) -> DataFrame:
        """``rows`` (key, ``_t``) with the vectors of their texts: a text is cleaned and encoded once, not for each mention that has it."""
        texts = rows.select(F.col("_t").alias("_text")).distinct().withColumn("_clean", clean("_text"))
        if model_factory is None:
            vecs = EN.hash_embed(texts, ["_text"], "_clean", dim)
        else:
            vecs = EN.model_embed(texts, "_clean", model_factory, dim)
        return rows.join(vecs, F.col("_t").eqNullSafe(F.col("_text"))).select(key, "embedding")

    m = mentions.select(key, F.col(label).alias("mention"), F.col(uri).alias("y_true"),
                        *[c for c in (doc_key, question) if c in mentions.columns])
    # stored once for its three uses, and spread: the texts are few bytes for the work that they make
    m = persist_table(m.repartition(key), "text-mentions")
    mv = enc(m.select(key, F.col("mention").alias("_t")), lambda t: F.lower(clean_eval(t))).select(key, F.col("embedding").alias("mention_vec"))
    if docs is not None:
        # contexts are cleaned with their documents
        cv = enc(L.context_sentences(m.select(key, "mention", doc_key), docs, max_len, key=doc_key).select(key, F.col("context").alias("_t")), F.col)
    else:
        cv = enc(m.select(key, F.col(question).alias("_t")), clean_eval)
    cvec = L.context_vectors(mv.select(key, F.col("mention_vec").alias("embedding")), cv, key,
                             with_mention=with_mention)
    return m.select(key, "mention", "y_true").join(mv, key).join(cvec, key)
