"""Mention linking.

All mentions are linked at once: candidates come from one distributed kNN
join, re-ranking is a per-mention aggregate, disambiguation forgiveness is a
pair of joins against the (symmetrised) disambiguation edge list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entlink.functions import text as TX
from entlink.functions import vectors as V
from entlink.operators.embed import mean_by_key

# ---- fixed values that must equal the reference's (do not change) --------
SAMPLE_SIZE = 370        # mentions evaluated per dataset (present ones count)
SAMPLE_SEED = 448
ERROR_REPORT_ROWS = 25   # nearest candidates listed for an error
STATUS_CORRECT, STATUS_ERROR = "Correct", "Error"
STATUS_DISAMBIGUATED, STATUS_NOT_PRESENT = "Disambiguated", "Not present"
# ---------------------------------------------------------------------------

BUCKET_BITS = 32768      # bits of one bitmap of bitmap_construct_agg
BLOCK_VALUES = 1024      # URIs of a class in one list (two lists make a row)
MOST_CELL_TASKS = 4096   # tasks that build pairs out of lists


def context_vector(mentions: DataFrame, mention_vec: str = "mention_vec", ctx_vec: str = "ctx_vec",
                   with_mention: bool = True) -> DataFrame:
    """C11 (one context vector per mention): mean(mention, context) or the context alone."""
    v = V.mean_vectors(mention_vec, ctx_vec) if with_mention else F.col(ctx_vec).cast("array<double>")
    return mentions.withColumn("context_vec", v)


def context_vectors(mention_vecs: DataFrame, ctx_rows: DataFrame, key: str = "idx",
                    vec: str = "embedding", with_mention: bool = True) -> DataFrame:
    """C11 (many context vectors): per mention, mean over the mention vector and
    all its context vectors (A2); a mention with no context keeps its own."""
    rows = ctx_rows.select(key, vec)
    if with_mention:
        rows = mention_vecs.select(key, vec).unionByName(rows)
    return mean_by_key(rows, key, vec).select(key, F.col(vec).alias("context_vec"))


def context_sentences(mentions: DataFrame, docs: DataFrame, max_len: int, key: str = "document_key",
                      mention: str = "mention", text: str = "text") -> DataFrame:
    """F9 + J9: context texts of each mention.

    Documents not longer than ``max_len`` are used whole; otherwise the
    sentences of at least 3 chars containing the mention (case-insensitive).
    Returns ``(mention columns..., context)``, one row per context text.
    """
    d = docs.select(F.col(key).alias("_k"), TX.clean_eval(text).alias("_doc"))
    j = mentions.join(d, F.col(key) == F.col("_k"))
    m = F.lower(F.col(mention))
    sents = F.filter(TX.sentences("_doc"), lambda s: (F.length(s) >= 3) & (F.instr(F.lower(s), m) > 0))
    ctx = F.when(F.length("_doc") > max_len, sents).otherwise(F.array("_doc"))
    return j.select(*mentions.columns, F.explode(ctx).alias("context"))


def key_filter(keys: DataFrame, n_rows: int, key: str = "_k") -> DataFrame:
    """A Bloom filter of ``keys`` as an aggregate: ``(bucket, bits)``, for each
    4-KB bucket of a bit table that two hashes of a key set bits in. The table
    has 8 bits for each of ``n_rows`` keys, but at most ``BROADCAST_BYTES``."""
    bits = filter_bits(n_rows)
    places = keys.select(F.explode(F.array(*[_place(key, seed, bits) for seed in (0, 1)])).alias("_x"))
    return places.groupBy(F.floor(F.col("_x") / BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("_x") % BUCKET_BITS).alias("bits"))


def filter_bits(n_rows: int) -> int:
    from entlink.operators.search import BROADCAST_BYTES
    buckets = -(-8 * max(1, n_rows) // BUCKET_BITS)
    return BUCKET_BITS * min(buckets, 8 * BROADCAST_BYTES // BUCKET_BITS)


def _place(key: str, seed: int, bits: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits))


def mark_possible(rows: DataFrame, bloom: DataFrame, n_rows: int, key: str = "_k", mark: str = "_possible") -> DataFrame:
    """``rows`` with a column ``mark``: whether the key passes the filter, which
    all of its own keys do, and about one in twenty others. The filter's size is
    bounded, so it is broadcast and the rows stay where they are."""
    bits = filter_bits(n_rows)
    columns, hits = rows.columns, []
    for seed in (0, 1):
        b = F.broadcast(bloom.select(F.col("bucket").alias(f"_bucket{seed}"), F.col("bits").alias(f"_bits{seed}")))
        at = _place(key, seed, bits)
        rows = rows.join(b, F.floor(at / BUCKET_BITS) == F.col(f"_bucket{seed}"), "left")
        # byte x // 8 of the bucket, bit x % 8
        byte = F.conv(F.hex(F.call_function("substring", F.col(f"_bits{seed}"), (F.floor(at % BUCKET_BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hits.append(F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False)))
    return rows.select(*columns, (hits[0] & hits[1]).alias(mark))


def might_be_in(rows: DataFrame, bloom: DataFrame, n_rows: int, key: str = "_k") -> DataFrame:
    """The rows that pass the filter (``mark_possible``)."""
    return mark_possible(rows, bloom, n_rows, key).where("_possible").drop("_possible")


def _found_keys(mentions: DataFrame, vectors: DataFrame, gold: str, sub: str,
                n_rows: int | None) -> DataFrame:
    """Lower-cased gold URIs that occur as ``lower(sub)``: one scan of the
    subjects alone. Up to a size the mention keys (``n_rows`` at most) are
    broadcast to it; beyond that a Bloom filter of theirs is, and only subjects
    that pass it are shuffled to meet them."""
    from entlink.operators.search import BROADCAST_BYTES, KEY_ROW_BYTES, small
    keys = mentions.select(F.lower(F.col(gold)).alias("_k")).where("_k is not null").distinct()
    subs = vectors.select(F.lower(sub).alias("_k"))
    if n_rows is not None and n_rows * KEY_ROW_BYTES > BROADCAST_BYTES:
        return might_be_in(subs, key_filter(keys, n_rows), n_rows).distinct().join(keys, "_k", "left_semi")
    if n_rows is not None:
        keys = small(keys, n_rows)
    return subs.join(keys, "_k", "left_semi").distinct()


def split_present(mentions: DataFrame, vectors: DataFrame, gold: str = "y_true", sub: str = "sub",
                  n_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """F10 + A16 at once: the mentions whose gold URI (case-insensitive) has rows
    in the vector table, and the others. What the table's one scan found is
    stored, so both halves, and every later use of them, read that."""
    from entlink.operators.search import small
    from entlink.session import persist_table
    found = persist_table(_found_keys(mentions, vectors, gold, sub, n_rows), "present-keys")
    if n_rows is not None:
        found = small(found, n_rows)
    is_found = F.lower(F.col(gold)) == F.col("_k")
    return mentions.join(found, is_found, "left_semi"), mentions.join(found, is_found, "left_anti")


def present_mentions(mentions: DataFrame, vectors: DataFrame, gold: str = "y_true", sub: str = "sub",
                     n_rows: int | None = None) -> DataFrame:
    """mentions whose gold URI (case-insensitive) has rows in the vector table."""
    found = _found_keys(mentions, vectors, gold, sub, n_rows)
    return mentions.join(found, F.lower(F.col(gold)) == F.col("_k"), "left_semi")


def missing_entities(mentions: DataFrame, vectors: DataFrame, gold: str = "y_true", sub: str = "sub",
                     n_rows: int | None = None) -> DataFrame:
    """Mentions whose gold URI is absent from the vector table."""
    found = _found_keys(mentions, vectors, gold, sub, n_rows)
    return mentions.join(found, F.lower(F.col(gold)) == F.col("_k"), "left_anti")


def rerank(cands: DataFrame, key: str = "idx", sub: str = "sub",
           order: tuple[str, ...] = ("d_ctx", "distance", "sub", "pred", "obj", "vec_id")) -> DataFrame:
    """T5: prediction = the candidate nearest to the context; ties go to the
    candidate earlier in the cosine order, then by ``sub``, ``pred``, ``obj``."""
    cols = [c for c in order if c in cands.columns]
    best = F.min_by(F.struct(F.col(sub).alias("y_pred"), F.col("d_ctx").alias("d_ctx")), F.struct(*cols))
    return cands.groupBy(key).agg(best.alias("_b")).select(key, "_b.y_pred", "_b.d_ctx")


def tied_candidates(cands: DataFrame, vectors: DataFrame | None = None, key: str = "idx", type_col: str = "type_obj") -> DataFrame:
    """The leading run of equal context distances per mention: its size and
    how many entity ('E') rows it holds (diagnostic; prediction is unchanged).
    The type is read from ``vectors`` for those rows where candidates don't carry it."""
    from entlink.operators.search import with_payload
    w = Window.partitionBy(key).orderBy(F.col("d_ctx").asc())
    top = cands.withColumn("_r", F.rank().over(w)).where(F.col("_r") == 1)
    if type_col not in top.columns:
        top = with_payload(top, vectors, [type_col])
    return top.groupBy(key).agg(F.count(F.lit(1)).alias("n_tied"),
                                F.count_if(F.col(type_col) == "E").alias("n_tied_entities"))


def error_report(cands: DataFrame, errors: DataFrame, vectors: DataFrame, details: DataFrame | None = None, key: str = "idx",
                 n: int = ERROR_REPORT_ROWS) -> DataFrame:
    """The ``n`` nearest candidates (by context distance) of every error, long
    form ``(idx, details..., y_true, y_pred, rank, sub, obj, d_ctx)``. ``details``
    holds what is to be read beside an error: mention, question or context.

    Candidates are cut first, with ties at the end of the list; then the rows
    that are left get their texts from ``vectors`` and the final order. An error
    without candidates has no row."""
    from entlink.operators.search import with_payload
    c = cands.join(errors.select(key, "y_true", "y_pred"), key)
    near = Window.partitionBy(key).orderBy(F.col("d_ctx").asc(), F.col("distance").asc(), F.col("sub").asc())
    c = c.withColumn("_r", F.rank().over(near)).where(F.col("_r") <= n)
    c = with_payload(c, vectors, [x for x in ("sub", "pred", "obj", "vec_id") if x in vectors.columns])
    last = [F.col(x).asc_nulls_first() for x in ("pred", "obj", "vec_id") if x in c.columns]
    w = Window.partitionBy(key).orderBy(F.col("d_ctx").asc(), F.col("distance").asc(), F.col("sub").asc(), *last)
    c = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    shown = [x for x in (details.columns if details is not None else []) if x != key]
    if details is not None:
        c = c.join(details, key, "left")
    return c.select(key, *shown, "y_true", "y_pred", "rank", "sub", "obj", "d_ctx")


def disambig_neighbourhood(golds: DataFrame, disambig: DataFrame, gold: str = "y_true") -> DataFrame:
    """G1 + J10: ``(y_true, e)`` with ``e`` lower-cased, for
    D = {o : (y,o)} U {s : (s,y)} (exact case) and every neighbour of D
    (case-insensitive) one hop further.

    Gold URIs with the same direct neighbours have the same neighbourhood, so it is
    worked out and made distinct once for each such class. A class's members and its
    neighbourhood are cut into blocks; each pair of blocks is a row, these rows are
    spread over tasks, and the pairs of URIs, whose number grows with the square of a
    page's degree, only arise where they are returned: none is shuffled."""
    from entlink.session import persist_table
    edges = _edges(disambig)
    g = golds.select(F.col(gold).alias("y_true")).distinct()
    d = edges.join(g, F.col("a") == F.col("y_true")).select("y_true", F.lower("b").alias("e")).distinct()
    classes = persist_table(d.groupBy("y_true").agg(
        F.array_sort(F.collect_set("e")).alias("_pages"), F.count_if(F.col("e").isNull()).alias("_null")), "neighbour-classes")
    classes = classes.withColumn("_class", F.sha2(F.to_json(F.struct("_pages", "_null"), {"ignoreNullFields": "false"}), 256))
    per = classes.groupBy("_class").agg(F.first("_pages").alias("_pages"), F.first("_null").alias("_null"))
    near = per.select("_class", F.explode("_pages").alias("e"))
    members = edges.select(F.lower("a").alias("_la"), F.lower("b").alias("_m")).distinct()
    far = near.join(members, F.col("e") == F.col("_la")).select("_class", F.col("_m").alias("e"))
    whole = near.unionByName(far).unionByName(per.where("_null > 0").select("_class", F.lit(None).cast("string").alias("e"))).distinct()
    left = _in_blocks(classes.select("_class", "y_true"), "y_true")
    right = _in_blocks(whole, "e")
    cells = persist_table(left.join(right, "_class").select("_y_true", "_e"), "neighbour-blocks")
    n = cells.count()
    cells = cells.repartition(min(n, MOST_CELL_TASKS)) if n > 1 else cells
    return cells.select(F.explode("_y_true").alias("y_true"), "_e").select("y_true", F.explode("_e").alias("e"))


def _in_blocks(rows: DataFrame, value: str) -> DataFrame:
    """``(_class, _<value>)``: each class's values in lists of about ``BLOCK_VALUES``."""
    sizes = rows.groupBy("_class").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VALUES).alias("_blocks"))
    at = F.pmod(F.xxhash64(value), F.col("_blocks"))
    # a null is a value like any other, which a list of structs keeps
    lists = rows.join(sizes, "_class").groupBy("_class", at.alias("_at")).agg(F.collect_list(F.struct(value)).alias("_l"))
    return lists.select("_class", F.transform("_l", lambda x: x[value]).alias(f"_{value}"))


@dataclass
class Neighbourhood:
    """G1 in factors: ``direct`` has ``(y_true, page)``, the gold URIs' direct
    neighbours, ``members`` ``(page, member)``, the neighbours of those; all but
    ``y_true`` lower-cased, all rows distinct. Together they stand for the
    neighbourhoods of all gold URIs in at most as many rows as edges meet them;
    the product, which grows with the square of a page's degree, is only built by
    ``flat``."""
    direct: DataFrame
    members: DataFrame

    def sizes(self) -> DataFrame:
        """``(y_true, n_direct, n_paths)``: direct neighbours, and ways to a
        member over one of them (an upper bound of the further neighbours)."""
        degree = self.members.groupBy("page").agg(F.count(F.lit(1)).alias("_d"))
        return self.direct.join(degree, "page", "left").groupBy("y_true").agg(
            F.count(F.lit(1)).alias("n_direct"), F.coalesce(F.sum("_d"), F.lit(0)).cast("bigint").alias("n_paths"))

    def contains(self, pairs: DataFrame, gold: str = "y_true", uri: str = "y_pred") -> DataFrame:
        """The rows of ``pairs`` whose URI lies in the neighbourhood of their gold
        URI. A pair meets the pages that its URI is a member of and itself as a
        page, so rows grow with that URI's degree alone."""
        own = pairs.select(F.col(gold).alias("_y"), F.lower(uri).alias("_e")).distinct()
        pages = own.join(self.members, F.col("_e") == F.col("member")).select("_y", "_e", "page") \
            .unionByName(own.select("_y", "_e", F.col("_e").alias("page")))
        hits = pages.join(self.direct, (F.col("_y") == F.col("y_true")) & (pages["page"] == self.direct["page"]), "left_semi").select("_y", "_e").distinct()
        return pairs.join(hits, (F.col(gold) == F.col("_y")) & (F.lower(uri) == F.col("_e")), "left_semi")

    def flat(self) -> DataFrame:
        """``(y_true, e)``: the product of the factors, as ``disambig_neighbourhood``."""
        far = self.direct.join(self.members, "page").select("y_true", F.col("member").alias("e"))
        return self.direct.select("y_true", F.col("page").alias("e")).unionByName(far).distinct()


def neighbourhood(golds: DataFrame, disambig: DataFrame, gold: str = "y_true") -> Neighbourhood:
    """G1 + J10, factorised. Both factors are stored: each is read by several uses."""
    from entlink.session import persist_table
    edges = _edges(disambig).where("a is not null and b is not null")
    g = golds.select(F.col(gold).alias("y_true")).distinct()
    direct = edges.join(g, F.col("a") == F.col("y_true")).select("y_true", F.lower("b").alias("page")).distinct()
    direct = persist_table(direct, "neighbour-pages")
    members = edges.select(F.lower("a").alias("page"), F.lower("b").alias("member")).distinct()
    return Neighbourhood(direct, persist_table(members.join(direct.select("page").distinct(), "page", "left_semi"), "page-members"))


def _edges(disambig: DataFrame) -> DataFrame:
    return disambig.select(F.col("s").alias("a"), F.col("o").alias("b")) \
        .unionByName(disambig.select(F.col("o").alias("a"), F.col("s").alias("b")))


def disambiguated_hits(preds: DataFrame, disambig: DataFrame, key: str = "idx",
                       n_rows: int | None = None) -> DataFrame:
    """G2 core: keys of wrong predictions that lie in the gold URI's
    disambiguation neighbourhood (G1), found without building it.

    ``y_pred`` is in nbr(y) iff some direct neighbour ``e`` of ``y`` (exact
    case) satisfies ``lower(e) = lower(y_pred)``, or ``lower(e) = lower(a)``
    for an edge ``(a, b)`` with ``lower(b) = lower(y_pred)``. So the gold side
    contributes its direct neighbours and the prediction side its own
    neighbours plus itself, and the two meet on ``(key, lower-cased URI)``:
    rows per mention stay at the two degrees instead of the product.
    """
    from entlink.operators.search import small
    e = _edges(disambig)
    p = preds.where(F.lower("y_pred") != F.lower("y_true")).select(key, "y_true", "y_pred")
    if n_rows is not None:
        p = small(p, n_rows)
    gold_side = p.join(e, F.col("y_true") == F.col("a")).select(key, F.lower("b").alias("_k"))
    el = e.select(F.lower("a").alias("_la"), F.lower("b").alias("_lb"))
    pred_side = p.join(el, F.lower(F.col("y_pred")) == F.col("_lb")).select(key, F.col("_la").alias("_k")) \
        .unionByName(p.select(key, F.lower("y_pred").alias("_k")))
    return gold_side.join(pred_side, [key, "_k"], "left_semi").select(key).distinct()


def apply_disambiguation(preds: DataFrame, disambig: DataFrame, key: str = "idx",
                         n_rows: int | None = None) -> DataFrame:
    """Status Correct / Disambiguated / Error and the forgiven prediction
    ``y_pred_dis`` (= ``y_true`` when Disambiguated)."""
    hits = disambiguated_hits(preds, disambig, key, n_rows).withColumn("_hit", F.lit(True))
    j = preds.join(hits, key, "left")
    correct = F.lower("y_pred") == F.lower("y_true")
    status = F.when(correct, F.lit(STATUS_CORRECT)) \
        .when(F.col("_hit"), F.lit(STATUS_DISAMBIGUATED)).otherwise(F.lit(STATUS_ERROR))
    out = j.withColumn("status", status)
    out = out.withColumn("y_pred_dis", F.when(F.col("status") == STATUS_DISAMBIGUATED, F.col("y_true"))
                         .otherwise(F.col("y_pred")))
    return out.drop("_hit")


def vote_scores(cands: DataFrame, key: str = "idx", by: str = "distance", sub: str = "sub") -> DataFrame:
    """G4 (scores): rows are taken in distance order; the rank grows by one wherever
    ``by`` (the distance, or the row's text) differs from the row before; an entity
    scores sum(1 / (rank + 1)) over its rows. Returns ``(key, entity, score, _first)``
    with the place of the entity's first row. Of candidates that a search by query
    finds, ``plans.link.vote_scores`` has the scores without shuffling them."""
    tie = [F.col(c).asc() for c in (sub, "obj", "vec_id") if c in cands.columns]
    w = Window.partitionBy(key).orderBy(F.col("distance").asc(), *tie)
    changed = (F.row_number().over(w) > 1) & ~F.col(by).eqNullSafe(F.lag(by).over(w))
    r = cands.withColumn("_pos", F.row_number().over(w)).withColumn("_change", changed.cast("int"))
    r = r.withColumn("_rank", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, F.lower(sub).alias("entity")).agg(
        F.sum(1.0 / (F.col("_rank") + 1)).alias("score"), F.min("_pos").alias("_first"))


def rank_vote(cands: DataFrame, key: str = "idx", by: str = "distance", sub: str = "sub") -> DataFrame:
    """Reciprocal-rank vote over candidates, or over their ``vote_scores``: the
    best score wins, ties to the entity seen first."""
    per = cands if "score" in cands.columns else vote_scores(cands, key, by, sub)
    best = F.max_by(F.struct("entity", "score"), F.struct("score", -F.col("_first")))
    return per.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.entity").alias("y_pred"),
                                                         F.col("_b.score").alias("score"))


def sample_mentions(mentions: DataFrame, present: DataFrame, n: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED,
                    key: str = "idx") -> DataFrame:
    """Seeded, order-independent shuffle; keep mentions in shuffled order
    until ``n`` present mentions are taken (absent ones met on the way stay).
    With ``n`` present mentions or fewer, all mentions stay."""
    h = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    # position of the n-th present mention in shuffled order, as a scalar subquery
    cut = present.select(h.alias("_h"), F.col(key).alias("_i")).orderBy("_h", "_i").limit(n) \
        .agg(F.when(F.count("*") == n, F.max(F.struct("_h", "_i"))).alias("_c"))
    return mentions.where(F.coalesce(F.struct(h, F.col(key)) <= cut.scalar(), F.lit(True)))


def with_index(df: DataFrame, order_cols: list[str], name: str = "index") -> DataFrame:
    """Dense 0-based index in ``order_cols`` order without a single-task window.

    Range-partitions and sorts, writes the positions to a table in the shared
    checkpoint folder (so they are stable under recomputation), then adds
    per-partition offsets from a tiny (one row per partition) table.
    """
    from entlink.session import persist_table
    s = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols) \
        .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    s = persist_table(s, "with-index")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).select("_pid", "_off")
    out = s.join(F.broadcast(offs), "_pid")
    local = F.col("_mid") - (F.col("_pid").cast("long") * F.lit(1 << 33))
    return out.withColumn(name, F.col("_off") + local).drop("_pid", "_mid", "_off")
