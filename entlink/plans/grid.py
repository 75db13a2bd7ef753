"""The linking results of a grid of settings, side by side.

A setting = (weighted, top_n, top_n_way, context_with_mention). All
vector-table variants (weighting x rarest-literal selection) share one
group-aware candidate pass; both context modes re-rank the same candidates;
metrics are reported per setting name (C14) and series (plain /
disambiguated).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.functions.text import setting_name
from entlink.operators import counting as CT
from entlink.operators import embed as EM
from entlink.operators import linking as L
from entlink.operators import metrics as M
from entlink.plans import link as LK
from entlink.sinks.stage import build_vector_table, shape_vector_rows


@dataclass(frozen=True)
class Setting:
    weighted: bool = False
    top_n: int | None = None
    top_n_way: str | None = None
    context_with_mention: bool = True


def default_settings() -> list[Setting]:
    out = []
    for weighted in (False, True):
        for top in ((None, None), (2, "SIMPLE"), (2, "GROUPED")):
            for ctx in (True, False):
                out.append(Setting(weighted, top[0], top[1], ctx))
    return out


def vector_variant(emb_lits: DataFrame, weighted: bool, top_n: int | None, way: str | None) -> DataFrame:
    """Vector table of one setting from literal vectors ``(s, p, o, typeObject, embedding, ...)``."""
    lits = emb_lits
    if weighted or top_n is not None:
        lits = CT.with_literal_count(lits)
    if weighted:
        lits = EM.weight_by_count(lits)
    if top_n is not None:
        lits = CT.top_n(lits, top_n, way or "SIMPLE", tie_break=[c for c in ("vec_id",) if c in lits.columns])
    ents = EM.entity_embeddings(lits)
    carried = [c for c in ("vec_id",) if c in emb_lits.columns]
    return shape_vector_rows(build_vector_table(lits, ents, keep=carried), as_float=False, keep=carried)


def link_grid(emb_lits: DataFrame, mentions: DataFrame, disambig: DataFrame,
              settings: list[Setting] | None = None, model: str = "HASH", strategy: str = "AVG",
              dataset: str = "fixture", key: str = "idx") -> DataFrame:
    """Metrics per setting and series: ``(setting, series, n, accuracy, ...)``.

    One plan for the whole grid: the vector tables of all variants
    (weighting x rarest-literal selection) are united with a ``_variant``
    column and variant-qualified subjects, the mentions are repeated per
    variant under a composite key, and one group-aware candidate pass serves
    every variant (a mention only meets its own variant's vectors). Both
    context modes re-rank the same candidates; one grouped aggregation
    computes every setting's metrics.
    """
    from entlink.operators.triples import union_tables
    from entlink.session import persist_table
    settings = settings or default_settings()
    spark = emb_lits.sparkSession
    variants = sorted({(s.weighted, s.top_n, s.top_n_way) for s in settings}, key=repr)

    def qual(i: int, c):
        return F.concat(F.lit(f"{i}|"), c)

    vts, ms = [], []
    for i, (weighted, top_n, way) in enumerate(variants):
        vt = vector_variant(emb_lits, weighted, top_n, way)
        vts.append(vt.withColumn("_variant", F.lit(i)).withColumn("sub", qual(i, F.col("sub"))))
        ms.append(mentions.withColumn("_variant", F.lit(i)).withColumn("y_true", qual(i, F.col("y_true")))
                  .withColumn(key, F.struct(F.lit(i).alias("variant"), F.col(key).alias("own"))))
    # written once: every later plan starts from two file scans instead of
    # repeating the variant subplans
    vt_all = persist_table(union_tables(vts), "grid-vectors")
    m_all = persist_table(union_tables(ms), "grid-mentions")
    n = m_all.count()   # bounds the broadcasts of mention-sized data
    present, absent = L.split_present(m_all, vt_all, n_rows=n)
    modes = sorted({st.context_with_mention for st in settings})
    with_ctx = present
    for ctx in modes:
        with_ctx = LK.with_context(with_ctx, ctx).withColumnRenamed("context_vec", f"ctx_{ctx}")
    unq = lambda c: F.regexp_replace(c, r"^[0-9]+\|", "")
    preds = LK.predictions(with_ctx, vt_all, key=key, group="_variant", contexts={f"d_{c}": f"ctx_{c}" for c in modes})
    preds = persist_table(preds, "grid-predictions")
    present = present.withColumn("y_true", unq(F.col("y_true")))
    absent = absent.withColumn("y_true", unq(F.col("y_true")))

    conf_rows = [(variants.index((st.weighted, st.top_n, st.top_n_way)), st.context_with_mention, model,
                  st.weighted, strategy, st.top_n, st.top_n_way, dataset) for st in settings]
    conf = spark.createDataFrame(conf_rows, "_variant int, _ctx boolean, m string, w boolean, st string, "
                                            "n int, way string, d string")
    conf = conf.select("_variant", "_ctx", setting_name("m", "w", "st", "n", "way", "_ctx", "d").alias("setting"))
    logs = []
    for ctx in modes:
        log = LK._finish(present, absent, preds.select(key, unq(F.col(f"d_{ctx}")).alias("y_pred")), disambig, key, n) \
            .where(F.col("status") != L.STATUS_NOT_PRESENT)
        logs.append(log.select(F.col(key)["variant"].alias("_variant"), F.lit(ctx).alias("_ctx"),
                               "y_true", "y_pred", "y_pred_dis"))
    # the settings table has one row per setting (a handful): broadcast
    all_logs = union_tables(logs).join(F.broadcast(conf), ["_variant", "_ctx"])
    long = all_logs.select("setting", F.lit("plain").alias("series"), "y_true", "y_pred") \
        .unionByName(all_logs.select("setting", F.lit("disambiguated").alias("series"), "y_true",
                                     F.col("y_pred_dis").alias("y_pred")))
    return M.metrics(long, group=["setting", "series"])
