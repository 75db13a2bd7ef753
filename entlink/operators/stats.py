"""Literal statistics for error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's (do not change) --------
TOP_BUCKET = 8  # literal-count buckets 1..7 exact, 8 means ">= 8"
# ---------------------------------------------------------------------------


def literals_per_entity(lits: DataFrame, key: str = "s") -> DataFrame:
    """``(s, n_literals)``."""
    return lits.groupBy(key).agg(F.count(F.lit(1)).alias("n_literals"))


def mean_literals(counts: DataFrame, col: str = "n_literals") -> DataFrame:
    """A10: mean number of literals per entity."""
    return counts.agg(F.avg(col).alias("mean_literals"))


def describe_literals(counts: DataFrame, col: str = "n_literals", group: str | None = None) -> DataFrame:
    """Count, mean, sample stddev, min, max of literals per entity
    (optionally per ``group``, e.g. all / in-sample / error entities)."""
    aggs = [F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("stddev"),
            F.min(col).alias("min"), F.max(col).alias("max")]
    return counts.groupBy(group).agg(*aggs) if group else counts.agg(*aggs)


def _entity_counts(lits: DataFrame) -> DataFrame:
    return literals_per_entity(lits).select(F.col("s").alias("_e"), "n_literals")


def accuracy_by_literal_count(log: DataFrame, lits: DataFrame, weighted: bool = False,
                              y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per literal-count bucket (1..7, 8 = '>= 8') of the gold entity:
    total, errors and accuracy. Unweighted counts distinct entities; weighted
    counts mention occurrences."""
    err = (F.lower(y_pred) != F.lower(y_true)).cast("int")
    rows = log.select(F.col(y_true).alias("_e"), err.alias("_err"))
    if not weighted:
        rows = rows.groupBy("_e").agg(F.max("_err").alias("_err"))
    j = rows.join(_entity_counts(lits), "_e")
    b = j.withColumn("bucket", F.least(F.col("n_literals"), F.lit(TOP_BUCKET)))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), F.sum("_err").alias("errors")) \
        .withColumn("accuracy", (F.col("total") - F.col("errors")) / F.col("total"))


def literal_count_confusion(log: DataFrame, lits: DataFrame, y_true: str = "y_true",
                            y_pred: str = "y_pred") -> DataFrame:
    """For errors, number of (true entity's literal count, predicted
    entity's literal count) pairs, long form ``(true_count, pred_count, n)``."""
    errs = log.where(F.lower(y_pred) != F.lower(y_true)).select(y_true, y_pred)
    c = _entity_counts(lits)
    j = errs.join(c.select(F.col("_e").alias("_t"), F.col("n_literals").alias("true_count")),
                  F.col(y_true) == F.col("_t")) \
        .join(c.select(F.col("_e").alias("_p"), F.col("n_literals").alias("pred_count")),
              F.col(y_pred) == F.col("_p"))
    return j.groupBy("true_count", "pred_count").agg(F.count(F.lit(1)).alias("n"))


def literal_count_matrix(confusion: DataFrame) -> DataFrame:
    """A15, wide form: one row per true count, one column per predicted count."""
    return confusion.groupBy("true_count").pivot("pred_count").agg(F.sum("n")).na.fill(0)


def order_by_literal_count(counts: DataFrame, descending: bool = False, col: str = "n_literals") -> DataFrame:
    """Entities ordered by literal count (then subject), a global range-partitioned sort."""
    c = F.col(col).desc() if descending else F.col(col).asc()
    return counts.orderBy(c, F.col("s").asc())
