"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy is trained from confirmed toxic texts and from
unlabelled texts, none of which is taken to be clean: the risk of calling
unlabelled texts toxic is corrected by the share ``prior`` that is, and kept
from turning negative, which overfitting would do. Features are the words, and
beginnings of words, whose document frequencies differ most between the two
samples; beginnings also meet forms of a word that no sample has.

Frequencies are counted over all rows that may be learned from. The classifier
is fitted to samples that are bounded by parameters (``MAX_POSITIVE``,
``MAX_UNLABELLED``, chosen by a hash of the id, one row each): of these only word
numbers, for the chosen words, reach the driver. Every text of the table is
scored, whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import crc_mod, prepare
from entlink.llm.decontam import words_of
from entlink.operators.linking import key_filter, mark_possible
from entlink.session import persist_table

MAX_POSITIVE, MAX_UNLABELLED = 5_000, 20_000
MAX_WORDS = 1_000
#: Distinct words that a task counts before it passes them on.
MEMO_WORDS = 500_000
#: Toxic ids are broadcast up to this size, 16 bytes each.
BROADCAST_BYTES = 32 << 20
#: A word is a feature if its document frequencies differ by this many standard errors.
MIN_Z = 4.0
#: Bytes of the beginnings that count as features too.
BEGINNINGS = (4, 5, 6)
#: Rows whose crc32 of the id leaves this remainder are never learned from.
MOD, HELD_OUT = 4, 2


def features_of(text: str | None) -> set[bytes]:
    """The distinct words, and beginnings of longer ones, marked by a star."""
    words = set(words_of(text))
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in BEGINNINGS))


@dataclass
class Classifier:
    words: list[bytes]
    weights: np.ndarray
    bias: float

    def scorer(self):
        weight = dict(zip(self.words, self.weights.tolist()))
        known = weight.keys()
        return lambda text: 1 / (1 + np.exp(-np.clip(self.bias + sum(weight[w] for w in known & features_of(text)), -40, 40)))


@dataclass
class Learnable:
    """What may be learned from: ``rows`` ``(id, text)``, ``toxic`` the ids with a
    toxic label, how many, and the share of toxic ones among labelled ids."""
    rows: DataFrame
    toxic: DataFrame
    n_toxic: int
    prior: float


def learnable(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Learnable:
    """An id with differing labels counts as toxic; null labels and null ids are no labels."""
    mine = lambda df, c: df.filter(crc_mod(F.col(c), MOD) != HELD_OUT)
    known = mine(labels.select(F.col(id_col).alias("label_id"), F.col("toxic").alias("toxic")).filter("label_id is not null and toxic is not null"), "label_id")
    known = persist_table(known.groupBy("label_id").agg((F.max("toxic") > 0).alias("toxic")), "toxic-labels")
    n, toxic = known.agg(F.count("*"), F.sum(F.col("toxic").cast("int"))).first()
    rows = mine(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    return Learnable(rows, known.filter("toxic").select(F.col("label_id").alias("id")), toxic or 0, (toxic or 0) / n if n else 0.0)


def marked(data: Learnable) -> DataFrame:
    """``(text, positive)`` of all learnable rows. The toxic ids are broadcast up to
    ``BROADCAST_BYTES``; beyond, a Bloom filter of them is, and only rows that
    pass it are shuffled."""
    ids = data.toxic.withColumn("positive", F.lit(True))
    flag = F.coalesce("positive", F.lit(False)).alias("positive")
    if 16 * data.n_toxic <= BROADCAST_BYTES:
        return data.rows.join(F.broadcast(ids), "id", "left").select("text", flag)
    bloom = persist_table(key_filter(data.toxic.select(F.col("id").alias("_k")), data.n_toxic), "toxic-filter")
    rows = mark_possible(data.rows.withColumn("_k", F.col("id")), bloom, data.n_toxic)
    some = rows.filter("_possible").select("id", "text").join(ids, "id", "left").select("text", flag)
    return rows.filter("not _possible").select("text", F.lit(False).alias("positive")).union(some)


def samples(data: Learnable, max_positive: int, max_unlabelled: int) -> DataFrame:
    """``(text, positive)``: one row for each id drawn, so the bounds are bounds on
    rows; of rows that share an id the smallest text."""
    by_hash = F.xxhash64("id")
    chosen = data.toxic.orderBy(by_hash, "id").limit(max_positive).withColumn("positive", F.lit(True))
    count = data.rows.count()
    share = min(1.0, 1.1 * max_unlabelled / max(1, count))
    # as many as wanted in the mean, from the ids' hashes; the limit holds them to the bound
    drawn = data.rows.select("id").filter(F.pmod(by_hash, F.lit(1_000_000)) < int(share * 1_000_000) + 1).distinct().orderBy(by_hash, "id").limit(max_unlabelled)
    ids = persist_table(chosen.union(drawn.withColumn("positive", F.lit(False))), "toxic-sample")
    # at most max_positive + max_unlabelled ids: bounded, so broadcast
    rows = data.rows.join(F.broadcast(ids), "id").groupBy("id", "positive").agg(F.min("text").alias("text"))
    return persist_table(rows.select("text", "positive"), "toxic-texts")


def choose_words(texts: DataFrame, max_words: int, min_z: float) -> list[bytes]:
    """Words whose document frequencies in the positive and the other rows of
    ``texts`` (``(text, positive)``) differ most. A task adds its documents up
    before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array([c[w] for w in words], pa.int64()) for c in (counts[1], counts[0])]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *columns], names=["word", "p", "u"])

        for b in batches:
            for t, p in zip(b.column("text").to_pylist(), b.column("positive").to_pylist()):
                counts[p].update(features_of(t))
            if len(counts[0]) + len(counts[1]) > MEMO_WORDS:
                yield told()
        yield told()

    n = {r["positive"]: r["count"] for r in texts.groupBy("positive").count().collect()}
    p, u = max(1, n.get(True, 0)), max(1, n.get(False, 0))
    counts = texts.mapInArrow(run, "word binary, p bigint, u bigint").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate = (F.col("p") + F.col("u") + 1) / (p + u + 2)
    z = F.abs(F.col("p") / p - F.col("u") / u) / F.sqrt(rate * (1 - rate) * (1 / p + 1 / u))
    return [bytes(r["word"]) for r in counts.withColumn("z", z).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "word").limit(max_words).collect()]


def nnpu(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk
    ``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))`` with the logistic
    loss, by Adam over the whole samples. Where the negative part falls below
    zero, its gradient is turned round, so that the part grows again."""
    x_p, x_u = (np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32) for x in (x_p, x_u))
    w = np.zeros(x_u.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))  # the bias
    mean, square = np.zeros_like(w), np.zeros_like(w)
    shrink = np.full(len(w), decay, np.float32)
    shrink[-1] = 0
    for step in range(1, steps + 1):
        f_p, f_u = x_p @ w, x_u @ w
        s_p, s_u = (1 / (1 + np.exp(-np.clip(f, -40, 40))) for f in (f_p, f_u))
        negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        down = x_u.T @ s_u / len(x_u) - prior * (x_p.T @ s_p) / len(x_p)
        up = prior * (x_p.T @ (s_p - 1)) / len(x_p)
        g = (up + down if negative >= 0 else -down) + shrink * w
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        w = w - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1].astype(float), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS,
          min_z: float = MIN_Z, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier from rows of ``docs`` and ``labels`` that aren't held out.
    Without a toxic label, or nothing but, it gives every text the same score: the prior."""
    prepare(docs.sparkSession)
    data = learnable(docs, labels, id_col, text_col)
    prior = data.prior
    if not 0 < prior < 1:
        return Classifier([], np.zeros(0), 40.0 if prior else -40.0)
    words = choose_words(marked(data), max_words, min_z)
    texts = samples(data, max_positive, max_unlabelled)
    number = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(number[w] for w in number.keys() & features_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column("positive")], names=["words", "positive"])

    parts: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for r in texts.mapInArrow(run, "words array<int>, positive boolean").toLocalIterator():
        row = np.zeros(len(words), np.int8)
        row[r["words"]] = 1
        parts[r["positive"]].append(row)
    if not parts[True] or not parts[False] or not words:
        return Classifier([], np.zeros(0), float(np.log(prior / (1 - prior))))
    # the order in which rows arrive depends on the cluster; theirs by content doesn't
    x_p, x_u = (np.unique(np.array(parts[k]), axis=0, return_counts=True) for k in (True, False))
    w, bias = nnpu(*(np.repeat(rows, n, axis=0) for rows, n in (x_p, x_u)), prior)
    return Classifier(words, w, bias)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row of ``docs``, 0 to 1. Null and empty texts
    have no words: their score is the bias's. Repeated rows each get a row, null
    ids stay null, other columns are not read, an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classifier.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([float(of(t)) for t in b.column("text").to_pylist()], pa.float64())], names=["id", "score"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))
