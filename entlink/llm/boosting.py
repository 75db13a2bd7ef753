"""Document quality by histogram gradient-boosted trees.

Every text is measured (``STATISTICS``: sizes, shares of kinds of characters,
repetition, entropy); labels are learned from the measurements alone. Trees are
grown level by level from histograms of binned measurements, with the logistic
loss, and then flattened: each tree is a complete binary tree in three arrays,
so a batch of texts walks all trees at once in numpy, one step for each level.

Measuring and scoring are narrow Spark passes over whole texts. The fit reads
one row for each labelled id, ``MAX_ROWS`` at most, chosen by a hash of the id:
that many short arrays are what reaches the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import crc_mod, prepare
from entlink.session import persist_table

#: Bound of the labelled rows that the trees are fitted to.
MAX_ROWS = 20_000
#: Rows whose crc32 of the id leaves this remainder are never learned from.
MOD, HELD_OUT = 4, 2
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.2
#: Smallest sum of second derivatives in a node, and the weights' decay.
MIN_HESSIAN, DECAY = 2.0, 1.0
#: Words in a window of the repetition statistic.
WINDOW = 3

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "spread_word", "longest_word", "mean_line", "upper", "digits", "symbols", "marks", "bangs", "bars",
    "other_punctuation", "beyond_ascii", "distinct_words", "commonest_word", "commonest_pair", "repeated_windows", "repeated_lines", "same_neighbours",
    "ends_marked", "single_letters", "entropy", "distinct_bytes", "longest_run", "links",
)
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&<>", "marks": b".,;:?", "bangs": b"!", "bars": b"|",
          "other_punctuation": b"\"'()+-/=@[\\]^_`{}~"}
_TABLE = np.zeros((len(_KINDS), 256))
for _row, _bytes in zip(_TABLE, _KINDS.values()):
    _row[list(_bytes)] = 1


def statistics_of(text: str | None) -> list[float]:
    """``STATISTICS`` of a whole text; without words all but the first few are 0."""
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, n_lines = len(words), len(lines)
    if not n:
        return [math.log1p(len(data))] + [0.0] * (len(STATISTICS) - 1)
    raw = np.frombuffer(data, np.uint8)
    histogram = np.bincount(raw, minlength=256)
    ink = len(data) - int(histogram[[9, 10, 11, 12, 13, 32]].sum())
    share = histogram[histogram > 0] / len(data)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counted, pairs = Counter(words), Counter(zip(words, words[1:]))
    windows = Counter(zip(*(words[k:] for k in range(WINDOW))))
    changes = np.flatnonzero(np.diff(raw)) if len(raw) > 1 else np.zeros(0, np.int64)
    kinds = _TABLE @ histogram / ink
    return [
        math.log1p(len(data)), math.log1p(n), math.log1p(n_lines), float(sizes.mean()), float(sizes.std()), math.log1p(int(sizes.max())), len(data) / n_lines,
        *kinds.tolist(), int(histogram[128:].sum()) / ink, len(counted) / n, max(counted.values()) / n, max(pairs.values(), default=0) / n,
        sum(c for c in windows.values() if c > 1) / n, 1 - len(set(lines)) / n_lines, sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(w[-1:] in b".,;:!?#*$%&|<>" for w in words) / n, int((sizes == 1).sum()) / n, float(-(share * np.log2(share)).sum()), len(share) / 256,
        math.log1p(int(np.diff(np.concatenate([[-1], changes, [len(raw) - 1]])).max())), (data.count(b"http") + data.count(b"www.")) / n,
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, statistics)`` of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.float64()))], names=["id", "statistics"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("statistics", T.ArrayType(T.DoubleType()))]))


# ---- trees -------------------------------------------------------------------

def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each column at most ``bins - 1`` edges between its values, by quantiles;
    a value belongs to the bin of the edges that are smaller."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        between = (values[1:] + values[:-1]) / 2
        if len(between) >= bins:
            between = np.unique(np.quantile(column, np.arange(1, bins) / bins))
        edges.append(between)
    return edges


@dataclass
class Trees:
    """Node ``i`` of a tree has the children ``2 i + 1`` and, for values above
    ``edge[i]``, ``2 i + 2``; leaves stand in ``leaf`` from left to right. A node
    that wasn't split has an infinite edge."""

    feature: np.ndarray  # (trees, 2 ** depth - 1)
    edge: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.leaf))
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(int(self.leaf.shape[1]).bit_length() - 1 if len(trees) else 0):
            above = x[np.arange(len(x))[:, None], self.feature[trees, node]] > self.edge[trees, node]
            node = 2 * node + 1 + above
        return self.bias + self.leaf[trees, node - self.feature.shape[1]].sum(1) if len(trees) else np.full(len(x), self.bias)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for labels ``y`` (0 or 1), both of which occur."""
    edges = bin_edges(x, bins)
    n, width = x.shape
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    usable = np.array([[b < len(e) for b in range(bins)] for e in edges])
    slot = binned + np.arange(width) * bins
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(y.mean() / (1 - y.mean()))))
    margin = np.full(n, out.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (width * bins) + slot).ravel()
            sums = [np.bincount(cell, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(2) for v in (g, h)]
            (gl, hl), (g_all, h_all) = sums, (s[:, :1, -1:] for s in sums)
            gr, hr = g_all - gl, h_all - hl
            gain = gl ** 2 / (hl + DECAY) + gr ** 2 / (hr + DECAY) - g_all ** 2 / (h_all + DECAY)
            gain = np.where((hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN) & usable, gain, -np.inf).reshape(count, -1)
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(count), best] > 1e-6):
                f, b = divmod(int(best[k]), bins)
                out.feature[t, first + k], out.edge[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.edge[t, node])
        node -= inner
        out.leaf[t] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + DECAY)
        margin += out.leaf[t][node]
    return out


# ---- learning and scoring ------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, label, statistics)``: one row for each labelled id that may be
    learned from, ``max_rows`` at most. An id with differing labels has the
    smallest; where several rows share an id, the smallest statistics count.
    Null ids and null labels are no labels."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    known = known.filter(crc_mod(F.col("id"), MOD) != HELD_OUT).groupBy("id").agg(F.min("label").alias("label"))
    chosen = persist_table(known.orderBy(F.xxhash64("id"), "id").limit(max_rows), "quality-labels")
    # at most max_rows ids and labels: bounded, so broadcast
    ids = F.broadcast(chosen.select(F.col("id").alias("labelled")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("labelled"), "left_semi")
    rows = measured(texts, "id", "text").groupBy("id").agg(F.min("statistics").alias("statistics"))
    return rows.join(F.broadcast(chosen), "id").select("id", (F.col("label") > 0).cast("int").alias("label"), "statistics")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees from rows of ``docs`` and ``labels`` that aren't held out. With
    labels of one kind every text gets that kind's score, without any 0.5."""
    prepare(docs.sparkSession)
    rows = sorted(training_rows(docs, labels, max_rows, id_col, text_col, label_col).collect(), key=lambda r: r["id"])
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0 if not len(y) else 40.0 if y[0] else -40.0)
    return grow(np.array([r["statistics"] for r in rows]), y)


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row of ``docs``, 0 to 1. Null and empty texts are
    scored by their statistics like any other. Repeated rows each get a row, null
    ids stay null, other columns are not read, an empty table gives an empty
    result. One narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics_of(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(trees.score(x), pa.float64())], names=["id", "score"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))
