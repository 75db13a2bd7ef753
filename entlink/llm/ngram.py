"""Interpolated modified Kneser-Ney language model on memory-mapped hash arrays.

Counting: every task counts the n-grams of its texts by 64-bit word hashes and
deals the distinct ones out to shards by hash. A shard's task merges them into
arrays sorted by n-gram hash, which it writes to the model folder, and passes on
what the next lower order needs: for each shorter n-gram the number of n-grams
that it ends (continuation counts), and totals of each context. A context's
n-grams spread over ``SPREAD`` shards, so a word that a third of the text
consists of doesn't fill one. The driver gets a row of statistics for each
shard and order.

Scoring: workers map the arrays into memory and look up the n-grams of a batch
of texts at once by binary search; texts are not shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import crc_mod, prepare
from entlink.session import local_path, scratch_path

#: Of the query that the SQL holds, and of the model for production.
ORDER = 2
PRODUCTION_ORDER = 3
#: Bytes of training text for each shard: bounds a merging task's memory.
SHARD_BYTES = 8 << 20
SPREAD = 8
#: Tokens that a counting task counts at once.
CHUNK_TOKENS = 3_000_000
MEMO_WORDS = 500_000
#: Arrays that a worker keeps mapped.
MAX_MAPS = 8192
#: Not words: words hold no white space.
END, BEGIN = b"\n", b"\t"

STAT = [("key", "<u8"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")]
BLOCKS = "shard bigint, kind int, payload binary"
GRAMS, CONTEXTS, STATS = 0, 1, 2


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def tokens_of(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased, and the end."""
    words = text.encode().lower().split() if text else []  # of bytes: ASCII only
    words.append(END)
    return words


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the pair of hashes (splitmix64 steps)."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Hash of word sequences; of none, 0."""
    out = np.zeros(n, np.uint64)
    for c in columns:
        out = mix(out, c)
    return out


def shard_of(context: np.ndarray, key: np.ndarray, shards: int) -> np.ndarray:
    """A context's n-grams go to ``SPREAD`` neighbouring shards, so that a shard
    sums them up before it passes them on. Single words have no context (0): they
    are dealt over all shards."""
    at = np.where(context == 0, key >> np.uint64(24), (context >> np.uint64(20)) + (key >> np.uint64(40)) % np.uint64(SPREAD))
    return (at % np.uint64(shards)).astype(np.int64)


def sum_by(keys: np.ndarray, *values: np.ndarray):
    """Order of the sorted distinct keys' first rows, and sums of the values."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return order[first], k[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def pack(columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    return b"".join([len(columns[0]).to_bytes(8, "little"), *(c.astype("<u8").tobytes() for c in columns), *(c.astype("<u4").tobytes() for c in counts)])


def unpack(payloads: list[bytes], n_columns: int, n_counts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts: list[list[np.ndarray]] = [[] for _ in range(n_columns + n_counts)]
    for p in payloads:
        n, at = int.from_bytes(p[:8], "little"), 8
        for i in range(n_columns + n_counts):
            kind = "<u8" if i < n_columns else "<u4"
            parts[i].append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    joined = [np.concatenate(p) if p else np.empty(0, "<u8") for p in parts]
    return joined[:n_columns], [c.astype(np.uint64) for c in joined[n_columns:]]


def deal(columns: list[np.ndarray], counts: list[np.ndarray], shard: np.ndarray, kind: int) -> list[tuple]:
    order = np.argsort(shard, kind="stable")
    ids, starts = np.unique(shard[order], return_index=True)
    out = []
    for s, rows in zip(ids.tolist(), np.split(order, starts[1:])):
        out.append((s, kind, pack([c[rows] for c in columns], [c[rows] for c in counts])))
    return out


def count_ngrams(order: int, shards: int):
    """For mapInArrow over ``text``: blocks of distinct n-grams and their counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        begin = np.full(order - 1, hashes[BEGIN], np.uint64)
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(h) for h in held]
            for h in held:
                h.clear()
            context = fold(columns[:-1], size)
            first, k, (n,) = sum_by(mix(context, columns[-1]), np.ones(size, np.uint32))
            columns, context = [c[first] for c in columns], context[first]  # the distinct ones; the rest is free again
            rows = deal(columns, [n], shard_of(context, k, shards), GRAMS)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))],
                                              names=["shard", "kind", "payload"])

        for b in batches:
            for text in b.column("text").to_pylist():
                words = tokens_of(text)
                h = np.concatenate([begin, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))])
                for i in range(order):
                    held[i].append(h[i:i + len(words)])
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def save(path: str, array: np.ndarray) -> None:
    """Whole or not at all, whichever attempt of the task comes last."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


def merge_level(level: int, folder: str, shards: int):
    """For applyInPandas over a shard's blocks: writes the shard's sorted arrays
    of ``level``-grams and of contexts of the level above; returns blocks for
    the level below. Statistics pass through."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        shard = int(blocks["shard"].iloc[0])
        if shard < 0:
            return blocks
        of = {kind: blocks["payload"][blocks["kind"] == kind].tolist() for kind in (GRAMS, CONTEXTS)}
        out: list[tuple] = []
        if of[CONTEXTS]:
            (key,), (low, high, *n) = unpack(of[CONTEXTS], 1, 5)
            _, key, (total, *n) = sum_by(key, low + (high << np.uint64(32)), *n)
            table = np.zeros(len(key), STAT)
            for name, column in zip(("key", "total", "n1", "n2", "n3"), (key, total, *n)):
                table[name] = column
            save(f"{folder}/contexts-{level + 1}/{shard}.npy", table)
        if grams := of[GRAMS]:
            # counts: at the highest order the n-gram's; below, n-grams that end in it; and the last word's tokens
            columns, counts = unpack(grams, level, 1 if len(grams) and _is_top(grams[0], level) else 2)
            context = fold(columns[:-1], len(columns[0]))
            first, key, counts = sum_by(mix(context, columns[-1]), *counts)
            columns, context = [c[first] for c in columns], context[first]
            n, raw = counts[0], counts[-1]
            save(f"{folder}/grams-{level}/{shard}.key.npy", key)
            save(f"{folder}/grams-{level}/{shard}.n.npy", n.astype("<u4"))
            if level == 1:
                save(f"{folder}/grams-1/{shard}.raw.npy", raw)
            of_count = [int((n == i).sum()) for i in (1, 2, 3, 4)]
            stats = np.array([level, len(n), int(n.sum()), int((n >= 3).sum()), int(raw.sum()), *of_count], "<i8")
            out.append((-level, STATS, stats.tobytes()))
            if level > 1:
                _, k, sums = sum_by(context, n, *(((n == i) if i < 3 else (n >= 3)).astype(np.uint64) for i in (1, 2, 3)))
                total = sums[0]
                low, high = total & np.uint64(0xFFFFFFFF), total >> np.uint64(32)
                out += deal([k], [low, high, *sums[1:]], shard_of(k, k, shards), CONTEXTS)
                below = columns[1:]
                context = fold(below[:-1], len(n))
                first, k, (n, raw) = sum_by(mix(context, below[-1]), np.ones(len(n), np.uint64), raw)
                out += deal([c[first] for c in below], [n, raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)], shard_of(context[first], k, shards), GRAMS)
        return pd.DataFrame(out, columns=["shard", "kind", "payload"])

    return run


def _is_top(payload: bytes, level: int) -> bool:
    return len(payload) == 8 + int.from_bytes(payload[:8], "little") * (8 * level + 4)


def discounts(of_count: list[int]) -> list[float]:
    """Of counts 0, 1, 2 and from 3 on, by Chen and Goodman's estimate; where
    too few counts are there for it, half a count less for each count up to 3."""
    n1, n2, n3, n4 = of_count
    if not min(n1, n2, n3):
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(min(max(x, 0.0), float(i)) for i, x in enumerate(d, 1))]


@dataclass
class Model:
    """Where the arrays are, and the numbers that hold for the whole model."""

    folder: str
    order: int
    shards: int
    train_tokens: int
    words: int
    discounts: dict[int, list[float]]
    unigram: tuple[int, int, int, int]  # total continuation count, words with 1, 2, 3 and more


def train(texts: DataFrame, order: int = ORDER, folder: str | None = None, text_col: str = "text") -> Model:
    """Counts ``texts`` (null: empty) and writes the model's arrays to ``folder``,
    which all executors must see as a path (by default under the checkpoint folder)."""
    spark = texts.sparkSession
    prepare(spark)
    folder = local_path(folder or scratch_path(spark, "lm"))
    if "://" in folder:
        raise ValueError(f"workers map the model's arrays into memory: {folder} must be a path that every machine mounts")
    rows = texts.select(F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SPREAD, -(-size // SHARD_BYTES))
    blocks = rows.mapInArrow(count_ngrams(order, shards), BLOCKS)
    for level in range(order, 0, -1):
        blocks = blocks.repartition(shards, "shard").groupBy("shard").applyInPandas(merge_level(level, folder, shards), BLOCKS)
    stats = {level: np.zeros(8, np.int64) for level in range(1, order + 1)}
    for r in blocks.filter(F.col("kind") == STATS).select("payload").collect():
        level, *numbers = np.frombuffer(r[0], "<i8").tolist()
        stats[level] += np.array(numbers)
    words, total, three, tokens, n1, n2, _, _ = stats[1].tolist()
    return Model(folder, order, shards, tokens, words, {k: discounts(s[4:].tolist()) for k, s in stats.items()}, (total, n1, n2, three))


class Scorer:
    """Looks texts' n-grams up in the mapped arrays."""

    def __init__(self, model: Model):
        self.m = model
        self.hashes = WordHashes()
        self.maps: dict[str, np.ndarray | None] = {}

    def _map(self, name: str) -> np.ndarray | None:
        if name not in self.maps:
            if len(self.maps) >= MAX_MAPS:  # the system has a limit; arrays in use stay mapped
                self.maps.clear()
            path = f"{self.m.folder}/{name}.npy"
            self.maps[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.maps[name]

    def _find(self, shard: np.ndarray, key: np.ndarray, table: str, parts: tuple[str, ...]) -> list[np.ndarray]:
        """Values of keys in a sharded table; 0 where they aren't there. Keys are
        looked up in order, so that neighbouring searches touch the same pages."""
        out = [np.zeros(len(key), np.uint64) for _ in parts]
        order = np.lexsort((key, shard))
        ids, starts = np.unique(shard[order], return_index=True)
        for s, rows in zip(ids.tolist(), np.split(order, starts[1:])):
            whole = self._map(f"{table}/{s}")
            keys = whole["key"] if whole is not None else self._map(f"{table}/{s}.key")
            if keys is None or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key[rows]), len(keys) - 1)
            hit = keys[at] == key[rows]
            for o, p in zip(out, parts):
                values = whole[p] if whole is not None else self._map(f"{table}/{s}.{p}")
                o[rows[hit]] = values[at[hit]]
        return out

    def _grams(self, columns: list[np.ndarray], parts: tuple[str, ...]):
        """Counts of the n-grams in rows, each distinct one looked up once."""
        context = fold(columns[:-1], len(columns[0]))
        key = mix(context, columns[-1])
        back, distinct = pd.factorize(key)
        first = np.empty(len(distinct), np.int64)
        first[back[::-1]] = np.arange(len(key))[::-1]
        found = self._find(shard_of(context[first], distinct, self.m.shards), distinct, f"grams-{len(columns)}", parts)
        return [f[back] for f in found], context

    def _discounted(self, level: int, n: np.ndarray) -> np.ndarray:
        return n - np.take(self.m.discounts[level], np.minimum(n, 3).astype(np.int64))

    def probabilities(self, h: np.ndarray, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``P(token | order - 1 tokens before)`` and the token's training count."""
        m = self.m
        (n, raw), _ = self._grams([h], ("n", "raw"))
        total, n1, n2, n3 = m.unigram
        d = m.discounts[1]
        p = np.full(len(h), 1.0 / (m.words + 1))  # the words known and one for all others
        if total:
            p = (self._discounted(1, n) + (d[1] * n1 + d[2] * n2 + d[3] * n3) * p) / total
        for level in range(2, m.order + 1):
            columns = [*before[len(before) - level + 1:], h]
            (n,), context = self._grams(columns, ("n",))
            back, key = pd.factorize(context)
            total, *ns = (x[back].astype(float) for x in self._find(shard_of(key, key, m.shards), key, f"contexts-{level}", ("total", "n1", "n2", "n3")))
            d = m.discounts[level]
            left = d[1] * ns[0] + d[2] * ns[1] + d[3] * ns[2]
            seen = total > 0  # else the shorter context decides
            p = np.where(seen, (self._discounted(level, n) + left * p) / np.where(seen, total, 1), p)
        return p, raw

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """Of each text: tokens, known tokens, base score, score (log10)."""
        m = self.m
        lists = [tokens_of(t) for t in texts]
        sizes = np.array([len(x) for x in lists])
        if not len(sizes):
            return []
        h = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(lists)), np.uint64, sizes.sum())
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(len(h)) - np.repeat(starts, sizes)
        begin = np.uint64(self.hashes[BEGIN])
        before = []
        for back in range(m.order - 1, 0, -1):
            moved = np.concatenate([np.full(min(back, len(h)), begin), h[:-back]])[:len(h)]
            before.append(np.where(place < back, begin, moved))
        p, raw = self.probabilities(h, before)
        base = np.log10((raw + 0.5) / (m.train_tokens + 0.5 * (m.words + 1)))
        sums = [np.add.reduceat(x, starts) for x in ((raw > 0).astype(np.int64), base, np.log10(p))]
        return list(zip(sizes.tolist(), *(s.tolist() for s in sums)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, base_score, score, perplexity)`` of every row of
    ``docs``: log10 probabilities of the whole text and its end. A null text is
    empty: it has its end only. Repeated rows each get a row, null ids stay
    null, other columns are not read; an empty table gives an empty result, and
    a model without training text gives every token an equal probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            out = scorer.score(b.column("text").to_pylist())
            arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            perplexity = pa.array([10 ** min(-o[3] / o[0], 300) for o in out], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("id"), *arrays, perplexity], names=["id", *NAMES])

    NAMES = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [T.StructField(n, T.LongType() if n.startswith("n_") else T.DoubleType()) for n in NAMES]
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *fields]))


def training_rows(docs: DataFrame, mod: int = 5, held_out: int = 1, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(crc_mod(F.col(id_col), mod) != held_out)
