"""Cross-tokenizer alignment with external spill counting.

Two tokenizers cut the same bytes; every byte range that a token of A shares
with a token of B is a link. How often an id pair is linked in the whole corpus
can't be kept in memory, so it is counted outside it:

* a task gathers the links of some megabytes of text, sorts them by B id, A id
  and document (side-major order), and writes them as a *run*: for each radix (a
  hash range of B ids) frames of zstd with the distinct pairs, how many links
  each has, and the documents that hold it;
* all runs' frames of a radix meet in one task, where a k-way heap merge reads
  them window by window and adds up each pair. A pair that every document holds
  is one entry for each run, so it is no hot key. More runs than ``FAN_IN`` are
  merged in levels;
* the last level is in side-major order, so a B id's maximum is known when its
  last pair has passed: each pair gets its total and a mark if it is the highest;
* totals stream back down the same levels to the runs, whose records add them
  up by document.

Only pairs and counts are shuffled for counting; the documents' records move
once, to meet their run's totals. Every table is written under the shared
checkpoint folder, so a lost executor costs the tasks it had.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import prepare
from entlink.session import persist_table

#: Parts that B ids are dealt to.
RADIXES = 128
#: Runs that one task merges.
FAN_IN = 64
#: Bytes of text whose links make one run.
RUN_BYTES = 16 << 20
#: Pairs in a frame, the unit that a merge reads and writes.
FRAME = 8192
#: Bytes of text that the tokenizers get at once.
BATCH_BYTES = 2 << 20


# ---- tokenizers --------------------------------------------------------------

def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    visible Latin-1 characters for themselves, the other bytes, in order, for
    the characters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


#: How a byte-level pre-tokenizer cuts texts (a fixed value of its library).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts go to the file's own library, which needs no backtracking limit.
LONG_TEXT = 1 << 20


class TokenizerA:
    """A byte-level file for ``tokenizers``; encodes a space and the text.

    Where the file proves that each merge makes the token of the next id (then
    merging by order and merging by id are one), and that nothing else touches a
    text, ``tiktoken`` merges the file's own vocabulary, with the same ids in a
    quarter of the time; any other file, and any text that it fails on, is left
    to ``tokenizers``."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        byte = byte_of_character()
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            self.ranked = self._ranked(json.load(f))

    def _ranked(self, spec: dict):
        """An encoder that merges by id, or None where the file doesn't prove that it is the same."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        ids = [model["vocab"].get(m) for m in merges]
        if not plain or odd or model.get("type") != "BPE" or ids != list(range(256, 256 + len(merges))) or len(model["vocab"]) != 256 + len(merges):
            return None
        import tiktoken

        ranks = {self.tokens[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("by-rank", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        if self.ranked is None:
            return self._library(texts)
        out = []
        for t in texts:
            try:
                ids = self.ranked.encode_ordinary(t) if len(t) < LONG_TEXT else None
            except (ValueError, RuntimeError):  # its pattern engine gave up
                ids = None
            out.append(self._library([t])[0] if ids is None else ids)
        return out


class TokenizerB:
    """A model for ``sentencepiece``, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        of = self.model
        self.tokens = [bytes([int(of.id_to_piece(i)[3:5], 16)]) if of.is_byte(i) else of.id_to_piece(i).replace("▁", " ").encode()
                       for i in range(of.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# ---- links of texts ----------------------------------------------------------

@dataclass
class Aligned:
    """What a batch of texts gives; ``document`` and ``pair`` have an entry for each link."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digest: list[str]
    document: np.ndarray
    a: np.ndarray
    b: np.ndarray


class Aligner:
    def __init__(self, a, b):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (a, b))
        # ids as text with what follows them: within a side, or at its end
        self.words = [f"{i}{c}".encode() for x, ends in ((a, ",|"), (b, ",;")) for c in ends for i in range(len(x.tokens))]

    def align(self, texts: list[str]) -> Aligned:
        """Texts that are empty, or whose tokens of either side don't spell a
        space and the text, have no tokens."""
        n = len(texts)
        some = [i for i, t in enumerate(texts) if t]
        sides = self.a.encode([texts[i] for i in some]), self.b.encode([texts[i] for i in some])
        whole = [b" " + texts[i].encode() for i in some]
        good = [k for k in range(len(some)) if all(b"".join(map(x.tokens.__getitem__, ids[k])) == whole[k] for x, ids in zip((self.a, self.b), sides))]
        at = np.array([some[k] for k in good], np.int64)
        counts = [np.zeros(n, np.int64) for _ in range(4)]
        digest = [""] * n
        if not good:
            none = np.zeros(0, np.int64)
            return Aligned(*counts, digest, none, none, none)
        ids_a, ids_b = (np.concatenate([np.array(ids[k], np.int64) for k in good]) for ids in sides)
        len_a, len_b = (np.array([len(ids[k]) for k in good]) for ids in sides)
        n_bytes = np.array([len(whole[k]) for k in good])
        # the texts one after another: where tokens of either side end, and of both
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        mark = np.zeros(int(n_bytes.sum()) + 1, np.uint8)
        mark[end_a] = 1
        mark[end_b] |= 2
        ends = np.flatnonzero(mark)
        kind = mark[ends]
        # the piece up to each end lies in one token of A and one of B: that is a link
        is_a, is_b = kind & 1, kind >> 1
        in_a, in_b = np.cumsum(is_a, dtype=np.int64) - is_a, np.cumsum(is_b, dtype=np.int64) - is_b
        closes = kind == 3
        group = np.cumsum(closes) - closes
        text_end = np.cumsum(n_bytes)
        of_link = np.searchsorted(text_end, ends)
        links = np.bincount(of_link, minlength=len(good))
        groups = np.bincount(of_link[closes], minlength=len(good))
        for column, value in zip(counts, (len_a, len_b, groups, links)):
            column[at] = value
        for k, text in enumerate(self._group_texts(ids_a, ids_b, group[is_a > 0], group[is_b > 0], len_a + len_b)):
            digest[at[k]] = hashlib.sha256(text).hexdigest()
        return Aligned(*counts, digest, at[of_link], ids_a[in_a], ids_b[in_b])

    def _group_texts(self, ids_a, ids_b, group_a, group_b, sizes) -> Iterator[bytes]:
        """``a1,a2|b1;...`` of each text: a group's tokens of A, then those of B."""
        ends = lambda g: np.append(g[1:] != g[:-1], True)
        n_a, n_b = len(self.a.tokens), len(self.b.tokens)
        word = np.empty(len(ids_a) + len(ids_b), np.int64)
        word[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a + n_a * ends(group_a)
        word[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = ids_b + 2 * n_a + n_b * ends(group_b)
        start = 0
        for end in np.cumsum(sizes).tolist():
            yield b"".join(map(self.words.__getitem__, word[start:end].tolist()))[:-1]
            start = end


# ---- frames --------------------------------------------------------------------

def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on as zstd, in as few bytes each as the largest needs."""
    import zstandard

    kind = next(k for k in (1, 2, 4, 8) if k == 8 or not len(values) or int(values.max()) < 1 << (8 * k))
    return bytes([kind]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{kind}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def framed(*columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(0, len(columns[0]), FRAME):
        yield tuple(c[at:at + FRAME] for c in columns)


RUNS = T.StructType([T.StructField(n, t) for n, t in (
    ("run", T.LongType()), ("radix", T.IntegerType()), ("pairs", T.ArrayType(T.BinaryType())), ("counts", T.ArrayType(T.BinaryType())),
    ("holders", T.ArrayType(T.BinaryType())), ("seqs", T.ArrayType(T.BinaryType())), ("links", T.ArrayType(T.BinaryType())))])


@dataclass
class Keys:
    """Pair keys in side-major order: B ids ordered by radix, then the A id."""

    n_a: int
    rank: np.ndarray
    starts: np.ndarray  # the first key of each radix, and one past the last

    @classmethod
    def of(cls, n_a: int, n_b: int, radixes: int) -> Keys:
        radix = (np.arange(n_b, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % radixes
        order = np.argsort(radix, kind="stable")
        rank = np.empty(n_b, np.int64)
        rank[order] = np.arange(n_b)
        return cls(n_a, rank, n_a * np.searchsorted(radix[order], np.arange(radixes + 1)))

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.rank[b] * self.n_a + a


def run_rows(run: int, keys: Keys, pair: np.ndarray, seq: np.ndarray) -> Iterator[dict]:
    """The rows of one run, from a key and a document number for each link."""
    bits = int(seq.max()).bit_length() + 1 if len(seq) else 1
    if int(keys.starts[-1]).bit_length() + bits > 63:
        raise ValueError("vocabularies too large for a run of so many documents")
    record = np.sort(pair << bits | seq)
    first = np.flatnonzero(np.append(True, record[1:] != record[:-1]))[: len(record)]
    link = np.diff(first, append=len(record))
    record = record[first]
    pair, seq = record >> bits, record & ((1 << bits) - 1)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))[: len(pair)]
    holders = np.diff(first, append=len(pair))
    step = np.diff(seq, prepend=0)
    step[first] = seq[first]
    count = np.add.reduceat(link, first) if len(first) else first
    pair = pair[first]
    cuts = np.searchsorted(pair, keys.starts)
    first = np.append(first, len(link))
    for radix in np.flatnonzero(np.diff(cuts)).tolist():
        row = {"run": run, "radix": radix, "pairs": [], "counts": [], "holders": [], "seqs": [], "links": []}
        for at in range(int(cuts[radix]), int(cuts[radix + 1]), FRAME):
            end = min(at + FRAME, int(cuts[radix + 1]))
            records = slice(int(first[at]), int(first[end]))
            for name, data in (("pairs", pack_sorted(pair[at:end])), ("counts", pack(count[at:end])), ("holders", pack(holders[at:end])),
                               ("seqs", pack(step[records])), ("links", pack(link[records]))):
                row[name].append(data)
        yield row


def link_batches(file_a: str, file_b: str, radixes: int, run_bytes: int, schema: pa.Schema):
    """For mapInArrow over ``(id, text)``: a row for each document, and the rows of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(TokenizerA(file_a), TokenizerB(file_b))
        keys = Keys.of(len(aligner.a.tokens), len(aligner.b.tokens), radixes)
        number = TaskContext.get().partitionId() << 32
        pairs: list[np.ndarray] = []
        seqs: list[np.ndarray] = []
        held = n_docs = 0

        def table(columns: dict[str, pa.Array | list]) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            if pairs:
                for row in run_rows(number, keys, np.concatenate(pairs), np.concatenate(seqs)):
                    yield table({k: [v] for k, v in row.items()})
            pairs.clear()
            seqs.clear()

        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                found = aligner.align([t or "" for t in texts[at:end]])
                seq = np.arange(n_docs, n_docs + end - at)
                yield table({"run": [number] * (end - at), "seq": seq, "doc_id": ids.slice(at, end - at), "n_a": found.n_a, "n_b": found.n_b,
                             "n_groups": found.n_groups, "n_links": found.n_links, "groups_sha256": found.digest})
                pairs.append(keys.key(found.a, found.b))
                seqs.append(found.document + n_docs)
                held, n_docs, at = held + size, n_docs + end - at, end
                if held >= run_bytes:
                    yield from close()
                    number, held, n_docs = number + 1, 0, 0
        yield from close()

    return run


# ---- merging and streaming back ------------------------------------------------

def merged(runs: list[tuple[list[bytes], list[bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(pairs, counts)`` of all runs added up, in order, a window at a time.
    The heap has each run's last pair in its open frame; up to the smallest of
    them every run's entries are there and can be added."""
    heap: list[tuple[int, int]] = []
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    frames = [iter(list(zip(*r))) for r in runs]

    def advance(k: int) -> None:
        frame = next(frames[k], None)
        if frame is None:
            open_.pop(k, None)
        else:
            open_[k] = unpack_sorted(frame[0]), unpack(frame[1])
            heapq.heappush(heap, (int(open_[k][0][-1]), k))

    for k in range(len(runs)):
        advance(k)
    while heap:
        last, k = heapq.heappop(heap)
        parts = []
        for j, (pair, count) in open_.items():
            cut = int(np.searchsorted(pair, last, "right"))
            parts.append((pair[:cut], count[:cut]))
            open_[j] = pair[cut:], count[cut:]
        pair, count = (np.concatenate(x) for x in zip(*parts))
        advance(k)
        while heap and heap[0][0] == last:  # runs that end a frame at the same pair
            advance(heapq.heappop(heap)[1])
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        yield pair[first], np.add.reduceat(count, first)


def by_side(windows: Iterator[tuple[np.ndarray, np.ndarray]], n_a: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows that end where a B id ends (at most ``n_a`` pairs longer)."""
    rest: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 2
    for window in windows:
        pair, count = (np.concatenate(x) for x in zip(rest, window))
        cut = int(np.searchsorted(pair, pair[-1] // n_a * n_a))
        if cut:
            yield pair[:cut], count[:cut]
        rest = pair[cut:], count[cut:]
    if len(rest[0]):
        yield rest


def highest(pair: np.ndarray, count: np.ndarray, n_a: int) -> np.ndarray:
    """Whether a pair's count is the highest of its B id, ties included."""
    side = pair // n_a
    first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
    top = np.maximum.reduceat(count, first)
    return count == np.repeat(top, np.diff(first, append=len(side)))


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows, sorted by ``keys``, of each key in turn."""
    from itertools import groupby

    rows = (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist())
    return groupby(rows, lambda r: tuple(r[k] for k in keys))


def merge_batches(n_a: int, top: bool):
    """For mapInArrow over rows sorted by ``(parent, radix)``: the parent's pairs
    with their counts, at the ``top`` with marks, twice the count and one more
    for the highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (parent, radix), rows in grouped(batches, ("parent", "radix")):
            windows = merged([(r["pairs"], r["counts"]) for r in rows])
            pairs, counts = [], []
            for pair, count in by_side(windows, n_a) if top else windows:
                value = 2 * count + highest(pair, count, n_a) if top else count
                for p, v in framed(pair, value):
                    pairs.append(pack_sorted(p))
                    counts.append(pack(v))
            yield pa.RecordBatch.from_arrays([pa.array([parent], pa.int64()), pa.array([radix], pa.int32()), pa.array([pairs], pa.list_(pa.binary())),
                                              pa.array([counts], pa.list_(pa.binary()))], names=["run", "radix", "pairs", "counts"])

    return run


def back_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by ``(parent, radix, run)``, the parent's
    own (a null run) first: each run's pairs with the parent's marks."""
    for _, rows in grouped(batches, ("parent", "radix")):
        own = next(rows)
        pair, mark = (np.concatenate([f(x) for x in own[c]]) for c, f in (("pairs", unpack_sorted), ("counts", unpack)))
        for row in rows:
            marks = [pack(mark[np.searchsorted(pair, unpack_sorted(x))]) for x in row["pairs"]]
            yield pa.RecordBatch.from_arrays([pa.array([row["run"]], pa.int64()), pa.array([row["radix"]], pa.int32()),
                                              pa.array([marks], pa.list_(pa.binary()))], names=["run", "radix", "marks"])


def document_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by ``(run, radix, marks)``, a radix's
    records (no marks) before its marks: ``(run, seq, n_best, count_sum)``."""
    for (run,), rows in grouped(batches, ("run",)):
        best = total = np.zeros(0, np.int64)
        records = None
        for row in rows:
            if row["marks"] is None:
                records = row
                continue
            for mark, holders, seqs, links in zip(row["marks"], *(records[c] for c in ("holders", "seqs", "links"))):
                mark, holders, step, link = (unpack(x) for x in (mark, holders, seqs, links))
                first = np.cumsum(holders) - holders
                seq = np.cumsum(step)
                seq -= np.repeat(seq[first] - step[first], holders)
                if (size := int(seq.max()) + 1) > len(best):
                    best, total = (np.append(x, np.zeros(max(size, 2 * len(x)) - len(x), np.int64)) for x in (best, total))
                mark = np.repeat(mark, holders)
                np.add.at(total, seq, (mark >> 1) * link)
                np.add.at(best, seq, (mark & 1) * link)
        seq = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seq), run), pa.int64()), pa.array(seq, pa.int64()), pa.array(best[seq]), pa.array(total[seq])],
                                         names=["run", "seq", "n_best", "count_sum"])


def _deal(rows: DataFrame, keys: list[str], then: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *then)


def align(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", radixes: int = RADIXES,
          fan_in: int = FAN_IN, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs``.

    A null or empty text, and one whose tokens of either side don't spell a
    space and the text, has no tokens: zeros, and '' for the digest. Ties: all
    pairs of a B id that reach its highest count are best. Repeated rows each
    count and each get a row; ids may be null or equal (rows are told apart by
    their place in a run). Other columns, whatever their names, are not read. An
    empty table gives an empty result. A text is held whole, with its links, by
    one task.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = T.StructType([T.StructField("seq", T.LongType()), T.StructField("doc_id", rows.schema["id"].dataType)]
                       + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())])
    schema = T.StructType(RUNS.fields + own.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    both = persist_table(rows.mapInArrow(link_batches(file_a, file_b, radixes, run_bytes, to_arrow_schema(schema)), schema), "align-runs")
    documents, runs = both.filter("seq is not null"), both.filter("radix is not null")
    n_a = len(TokenizerA(file_a).tokens)

    # up: each level merges up to fan_in runs in the mean, the last one all that are left
    levels = []
    level, n = runs.select("run", "radix", "pairs", "counts"), runs.select("run").distinct().count()
    while True:
        top = n <= fan_in
        n = 1 if top else -(-n // fan_in)
        parent = F.pmod(F.xxhash64("run"), F.lit(n)).cast("bigint")
        level = level.withColumn("parent", parent)
        levels.append(level.select("parent", "radix", "run", "pairs"))
        level = _deal(level, ["parent", "radix"], ["run"]).mapInArrow(merge_batches(n_a, top), "run bigint, radix int, pairs array<binary>, counts array<binary>")
        level = persist_table(level, "align-merged")
        if top:
            break
    # down: a parent's totals meet its runs
    for children in reversed(levels):
        totals = level.select(F.col("run").alias("parent"), "radix", F.lit(None).cast("bigint").alias("run"), "pairs", "counts")
        met = _deal(totals.unionByName(children.withColumn("counts", F.lit(None).cast("array<binary>"))), ["parent", "radix"], ["run"])
        marks = persist_table(met.mapInArrow(back_batches, "run bigint, radix int, marks array<binary>"), "align-marks")
        if children is not levels[0]:
            level = children.select("run", "radix", "pairs").join(marks.withColumnRenamed("marks", "counts"), ["run", "radix"])
    leaf = ["run", "radix", "holders", "seqs", "links", "marks"]
    empty = F.lit(None).cast("array<binary>")
    met = runs.withColumn("marks", empty).select(leaf).unionByName(marks.withColumns({c: empty for c in leaf[2:5]}).select(leaf))
    met = _deal(met.withColumn("told", F.col("marks").isNotNull()), ["run"], ["radix", "told"])
    sums = met.mapInArrow(document_batches, "run bigint, seq bigint, n_best bigint, count_sum bigint")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return documents.join(sums, ["run", "seq"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
