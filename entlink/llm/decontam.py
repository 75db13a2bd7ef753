"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the benchmark items, in blocks of bounded size, become
generalised suffix automata. Training documents stream through each automaton;
at every word the length of the longest match that ends there is known. A word
inside a match of ``window`` words, or inside a whole item that is shorter, is
hit. Spans of hit words can then be removed, or documents that are covered
beyond a limit dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import prepare
from entlink.session import persist_table

#: Words of benchmark items in one automaton: it has at most twice as many
#: states, about 100 MB in a worker; more items make more blocks.
BLOCK_WORDS = 100_000

#: Lower-cases A-Z and turns every other ASCII byte that isn't a letter or digit into a space.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


@dataclass
class Automaton:
    """Generalised suffix automaton over word sequences.

    ``go``: transitions of each state; ``length``: longest string of a state;
    ``link``: suffix link. ``owners``: items that contain the state's strings;
    ``whole``: for a state, lengths of the short items that are suffixes of its
    longest string, as ``(length, item)``.
    """

    window: int
    go: list[dict] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    owners: list[set] = field(default_factory=lambda: [set()])
    whole: dict[int, list] = field(default_factory=dict)

    def _state(self, length: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        return len(self.go) - 1

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the string of ``last`` followed by ``word``."""
        known = self.go[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.go[at]:
            self.go[at][word] = new
            at = self.link[at]
        if at != -1:
            target = self.go[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _split(self, at: int, word: bytes, target: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.go[target]), self.link[target])
        self.link[target] = clone
        while at != -1 and self.go[at].get(word) == target:
            self.go[at][word] = clone
            at = self.link[at]
        return clone

    @classmethod
    def build(cls, items: list[tuple], window: int) -> Automaton:
        """``items``: ``(item, words)``."""
        a = cls(window)
        for _, words in items:
            at = 0
            for w in words:
                at = a._extend(at, w)
        short: dict[int, list] = {}
        for item, words in items:
            at = 0
            for w in words:
                at = a.go[at][w]
                a.owners[at].add(item)
            if 0 < len(words) < window:
                short.setdefault(at, []).append((len(words), item))
        order = sorted(range(1, len(a.go)), key=a.length.__getitem__)
        for s in reversed(order):  # a suffix occurs wherever the longer string does
            a.owners[a.link[s]] |= a.owners[s]
        for s in order:
            if found := a.whole.get(a.link[s], []) + short.get(s, []):
                a.whole[s] = found
        return a

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans ``[start, end)`` of hit words and the items that hit."""
        go, length, link, window, whole = self.go, self.length, self.link, self.window, self.whole
        spans: list[tuple[int, int]] = []
        items: set = set()
        state = matched = 0
        start = go[0]
        for i, w in enumerate(words):
            if not state:  # most words: nothing matched so far
                if w not in start:
                    continue
                state, matched = start[w], 1
            else:
                to = go[state].get(w)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = go[state].get(w)
                if to is None:
                    matched = 0
                    continue
                state = to
                matched += 1
            if matched >= window:
                spans.append((i + 1 - matched, i + 1))
                s = state
                while length[link[s]] >= window:  # the state that holds the last `window` words
                    s = link[s]
                items |= self.owners[s]
            if state in whole:
                for n, item in whole[state]:
                    if n <= matched:
                        spans.append((i + 1 - n, i + 1))
                        items.add(item)
        return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Benchmark items as ``(item, words)``, in blocks of about ``BLOCK_WORDS``
    words, streamed to the driver a partition at a time: no more than a block
    and a partition is held. One item longer than a block is a block."""
    block: list[tuple] = []
    size = 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if words := words_of(r["t"]):
            block.append((r["i"], words))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield block
                block, size = [], 0
    if block:
        yield block


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scanner(shared, window: int, keep_text: bool, more: bool):
    """For mapInArrow: adds ``FOUND`` to the columns, or with ``more`` unites
    it with what earlier blocks of items have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.build(shared.value, window)
        for b in batches:
            n, spans, items = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                found, who = automaton.scan(words)
                if more:
                    found = merge_spans(found + [(s["start"], s["end"]) for s in b.column("spans")[i].as_py()])
                    who |= {*b.column("items")[i].as_py()}
                n.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in found])
                items.append([*who])
            kept = [c for c in b.schema.names if c not in ("n_words", "spans", "items") and (keep_text or c != "text")]
            found = [pa.array(n, pa.int64()), pa.array(spans, ARROW_SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), *found], names=[*kept, "n_words", "spans", "items"])

    return run


def _scan(rows: DataFrame, benchmark: DataFrame, window: int, keep_text: bool, item_col: str, item_text_col: str) -> DataFrame:
    """``rows`` (with a column ``text``) and ``FOUND``. One narrow pass over the
    rows for each block of items; what a pass found is stored between passes."""
    sc = rows.sparkSession.sparkContext
    blocks = item_blocks(benchmark, item_col, item_text_col)
    out, block, more = rows, next(blocks, []), False
    while block is not None:
        following = next(blocks, None)
        text = keep_text or following is not None
        fields = [f for f in rows.schema if text or f.name != "text"]
        out = out.mapInArrow(_scanner(sc.broadcast(block), window, text, more), T.StructType([*fields, *FOUND]))
        if following is not None:
            out = persist_table(out, "decontam")
        block, more = following, True
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, n_words, spans, items)`` of every row of ``docs``: merged spans of
    hit word positions and the ids, as strings, of the items that hit.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
    An item of fewer than ``window`` words counts as one window; an item or text
    that is null or has no words hits nothing. Repeated rows each get a row;
    items with equal id count as one; an item whose id is null can hit, but has
    no name. Other columns are not read. Empty tables give empty results or no hits.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _scan(rows, benchmark, window, False, item_col, item_text_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hit words, items and digest of ``matches``' rows."""
    named = F.array_sort(F.filter("items", lambda x: x.isNotNull()))
    return (found.withColumn("items", named)
            .select(F.col("id").alias(id_col), F.col("n_words"),
                    F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
                    F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    (F.size("spans") > 0).alias("contaminated")))


def remove_spans(text: str, spans: list) -> str:
    """``text`` without the hit words and what stands between them."""
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data)]
    out, done = [], 0
    for s in spans:
        out.append(data[done:at[s["start"]][0]])
        done = at[s["end"] - 1][1]
    return b"".join([*out, data[done:]]).decode()


def _cleaner(min_words: int, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            columns = (b.column(c).to_pylist() for c in ("text", "n_words", "spans"))
            for text, n, spans in zip(*columns):
                cut = [s for s in spans if s["end"] - s["start"] >= min_words]
                hit = sum(s["end"] - s["start"] for s in cut)
                keep.append(not cut or hit <= max_coverage * n)
                texts.append(remove_spans(text, cut) if cut and keep[-1] else text)
            names = [c for c in b.schema.names if c not in ("n_words", "spans", "items")]
            arrays = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_words: int = 1, max_coverage: float = 0.8,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with its columns: spans of at least ``min_words`` hit words are
    cut from the texts, and documents of which more than the share
    ``max_coverage`` of words is hit go. Rows without hits stay as they are,
    null texts too. Column names of ``docs`` may be any; repeated rows stay."""
    prepare(docs.sparkSession)
    names = ["text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*names)
    found = _scan(rows, benchmark, window, True, item_col, item_text_col)
    return found.mapInArrow(_cleaner(min_words, max_coverage), rows.schema).toDF(*docs.columns)
