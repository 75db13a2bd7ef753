"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over a text's characters once. For every boundary it keeps the
piece that ends there on the best path and the boundary where that piece starts.
Only boundaries inside a window of the longest piece's length can still be
continued; whenever the backpointer paths from all of them run through one
boundary, the ids up to it are final: they are committed, and the table behind
is dropped. So memory doesn't grow with the text.

The model here is a BPE model, whose right segmentation isn't the one with the
best sum of piece scores but the one its merges make. The search therefore
scores a step by the merges themselves: a segmentation is the model's exactly
if every two neighbouring pieces are what the merges make of their joined text,
and of the paths that end at a boundary exactly one is. A step to a boundary is
admitted if its piece and the piece before it are such a pair; the first one found,
from the shortest piece on, is the only one.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import prepare

SPACE = "▁"
#: Texts fall into stretches that no piece leaves (``Model.stretches``), which are
#: searched on their own; short ones recur, and a worker remembers the ids of this
#: many: the last that it met, and as many of those before them.
MEMO = 1_000_000
MEMO_CHARS = 48


class Model:
    """A SentencePiece BPE model with byte fallback and without text normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model changes texts before it encodes them")
        self.prefix = spec.add_dummy_prefix
        normal, byte = 1, 6
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces cross the borders of stretches")
        self.stretches = self._stretches()
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == byte}
        self.longest = max(map(len, self.ids))
        self.surface = [b"" if p.type in (2, 3) else bytes([int(p.piece[3:5], 16)]) if p.type == byte else p.piece.replace(SPACE, " ").encode()
                        for p in proto.pieces]
        # Only pieces that merges can make may stand on a path.
        reachable = [p for p in self.ids if len(p) == 1 or self.merge(p) == [p]]
        self.trie: dict = {}  # from a piece's last character to its first
        for p in reachable:
            node = self.trie
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self.pairs: dict[str, dict[str, bool]] = {}
        self.ends: dict[str, tuple[list[str], list[str]]] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _stretches(self) -> re.Pattern:
        """Characters that stand side by side in a piece, directly or through others, are of
        one kind. A stretch: characters of one kind, with the space marks before them."""
        kind: dict[str, set[str]] = {}
        for p in self.ids:
            own = set(p.lstrip(SPACE))
            for other in {id(k): k for c in own if (k := kind.get(c)) is not None}.values():
                own |= other
            for c in own:
                kind[c] = own
        kinds = sorted({"".join(map(re.escape, sorted(k))) for k in kind.values() if len(k) > 1})
        rest = f"[^{SPACE}{''.join(kinds)}]+"
        return re.compile(f"{SPACE}*(?:{'|'.join([*(f'[{k}]+' for k in kinds), rest])})|{SPACE}+")

    def merge(self, text: str, firsts: list[str] | None = None, lasts: list[str] | None = None) -> list[str]:
        """The model's merges on a short text: always the best-scored pair of
        neighbours, of equals the leftmost. ``firsts`` and ``lasts``, where given,
        get what the first and the last part become."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap = [(-self.scores[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            elif lasts is not None:
                lasts.append(made)
            if i == 0 and firsts is not None:
                firsts.append(made)
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (both := parts[left] + parts[right]) in self.scores:
                    heapq.heappush(heap, (-self.scores[both], left, both))
        return [p for p in parts if p is not None]

    def _judge(self, row: dict[str, bool], a: str, b: str) -> bool:
        """Whether the merges keep ``a`` and ``b`` apart and whole; ``row`` remembers it for ``a``.

        They do if no part that ever ends ``a`` and none that ever begins ``b`` make
        a piece, and don't if the two make one; other pairs are merged."""
        if len(row) > MEMO // 100:
            row.clear()
        scores = self.scores
        if a + b in scores:
            known = False
        else:
            lasts, firsts = self._ends(a)[1], self._ends(b)[0]
            known = not any(x + y in scores for x in lasts for y in firsts) or self.merge(a + b) == [a, b]
        row[b] = known
        return known

    def _ends(self, piece: str) -> tuple[list[str], list[str]]:
        """All that the first part and the last part of a piece are while it is merged."""
        found = self.ends.get(piece)
        if found is None:
            if len(self.ends) > MEMO // 10:
                self.ends.clear()
            found = self.ends[piece] = [piece[0]], [piece[-1]]
            self.merge(piece, *found)
        return found

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[x] for x in piece.encode()]

    def search(self, chars: str) -> Iterator[str]:
        """The pieces of a stretch, committed as soon as all paths agree."""
        longest, root, pairs, n = self.longest, self.trie, self.pairs, len(chars)
        done = 0  # what lies before is committed
        last: dict[int, str] = {0: ""}  # boundary -> the piece that ends there on its path
        after: dict[int, dict[str, bool] | None] = {0: None}  # boundary -> what is known of the pieces after that one
        for at in range(n):
            node, i, found = root, at, ""
            while i >= 0 and (node := node.get(chars[i])) is not None:
                if (p := node.get("")) is not None:
                    row = after[i]
                    if row is None:  # nothing before it
                        found = p
                        break
                    known = row.get(p)
                    if known is None:
                        known = self._judge(row, last[i], p)
                    if known:
                        found = p
                        break
                i -= 1
            if not found:  # a character without a piece, or not yet merged
                found = chars[at]
            row = pairs.get(found)
            if row is None:
                if len(pairs) > MEMO:
                    pairs.clear()
                row = pairs[found] = {}
            last[at + 1], after[at + 1] = found, row
            if at - done >= 2 * longest:
                # the boundaries that a later piece can start from, and the paths behind them
                live = set(range(at + 2 - longest, at + 2))
                while len(live) > 1:
                    b = max(live)
                    live.discard(b)
                    live.add(b - len(last[b]))
                agreed = live.pop()
                if agreed > done:
                    yield from self._path(last, agreed, done)
                    for b in range(done, agreed):
                        del last[b], after[b]
                    done = agreed
        yield from self._path(last, n, done)

    @staticmethod
    def _path(last: dict[int, str], to: int, back_to: int) -> list[str]:
        out = []
        while to > back_to:
            out.append(last[to])
            to -= len(last[to])
        return out[::-1]

    def _stretch(self, chars: str) -> bytes:
        ids: list[int] = []
        for p in self.search(chars):
            ids += self.piece_ids(p)
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; none for an empty one."""
        if not text:
            return np.empty(0, np.int32)
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        stretches = self.stretches.findall(text)
        found = [*map(self.memo.get, stretches)]
        if None in found:
            for i, (m, ids) in enumerate(zip(stretches, found)):
                if ids is None:
                    found[i] = self._remembered(m)
        return np.frombuffer(b"".join(found), np.int32)

    def _remembered(self, chars: str) -> bytes:
        """The ids of a stretch that isn't among the last ones met."""
        ids = self.memo.get(chars) or self.older.get(chars) or self._stretch(chars)
        if len(chars) <= MEMO_CHARS:
            if len(self.memo) >= MEMO // 2:
                self.memo, self.older = {}, self.memo
            self.memo[chars] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _model(model_file: str, changed: int) -> Model:
    return Model(model_file)


def model_of(model_file: str) -> Model:
    """The model of a file, with what it remembers, kept by a Python worker from task to task."""
    return _model(model_file, os.stat(model_file).st_mtime_ns)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, ids, round_trip)`` of every row of ``docs``.

    ``ids`` are those of the SentencePiece library, without begin or end.
    Null and empty texts have none. ``round_trip``: decoding gives the text
    again; it can't where a text holds the space mark itself, which decodes to
    a space. Repeated rows each get a row, null ids stay null, other columns are
    not read, an empty table gives an empty result. One narrow pass: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [model.encode(t) for t in texts]
            back = [model.decode(x.tolist()) == t for x, t in zip(ids, texts)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(back, pa.bool_())],
                names=["id", "n_chars", "ids", "round_trip"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("n_chars", T.LongType()),
                                              T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]))


def decode(rows: DataFrame, model_file: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of every row: the text of its ids; empty for none or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for b in batches:
            texts = [model.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    prepare(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("text", T.StringType())]))
