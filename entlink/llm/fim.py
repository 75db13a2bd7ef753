"""Fill-in-middle documents cut by a learned rank index.

A text's units are words of letters and single other characters. A cut is a
rank among the unit boundaries; its place in the text comes from an index that
is fitted to all boundary offsets of the text: line segments that predict each
offset from its rank within a fixed error, and the residual of every rank, one
byte each, which makes the prediction exact. The index of a text is a few
segments and a byte a unit, so texts can be cut again and again (one draw for
each epoch, say) without matching their units anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest difference between a segment's line and an offset; with rounding, a residual fits a byte.
ERROR = 64
#: Percent of texts that are cut, and of those the percent with the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, before each unit and after the last."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((codes | 32) >= 97) & ((codes | 32) <= 122)
    starts = np.ones(len(codes) + 1, bool)
    starts[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts) if len(codes) else np.zeros(1, np.int64)


@dataclass
class RankIndex:
    """Segment ``s`` has the ranks from ``rank[s]`` on, and predicts
    ``offset[s] + floor(slope[s] * (r - rank[s]))``."""

    rank: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Shrinking cone: a segment starts in a point and takes in ranks as
        long as some slope keeps all of them within ``error``. Ranks are looked
        at in windows, so memory beside the offsets is a window's."""
        rank, offset, slope = [], [], []
        at, n = 0, len(offsets)
        while at < n:
            low, high, end, width = 0.0, np.inf, at + 1, 256
            while end < n:
                x = np.arange(end, min(n, end + width)) - at
                y = offsets[end:end + width] - offsets[at]
                lows = np.maximum.accumulate(np.maximum((y - error) / x, low))
                highs = np.minimum.accumulate(np.minimum((y + error) / x, high))
                fits = int(np.argmin(lows <= highs)) if lows[-1] > highs[-1] else len(x)
                if fits:
                    low, high = lows[fits - 1], highs[fits - 1]
                end += fits
                if fits < len(x):
                    break
                width *= 2
            rank.append(at)
            offset.append(int(offsets[at]))
            slope.append((low + high) / 2 if high < np.inf else 0.0)
            at = end
        index = cls(np.array(rank), np.array(offset), np.array(slope), np.zeros(0, np.int8))
        index.residual = (offsets - index.predict(np.arange(n))).astype(np.int8)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.rank, ranks, "right") - 1
        return self.offset[s] + np.floor(self.slope[s] * (ranks - self.rank[s])).astype(np.int64)

    def __getitem__(self, ranks) -> np.ndarray:
        """Exact offsets of ``ranks``."""
        ranks = np.asarray(ranks, np.int64)
        return self.predict(ranks) + self.residual[ranks]

    @property
    def units(self) -> int:
        return len(self.residual) - 1


@dataclass
class Cut:
    n: int
    form: str
    output: str
    prefix_chars: int | None
    middle_chars: int | None


def draw(doc_id, number: int) -> tuple[int, ...]:
    """Four numbers below 2 ** 32 from a document's id (null as empty text) and the draw's number."""
    digest = hashlib.sha256(f"{number}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))


def cut(text: str, index: RankIndex, h: tuple[int, ...]) -> Cut:
    n = index.units
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= CUT_PERCENT:
        return Cut(n, "plain", text, None, None)
    i, j = (int(x) for x in index[sorted((h[0] % (n + 1), h[1] % (n + 1)))])
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h[3] % 100 < SPM_PERCENT:
        return Cut(n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", i, j - i)
    return Cut(n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", i, j - i)


def restore(output: str, form: str) -> str:
    """The text of an output. No sentinel stands in a text that was cut, and
    none arises where a part meets one, as sentinels share no beginning and end."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output.removeprefix(first).split(MIDDLE, 1)
    one, two = head.split(second, 1)
    return two + middle + one if form == "spm" else one + middle + two


COLUMNS = T.StructType([T.StructField(n, t) for n, t in (
    ("draw", T.IntegerType()), ("n", T.LongType()), ("form", T.StringType()), ("output", T.StringType()), ("prefix_chars", T.LongType()),
    ("middle_chars", T.LongType()), ("restored", T.StringType()))])


def transform(docs: DataFrame, draws: tuple[int, ...] = (1,), id_col: str = "doc_id", text_col: str = "text", error: int = ERROR) -> DataFrame:
    """``(id, draw, n, form, output, prefix_chars, middle_chars, restored)``: a
    row for each row of ``docs`` and each draw; ``restored`` is rebuilt from
    ``output`` and ``form``.

    Null and empty texts have no units, stay plain and give ''. Equal ids draw
    alike and repeated rows each get a row; null ids draw as empty text. Both
    cuts may fall on one boundary (an empty middle). Other columns are not read.
    An empty table gives an empty result. One narrow pass: no shuffle, and a
    task holds one text with its boundaries at a time.
    """
    if not 0 < error < 127:
        raise ValueError("residuals are bytes: the error must be between 1 and 126")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                index = RankIndex.fit(boundaries(text or ""), error)
                for number in draws:
                    c = cut(text or "", index, draw(doc_id, number))
                    rows.append((number, c.n, c.form, c.output, c.prefix_chars, c.middle_chars, restore(c.output, c.form)))
            ids = b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), len(draws))))
            columns = list(zip(*rows)) or [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))], names=["id", *COLUMNS.names])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *COLUMNS.fields]))


def indexes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: int = ERROR) -> DataFrame:
    """``(id, rank, offset, slope, residual)``: each text's rank index, to store
    beside the texts. Nulls, ties and repeated rows as in ``transform``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fitted = [RankIndex.fit(boundaries(t or ""), error) for t in b.column("text").to_pylist()]
            columns = [pa.array([list(getattr(x, c)) for x in fitted], pa.list_(t)) for c, t in (("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns, pa.array([x.residual.tobytes() for x in fitted], pa.binary())],
                                             names=["id", "rank", "offset", "slope", "residual"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wide = [T.StructField(c, T.ArrayType(t)) for c, t in (("rank", T.LongType()), ("offset", T.LongType()), ("slope", T.DoubleType()))]
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *wide, T.StructField("residual", T.BinaryType())]))
