"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered whole, by a template whose markers are special tokens
of the tokenizer, and encoded once with offsets. The spans of the turns whose
text is learned, sorted by place, are intersected with the tokens' spans by
binary search. Control strings inside texts are escaped reversibly, so that a
text can neither end a turn nor start one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import prepare

#: A turn is TURN role TEXT text END.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED = ("assistant",)
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
#: Conversations that a worker formats before it hands them on.
HAND_ON = 64

FORMATTED = T.StructType([
    T.StructField("formatted", T.StringType()), T.StructField("n_turns", T.LongType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("token_starts", T.ArrayType(T.IntegerType())),
    T.StructField("token_ends", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))])


def escape(text: str) -> str:
    """Every ``<`` that ``|`` follows, after backslashes or none, gets one backslash more: no ``<|`` is left."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], learned: tuple[str, ...] = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of its learned texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{TURN}{escape(role)}{TEXT}"
        body = escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token has a character in some span. Spans are sorted and
    apart: of those that end after the token's start, only the first can meet it."""
    if not spans:
        return np.zeros(len(starts), bool)
    lo, hi = np.array([s for s in spans if s[0] < s[1]] or [(0, 0)]).T
    i = np.searchsorted(hi, starts, side="right")
    return (i < len(hi)) & (ends > starts) & (lo[np.minimum(i, len(lo) - 1)] < ends)


def masked_text(formatted: str, starts, ends, mask) -> str:
    """The text that masked tokens cover, unescaped. Tokens of one character
    (its bytes) share it; it is read once. A piece ends where no masked token
    goes on, so escapes of different turns don't run together."""
    starts, ends = starts[mask], np.maximum.accumulate(ends[mask])
    if not len(starts):
        return ""
    apart = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    pieces = zip(starts[np.r_[0, apart]].tolist(), ends[np.r_[apart - 1, len(ends) - 1]].tolist())
    return "".join(unescape(formatted[s:e]) for s, e in pieces)


def slices(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column without nulls, as arrays."""
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[s:e] for s, e in zip(ends, ends[1:])]


def load_tokenizer(tokenizer_file: str):
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(tokenizer_file)
    t.no_truncation()
    t.no_padding()
    t.add_special_tokens([TURN, TEXT, END])
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep white space
    return t


def _formatter(tokenizer_file: str, learned: tuple[str, ...]):
    """For mapInArrow over rows sorted by conversation and turn: one row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_file)
        done: list[dict] = []
        turns: list[tuple[str, str]] = []
        key = id_type = None

        def close() -> None:
            formatted, spans = render(turns, learned)
            encoded = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = encoded.offsets
            starts, ends = np.fromiter(chain.from_iterable(offsets), np.int32, 2 * len(offsets)).reshape(-1, 2).T
            done.append({"id": key[0], "formatted": formatted, "n_turns": len(turns), "input_ids": np.array(encoded.ids, np.int32),
                         "token_starts": starts.copy(), "token_ends": ends.copy(), "loss_mask": mask_tokens(starts, ends, spans)})

        def hand_on() -> pa.RecordBatch:
            types = {"id": id_type, "formatted": pa.string(), "n_turns": pa.int64(), "input_ids": pa.list_(pa.int32()),
                     "token_starts": pa.list_(pa.int32()), "token_ends": pa.list_(pa.int32()), "loss_mask": pa.list_(pa.bool_())}
            out = pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in types.items()], names=list(types))
            done.clear()
            return out

        for b in batches:
            id_type = b.schema.field("id").type
            for i, role, text in zip(*(b.column(c).to_pylist() for c in ("id", "role", "text"))):
                if key is not None and (i,) != key:
                    close()
                    turns = []
                    if len(done) >= HAND_ON:
                        yield hand_on()
                key = (i,)
                turns.append((role or "", text or ""))
        if key is not None:
            close()
            yield hand_on()

    return run


def format_conversations(turns: DataFrame, tokenizer_file: str, learned: tuple[str, ...] = LEARNED, id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row ``(id, formatted, n_turns, input_ids, token_starts, token_ends,
    loss_mask)`` for each conversation.

    Turns are ordered by turn number, nulls first, ties by role and text;
    repeated rows are turns of their own. Null roles and texts are empty, an
    empty text has no tokens. Rows with a null id make one conversation. Other
    columns are not read. An empty table gives an empty result. Rows are
    shuffled by conversation and sorted; a worker holds one conversation and a
    few formatted ones. A conversation is one text, so it is one task's work.
    """
    prepare(turns.sparkSession)
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    return rows.mapInArrow(_formatter(tokenizer_file, learned), T.StructType([rows.schema["id"], *FORMATTED]))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of turns and of the text under the mask, from formatted rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, starts, ends, mask in zip(b.column("formatted").to_pylist(), *(slices(b.column(c)) for c in ("token_starts", "token_ends", "loss_mask"))):
                turns = parse(text)
                loss = masked_text(text, starts, ends, mask)
                out.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                            len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(mask), int(mask.sum())))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *arrays], names=[id_col, *NAMES])

    NAMES = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
    fields = [T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in NAMES]
    return formatted.mapInArrow(run, T.StructType([T.StructField(id_col, formatted.schema["id"].dataType), *fields]))
