"""Text column expressions.

Every function maps Column -> Column with built-in Spark SQL expressions
(Java regex), so it stays inside whole-stage codegen where Spark allows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from entlink.functions.util import col as _c

# ---- fixed values that must equal the reference's (do not change) --------
# language suffix of a literal: '@en', a space and any one character
LANG_SUFFIX_PATTERN = r"\r?@en ."
# characters kept by the literal cleaner (encoding side)
KEEP_CLASS_ENCODE = r"""[^a-zA-Z0-9()'".,:<>?!@$%&|\s]+"""
# characters kept by the cleaner on the evaluation side; '"-.' is a range,
# so '# * + -' are kept as well
KEEP_CLASS_EVAL = r"""[^a-zA-Z0-9()'"-.,:<>?!@$%&|\s]+"""
# characters stripped from both ends after cleaning
STRIP_CHARS = '[" ]'
# predicates that name an entity (label blend, CONCAT strategy)
LABEL_PREDICATES = ["http://www.w3.org/2000/01/rdf-schema#label", "http://xmlns.com/foaf/0.1/name"]
# wiki URL rewrite for gold URIs
WIKI_PREFIX = "en.wikipedia.org/wiki"
KG_PREFIX = "dbpedia.org/resource"
# ---------------------------------------------------------------------------

# Java's '.' also stops at \r, \u0085, \u2028, \u2029; UNIX_LINES mode makes
# it stop at '\n' only, like the reference's regex engine and RE2.
_SUFFIX = "(?d)" + LANG_SUFFIX_PATTERN


def clean_literal(c) -> Column:
    """Drop the '@en' suffix, delete chars outside the kept class, strip ends."""
    x = F.regexp_replace(_c(c), _SUFFIX, "")
    x = F.regexp_replace(x, KEEP_CLASS_ENCODE, "")
    return F.btrim(x, F.lit(STRIP_CHARS))


def clean_eval(c) -> Column:
    """Evaluation-side cleaner (wider kept class)."""
    x = F.regexp_replace(_c(c), _SUFFIX, "")
    x = F.regexp_replace(x, KEEP_CLASS_EVAL, "")
    return F.btrim(x, F.lit(STRIP_CHARS))


def strip_lang_suffix(c) -> Column:
    """Only remove the language suffix."""
    return F.regexp_replace(_c(c), _SUFFIX, "")


def fold(c) -> Column:
    """Case folding used for every matching key."""
    return F.lower(_c(c))


def normalise_uri(c) -> Column:
    """Add 'http://' when absent, map wiki URLs to KG resource URIs."""
    x = _c(c)
    x = F.when(F.instr(x, "http://") == 0, F.concat(F.lit("http://"), x)).otherwise(x)
    return F.replace(x, F.lit(WIKI_PREFIX), F.lit(KG_PREFIX))


def camel_split(c) -> Column:
    """C13: 'camelCase' -> 'camel Case'."""
    return F.regexp_replace(_c(c), r"([a-z0-9])([A-Z])", "$1 $2")


def sentences(c) -> Column:
    """Sentence split used by C4 and F9: a run of non-terminators followed by
    its terminators, trimmed; empty pieces dropped."""
    parts = F.regexp_extract_all(_c(c), F.lit(r"[^.!?]+[.!?]*"), 0)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def packed(parts: list[str], max_len: int) -> list[str]:
    """Sentences packed into chunks, by jumps: the end of each chunk is found by
    binary search in the running sum of lengths. The first chunk has a space after
    each sentence, a later one after each but its first (the rule of C4)."""
    import numpy as np
    ends = np.cumsum([len(s) + 1 for s in parts])      # with a space each
    out, at = [], 0
    while at < len(parts):
        before = int(ends[at - 1]) if at else 0
        spare = 2 if at else 1                         # spaces that the sum has and the comparison hasn't
        end = max(at + 1, int(np.searchsorted(ends, max_len + before + spare, "right")))
        head = parts[at] + (" " if at == 0 else "")
        out.append(head + "".join(s + " " for s in parts[at + 1:end]))
        at = end
    return out


def chunk_text(c, max_len: int) -> Column:
    """C4: greedy packing of sentences into chunks of at most ``max_len`` chars.

    Texts not longer than ``max_len`` stay whole; null stays one null chunk.
    Otherwise a sentence joins the buffer when ``len(buf + sent) <= max_len`` or
    the buffer is empty, then ``buf = buf + sent + ' '``; else the buffer is
    emitted and ``buf = sent``. A long text is linear in its sentences
    (``packed``, in Arrow batches); short ones never leave the JVM's columns.
    """
    text = _c(c)

    @F.pandas_udf("array<string>")
    def pack(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: None if x is None else packed(list(x), max_len))

    long = F.length(text) > max_len
    return F.when(long, pack(F.when(long, sentences(text)))).otherwise(F.array(text))


def tokens(c) -> Column:
    """Lower-case alphanumeric tokens (used by the hashing encoder)."""
    return F.filter(F.split(F.lower(_c(c)), r"[^a-z0-9]+"), lambda t: t != "")


def mention_window(text_tokens, mention_tokens, radius: int) -> Column:
    """Words around a mention.

    Positions are every text token equal to any mention token, in mention-token
    order; left = first such position, right = last. Result is the text tokens
    ``[left-radius, left)`` + the mention tokens + ``(right, right+radius]``,
    clipped to the text, joined by spaces. NULL when no token matches.
    """
    t = _c(text_tokens)
    m = _c(mention_tokens)
    idx = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))
    hits = F.flatten(F.transform(m, lambda mt: F.filter(idx, lambda i: F.element_at(t, i) == mt)))
    left = F.element_at(hits, 1)
    right = F.element_at(hits, -1)
    lb = F.greatest(left - radius, F.lit(1))
    rb = F.least(right + radius, F.size(t))
    before = F.slice(t, lb, left - lb)
    after = F.when(rb > right, F.slice(t, right + 1, rb - right)).otherwise(F.array().cast("array<string>"))
    out = F.array_join(F.concat(before, m, after), " ")
    return F.when(F.size(hits) > 0, out)


def setting_name(model, weighted, strategy, top_n, top_n_way, context=None, dataset=None) -> Column:
    """C14: experiment setting name, e.g. 'ST_NotWGT_AVG_Top2Grouped_ContWithMention_qald-7'."""
    tn = _c(top_n)
    top = F.when(tn.isNull(), F.lit("TopNone")) \
           .when(_c(top_n_way) == "GROUPED", F.concat(F.lit("Top"), tn.cast("string"), F.lit("Grouped"))) \
           .otherwise(F.concat(F.lit("Top"), tn.cast("string"), F.lit("Simple")))
    parts = [_c(model), F.when(_c(weighted), F.lit("WGT")).otherwise(F.lit("NotWGT")), _c(strategy), top]
    name = F.concat_ws("_", *parts)
    if context is not None:
        name = F.concat(name, F.when(_c(context), F.lit("_ContWithMention")).otherwise(F.lit("_ContWithoutMention")))
    if dataset is not None:
        name = F.concat_ws("_", name, _c(dataset))
    return name


def log_index(c) -> Column:
    """First integer after 'Index:' or 'i:' in a log line."""
    x = F.regexp_extract(_c(c), r"(?:Index|i):\s*(\d+)", 1)
    return F.when(x != "", x.cast("int"))
