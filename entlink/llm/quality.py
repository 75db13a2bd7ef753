"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and stores, beside the measurements, one
integer whose bits name the rules that the text fails. Policies are versioned
masks over those bits: applying one, or asking what a rule costs, never reads a
text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entlink.llm.common import computed, split_words

#: Words in a window of the repetition rule.
REPEAT_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")


@dataclass(frozen=True)
class Rule:
    """``bit`` is the rule's place in the ledger for good; ``fails`` is SQL over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "upper_case", "100 * n_upper > 50 * word_chars"),
    Rule(5, "exclamations", "100 * n_bangs > 40 * n_words"),
    Rule(6, "short_words", "word_chars < 2 * n_words"),
    Rule(7, "long_words", "word_chars > 40 * n_words"),
)
#: The bits of the contract's ``base_failed``.
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any rule of ``mask``."""

    name: str
    version: int
    mask: int


POLICIES = (
    Policy("base", 1, BASE),
    Policy("web", 1, 0b11110111),
    Policy("web", 2, 0b11111111),
)
#: The policy that the query and the pipeline apply.
PRODUCTION = POLICIES[1]


def _windows(word_hashes: str, n: int) -> Column:
    """Hashes of the windows of ``n`` neighbouring words."""
    h = F.col(word_hashes)
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + k] for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *MEASURES)`` of every row; see ``ledger``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    word_lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    step = rows.select(
        "id",
        (F.char_length("text") - F.regexp_count("text", F.lit("[ \\t-\\r]"))).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("bigint").alias("n_bangs"),
        word_lines.alias("lines"),
        F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
    )
    step = step.select(
        "id", "word_chars", "n_symbols", "n_upper", "n_bangs",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _windows("words", REPEAT_WINDOW).alias("windows"),
    )
    # Most texts repeat no window: only the others sort theirs, by hash and place.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    step = step.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))))
    beside = lambda i: F.get(F.col("sorted"), i)["h"]
    twice = F.filter("sorted", lambda x, i: (x["h"] == F.coalesce(beside(i - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(beside(i + 1), F.bitwise_not(x["h"]))))
    step = step.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["at"])))
    # each start covers the words up to the next start, REPEAT_WINDOW at most
    covered = F.transform("starts", lambda p, j: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(F.col("starts"), j + 1) - p, F.lit(REPEAT_WINDOW))))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    return step.select("id", *MEASURES)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *MEASURES, fail_bits)`` of every row of ``docs``.

    One narrow pass over whole texts: no shuffle, so skew doesn't matter, and
    memory is that of the longest text. A null text measures like an empty one
    (no words: it fails ``few_words``). Repeated rows each get a row; ids may be
    null or tied. Other columns are not read, whatever their names. An empty
    table gives an empty ledger. Windows are compared by 64-bit hashes.
    """
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def passes(policy: Policy, fail_bits: Column | None = None) -> Column:
    bits = F.col("fail_bits") if fail_bits is None else fail_bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablation(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that fail the rule, that
    the policy rejects, and that it would keep without the rule. The ledger is
    first counted by its bits (at most ``2 ** len(rules)`` rows)."""
    cases = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"),
                      F.lit(p.mask).cast("bigint").alias("mask"), F.lit(1 << r.bit).cast("bigint").alias("one"))
             for p in policies for r in rules if p.mask >> r.bit & 1]
    counted = book.groupBy("fail_bits").count().withColumn("case", F.explode(F.array(*cases))).select("*", "case.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0)).alias
    return counted.groupBy("policy", "version", "rule").agg(
        total(failed.bitwiseAND(F.col("one")) != 0)("n_failing"), total(failed != 0)("n_rejected"), total(failed == F.col("one"))("n_only_this_rule"))


def filter_quality(docs: DataFrame, policy: Policy = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with their columns. Works on
    each row where it is: ids aren't used, so they may be null or tied. A null
    text has no words and goes."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).select(F.struct(*names).alias("row"), F.col(names[docs.columns.index(text_col)]).alias("t"))
    book = ledger(rows, id_col="row", text_col="t")
    book = book.select("id", computed(F.col("fail_bits")).alias("fail_bits"))
    return book.filter(passes(policy)).select("id.*").toDF(*docs.columns)
