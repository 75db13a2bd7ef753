"""Token counts with a digest cache.

The cache is a Parquet folder of ``(content, tokenizer, n_tokens)``: SHA-256 of
a text's normalised content, SHA-256 of the tokenizer file, and the count. A
call joins the texts' digests with the cache, encodes one text for each digest
that is missing, appends those counts, and joins counts back to all texts.
Texts are shuffled once at most (only those that have to be encoded), by their
unique ids, so a text that a third of all documents share stays one task's
single row; the join of counts with documents moves 40 bytes a document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.llm.common import pieces, prepare
from entlink.session import persist_table

CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens bigint"
#: Words whose counts a worker remembers before it starts anew.
MEMO_WORDS = 1_000_000


def drops_white_space(tokenizer_file: str) -> bool:
    """Whether the tokenizer's own rules put no white space into any token: it
    folds white space to one space and keeps only matches of a pattern that
    has none. Its count of a text is then the sum over the text's words."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    rules = (spec.get("normalizer") or {}).get("normalizers", [])
    folds = any(r.get("type") == "Replace" and r.get("pattern") == {"Regex": "\\s+"} and r.get("content") == " " for r in rules)
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    keeps = any(c.get("type") == "Split" and c.get("behavior") == "Removed" and c.get("invert")
                and "[^\\s\\p{L}\\p{N}]+" in c.get("pattern", {}).get("Regex", "") for c in cuts)
    return folds and keeps


def normalised(text: Column, white_space_free: bool) -> Column:
    """The content that a digest stands for: null as empty, and runs of ASCII
    white space as one space where the tokenizer doesn't see the difference."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ") if white_space_free else text


def tokenizer_digest(tokenizer_file: str) -> bytes:
    with open(tokenizer_file, "rb") as f:
        return hashlib.sha256(f.read()).digest()


class Counter:
    """Counts tokens of texts in a worker, with a bounded memory of words."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = drops_white_space(tokenizer_file)
        self.memo: dict[bytes, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self._encode(texts)
        return [sum(self._count_words(part.split()) for part in pieces(t.encode())) for t in texts]

    def _count_words(self, words: list[bytes]) -> int:
        new = list(set(words).difference(self.memo))
        if new:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
                new = list(set(words))
            self.memo.update(zip(new, self._encode([w.decode() for w in new])))
        return sum(map(self.memo.__getitem__, words))


def count_batches(tokenizer_file: str):
    """For mapInArrow over ``(content, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(tokenizer_file)
        for b in batches:
            n = pa.array(counter.count(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("content"), n], names=["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The cache, or an empty one where the folder doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)


def counts_of(spark: SparkSession, cache_dir: str, version: bytes) -> DataFrame:
    """``(content, n_tokens)`` of a tokenizer, one row a digest: two writers, or a
    job that ran again, may have appended the same digests, with equal counts."""
    rows = read_cache(spark, cache_dir).filter(F.col("tokenizer") == F.lit(version))
    return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_file: str, cache_dir: str,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row of ``docs``.

    Counts are the library's for the whole text, without special tokens added.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and equal ids
    each get a row; null ids stay null. Other columns of ``docs``, whatever
    their names, are not read. An empty table gives an empty result. Missing
    digests are appended to ``cache_dir``; a second call encodes nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    version = tokenizer_digest(tokenizer_file)
    free = drops_white_space(tokenizer_file)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(normalised(F.col("text"), free), 256))

    keyed = persist_table(rows.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), digest.alias("content")), "token-keys")
    known = counts_of(spark, cache_dir, version)
    first = F.min(F.struct("id", F.col("n_bytes"))).alias("first")
    misses = keyed.groupBy("content").agg(first, F.count("*").alias("n_rows")).join(known, "content", "left_anti")
    misses = persist_table(misses.select(F.col("content").alias("missing"), F.col("first.id").alias("rep"), "n_rows"), "token-misses")
    texts = rows.withColumn("content", digest).join(misses, F.col("id").eqNullSafe(F.col("rep")) & (F.col("content") == F.col("missing")))
    # rows that share id and content: one text of theirs is encoded (few, and the rest isn't shuffled)
    same = keyed.join(misses.filter("n_rows > 1"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("content") == F.col("missing")))
    if same.groupBy("missing").count().filter("count > 1").limit(1).count():
        several = persist_table(same.groupBy("missing").count().filter("count > 1").select(F.col("missing").alias("content")), "token-repeated")
        once = texts.join(several, "content", "left_semi").groupBy("content").agg(F.min("text").alias("text"))
        texts = texts.join(several, "content", "left_anti").select("content", "text").union(once)
    found = texts.select("content", "text").mapInArrow(count_batches(tokenizer_file), "content binary, n_tokens bigint")
    (found.dropDuplicates(["content"]).select("content", F.lit(version).alias("tokenizer"), "n_tokens")
     .write.mode("append").parquet(cache_dir))

    counts = persist_table(counts_of(spark, cache_dir, version), "token-counts")
    return keyed.join(counts, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
