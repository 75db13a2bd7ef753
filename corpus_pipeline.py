"""From raw documents to token ids: each stage applies one operator of ``entlink.llm``
to all rows that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.llm.common import table
from entlink.llm.decontam import decontaminate
from entlink.llm.linededup import dedup_lines
from entlink.llm.quality import filter_quality
from entlink.llm.queries import tokenizer_file
from entlink.llm.simhash import drop_near_duplicates
from entlink.llm.spiece import encode
from entlink.session import persist_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, equal or within two edits, in an earlier place."""
    return dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that stand in the benchmark; documents that are mostly such spans go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_ids, ids, round_trip)`` of each document."""
    out = encode(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: SQL can't express fingerprints (XXH64) and SentencePiece ids; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = persist_table(docs, f"pipeline-{i}")
    return docs
