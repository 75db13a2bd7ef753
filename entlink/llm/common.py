"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.session import ensure_checkpoint_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch: texts may be long, so a batch holds fewer than Spark's 10,000.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Make executors' Python workers able to import the package, the shared
    checkpoint folder known, and Arrow batches small enough for long texts."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other letters)."""
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), "[ \\t-\\r]+"), "")


def computed(value: Column) -> Column:
    """A column that filters above don't merge with: a predicate that is pushed
    below a projection would copy the column's expression, and what its lambdas
    read, into itself, and work it out anew for every array element."""
    return F.explode(F.array(value))


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def pieces(data: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, cut only before ASCII white
    space, so no word is split and memory for word lists stays bounded."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end
