"""RDF line dumps and stage-table sources.

``read_ntriples`` is a splittable line scan (plain or bz2) parsed by regular
expressions into typed columns. Bad bytes: lines keep their bytes, and those
that aren't valid UTF-8 are read as ISO-8859-1 (S2), so a file mixing both
encodings keeps every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a triple line: subject IRI, predicate IRI, object token, final dot
LINE_PATTERN = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(<[^>]*>|".*"(?:@[A-Za-z][A-Za-z0-9-]*|\^\^<[^>]*>)?)\s*\.\s*$'
# object token: quoted literal with an optional language tag or datatype
LITERAL_PATTERN = r'^"(.*)"(?:@([A-Za-z][A-Za-z0-9-]*)|\^\^<([^>]*)>)?$'

# what follows the last quote of such a literal, if no datatype holds a quote
END_PATTERN = r'^(?:|@[A-Za-z][A-Za-z0-9-]*|\^\^<[^>]*>)$'

TRIPLE_SCHEMA = "s string, p string, o_iri string, o_lit string, lang string, dtype string"

EMBEDDING_SCHEMA = T.StructType([
    T.StructField("s", T.StringType(), True),
    T.StructField("p", T.StringType(), True),
    T.StructField("o", T.StringType(), True),
    T.StructField("typeObject", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType(), True), True),
    T.StructField("count", T.LongType(), True),
    T.StructField("top_n", T.IntegerType(), True),
])


def _nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def parse_ntriples(lines: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Parse N-Triples lines into ``(s, p, o_iri, o_lit, lang, dtype)``.

    One anchored line pattern yields subject, predicate and object token;
    a literal object is split into text, language tag and datatype. Comment lines, blank lines and lines that are not one triple are
    dropped. Literal text is unescaped for ``\\"`` only.
    """
    v = F.col(value)
    keep = keep or []
    # of a line that matches, subject and predicate are what the first two pairs of angle brackets
    # hold, so the pattern is run for the object alone
    after = F.substr(v, F.instr(v, ">") + 1)
    inside = lambda x: F.substr(x, F.instr(x, "<") + 1, F.instr(x, ">") - F.instr(x, "<") - 1)
    # exploded, a line is parsed once: later filters on the columns would otherwise repeat the expressions
    token = F.filter(F.array(F.regexp_extract(v, LINE_PATTERN, 3)), lambda o: o != "")
    parts = F.transform(F.transform(token, lambda o: F.struct(o.alias("o"), F.substring_index(o, '"', -1).alias("end"))), lambda t: _object(t["o"], t["end"]))
    return lines.select(*keep, inside(v).alias("s"), inside(after).alias("p"), F.inline(parts))


def _object(o: Column, end: Column) -> Column:
    """The object's columns, of its token and what follows the token's last quote. Where
    that is a tag, a datatype or nothing it is what the pattern finds; else the pattern is run."""
    is_iri, plain = o.startswith("<"), end.rlike(END_PATTERN)
    part = lambda n: F.regexp_extract(o, LITERAL_PATTERN, n)
    text = F.when(plain, F.substr(o, F.lit(2), F.length(o) - F.length(end) - 2)).otherwise(part(1))
    tag = F.when(end.startswith("@"), F.substr(end, F.lit(2)))
    iri = F.when(end.startswith("^"), F.substr(end, F.lit(4), F.length(end) - 4))
    return F.struct(
        F.when(is_iri, F.substr(o, F.lit(2), F.length(o) - 2)).alias("o_iri"),
        F.when(~is_iri, F.replace(text, F.lit('\\"'), F.lit('"'))).alias("o_lit"),
        F.when(~is_iri, _nullif_empty(F.when(plain, tag).otherwise(part(2)))).alias("lang"),
        F.when(~is_iri, _nullif_empty(F.when(plain, iri).otherwise(part(3)))).alias("dtype"))


def read_lines(spark: SparkSession, paths: str | list[str], latin1_fallback: bool = True) -> DataFrame:
    """One splittable scan over many line files (``.bz2`` allowed).

    Returns ``(value, file_path)``. With ``latin1_fallback`` a line that isn't
    valid UTF-8 is read as ISO-8859-1.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths)
    value = decoded("value") if latin1_fallback else F.col("value")
    return raw.select(value.alias("value"), F.col("_metadata.file_path").alias("file_path"))


def decoded(value: str = "value") -> Column:
    """A line of the text source, whose bytes are those of the file, read as
    ISO-8859-1 where they aren't UTF-8."""
    v = F.col(value)
    return F.when(F.is_valid_utf8(v), v).otherwise(F.decode(v.cast("binary"), "ISO-8859-1"))


def lang_gate(triples: DataFrame, lang: str = "en") -> DataFrame:
    """S3: keep IRIs, untagged literals and literals tagged ``lang`` / ``lang-*``."""
    tag = F.lower(F.col("lang"))
    return triples.where(F.col("lang").isNull() | (tag == lang) | tag.startswith(lang + "-"))


def lang_gate_strict(lines: DataFrame, lang: str = "en", value: str = "value") -> DataFrame:
    """S3 strict: whole-line test, a line with '@' must contain '@<lang>'."""
    v = F.col(value)
    return lines.where((F.instr(v, "@") == 0) | (F.instr(v, "@" + lang) > 0))


def read_ntriples(spark: SparkSession, paths: str | list[str], latin1_fallback: bool = True,
                  lang: str | None = "en", strict: bool = False) -> DataFrame:
    """Dump files -> triples (+ ``file_path``), language-gated at ingest."""
    lines = read_lines(spark, paths, latin1_fallback)
    if lang and strict:
        lines = lang_gate_strict(lines, lang)
    t = parse_ntriples(lines, keep=["file_path"])
    if lang and not strict:
        t = lang_gate(t, lang)
    return t


def read_disambiguation(triples_with_file: DataFrame, marker: str = "disambiguation") -> DataFrame:
    """Disambiguation links = link triples read from files whose path holds ``marker``."""
    return triples_with_file.where(F.col("file_path").contains(marker) & F.col("o_iri").isNotNull()) \
        .select("s", "p", F.col("o_iri").alias("o"))


def read_triples_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited CSV with header, all columns strings (no inference)."""
    return spark.read.options(header=True, delimiter="|", inferSchema=False).csv(path)


def read_embeddings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Embedding rows with the explicit full schema (literal and entity rows)."""
    if fmt == "json":
        return spark.read.schema(EMBEDDING_SCHEMA).json(path)
    df = spark.read.parquet(path)
    for f in EMBEDDING_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in EMBEDDING_SCHEMA.fields])
