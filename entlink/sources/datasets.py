"""Gold-data sources: CoNLL entity-disambiguation files, annotated question
JSON, raw QALD JSON, evaluation logs (S8-S11, W4, A18).

CoNLL: ``-DOCSTART-`` is used as the record separator, so each document is one
record however the file is split; lines are exploded with their position and
sentence ids are a running count of blank lines inside the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entlink.functions.text import normalise_uri

# ---- fixed values that must equal the reference's (do not change) --------
DOC_MARKER = "-DOCSTART-"
MENTION_MARKER = "en.wikipedia.org/wiki/"
PREFIX_DECL = r"PREFIX\s+(\w+:)\s+<([^>]+)>"
PREFIX_DECL_SPACE = r"PREFIX\s+\w+:\s+<[^>]+> "
LOG_HEADER = "Index|y_true|y_pred|Status"
LOG_INDEX = "Index:"
LOG_EMPTY = "Empty"                          # no prediction
LOG_NOT_PRESENT = "Not present at database"  # the status 'Not present'
URL_PATTERN = r"((?:(?:https?|ftp):\/\/)?[\w/\-?=%.]+\.[\w/\-&?=%:#]+)"
# ---------------------------------------------------------------------------


def conll_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Document records -> ``(file, record, doc_key, pos, line, sid)``; ``pos`` is
    the line number after the key line, ``sid`` the sentence of the line (a blank
    line closes sentence ``sid``). ``file`` and ``record``, the record's place in
    the scan, tell documents with equal keys apart, in one file too; text before a
    file's first marker is no document (key lines begin with a parenthesis)."""
    docs = conll_documents(spark, path)
    lines = docs.select("file", "record", "doc_key", F.posexplode(F.slice(F.split(F.array_join("blocks", "\n"), "\n"), 2, 2 ** 31 - 1)).alias("pos", "line"))
    blank = (F.col("line") == "").cast("int")
    w = Window.partitionBy("file", "record").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("sid", F.coalesce(F.sum(blank).over(w), F.lit(0)))


def conll_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, record, doc_key, blocks)``: a document's text cut at its blank lines,
    so block ``i`` holds sentence ``i``, each line of it after a newline; the last
    block is what no blank line closes."""
    raw = spark.read.option("lineSep", DOC_MARKER).text(path)
    at = F.instr("value", "\n")
    key = F.substr("value", F.lit(1), at - 1)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("record"), key.alias("doc_key"),
                      F.split(F.substr("value", at), r"\n(?=\n|\z)", -1).alias("blocks"), at.alias("_at")) \
        .where((F.col("_at") > 0) & F.col("doc_key").rlike("^\\s*\\(")).drop("_at")


def read_conll(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sentences, mentions, documents)``.

    sentences ``(doc_key, sid, text)``: text = column-1 tokens each followed by
    one space; a blank line closes a sentence (empty sentences kept); a last
    sentence without a closing blank line is kept when it has tokens.
    mentions ``(doc_key, sid, m_pos, label, uri)``: token lines holding a wiki
    URL (``m_pos`` = token index in the sentence); label = column 3, uri = column 5 normalised; per sentence one mention
    per label, at the position of the first, with the value of the last.
    documents ``(doc_key, text)``: all tokens of the document (A18). All three
    carry ``file`` and ``record``, which name a document also where keys repeat. Columns that a
    mention line lacks are null.
    """
    docs = conll_documents(spark, path)
    name = ["file", "record", "doc_key"]
    first_column = lambda line: F.concat(F.element_at(F.split(line, "\t"), 1), F.lit(" "))
    text = lambda lines: F.array_join(F.transform(lines, first_column), "")
    # a sentence is what stands between blank lines: its lines stay together, so nothing is shuffled to find them
    blocks = docs.select(*name, F.size("blocks").alias("_n"), F.posexplode("blocks").alias("sid", "_b")) \
        .select(*name, "_n", F.col("sid").cast("bigint").alias("sid"), F.filter(F.split("_b", "\n"), lambda line: line != "").alias("_lines"))
    sentences = blocks.where((F.col("sid") < F.col("_n") - 1) | (F.size("_lines") > 0)).select(*name, "sid", text("_lines").alias("text"))
    cols = F.split("line", "\t")
    m = blocks.select(*name, "sid", F.posexplode("_lines").alias("tpos", "line")).where(F.col("line").contains(MENTION_MARKER)) \
        .select(*name, "sid", "tpos", F.get(cols, F.lit(2)).alias("label"), normalise_uri(F.get(cols, F.lit(4))).alias("uri"))
    mentions = m.groupBy(*name, "sid", "label").agg(F.min("tpos").alias("m_pos"), F.max_by("uri", "tpos").alias("uri"))
    documents = docs.select(*name, F.filter(F.split(F.array_join("blocks", "\n"), "\n"), lambda line: line != "").alias("_lines")) \
        .where(F.size("_lines") > 0).select(*name, text("_lines").alias("text"))
    return sentences, mentions.select(*name, "sid", "m_pos", "label", "uri"), documents


def read_qa(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Annotated question JSON (a JSON array per file) ->
    ``(items(id, question, sparql_query, ...), mentions(id, m_pos, label, uri))``."""
    raw = spark.read.option("multiLine", True).json(path)
    items = raw.select("id", "question", "sparql_query",
                       F.col("`entity mapping`").alias("entity_mapping"),
                       F.col("`predicate mapping`").alias("predicate_mapping"))
    mentions = items.select("id", F.posexplode("entity_mapping").alias("m_pos", "_m")) \
        .where(F.col("_m.uri") != "").select("id", "m_pos", F.col("_m.label").alias("label"),
                                             F.col("_m.uri").alias("uri"))
    return items, mentions


def expand_sparql(c) -> F.Column:
    """S10 helper: drop ``PREFIX p: <iri> `` declarations, replace every ``p:``
    by its IRI (declaration order), then wrap URL-like runs in ``<>``."""
    q = F.col(c) if isinstance(c, str) else c
    names = F.regexp_extract_all(q, F.lit(PREFIX_DECL), 1)
    iris = F.regexp_extract_all(q, F.lit(PREFIX_DECL), 2)
    body = F.regexp_replace(q, PREFIX_DECL_SPACE, "")
    pairs = F.arrays_zip(names.alias("n"), iris.alias("i"))
    expanded = F.aggregate(pairs, body, lambda acc, x: F.replace(acc, x["n"], x["i"]))
    return F.regexp_replace(expanded, "(?U)" + URL_PATTERN, "<$1>")


def ingest_qald(spark: SparkSession, path: str | list[str], lang: str = "en") -> DataFrame:
    """Raw QALD JSON -> annotated items with blank mapping templates."""
    raw = spark.read.option("multiLine", True).json(path)
    q = raw.select(F.explode("questions").alias("q")).select("q.*")
    text = F.get(F.filter("question", lambda x: x["language"] == lang), F.lit(0))["string"]   # null without one
    blank = F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("uri")))
    return q.select(text.alias("question"), F.col("id").cast("string").alias("id"),
                    F.col("query.sparql").alias("sparql_query_o"),
                    expand_sparql(F.col("query.sparql")).alias("sparql_query"),
                    blank.alias("entity mapping"), blank.alias("predicate mapping"))


def read_eval_log(spark: SparkSession, path: str | list[str], header_lines: int = 2) -> DataFrame:
    """S11 + C15: ``Index:i|y_true|y_pred|Status`` lines -> ``(idx, y_true, y_pred, status)``.

    The setting-name line and the column header line are skipped (they carry
    no ``Index:<n>`` field); absent entities are logged with ``Empty`` and
    'Not present at database'.
    """
    from entlink.functions.text import log_index
    lines = spark.read.text(path)
    parts = F.split("value", r"\|")
    rows = lines.select(log_index(F.element_at(parts, 1)).alias("idx"), parts.alias("_p")) \
        .where(F.col("idx").isNotNull() & (F.size("_p") >= 4))
    status = F.element_at("_p", 4)
    return rows.select(
        "idx", F.element_at("_p", 2).alias("y_true"),
        F.when(F.element_at("_p", 3) != LOG_EMPTY, F.element_at("_p", 3)).alias("y_pred"),
        F.when(status == LOG_NOT_PRESENT, F.lit("Not present")).otherwise(status).alias("status"))


def eval_log_lines(log: DataFrame, setting: str) -> DataFrame:
    """K7 text form: one ``value`` per log line (header rows first when sorted by ``_order``)."""
    body = log.select(F.lit(2).alias("_h"), F.col("idx").alias("_order"), F.concat(
        F.lit(LOG_INDEX), F.col("idx").cast("string"), F.lit("|"), F.col("y_true"), F.lit("|"),
        F.coalesce(F.col("y_pred"), F.lit(LOG_EMPTY)), F.lit("|"),
        F.when(F.col("status") == "Not present", F.lit(LOG_NOT_PRESENT)).otherwise(F.col("status"))
    ).alias("value"))
    spark = log.sparkSession
    head = spark.createDataFrame([(0, 0, setting), (1, 0, LOG_HEADER)], "_h int, _order long, value string")
    return head.unionByName(body)
