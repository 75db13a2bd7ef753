"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit positions of a fingerprint are mapped to the non-zero vectors of
``radius + 1`` bits; for every non-zero vector ``v`` there is a table whose mask
has the positions that ``v`` meets in an odd number of bits. ``radius`` positions
or fewer span no more than ``radius`` dimensions, so some ``v`` meets none of
them: every pair within the radius agrees on that table's whole mask. There are
``2 ** (radius + 1) - 1`` tables, each with about half of the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.llm.common import prepare
from entlink.llm.components import components
from entlink.operators.linking import key_filter, mark_possible
from entlink.session import persist_table

SHINGLE = 3
RADIUS = 3
#: Fingerprints of one bucket that a task compares at once; larger buckets are
#: dealt out in blocks, and every two blocks meet in some task.
BLOCK = 1024
#: Ids are broadcast up to this size, 32 bytes each.
BROADCAST_BYTES = 32 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set where more than half of the shingles' hashes have it set; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # of bytes: ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    at = list(zip(starts[:n].tolist(), ends[shingle - 1:].tolist()))
    for k in range(0, n, 100_000):
        hashes = np.array([xxh64_intdigest(line[s:e], 42) for s, e in at[k:k + 100_000]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())]))


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Position ``p`` belongs to vector ``p mod (2 ** (radius + 1) - 1) + 1``."""
    vectors = range(1, 1 << (radius + 1))
    of = [p % len(vectors) + 1 for p in range(bits)]
    return [sum(1 << p for p in range(bits) if (v & of[p]).bit_count() & 1) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(radius: int):
    """For mapInArrow over ``(task, tab, key, fp)`` sorted by the first three:
    links of fingerprints within the radius in each bucket. Of a bucket's links
    those that join what is apart so far are returned, one less than it has
    fingerprints at most; all its pairs are compared, none is built as a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        bucket = None
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            fps = np.unique(np.array(held, np.int64))
            root = np.arange(len(fps))
            for i in range(len(fps) - 1):
                near = np.flatnonzero(np.bitwise_count((fps[i + 1:] ^ fps[i]).view(np.uint64)) <= radius) + i + 1
                for j in near[root[near] != root[i]].tolist():
                    if root[j] != root[i]:
                        a.append(int(fps[i]))
                        b.append(int(fps[j]))
                        root[root == root[j]] = root[i]

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("i", "j", "tab", "key", "fp"))
            for i, j, t, k, fp in zip(*columns):
                if (i, j, t, k) != bucket:
                    if len(held) > 1:
                        close()
                    bucket, held = (i, j, t, k), []
                held.append(fp)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if len(held) > 1:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links that connect all distinct fingerprints within ``radius``
    bits of each other (enough of them for the components, not every pair)."""
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(covering_masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.*")
    sizes = rows.groupBy("tab", "key").count().filter("count > 1")
    sizes = persist_table(sizes.select("tab", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "simhash-buckets")
    rows = rows.join(sizes, ["tab", "key"])
    # A fingerprint of block x meets every block y in the task of (x, y), the smaller first.
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.least("own", "y").alias("i"), F.greatest("own", "y").alias("j"), "tab", "key", "fp")
    rows = rows.repartition("tab", "key", "i", "j").sortWithinPartitions("i", "j", "tab", "key")
    return rows.mapInArrow(bucket_links(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` of every row of ``docs``: the fingerprint and
    the smallest id that is reachable over links of ``radius`` bits or fewer.

    Words are runs without ASCII white space, A-Z lower-cased. Null and empty
    texts have fingerprint 0 and link like others. Equal fingerprints are one
    node, so copies make no links; repeated rows each get a row. Null ids are
    skipped in the smallest id (null only if a component has no other).
    Other columns are not read. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = persist_table(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    firsts = persist_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    labels = components(persist_table(near_links(firsts, radius), "simhash-links"))
    linked = firsts.join(labels, firsts["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = persist_table(linked.join(smallest, "label").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, and of each component the row with the smallest
    id. Where several rows share that id, the smallest by text stays. Rows whose
    id is null can't be named as a group's and all stay. An empty table gives an
    empty result; other columns are carried along, whatever their names.

    Ids that go are few beside the documents: while they fit ``BROADCAST_BYTES``
    no text is shuffled; beyond, a Bloom filter of them is broadcast and only
    documents that pass it are."""
    found = near_duplicates(docs, shingle, radius, id_col, text_col).filter(F.col("id").isNotNull())
    found = persist_table(found.groupBy("id").agg(F.count_if(F.col("id") == F.col("component_id")).alias("n_kept")), "simhash-kept")
    gone, many = found.filter("n_kept = 0").select(F.col("id").alias("gone")), found.filter("n_kept > 1").select(F.col("id").alias("many"))
    n_gone, n_many = found.agg(F.count_if(F.col("n_kept") == 0), F.count_if(F.col("n_kept") > 1)).first()
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = _without(docs.toDF(*names), gone, "gone", id_, n_gone)
    if n_many:
        # rows that share a kept id: one of each stays
        one = rows.join(_bounded(many, n_many), F.col(id_) == F.col("many"), "left_semi")
        one = one.groupBy(id_).agg(F.min(F.struct(text, *names)).alias("row")).select("row.*").toDF("_", *names).select(*names)
        rows = _without(rows, many, "many", id_, n_many).union(one)
    return rows.toDF(*docs.columns)


def _bounded(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if 32 * n <= BROADCAST_BYTES else ids


def _without(rows: DataFrame, ids: DataFrame, name: str, id_: str, n: int) -> DataFrame:
    """The rows whose id isn't among the ``n`` of ``ids``."""
    same = F.col(id_) == F.col(name)
    if 32 * n <= BROADCAST_BYTES:
        return rows.join(F.broadcast(ids), same, "left_anti")
    bloom = persist_table(key_filter(ids.withColumnRenamed(name, "_k"), n), f"simhash-{name}-filter")
    marked = mark_possible(rows.withColumn("_k", F.col(id_)), bloom, n)
    return marked.filter("not _possible").select(*rows.columns).union(marked.filter("_possible").select(*rows.columns).join(ids, same, "left_anti"))
