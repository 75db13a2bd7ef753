"""Vector search.

Exact nearest-neighbour join of a query set (mentions) against the vector table
(the big side), and the expansion of its hits, as scans of the vector table:

* the query set is written once to the shared checkpoint directory by a Spark
  job (``stage_queries``); its row count is then known, which bounds every
  broadcast made from it;
* each vector partition runs ``mapInArrow``: vectors are taken in blocks of
  bounded size, and for each block the staged queries are read chunk by chunk
  from storage, so that a worker holds one block and one chunk whatever the
  number of queries. Distances of a block and a chunk are one numpy product; per
  query only its k first rows in ``(distance, tie-break)`` order are returned,
  and of those only rows within its bound;
* a query's bound is the smallest k-th distance seen so far: that of a sampled
  pass (k rows of a sample that are so near prove that all answers are), then
  those of the task's own blocks;
* the lists are merged in two levels, ``(query, salt)`` then ``query``, so that
  the last merge of a query gets a few lists, not one for each task.

The expansion (``candidates``) is a second scan of the same kind: the chunks
carry the subjects that each query hit, and distances, to the query and to other
vectors of it (its context), are worked out where the vectors are. No vector is
ever shuffled, and no pair of (query, vector) rows is materialised beyond the
returned rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.functions import vectors as V
from entlink.session import local_path, persist_table, scratch_path, ship_package

# ---- fixed values that must equal the reference's (do not change) --------
TOP_K = 100              # vector rows fetched per mention
RANGE_MAX_DISTANCE = 1.0  # fallback range search: cosine distance below this
RANGE_LIMIT = 10000       # fallback range search: nearest rows kept
IVF_CELLS, IVF_PROBES, IVF_ITERATIONS, IVF_PER_CELL = 250, 10, 10, 30  # blocked search: cells, cells probed, k-means iterations, rows of a cell
# ---------------------------------------------------------------------------

# Mention-sized tables are broadcast only below this estimated size; the row
# count (and vector width) of a staged query set is known exactly.
BROADCAST_BYTES = 64 * 1024 * 1024
KEY_ROW_BYTES = 128      # a (key, uri) row
METRICS = ("cosine", "l2", "dot")
QUERY_CHUNK = 1024       # queries held at once
BLOCK_BYTES = 32 << 20   # vectors held at once
SLICE_ROWS = 4096        # vectors of one distance product
HELD_ROWS = 1_000_000    # (query, row) pairs held before a prune
SAMPLE_SHARE = 64        # the sampled pass takes one row in so many
IVF_SAMPLE_ROWS = 1_000_000   # vectors that the cells' centres are fitted to, in the mean
IVF_CHOICES = 16         # nearest cells that a vector may be given
IVF_COPIES = 2           # cells that a vector stands in
IVF_ROUNDS = 12          # rounds in which full cells pass rows on
SMALL_SCANS = 32         # scans of fewer tasks need neither sampled bounds nor a second merge level


@dataclass
class QuerySet:
    """A staged query set: parquet at ``path`` with columns ``_q``, ``_qv`` and,
    where given, ``_g`` (group), ``_b`` (bound) and carried columns."""
    path: str
    n: int
    key_type: T.DataType
    dim: int = 0
    grouped: bool = False

    @property
    def row_bytes(self) -> int:
        return 16 + 8 * self.dim

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def stage_queries(queries: DataFrame, key: str, vec: str, group: str | None = None,
                  carry: dict[str, Column] | None = None) -> QuerySet:
    """Write the query set (``_q`` key, ``_qv`` vector, optional ``_g`` group,
    columns ``carry``) to the shared checkpoint folder; returns its exact size."""
    spark = queries.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "queries")
    cols = [F.col(key).alias("_q"), F.col(vec).cast("array<double>").alias("_qv")]
    if group:
        cols.append(F.col(group).cast("string").alias("_g"))
    q = queries.select(*cols, *[c.alias(n) for n, c in (carry or {}).items()]).where(F.col("_qv").isNotNull())
    q.write.parquet(path)
    staged = spark.read.parquet(path)
    st = staged.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qv")).alias("d")).collect()[0]
    return QuerySet(path, int(st["n"]), staged.schema["_q"].dataType, int(st["d"] or 0), bool(group))


def small(df: DataFrame, n_rows: int, row_bytes: int = KEY_ROW_BYTES, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its proven size bound (``n_rows`` rows of
    about ``row_bytes``) is below ``limit``; otherwise leave the join strategy
    to AQE (sort-merge with skew splits)."""
    return F.broadcast(df) if n_rows * row_bytes <= limit else df


_QCACHE: dict = {}


def query_chunks(path: str, chunk: int, n: int, columns: list[str] | None = None) -> Iterator:
    """The staged queries as Arrow tables of ``chunk`` rows at most, read from
    storage one after another. A set of one chunk (``n`` rows in all) is kept by
    the Python worker; nothing else is."""
    import pyarrow as pa
    import pyarrow.dataset as ds
    if (path, chunk) in _QCACHE:
        yield _QCACHE[path, chunk]
        return
    held, rows = [], 0
    source = ds.dataset(local_path(path), format="parquet")
    for b in source.to_batches(columns=columns, batch_size=chunk, batch_readahead=1, fragment_readahead=1):
        while b.num_rows:
            part = b.slice(0, chunk - rows)
            held.append(part)
            rows += part.num_rows
            b = b.slice(part.num_rows)
            if rows == chunk:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if held:
        last = pa.Table.from_batches(held).combine_chunks()
        if n <= chunk:
            _QCACHE.clear()
            _QCACHE[path, chunk] = last
        yield last


def _blocks(batches: Iterator) -> Iterator:
    """Arrow tables of about ``BLOCK_BYTES`` from the batches of a partition."""
    import pyarrow as pa
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks a scan of ``df`` has, from the plan's size (no job runs)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per_task = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1, size // int(per_task))


def _block_distance(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(b, d) x (nq, d) -> (b, nq) distance block. These values are the
    distances reported (cosine: 1 - normalised dot; L2 through the dot-product
    expansion; dot: negative inner product)."""
    if metric == "cosine":
        # a zero vector has no direction: it is at no distance from anything
        with np.errstate(invalid="ignore", divide="ignore"):
            xn = x / np.linalg.norm(x, axis=1, keepdims=True)
            qn = q / np.linalg.norm(q, axis=1, keepdims=True)
            d = 1.0 - xn @ qn.T
        return np.where(np.isnan(d), np.inf, d)
    if metric == "l2":
        sq = (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2.0 * (x @ q.T)
        return np.sqrt(np.maximum(sq, 0.0))
    return -(x @ q.T)


def _distance_columns(also: dict[str, str] | None) -> dict[str, str]:
    """Output column -> staged column of further query vectors."""
    return {name: f"_v_{name}" for name in also or {}}


def _rows_of(col) -> dict:
    """The rows of each value of a column, nulls left out."""
    names = col.combine_chunks().dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy().astype(np.int64)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
    return {g: order[a:b] for g, a, b in zip(names.dictionary.to_pylist(), starts[:-1], starts[1:])}


def _float_matrix(col) -> np.ndarray:
    return _batch_matrix(col, len(col))


def _pair_l2(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for at in range(0, len(rows), SLICE_ROWS):
        s = slice(at, at + SLICE_ROWS)
        out[s] = np.linalg.norm(x[rows[s]] - q[cols[s]], axis=1)
    return out


def _first_k(rows: np.ndarray, cols: np.ndarray, dist: np.ndarray, rank: np.ndarray, k: int):
    """Of the pairs, per query the ``k`` first by ``(distance, tie rank)``, sorted by query."""
    order = np.lexsort((rank[rows], dist, cols))
    rows, cols, dist = rows[order], cols[order], dist[order]
    starts = np.flatnonzero(np.append(True, cols[1:] != cols[:-1]))[:len(cols)]
    place = np.arange(len(cols)) - np.repeat(starts, np.diff(starts, append=len(cols)))
    keep = place < k
    return rows[keep], cols[keep], dist[keep]


def knn_join(queries: DataFrame | QuerySet, vectors: DataFrame, k: int, metric: str = "cosine",
             key: str = "idx", qvec: str = "mention_vec", vec: str = "embedding",
             payload: list[str] | None = None, tie_break: list[str] | None = None,
             max_distance: float | None = None, query_chunk: int = QUERY_CHUNK,
             group: str | None = None, also: dict[str, str] | None = None,
             salts: int | None = None, sample: float | None = None, store=None) -> DataFrame:
    """The ``k`` nearest vector rows of every query.

    Returns ``(key, payload..., distance)``; ``distance`` per ``metric``
    (cosine distance, L2 distance, or negative inner product). With
    ``max_distance`` only rows strictly below it qualify (T3). Ties are broken
    by ``tie_break`` columns (default: the payload columns in order). With
    ``group`` (a column of both the query set and ``vectors``) a query is
    compared only with the vectors of its own group.

    ``also`` maps further columns of the result to vector columns of the query
    set: each is the L2 distance of the row to that vector, worked out in the
    scan (a staged ``QuerySet`` must carry them as ``_v_<name>``). ``salts``:
    lists per query that the last merge gets (1: one level); ``sample``: share
    of the rows in the pass that finds bounds (0: none). Both are chosen from the
    size of the scan where not given; then a large query set, or one that is given the
    table's ``store``, is searched by query (``byquery``). A zero vector has no cosine distance and
    never qualifies; null vectors are skipped.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    extra_vecs = _distance_columns(also)
    if not isinstance(queries, QuerySet):
        carry = {c: F.col(also[n]).cast("array<double>") for n, c in extra_vecs.items()}
        queries = stage_queries(queries, key, qvec, group, carry)
    qs = queries
    payload = payload or [c for c in vectors.columns if c not in (vec, group)]
    tie_break = tie_break or [c for c in payload if c != vec]
    extra = [c for c in ([vec] + ([group] if group else [])) if c not in payload]
    src = vectors.select(*payload, *extra).where(F.col(vec).isNotNull())
    if salts is None and sample is None:
        from entlink.operators import byquery as BQ
        if store is not None or BQ.chosen(qs.n, src):
            store = store or BQ.stage_store(vectors, list(dict.fromkeys([*payload, *tie_break])), tie_break, vec, group)
            rows = BQ.knn(qs.df(vectors.sparkSession), qs.n, store, k, metric, qs.key_type, payload, max_distance, extra_vecs, min(query_chunk, BQ.CHUNK_QUERIES))
            if qs.df(vectors.sparkSession).agg(F.count_distinct("_q")).first()[0] < qs.n:      # rows of equal keys are ranked together
                rows = _merge(rows.withColumn("_part", F.lit(0)), k, tie_break, 1)
            return rows.withColumnRenamed("_q", key).select(key, *payload, "distance", *extra_vecs)
    if salts is None or sample is None:
        tasks = scan_tasks(src)
        salts = salts if salts is not None else 1 if tasks <= SMALL_SCANS else int(tasks ** 0.5)
        sample = sample if sample is not None else 0.0 if tasks <= SMALL_SCANS else 1 / SAMPLE_SHARE
    if sample:
        part = src.where(F.rand(17) < sample)
        near = _partial_lists(qs, part, k, metric, vec, payload, tie_break, max_distance, query_chunk, group, {})
        near = _merge(near, k, tie_break, salts).groupBy("_q").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_b"))
        near = near.where(F.col("_n") >= k).select("_q", "_b")
        path = scratch_path(vectors.sparkSession, "queries-bounded")
        qs.df(vectors.sparkSession).join(near, "_q", "left").write.parquet(path)
        qs = QuerySet(path, qs.n, qs.key_type, qs.dim, qs.grouped)
    lists = _partial_lists(qs, src, k, metric, vec, payload, tie_break, max_distance, query_chunk, group, extra_vecs)
    top = _merge(lists, k, tie_break, salts)
    return top.withColumnRenamed("_q", key).select(key, *payload, "distance", *extra_vecs)


def _merge(lists: DataFrame, k: int, tie_break: list[str], salts: int) -> DataFrame:
    """The ``k`` first rows of each query, of the lists of all tasks."""
    order = [F.col("distance").asc(), *[F.col(c).asc_nulls_first() for c in tie_break]]
    levels = [["_q"]] if salts <= 1 else [["_q", "_salt"], ["_q"]]
    top = lists.withColumn("_salt", F.pmod("_part", F.lit(max(1, salts))))
    for keys in levels:
        top = top.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k)
    return top.drop("_rn", "_salt", "_part")


def _partial_lists(qs: QuerySet, src: DataFrame, k: int, metric: str, vec: str, payload: list[str], tie_break: list[str],
                   max_distance: float | None, query_chunk: int, group: str | None, extra_vecs: dict[str, str]) -> DataFrame:
    """For each block of vectors its ``k`` first rows of each query:
    ``(payload..., _q, distance, <extra distances>, _part)``."""
    out_schema = T.StructType(list(src.select(*payload).schema.fields) + [
        T.StructField("_q", qs.key_type, True), T.StructField("distance", T.DoubleType(), True),
        *[T.StructField(n, T.DoubleType(), True) for n in extra_vecs], T.StructField("_part", T.IntegerType(), False)])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_out = to_arrow_schema(out_schema)
    path, n_queries, kk = qs.path, qs.n, int(k)
    # so many queries at once that their lists of k rows stay within the rows held
    chunk = max(1, min(query_chunk, HELD_ROWS // max(1, kk)))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        bounds: dict[int, np.ndarray] = {}   # one number for each query: the smallest k-th distance so far
        for block in _blocks(batches):
            x_all = _float_matrix(block.column(vec).combine_chunks())
            rank_all = _tie_rank(block, [block.schema.get_field_index(c) for c in tie_break])
            groups = _rows_of(block.column(group).cast(pa.string())) if group else None
            for number, queries in enumerate(query_chunks(path, chunk, n_queries)):
                q_all = _float_matrix(queries.column("_qv").combine_chunks())
                if number not in bounds:
                    bounds[number] = np.full(len(q_all), np.inf) if "_b" not in queries.schema.names \
                        else np.nan_to_num(queries.column("_b").to_numpy().astype(float), nan=np.inf) * (1 + 1e-9) + 1e-9
                found = []
                if groups is None:
                    found.append(_nearest(x_all, q_all, rank_all, bounds[number]))
                else:
                    for g, cols in _rows_of(queries.column("_g")).items():
                        rows = groups.get(g)
                        if rows is not None:
                            own = bounds[number][cols]
                            r, c, d = _nearest(x_all[rows], q_all[cols], rank_all[rows], own)
                            bounds[number][cols] = own
                            found.append((rows[r], cols[c], d))
                if not found:
                    continue
                rows, cols, dist = (np.concatenate(z) for z in zip(*found))
                if len(rows) == 0:
                    continue
                yield from _rows_out(block.select(payload), queries, x_all, rows, cols, dist, extra_vecs, arrow_out, part)

    def _nearest(x, q, rank, bound):
        """``(rows, cols, distances)`` of each query's first rows; lowers ``bound``."""
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        n_held = 0
        for at in range(0, len(x), SLICE_ROWS):
            d = _block_distance(x[at:at + SLICE_ROWS], q, metric)
            if max_distance is not None:
                d = np.where(d < max_distance, d, np.inf)
            d = np.where(d <= bound[None, :], d, np.inf)
            rows, cols = _topk_rows(d, kk, rank[at:at + SLICE_ROWS])
            held.append((rows + at, cols, d[rows, cols]))
            n_held += len(rows)
            if n_held > 2 * HELD_ROWS:
                held = [_first_k(*(np.concatenate(z) for z in zip(*held)), rank, kk)]
                n_held = len(held[0][0])
        rows, cols, dist = _first_k(*(np.concatenate(z) for z in zip(*held)), rank, kk)
        if metric == "l2":      # the expansion loses digits near 0: kept rows get the plain distance
            dist = _pair_l2(x, q, rows, cols)
        full = np.bincount(cols, minlength=len(q)) == kk
        kth = np.full(len(q), -np.inf)
        np.maximum.at(kth, cols, dist)
        bound[full] = np.minimum(bound[full], kth[full] + np.abs(kth[full]) * 1e-9 + 1e-9)
        return rows, cols, dist

    return src.mapInArrow(run, out_schema)


def _rows_out(base, queries, x, rows, cols, dist, extra_vecs, schema, part=None) -> Iterator:
    """Arrow batches of result rows; further distances are worked out here."""
    import pyarrow as pa
    others = {n: _float_matrix(queries.column(c).combine_chunks()) for n, c in extra_vecs.items()}
    ids = queries.column("_q").combine_chunks()
    for at in range(0, len(rows), 100_000):
        r, c = rows[at:at + 100_000], cols[at:at + 100_000]
        columns = [base.column(n).combine_chunks().take(pa.array(r)) for n in base.schema.names] + [ids.take(pa.array(c))]
        columns.append(pa.array(dist[at:at + 100_000], pa.float64(), mask=np.isnan(dist[at:at + 100_000])))
        columns += [pa.array(_pair_l2(x, q, r, c)) for q in others.values()]
        if part is not None:
            columns.append(pa.array(np.full(len(r), part, np.int32)))
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(columns, schema)], schema=schema)


def _batch_matrix(col, n: int) -> np.ndarray:
    """Arrow list<float|double> column of equal-length vectors -> (n, d) float64
    matrix, read from the flat value buffer without per-row Python."""
    import pyarrow as pa
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs = col.offsets.to_numpy()
    lens = np.diff(offs)
    if len(lens) and not np.all(lens == lens[0]):
        raise ValueError("vectors of different lengths in one table")
    d = int(lens[0]) if len(lens) else 0
    flat = col.values.slice(int(offs[0]), n * d).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(n, d)


def _tie_rank(rb, tie_pos: list[int]) -> np.ndarray:
    """Rank of every batch row in tie-break order (ascending, nulls first)."""
    import pyarrow.compute as pc
    n = rb.num_rows
    if not tie_pos:
        return np.arange(n)
    t = rb.select(tie_pos)
    order = pc.sort_indices(t, sort_keys=[(name, "ascending") for name in t.schema.names],
                            null_placement="at_start").to_numpy()
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    return rank


def _topk_rows(d: np.ndarray, k: int, tie_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per query column of ``d`` the row indices of its ``k`` smallest
    ``(distance, tie_rank)``; infinite distances never qualify."""
    b, nq = d.shape
    m = min(k, b)
    kth = np.partition(d, m - 1, axis=0)[m - 1]
    less = d < kth[None, :]
    eq = d == kth[None, :]
    need = m - less.sum(axis=0)
    fits = eq.sum(axis=0) == need
    rows, cols = np.nonzero(less | (eq & fits[None, :]))
    extra_r, extra_c = [rows], [cols]
    for j in np.nonzero(~fits & np.isfinite(kth))[0]:
        cand = np.nonzero(eq[:, j])[0]
        pick = cand[np.argsort(tie_rank[cand], kind="stable")[:need[j]]]
        extra_r.append(pick)
        extra_c.append(np.full(len(pick), j))
    rows, cols = np.concatenate(extra_r), np.concatenate(extra_c)
    ok = np.isfinite(d[rows, cols])
    return rows[ok], cols[ok]


def cosine_top_k(queries, vectors: DataFrame, k: int = TOP_K, **kw) -> DataFrame:
    """Cosine top-k vector rows per query."""
    return knn_join(queries, vectors, k, "cosine", **kw)


def range_search(queries, vectors: DataFrame, max_distance: float = RANGE_MAX_DISTANCE,
                 limit: int = RANGE_LIMIT, **kw) -> DataFrame:
    """Rows with cosine distance < ``max_distance``, nearest ``limit`` per query."""
    return knn_join(queries, vectors, limit, "cosine", max_distance=max_distance, **kw)


def _nearest_pairs(cols: np.ndarray, by: list[np.ndarray], n: int) -> np.ndarray:
    """The pairs of each query that are among its first ``n`` in the order
    ``by``, or equal the n-th in the first of ``by``."""
    order = np.lexsort((*by[::-1], cols))
    cols = cols[order]
    starts = np.flatnonzero(np.append(True, cols[1:] != cols[:-1]))
    sizes = np.diff(starts, append=len(cols))
    place = np.arange(len(cols)) - np.repeat(starts, sizes)
    first = by[0][order]
    return order[(place < n) | (first == first[np.repeat(starts + np.minimum(sizes, n) - 1, sizes)])]


def row_id(vectors: DataFrame) -> list[str]:
    """The columns that stand for a row of the vector table until its payload is
    joined: subject and ``vec_id``, or all where the table has no such number."""
    return ["sub", "vec_id"] if "vec_id" in vectors.columns else [c for c in ("sub", "pred", "obj", "type_obj") if c in vectors.columns]


def with_payload(cands: DataFrame, vectors: DataFrame, payload: list[str]) -> DataFrame:
    """Candidate rows with the vector table's columns ``payload`` (late
    materialisation): only rows that candidates name are read out of the table,
    and no vector is."""
    own = row_id(vectors)
    if set(payload) <= set(cands.columns):
        return cands
    named = vectors.select(*own, *[c for c in payload if c not in own]).join(cands.select(*own).distinct(), own, "left_semi")
    return cands.join(named.dropDuplicates(own), own)


def candidates(queries: DataFrame | QuerySet, vectors: DataFrame, k: int = TOP_K, key: str = "idx",
               qvec: str = "mention_vec", vec: str = "embedding", sub: str = "sub",
               payload: list[str] | None = None, group: str | None = None) -> DataFrame:
    """T2 + J7: all rows of the subjects hit by the cosine top-k, with their
    cosine distance to the query (null for a zero vector). Returns ``(key,
    payload..., distance)``. With ``group``, subjects must be unique per group
    (the grid qualifies them)."""
    qs = queries if isinstance(queries, QuerySet) else stage_queries(queries, key, qvec, group)
    payload = payload or [c for c in vectors.columns if c not in (vec, group)]
    from entlink.operators import byquery as BQ
    if group is None and BQ.chosen(qs.n, vectors):
        names = row_id(vectors)
        store = BQ.stage_store(vectors, list(dict.fromkeys([*names, *payload])), names, vec)
        hits = hit_subjects(qs, vectors, k, vec, sub, store=store)
        own = qs.df(vectors.sparkSession).join(hits, "_q").withColumn("_wide", F.lit(False))
        rows = BQ.candidate_rows(own, qs.n, store, qs.key_type, payload, {}, sub=sub, own=tuple(names))
        return rows.withColumnRenamed("_q", key).select(key, *payload, "distance")
    hits = hit_subjects(qs, vectors, k, vec, sub, group)
    own = qs.df(vectors.sparkSession).join(hits, "_q")
    return expand(own, vectors, payload, key=key, vec=vec, sub=sub)


def hit_subjects(qs: QuerySet, vectors: DataFrame, k: int = TOP_K, vec: str = "embedding", sub: str = "sub",
                 group: str | None = None, store=None) -> DataFrame:
    """``(_q, _subs)``, the distinct subjects of each query's top-k rows (k at most)."""
    tie = [c for c in row_id(vectors) if c in vectors.columns]
    top = knn_join(qs, vectors, k, "cosine", key="_q", vec=vec, payload=list(dict.fromkeys([sub, *tie])), group=group, store=store)
    return top.groupBy("_q").agg(F.collect_set(sub).alias("_subs"))


def expand(queries: DataFrame, vectors: DataFrame, payload: list[str], also: dict[str, str] | None = None,
           key: str = "idx", vec: str = "embedding", sub: str = "sub", nearest: int | None = None) -> DataFrame:
    """For queries ``(_q, _qv, _subs, vectors of also...)`` all rows of the
    subjects ``_subs`` with their cosine distance to ``_qv`` and their L2
    distances to the vectors ``also``: ``(key, payload..., distance, also...)``.

    One scan of the vector table; the queries are read chunk by chunk and meet
    the rows in the task that scanned them, so neither a hub subject's rows nor
    any vector is shuffled, and a hub's rows stay spread over the scan. With
    ``nearest`` a task returns of the rows it compares at once only each query's
    first so many, for each distance of ``also`` (then the cosine distance), and
    rows as near as the last: all that a later cut of as many rows can keep."""
    extra_vecs = _distance_columns(also)
    qs = stage_queries(queries, "_q", "_qv", carry={"_subs": F.col("_subs")} | {c: F.col(also[n]).cast("array<double>") for n, c in extra_vecs.items()})
    src = vectors.select(*payload, *[c for c in (sub, vec) if c not in payload]).where(F.col(vec).isNotNull())
    out_schema = T.StructType(list(src.select(*payload).schema.fields) + [
        T.StructField("_q", qs.key_type, True), T.StructField("distance", T.DoubleType(), True),
        *[T.StructField(n, T.DoubleType(), True) for n in extra_vecs]])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_out = to_arrow_schema(out_schema)
    path, n_queries = qs.path, qs.n

    def run(batches):
        import pyarrow.compute as pc
        for block in _blocks(batches):
            x = _float_matrix(block.column(vec).combine_chunks())
            norms = np.linalg.norm(x, axis=1)
            names = block.column(sub).combine_chunks().dictionary_encode()
            code = names.indices.fill_null(-1).to_numpy().astype(np.int64)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
            for queries in query_chunks(path, QUERY_CHUNK, n_queries):
                q = _float_matrix(queries.column("_qv").combine_chunks())
                lists = queries.column("_subs").combine_chunks()
                hit = pc.index_in(lists.flatten(), value_set=names.dictionary)
                owner = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
                known = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
                hit = hit.fill_null(0).to_numpy().astype(np.int64)[known]
                size = starts[hit + 1] - starts[hit]
                # the rows of each hit subject, some pairs at a time
                cut = np.append(0, np.cumsum(size))
                at = 0
                while at < len(hit):
                    end = max(at + 1, int(np.searchsorted(cut, cut[at] + HELD_ROWS // 8)) - 1)
                    n = size[at:end]
                    rows = order[np.repeat(starts[hit[at:end]] - (cut[at:end] - cut[at]), n) + np.arange(cut[end] - cut[at])]
                    cols = np.repeat(owner[known[at:end]], n)
                    dist = np.empty(len(rows))
                    for s0 in range(0, len(rows), SLICE_ROWS):
                        s1 = slice(s0, s0 + SLICE_ROWS)
                        with np.errstate(invalid="ignore", divide="ignore"):
                            dist[s1] = 1.0 - np.einsum("ij,ij->i", x[rows[s1]], q[cols[s1]]) / (norms[rows[s1]] * np.linalg.norm(q[cols[s1]], axis=1))
                    dist = np.where(np.isfinite(dist), dist, np.nan)
                    if nearest is not None and len(rows):
                        others = [_pair_l2(x, _float_matrix(queries.column(c).combine_chunks()), rows, cols) for c in extra_vecs.values()]
                        near = np.nan_to_num(dist, nan=-np.inf)
                        keep = np.unique(np.concatenate([_nearest_pairs(cols, [*by, near], nearest) for by in [[o] for o in others] or [[]]]))
                        rows, cols, dist = rows[keep], cols[keep], dist[keep]
                    yield from _rows_out(block.select(payload), queries, x, rows, cols, dist, extra_vecs, arrow_out)
                    at = end

    return src.mapInArrow(run, out_schema).withColumnRenamed("_q", key).select(key, *payload, "distance", *extra_vecs)


def ivf_index(vectors: DataFrame, n_cells: int = IVF_CELLS, vec: str = "embedding", seed: int = 1,
              max_iter: int = IVF_ITERATIONS, slack: float = 1.5, sample_rows: int = IVF_SAMPLE_ROWS, copies: int = IVF_COPIES):
    """G3 (build): vectors in cells of bounded size, as inverted lists. Returns
    ``(vectors with column 'cell', centroids DataFrame (cell, centroid))``; the
    vectors are a table partitioned by cell under the shared checkpoint folder.
    A row stands in ``copies`` cells at most (one between two centres would be
    missed by queries on the other side), and in one at least.

    Centroids are k-means centres of a random sample (``sample_rows`` in the
    mean; all rows of smaller tables) of normalised vectors. Every row is then
    given its cells: the nearest, unless they are full. A cell holds ``slack``
    times the mean at most; it is filled with its nearest rows, and the farthest
    pass to the next nearest cell of theirs, in rounds. A round is an aggregate:
    sizes and distance percentiles for each cell, from which a full cell's cutoff
    is lowered; a row's cells are the first whose cutoff it meets, so nothing is
    sorted or gathered, and equal vectors are told apart by a hash, so copies don't
    overfill a cell. Rows that no near cell takes go where space is left. Zero
    and null vectors have no direction and no cell: they are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    spark = vectors.sparkSession
    ship_package(spark)
    whole = vectors.where(F.col(vec).isNotNull() & (V.norm(vec) > 0))
    n = whole.count()
    unit = whole.select(array_to_vector(F.transform(F.col(vec).cast("array<double>"), lambda x: x / V.norm(vec))).alias("_nv"))
    if n > sample_rows:
        unit = unit.sample(sample_rows / n, seed)
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_nv").fit(unit)
    centres = np.array([c for c in model.clusterCenters()])
    cents = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    n_cells = len(centres)
    capacity = slack * copies * n / n_cells

    # each row's nearest cells, with distances: all that the rounds need
    near = persist_table(whole.select(vec).mapInArrow(_near_cells(centres, vec), "cells array<int>, dists array<double>"), "ivf-near")
    cutoff = np.full(n_cells, np.inf)
    marks = [i / 100 for i in range(1, 100)]
    for _ in range(IVF_ROUNDS):
        first = F.filter(F.transform("cells", lambda c, i: F.struct(c.alias("c"), F.get("dists", i).alias("d"))),
                         lambda x: x["d"] <= F.get(F.array(*[F.lit(float(v)) for v in cutoff]), x["c"]))
        given = near.select(F.explode(F.slice(first, 1, copies)).alias("x")).groupBy("x.c").agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("x.d", marks, 1000).alias("marks")).collect()   # one row a cell
        sizes = np.zeros(n_cells)
        for r in given:
            sizes[r["c"]] = r["n"]
            if r["n"] > capacity:
                cutoff[r["c"]] = r["marks"][min(98, max(0, int(100 * capacity / r["n"]) - 1))]
        if (sizes <= capacity).all():
            break
    room = np.cumsum(np.maximum(capacity - sizes, 1e-9))
    names = vectors.columns
    cells = whole.select(*names).mapInArrow(_final_cells(centres, vec, cutoff, room, copies), T.StructType([*whole.schema.fields, T.StructField("cell", T.IntegerType())]))
    path = scratch_path(spark, "ivf-lists")
    cells.repartition(n_cells, "cell").write.partitionBy("cell").parquet(path)
    lists = spark.read.schema(T.StructType([*whole.schema.fields, T.StructField("cell", T.IntegerType())])).parquet(path)
    return lists.select(*names, "cell"), cents


def _told_apart(x: np.ndarray, centres: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``IVF_CHOICES`` nearest cells of each row, with distances that
    ``salt`` (0 to 1) makes different for equal vectors."""
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = (centres * centres).sum(1)[None, :] - 2 * unit @ centres.T + 1
    cells = np.argsort(d, axis=1, kind="stable")[:, :IVF_CHOICES]
    return cells, np.take_along_axis(d, cells, 1) + 1e-6 * salt[:, None]


def _salts(batch, at: int) -> np.ndarray:
    """A number from 0 to 1 for each row, from its place in its partition."""
    place = np.arange(at, at + batch.num_rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (place >> np.uint64(11)).astype(float) / (1 << 53)


def _near_cells(centres: np.ndarray, vec: str):
    def run(batches):
        import pyarrow as pa
        at = 0
        for b in batches:
            if b.num_rows:
                cells, dists = _told_apart(_float_matrix(b.column(vec)), centres, _salts(b, at))
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(dists), pa.list_(pa.float64()))], names=["cells", "dists"])
    return run


def _final_cells(centres: np.ndarray, vec: str, cutoff: np.ndarray, room: np.ndarray, copies: int):
    """Each row once for each cell that takes it: its first ``copies`` choices
    that do, or where none does a cell with room."""
    def run(batches):
        import pyarrow as pa
        at = 0
        for b in batches:
            if b.num_rows:
                salt = _salts(b, at)
                at += b.num_rows
                cells, dists = _told_apart(_float_matrix(b.column(vec)), centres, salt)
                takes = dists <= cutoff[cells]
                rows, choice = np.nonzero(takes & (np.cumsum(takes, axis=1) <= copies))
                left = np.flatnonzero(~takes.any(1))
                spare = np.minimum(np.searchsorted(room, salt[left] * room[-1]), len(room) - 1)
                cell = np.append(cells[rows, choice], spare).astype(np.int32)
                out = b.take(pa.array(np.append(rows, left)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell)], names=[*b.schema.names, "cell"])
    return run


def ivf_search(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int = TOP_K,
               probes: int = IVF_PROBES, key: str = "idx", qvec: str = "mention_vec", vec: str = "embedding",
               payload: list[str] | None = None, per_cell: int | None = None) -> DataFrame:
    """G3 (search): probe the ``probes`` nearest cells of each query, keep its
    ``per_cell`` nearest rows of each (default: ``k``, so no row of a probed cell
    is lost), then rank those. Returns ``(key, payload..., distance)``; rows that
    are equal in all of ``payload`` are one row, as copies in several cells are.

    The scan of the lists is pruned to probed cells (dynamic partition pruning);
    within it a query meets only its own cells' rows, where they were scanned, so
    the rows of a cell that all queries probe are neither shuffled nor gathered."""
    payload = payload or [c for c in assigned.columns if c not in (vec, "cell")]
    qs = stage_queries(queries, key, qvec)
    near = knn_join(qs, centroids, probes, "cosine", key="_q", vec="centroid", payload=["cell"]).select("_q", "cell")
    own = persist_table(qs.df(assigned.sparkSession).join(near, "_q").select(F.struct("_q", "cell").alias("_p"), "_qv", "cell"), "ivf-probes")
    probed = F.broadcast(own.where(F.col("cell") >= 0).select("cell").distinct())     # a row a cell at most
    lists = assigned.join(probed, "cell", "left_semi")
    hits = knn_join(stage_queries(own, "_p", "_qv", "cell"), lists, per_cell or k, "cosine", key="_p", vec=vec, payload=payload, group="cell")
    # a row that stands in two probed cells is one row
    hits = hits.groupBy(F.col("_p._q").alias(key), *payload).agg(F.min("distance").alias("distance"))
    w = Window.partitionBy(key).orderBy(F.col("distance").asc(), *[F.col(c).asc_nulls_first() for c in payload])
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select(key, *payload, "distance")
