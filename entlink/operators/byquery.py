"""Vector search split by query (J7, J8, T1-T4), for many queries.

``search.py`` splits a search by the vector table: each task returns its own list
for every query, so lists grow with tasks times queries, and a small table is one
task's work however many queries there are. Here a task has some of the queries and
streams the table past them:

* the table is stored once in the order that breaks ties, with its rows numbered
  (``stage_store``); a task reads it block by block, so it holds one block;
* a chunk of queries is bounded by the rows it may hold; of each query only its
  first ``k`` rows are held, and the distance of the last of them bounds what later
  blocks can add (``top_of_store``);
* the columns of the rows that are left are read in a second pass.

A query's rows all arise in one task: nothing is merged, and no pair of query and
row is shuffled or stored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entlink.operators import search as S
from entlink.session import local_path, scratch_path, ship_package

LEAST_QUERIES = 256         # smaller query sets are searched by vector
CHUNK_QUERIES = 256         # queries that meet the table at once
CHUNK_ROWS = 1_000_000      # rows that a chunk's queries may hold
STORE_BLOCK_BYTES = 8 << 20  # vectors of one block, as doubles
MOST_PAIRS = 1_000_000      # pairs of a block and a chunk
FEW_PAIRS = 65_536          # pairs held, beyond those that may be answers, before a prune
STORED_BYTES = 4 << 20      # a row group of the store, which is read as a whole
OUT_ROWS = 65_536           # rows of one Arrow batch of results
VOTE_PAIRS = 8_000_000      # pairs of query and row held for votes; one query's may be more
LEAST_TASKS = 64            # a larger query set has so many tasks at least, where there are as many cores
CONTEXT_BYTES = 48 << 20    # context vectors that meet the table at once
GATHER_BYTES = 32 << 20     # candidate rows of the table that meet the contexts at once


@dataclass
class Store:
    """The table at ``path``: payload columns, ``_x`` (vector), ``_row`` (ascending in
    tie-break order) and, where given, ``_g`` (group, by which it is ordered first)."""
    path: str
    schema: T.StructType
    grouped: bool


def chosen(n: int, vectors: DataFrame) -> bool:
    """Whether ``n`` queries are searched by query: many, and more than the table's scan has tasks."""
    return n > LEAST_QUERIES and S.scan_tasks(vectors) < n


def stage_store(vectors: DataFrame, columns: list[str], order: list[str], vec: str = "embedding", group: str | None = None) -> Store:
    spark = vectors.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "vector-store")
    own = [F.col(group).cast("string").alias("_g")] if group else []
    src = vectors.where(F.col(vec).isNotNull()).select(*columns, *own, F.col(vec).alias("_x"))
    keys = [F.col(c).asc_nulls_first() for c in (["_g"] if group else []) + order]
    src = src.orderBy(*keys) if keys else src
    src.withColumn("_row", F.monotonically_increasing_id()).write.option("parquet.block.size", STORED_BYTES).parquet(path)
    return Store(path, T.StructType([src.schema[c] for c in columns]), bool(group))


def spread(queries: DataFrame, n: int) -> DataFrame:
    """The queries over enough tasks; those with equal vectors, and of one group, stand together.
    Each task reads the whole table, so a small set has no more tasks than run at once."""
    tasks = max(1, min(n, max(min(LEAST_TASKS, queries.sparkSession.sparkContext.defaultParallelism), -(-n // (2 * CHUNK_QUERIES)))))
    keys = [*(["_g"] if "_g" in queries.columns else []), "_s", "_q"]
    return queries.withColumn("_s", F.xxhash64("_qv")).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)


def _store_blocks(path: str, columns: list[str], rows: int, groups: list | None) -> Iterator:
    import glob

    import pyarrow as pa
    import pyarrow.dataset as ds
    files = sorted(glob.glob(local_path(path) + "/part-*.parquet"))
    if not files:
        return
    wanted = None if groups is None else ds.field("_g").isin(pa.array(groups, pa.string()))
    plain = ds.ParquetFragmentScanOptions(pre_buffer=False)
    for b in ds.dataset(files, format="parquet").to_batches(columns=columns, filter=wanted, batch_size=rows, batch_readahead=1,
                                                            fragment_readahead=1, fragment_scan_options=plain, use_threads=False):
        if b.num_rows:
            yield pa.Table.from_batches([b])


def _chunks(batches: Iterator, size: int) -> Iterator:
    import pyarrow as pa
    held, rows = [], 0
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, size - rows))
            rows += held[-1].num_rows
            b = b.slice(held[-1].num_rows)
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups_of(queries) -> np.ndarray | None:
    return np.array(queries.column("_g").to_pylist(), object) if "_g" in queries.schema.names else None


def _named(groups: np.ndarray | None) -> list | None:
    return None if groups is None else sorted({g for g in groups if g is not None})


def _block_rows(dim: int, n: int) -> int:
    return int(max(64, min(STORE_BLOCK_BYTES // (8 * max(1, dim)), MOST_PAIRS // max(1, n))))


def top_of_store(path: str, q: np.ndarray, groups: np.ndarray | None, k: int, metric: str = "cosine",
                 max_distance: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, queries, distances)``: each query's ``k`` first rows by distance and ``_row``.

    Pairs are held only if no more than ``k`` rows of their block, or of all before, are nearer."""
    n = len(q)
    bound, top = np.full(n, np.inf), np.inf if max_distance is None else max_distance
    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))], 0
    limit = 2 * n * k + FEW_PAIRS

    def first():
        rows, cols, dist = (np.concatenate(z) for z in zip(*held))
        order = np.lexsort((rows, dist, cols))
        rows, cols, dist = rows[order], cols[order], dist[order]
        starts = np.flatnonzero(np.append(True, cols[1:] != cols[:-1]))[:len(cols)]
        sizes = np.diff(starts, append=len(cols))
        full = sizes >= k
        bound[cols[starts[full]]] = dist[starts[full] + k - 1]
        keep = np.arange(len(cols)) - np.repeat(starts, sizes) < k
        return rows[keep], cols[keep], dist[keep]

    for block in _store_blocks(path, ["_row", "_x"] + (["_g"] if groups is not None else []), _block_rows(q.shape[1], n), _named(groups)):
        x, ids = S._float_matrix(block.column("_x")), block.column("_row").to_numpy()
        if groups is None:
            parts = [(slice(None), np.arange(n, dtype=np.int32))]
        else:
            parts = [(rows, np.flatnonzero(groups == g).astype(np.int32)) for g, rows in S._rows_of(block.column("_g")).items()]
        for own, cols in parts:
            xs, rows_of = x[own], ids[own]
            d = S._block_distance(xs, q[cols], metric)
            # L2 through the dot product loses digits near 0: rows that it lets pass get the plain distance
            slack = 1e-6 * (1 + np.abs(xs).max(initial=0) + np.abs(q).max(initial=0)) if metric == "l2" else 0.0
            near = (d <= bound[cols] + slack) & (d < top)
            if len(xs) > k and np.count_nonzero(near) > len(cols) * k + FEW_PAIRS:
                bound[cols] = np.fmin(bound[cols], np.partition(d, k - 1, axis=0)[k - 1] + slack)
                near &= d <= bound[cols] + slack
            r, c = np.nonzero(near)
            dist = S._pair_l2(xs, q, r, cols[c]) if metric == "l2" else d[r, c]
            held.append((rows_of[r], cols[c], dist))
            size += len(r)
            if size > limit:
                held = [first()]
                size = len(held[0][0])
    return first()


def knn(queries: DataFrame, n: int, store: Store, k: int, metric: str, key_type: T.DataType, payload: list[str],
        max_distance: float | None, extra_vecs: dict[str, str], query_chunk: int = CHUNK_QUERIES) -> DataFrame:
    """``(payload..., _q, distance, further distances...)`` of queries ``(_q, _qv, _g, ...)``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    out_schema = T.StructType([store.schema[c] for c in payload] + [
        T.StructField("_q", key_type, True), T.StructField("distance", T.DoubleType(), True), *[T.StructField(e, T.DoubleType(), True) for e in extra_vecs]])
    arrow_out, path, size = to_arrow_schema(out_schema), store.path, max(1, min(query_chunk, CHUNK_ROWS // max(1, int(k))))

    def run(batches):
        for queries in _chunks(batches, size):
            q, groups = S._float_matrix(queries.column("_qv")), _groups_of(queries)
            rows, cols, dist = top_of_store(path, q, groups, int(k), metric, max_distance)
            order = np.argsort(rows, kind="stable")
            rows, cols, dist = rows[order], cols[order], dist[order]
            names = payload + ["_row"] + (["_x"] if extra_vecs else [])
            for block in _store_blocks(path, names, _block_rows(q.shape[1], len(q)), _named(groups)):
                ids = block.column("_row").to_numpy()
                own = slice(*np.searchsorted(rows, [ids[0], ids[-1] + 1]))
                if own.start < own.stop:
                    x = S._float_matrix(block.column("_x")) if extra_vecs else None
                    yield from S._rows_out(block.select(payload), queries, x, np.searchsorted(ids, rows[own]), cols[own], dist[own], extra_vecs, arrow_out)

    return spread(queries, n).mapInArrow(run, out_schema)


def candidate_rows(queries: DataFrame, n: int, store: Store, key_type: T.DataType, payload: list[str], also: dict[str, str],
                   nearest: int | None = None, apart: bool = False, sub: str = "sub", own: tuple[str, ...] = ("sub", "vec_id"),
                   limit: int = S.RANGE_LIMIT, max_distance: float = S.RANGE_MAX_DISTANCE, votes: str | None = None) -> DataFrame:
    """J7 + T3 + T4: ``(payload..., _q, distance, also..., _range)`` of queries ``(_q, _qv,
    _subs, _wide, _g, vectors of also...)``.

    A query has the rows of its subjects ``_subs`` and, with ``_wide``, those of its
    range search (the ``limit`` nearest below ``max_distance``). These are united
    without duplicates by the columns ``own`` where ``_wide`` is set; with ``apart``
    they aren't united, and ``_range`` tells range rows. With ``nearest`` only rows
    that can be among a query's first so many by a distance of ``also``, then the
    cosine distance, are returned, and rows as near as the last.

    With ``votes`` (a payload column or ``distance``) no row is returned but what they
    add up to, ``(_q, _entity, score, _first)`` as of ``linking.vote_scores``: the payload
    is then ``_place`` (the rows' order among equal distances), ``_entity`` and that column
    as numbers. A chunk whose queries have too many rows is taken in smaller ones."""
    from pyspark.sql.pandas.types import to_arrow_schema
    extra_vecs = S._distance_columns(also)
    out_schema = T.StructType([store.schema[c] for c in payload] + [
        T.StructField("_q", key_type, True), T.StructField("distance", T.DoubleType(), True), *[T.StructField(e, T.DoubleType(), True) for e in extra_vecs],
        T.StructField("_range", T.BooleanType(), False)])
    if votes:
        out_schema = T.StructType([out_schema["_q"], T.StructField("_entity", T.LongType(), True), T.StructField("score", T.DoubleType(), True),
                                   T.StructField("_first", T.LongType(), True)])
    arrow_out, path = to_arrow_schema(out_schema), store.path
    cols_read = list(dict.fromkeys([*payload, sub, *own, "_row", "_x"]))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def found(queries):
            q, groups, keys = S._float_matrix(queries.column("_qv")), _groups_of(queries), queries.column("_q").combine_chunks()
            norms_q = np.linalg.norm(q, axis=1)
            others = [S._float_matrix(queries.column(c)) for c in extra_vecs.values()]
            lists = queries.column("_subs").combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            names, owner = lists.flatten(), np.repeat(np.arange(len(q)), lengths)
            wide = queries.column("_wide").to_numpy().astype(bool)
            far = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            # queries with equal vectors (of one group) have one range search
            alike, which = {}, []
            for i in np.flatnonzero(wide):
                same = alike.setdefault((q[i].tobytes(), None if groups is None else groups[i]), [])
                which += [] if same else [i]
                same.append(i)
            lists_of = list(alike.values())
            which = np.array(which, np.int64)
            for at in range(0, len(which), max(1, CHUNK_ROWS // limit)):
                some = which[at:at + max(1, CHUNK_ROWS // limit)]
                r, c, _ = top_of_store(path, q[some], None if groups is None else groups[some], limit, "cosine", max_distance)
                for i, users in enumerate(lists_of[at:at + len(some)]):
                    mine = r[c == i]
                    far.append((np.tile(mine, len(users)), np.repeat(np.array(users, np.int64), len(mine))))
            far_rows, far_cols = (np.concatenate(z) for z in zip(*far))
            order = np.argsort(far_rows, kind="stable")
            far_rows, far_cols = far_rows[order], far_cols[order]
            bounds = np.full((2, len(others), len(q)), np.inf)
            held, n_held = [], 0
            last, seen = None, np.zeros(len(q), bool)
            read = 0

            def measured(x, norms, rows, cols):
                """Cosine distances and the further distances of pairs."""
                dist = np.empty(len(rows))
                for s0 in range(0, len(rows), S.SLICE_ROWS):
                    s1 = slice(s0, s0 + S.SLICE_ROWS)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        dist[s1] = 1.0 - np.einsum("ij,ij->i", x[rows[s1]], q[cols[s1]]) / (norms[rows[s1]] * norms_q[cols[s1]])
                return np.where(np.isfinite(dist), dist, np.nan), [S._pair_l2(x, o, rows, cols) for o in others]

            def out(table, cols, dist, far_off, marks):
                for at in range(0, len(cols), OUT_ROWS):
                    s = slice(at, at + OUT_ROWS)
                    columns = [table.column(c).slice(at, OUT_ROWS).combine_chunks() for c in payload] + [keys.take(pa.array(cols[s])), pa.array(dist[s], pa.float64(), mask=np.isnan(dist[s]))]
                    columns += [pa.array(o[s]) for o in far_off] + [pa.array(marks[s])]
                    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(columns, arrow_out)], schema=arrow_out)

            def nearest_held():
                table = pa.concat_tables([h[0] for h in held])
                cols, dist, marks = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
                far_off = [np.concatenate([h[4][i] for h in held]) for i in range(len(others))]
                near = np.nan_to_num(dist, nan=-np.inf)
                keep = np.unique(np.concatenate([S._nearest_pairs(cols * 2 + marks, [*by, near], nearest) for by in [[o] for o in far_off] or [[]]]))
                return table.take(pa.array(keep)).combine_chunks(), cols[keep], dist[keep], marks[keep], [o[keep] for o in far_off]

            for block in _store_blocks(path, cols_read, _block_rows(q.shape[1], len(q)), _named(groups)):
                x, ids = S._float_matrix(block.column("_x")), block.column("_row").to_numpy()
                base, norms = block.select(payload), np.linalg.norm(x, axis=1)
                uris = block.column(sub).combine_chunks().dictionary_encode()
                code = uris.indices.fill_null(len(uris.dictionary)).to_numpy().astype(np.int64)
                hit = pc.index_in(names, value_set=uris.dictionary)
                known = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
                has = np.zeros((len(q), len(uris.dictionary) + 1), bool)
                has[owner[known], hit.fill_null(0).to_numpy().astype(np.int64)[known]] = True
                has[:, -1] = False
                mine = has[:, code]
                ranged = np.zeros_like(mine)
                part = slice(*np.searchsorted(far_rows, [ids[0], ids[-1] + 1]))
                ranged[far_cols[part], np.searchsorted(ids, far_rows[part])] = True
                if apart:
                    masks = [mine, ranged]
                else:
                    both = mine | ranged
                    if wide.any():      # rows with equal ``own`` stand side by side: of such a run a query gets the first it has
                        same = np.ones(len(ids), bool)
                        for c in own:
                            v = block.column(c).combine_chunks()
                            same[1:] &= pc.fill_null(pc.equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False)
                        ends = [tuple(block.column(c)[i].as_py() for c in own) for i in (0, len(ids) - 1)]
                        same[0] = ends[0] == last
                        for i in np.flatnonzero(same | np.append(same[1:], True)):
                            if not same[i]:
                                seen = np.zeros(len(q), bool)
                            both[:, i] &= ~(seen & wide)
                            seen = seen | both[:, i]
                        last = ends[1]
                    masks = [both]
                for mark, mask in enumerate(masks):
                    if votes:
                        rows, cols = np.nonzero(mask.T)
                        n_held += len(rows)
                        if n_held > VOTE_PAIRS and len(q) > 1:
                            raise _TooManyPairs
                        held.append((base, (rows + read).astype(np.int64), cols.astype(np.int16), measured(x, norms, rows, cols)[0]))
                        read += len(ids)
                        continue
                    if nearest is None:
                        cols, rows = np.nonzero(mask)
                        for at in range(0, len(rows), OUT_ROWS):
                            r, c = rows[at:at + OUT_ROWS], cols[at:at + OUT_ROWS]
                            dist, far_off = measured(x, norms, r, c)
                            yield from out(base.take(pa.array(r)), c, dist, far_off, np.full(len(r), bool(mark)))
                        continue
                    if not mask.any():
                        continue
                    # the few rows that any query has
                    some = np.flatnonzero(mask.any(0))
                    mask = mask[:, some]
                    near = mask if not others else np.zeros_like(mask)
                    for i, o in enumerate(others):
                        # the product's distances, less exact than the plain ones, only say which rows can't be near
                        d = np.where(mask, S._block_distance(x[some], o, "l2").T, np.inf)
                        slack = 2e-6 * (1 + np.abs(x).max(initial=0) + np.abs(o).max(initial=0))
                        if d.shape[1] >= nearest:
                            bounds[mark, i] = np.minimum(bounds[mark, i], np.partition(d, nearest - 1, axis=1)[:, nearest - 1] + slack)
                        near |= mask & (d <= bounds[mark, i][:, None] + slack)
                    cols, rows = np.nonzero(near)
                    rows = some[rows]
                    dist, far_off = measured(x, norms, rows, cols)
                    held.append((base.take(pa.array(rows)), cols, dist, np.full(len(rows), bool(mark)), far_off))
                    n_held += len(rows)
                    if n_held > CHUNK_ROWS // 4:
                        table, cols, dist, marks, far_off = nearest_held()
                        held, n_held = [(table, cols, dist, marks, far_off)], len(cols) // 2
            if votes:
                yield from _votes(held, keys, votes, arrow_out)
            elif held:
                table, cols, dist, marks, far_off = nearest_held()
                yield from out(table, cols, dist, far_off, marks)

        size = CHUNK_QUERIES
        for queries in _chunks(batches, CHUNK_QUERIES):
            at = 0
            while at < len(queries):
                try:
                    yield from found(queries.slice(at, size).combine_chunks())
                except _TooManyPairs:       # nothing was returned yet
                    size //= 2
                else:
                    at += size

    return spread(queries, n).mapInArrow(run, out_schema)


def stage_vectors(vectors: DataFrame) -> str:
    """The distinct query vectors ``(_vk, _qv, _subs, _far, _g)`` in the order in which ``nearest_rows`` meets them."""
    path = scratch_path(vectors.sparkSession, "query-vectors")
    vectors.orderBy(*(["_g"] if "_g" in vectors.columns else []), "_vk").write.option("parquet.block.size", STORED_BYTES).parquet(path)
    return path


def _stored_vectors(path: str, keys: list[str], groups: list | None):
    """The rows of the sorted ``keys`` of ``stage_vectors``, in their order."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    wanted = (ds.field("_vk") >= min(keys)) & (ds.field("_vk") <= max(keys))
    if groups is not None:
        wanted = wanted & (ds.field("_g").isin(pa.array(groups, pa.string())) | ds.field("_g").is_null())
    found = ds.dataset(local_path(path), format="parquet").to_table(filter=wanted, use_threads=False)
    return found.take(pc.index_in(pa.array(keys), value_set=found.column("_vk").combine_chunks())).combine_chunks()


def nearest_rows(queries: DataFrame, n: int, dim: int, store: Store, vectors: str, key_type: T.DataType, also: list[str], own: list[str],
                 sub: str = "sub", limit: int = S.RANGE_LIMIT, max_distance: float = S.RANGE_MAX_DISTANCE) -> DataFrame:
    """T2 + T3 + T5 for queries ``(_q, _vk, _g, a vector _v_<name> for each of also)``: of
    the candidates of the query's mention vector ``_vk`` the one nearest to each context.

    ``vectors``: the distinct mention vectors (``stage_vectors``) with their hit subjects
    ``_subs`` and ``_far``, whether they have a range search (the ``limit`` nearest rows
    below ``max_distance``). Returns ``(own..., _q, distance, also..., _range)``: for each
    context, and apart for the hit subjects' rows and those of the range search
    (``_range``), the first row by context distance, cosine distance and store order;
    only that context's column is set.

    Candidates are a matter of the mention vector, so they are found once for all of its
    queries that stand together: a task gathers their rows as it reads the table, drops
    copies (of equal vectors only the first row in store order can be the answer) and
    compares the rest with the contexts. What is held for a query is its best row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    out_schema = T.StructType([store.schema[c] for c in own] + [
        T.StructField("_q", key_type, True), T.StructField("distance", T.DoubleType(), True), *[T.StructField(e, T.DoubleType(), True) for e in also],
        T.StructField("_range", T.BooleanType(), False)])
    arrow_out, path = to_arrow_schema(out_schema), store.path
    size = max(CHUNK_QUERIES, CONTEXT_BYTES // (8 * max(1, dim) * max(1, len(also))))
    tasks = max(1, min(n, max(queries.sparkSession.sparkContext.defaultParallelism, n // (4 * size))))
    keys = [*(["_g"] if "_g" in queries.columns else []), "_vk", "_q"]
    # copies of a query may go to different tasks, so that a frequent one is not one task's work
    spread_out = queries.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys, "_copy").sortWithinPartitions(*keys).drop("_copy")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def nearest(queries, starts, known, ranged):
            """``queries`` of vector ``i`` are those from ``starts[i]`` on; ``ranged``: each vector's range rows."""
            v, contexts, n = S._float_matrix(known.column("_qv")), [S._float_matrix(queries.column(f"_v_{c}")) for c in also], len(queries)
            lists = known.column("_subs").combine_chunks()
            names = lists.flatten().dictionary_encode()
            code = names.indices.fill_null(len(names.dictionary)).to_numpy().astype(np.int64)
            by_name = np.argsort(code, kind="stable")
            owner = np.repeat(np.arange(len(v)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[by_name]
            first = np.searchsorted(code[by_name], np.arange(len(names.dictionary) + 1))
            number = {s: i for i, s in enumerate(names.dictionary.to_pylist())}
            far_rows, far_vecs = np.concatenate([*ranged, np.zeros(0, np.int64)]), np.repeat(np.arange(len(v)), [len(r) for r in ranged])
            order = np.argsort(far_rows, kind="stable")
            far_rows, far_vecs = far_rows[order], far_vecs[order]
            shape = (2, len(also), n)
            best, cosine, place, kept = np.full(shape, np.inf), np.full(shape, np.inf), np.full(shape, -1), None
            held, n_rows, n_pairs = [], 0, 0

            def compare():
                nonlocal kept
                table, x = pa.concat_tables([h[0] for h in held]), np.concatenate([h[1] for h in held])
                rows, vecs = (np.concatenate([h[i] for h in held]) for i in (2, 3))     # vecs: 2 * vector + whether of its range search
                copies, norms = {}, np.linalg.norm(x, axis=1)
                alike = np.array([copies.setdefault(r.tobytes(), i) for i, r in enumerate(x)])
                order = np.lexsort((rows, vecs))
                rows, vecs = rows[order], vecs[order]
                cuts = np.flatnonzero(np.append(True, vecs[1:] != vecs[:-1]))
                offset = 0 if kept is None else len(kept)
                for a, b in zip(cuts, np.append(cuts[1:], len(vecs))):
                    i, mark = divmod(int(vecs[a]), 2)
                    mine = np.sort(rows[a:b][np.unique(alike[rows[a:b]], return_index=True)[1]])
                    u = x[mine]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        cos = 1.0 - np.einsum("ij,j->i", u, v[i]) / (norms[mine] * np.linalg.norm(v[i]))
                    cos = np.where(np.isfinite(cos), cos, -np.inf)       # no distance stands before all others
                    step = max(1, MOST_PAIRS // len(mine))
                    for e, c in enumerate(contexts):
                        for at in range(starts[i], starts[i + 1], step):
                            asks = slice(at, min(at + step, starts[i + 1]))
                            # the product's distances, less exact than the plain ones, only say which rows can't be nearest
                            d = np.nan_to_num(S._block_distance(c[asks], u, "l2"), nan=np.inf)
                            slack = 2e-6 * (1 + np.abs(u).max(initial=0) + np.abs(c[asks]).max(initial=0))
                            q, r = np.nonzero(d <= (np.fmin(d.min(axis=1), best[mark, e, asks]) + slack)[:, None])
                            plain = S._pair_l2(u, c[asks], r, q)
                            plain[np.isnan(plain)] = np.inf
                            order = np.lexsort((r, cos[r], plain, q))
                            q, r, plain = q[order], r[order], plain[order]
                            one = np.flatnonzero(np.append(True, q[1:] != q[:-1]))[:len(q)]
                            q, r, plain = q[one] + at, r[one], plain[one]
                            won = (place[mark, e, q] < 0) | (plain < best[mark, e, q]) | ((plain == best[mark, e, q]) & (cos[r] < cosine[mark, e, q]))
                            q, r = q[won], r[won]
                            best[mark, e, q], cosine[mark, e, q], place[mark, e, q] = plain[won], cos[r], offset + mine[r]
                # only rows that are some query's best stay
                used, at = np.unique(place[place >= 0], return_inverse=True)
                kept = (table if kept is None else pa.concat_tables([kept, table])).take(pa.array(used)).combine_chunks()
                place[place >= 0] = at

            columns = list(dict.fromkeys([*own, sub, "_row", "_x"]))
            for block in _store_blocks(path, columns, _block_rows(v.shape[1], len(v)), _named(_groups_of(known))):
                ids = block.column("_row").to_numpy()
                uris = block.column(sub).combine_chunks().dictionary_encode()
                of_dictionary = np.array([number.get(u, -1) for u in uris.dictionary.to_pylist()] + [-1], np.int64)
                subject = of_dictionary[uris.indices.fill_null(len(uris.dictionary)).to_numpy().astype(np.int64)]
                rows = np.flatnonzero(subject >= 0)
                begin, end = first[subject[rows]], first[subject[rows] + 1]
                total = np.cumsum(end - begin)
                vecs = owner[np.repeat(begin - (total - (end - begin)), end - begin) + np.arange(total[-1] if len(total) else 0)] * 2
                part = slice(*np.searchsorted(far_rows, [ids[0], ids[-1] + 1]))
                rows = np.append(np.repeat(rows, end - begin), np.searchsorted(ids, far_rows[part]))
                vecs = np.append(vecs, far_vecs[part] * 2 + 1)
                if not len(rows):
                    continue
                needed = np.unique(rows)
                taken = block.take(pa.array(needed))
                held.append((taken.select(own), S._float_matrix(taken.column("_x")), np.searchsorted(needed, rows) + n_rows, vecs))
                n_rows, n_pairs = n_rows + len(needed), n_pairs + len(rows)
                if 8 * n_rows * v.shape[1] > GATHER_BYTES or n_pairs > MOST_PAIRS:
                    compare()
                    held, n_rows, n_pairs = [], 0, 0
            if held:
                compare()
            asked = queries.column("_q").combine_chunks()
            for mark in (0, 1):
                for e in range(len(also)):
                    q = np.flatnonzero(place[mark, e] >= 0)
                    for at in range(0, len(q), OUT_ROWS):
                        some = q[at:at + OUT_ROWS]
                        rows, cos = kept.take(pa.array(place[mark, e, some])), cosine[mark, e, some]
                        far_off = [pa.array(best[mark, e, some]) if i == e else pa.nulls(len(some), pa.float64()) for i in range(len(also))]
                        columns = [rows.column(c).combine_chunks() for c in own] + [asked.take(pa.array(some)), pa.array(cos, pa.float64(), mask=np.isneginf(cos)), *far_off]
                        columns.append(pa.array(np.full(len(some), bool(mark))))
                        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(columns, arrow_out)], schema=arrow_out)

        before: dict = {}       # range rows of the vector that the next queries may have as well
        for chunk in _chunks(batches, size):
            asked = chunk.column("_q").combine_chunks()
            chunk = chunk.filter(pa.array(np.append(True, pc.not_equal(asked[1:], asked[:-1]).to_numpy(zero_copy_only=False)))).combine_chunks()
            names = chunk.column("_vk").combine_chunks().dictionary_encode()
            starts = np.append(np.searchsorted(names.indices.to_numpy(), np.arange(len(names.dictionary))), len(chunk))
            names = names.dictionary.to_pylist()
            for at in range(0, len(names), CHUNK_QUERIES):
                some = names[at:at + CHUNK_QUERIES]
                own_starts = starts[at:at + len(some) + 1]
                queries = chunk.slice(own_starts[0], own_starts[-1] - own_starts[0])
                known = _stored_vectors(vectors, some, _named(_groups_of(queries)))
                v, groups = S._float_matrix(known.column("_qv")), _groups_of(known)
                ranged = {k: before.get(k) if far else np.zeros(0, np.int64) for k, far in zip(some, known.column("_far").to_pylist())}
                new = np.array([i for i, k in enumerate(some) if ranged[k] is None], np.int64)
                for first in range(0, len(new), max(1, CHUNK_ROWS // limit)):
                    part = new[first:first + max(1, CHUNK_ROWS // limit)]
                    rows, cols, _ = top_of_store(path, v[part], None if groups is None else groups[part], limit, "cosine", max_distance)
                    ends = np.searchsorted(cols, np.arange(len(part) + 1))
                    ranged |= {some[i]: rows[ends[j]:ends[j + 1]] for j, i in enumerate(part)}
                before = {some[-1]: ranged[some[-1]]} if known.column("_far")[-1].as_py() else {}
                yield from nearest(queries, own_starts - own_starts[0], known, [ranged[k] for k in some])

    return spread_out.mapInArrow(run, out_schema)


class _TooManyPairs(Exception):
    """The queries of a chunk have more rows than are to be held."""


def _votes(held: list, keys, by: str, schema) -> Iterator:
    """The votes of a chunk's queries, of which ``held`` has all rows: blocks of
    ``(table, rows, queries, distances)``, rows numbered over all blocks."""
    import pyarrow as pa
    if not held:
        return
    column = lambda c: np.concatenate([h[0].column(c).to_numpy() for h in held])
    place, entity = column("_place"), column("_entity")
    what = None if by == "distance" else column(by)
    rows, cols, dist = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    held.clear()
    order = np.argsort(cols, kind="stable")
    ends = np.searchsorted(cols[order], np.arange(len(keys) + 1))
    for i in range(len(keys)):
        own = order[ends[i]:ends[i + 1]]
        if not len(own):
            continue
        r, d = rows[own], np.nan_to_num(dist[own], nan=-np.inf)     # no distance stands before all others
        sort = np.lexsort((place[r], d))
        r, d = r[sort], d[sort]
        v = d if what is None else what[r]
        rank = np.cumsum(np.append(False, v[1:] != v[:-1]))
        names, first, code = np.unique(entity[r], return_index=True, return_inverse=True)
        score = np.bincount(code, weights=1.0 / (rank + 1))
        columns = [keys.take(pa.array(np.full(len(names), i))), pa.array(names), pa.array(score), pa.array(first + 1)]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(columns, schema)], schema=schema)
