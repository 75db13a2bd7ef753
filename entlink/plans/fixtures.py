"""Fixture views derived from the driver tables.

Each view is one SQL text that runs unchanged in Spark SQL and DuckDB, so
the Spark query under test and its DuckDB oracle start from the same rows.
Views cover whole tables; ``vectors`` / ``mentions`` split ``embeddings`` into
a searched table and held-out queries (every row is used by one of them).
In Spark the views are registered as temp views over the parquet tables of
one scale-factor directory; in DuckDB they become CTEs (see ``with_views``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

# Order matters: a view may only use views defined above it.
VIEWS: dict[str, str] = {}

VIEWS["kg_lines"] = """
SELECT concat('<http://kg.example/part/', p_partkey, '> <http://www.w3.org/2000/01/rdf-schema#label> "', p_name, '"@en .') AS value
FROM part
UNION ALL SELECT concat('<http://kg.example/part/', p_partkey, '> <http://kg.example/brand> "', p_brand, '"@en .')
FROM part
UNION ALL SELECT concat('<http://kg.example/part/', l_partkey, '> <http://kg.example/status> "', l_returnflag, ' ', l_linestatus, '"@en .')
FROM lineitem
UNION ALL SELECT concat('<http://kg.example/part/', p_partkey, '> <http://kg.example/type> "', p_type, '"@fr .')
FROM part
UNION ALL SELECT concat('<http://kg.example/part/', p_partkey, '> <http://kg.example/size> "', p_size, '"^^<http://www.w3.org/2001/XMLSchema#integer> .')
FROM part
UNION ALL SELECT concat('<http://kg.example/part/', l_partkey, '> <http://kg.example/suppliedBy> <http://kg.example/supplier/', l_suppkey, '> .')
FROM lineitem
"""

VIEWS["triples"] = """
SELECT DISTINCT *
FROM (
SELECT concat('http://kg.example/part/', p_partkey) AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, CAST(NULL AS STRING) AS o_iri, p_name AS o_lit, 'en' AS lang, CAST(NULL AS STRING) AS dtype
FROM part
UNION ALL SELECT concat('http://kg.example/part/', p_partkey), 'http://kg.example/brand', NULL, p_brand, 'en', NULL
FROM part
UNION ALL SELECT concat('http://kg.example/part/', l_partkey), 'http://kg.example/status', NULL, concat(l_returnflag, ' ', l_linestatus), 'en', NULL
FROM lineitem
UNION ALL SELECT concat('http://kg.example/part/', p_partkey), 'http://kg.example/type', NULL, p_type, 'fr', NULL
FROM part
UNION ALL SELECT concat('http://kg.example/part/', p_partkey), 'http://kg.example/size', NULL, CAST(p_size AS STRING), NULL, 'http://www.w3.org/2001/XMLSchema#integer'
FROM part
UNION ALL SELECT concat('http://kg.example/part/', l_partkey), 'http://kg.example/suppliedBy', concat('http://kg.example/supplier/', l_suppkey), NULL, NULL, NULL
FROM lineitem) t
"""

VIEWS["literals"] = """
SELECT s, p, o_lit AS o
FROM triples
WHERE lang = 'en'
"""

VIEWS["links"] = """
SELECT s, p, o_iri AS o
FROM triples
WHERE o_iri LIKE 'http%'
"""

VIEWS["emb_literals"] = """
SELECT concat('http://kg.example/entity/', vec_id % 50) AS s, CASE WHEN vec_id < 50 THEN 'http://www.w3.org/2000/01/rdf-schema#label' ELSE concat('http://kg.example/p', vec_id % 7) END AS p, concat(CASE WHEN vec_id % 2 = 0 THEN 'Lit ' ELSE 'lit ' END, CAST(floor(sqrt(vec_id)) AS INT)) AS o, 'L' AS typeObject, embedding, vec_id
FROM embeddings
"""

# pages of part names, and a page for each fifth of the entities
VIEWS["disambig"] = """
SELECT concat('http://kg.example/disambiguation/', replace(lower(p_name), ' ', '_')) AS s, concat('http://kg.example/part/', p_partkey) AS o
FROM part
UNION ALL SELECT DISTINCT concat('http://kg.example/disambiguation/entity_', vec_id % 5), s
FROM emb_literals
"""

VIEWS["ent_links"] = """
SELECT DISTINCT s, concat('http://kg.example/entity/', (vec_id % 50 * 7 + CAST(floor(vec_id / 50.0) AS INT) + 3) % 50) AS o
FROM emb_literals
"""

# Rows 46 apart are mentions whose vector the table also holds, as an alias and as an entity row: of their
# gold entity, or, 184 apart, of another one that shares its disambiguation page.
VIEWS["vectors"] = """
SELECT s AS sub, p AS pred, o AS obj, typeObject AS type_obj, embedding, vec_id
FROM emb_literals
WHERE vec_id % 23 <> 0
UNION ALL SELECT concat('http://kg.example/entity/', CASE WHEN vec_id % 184 = 0 THEN (vec_id + 5) % 50 ELSE vec_id % 50 END), 'http://kg.example/alias', o, 'L', embedding, vec_id + 1000000
FROM emb_literals
WHERE vec_id % 46 = 0
UNION ALL SELECT concat('http://kg.example/entity/', CASE WHEN vec_id % 184 = 0 THEN (vec_id + 5) % 50 ELSE vec_id % 50 END), 'http://kg.example/self', s, 'E', embedding, vec_id + 2000000
FROM emb_literals
WHERE vec_id % 46 = 0
"""

VIEWS["mentions"] = """
SELECT m.vec_id AS idx, m.o AS mention, CASE WHEN m.vec_id % 115 = 0 THEN 'http://kg.example/entity/none' WHEN m.vec_id % 69 = 0 THEN upper(m.s) ELSE m.s END AS y_true, m.embedding AS mention_vec, coalesce(c.embedding, m.embedding) AS ctx_vec
FROM emb_literals m
LEFT JOIN emb_literals c ON c.vec_id = m.vec_id + 1 AND m.vec_id % 46 <> 0
WHERE m.vec_id % 23 = 0
"""

VIEWS["preds"] = """
SELECT p_partkey AS idx, concat('http://kg.example/part/', p_partkey) AS y_true, concat('http://kg.example/part/', CASE WHEN p_partkey % 3 = 0 THEN p_partkey WHEN p_partkey % 3 = 1 THEN min(p_partkey) OVER (PARTITION BY lower(p_name)) ELSE p_partkey + 1 END) AS y_pred
FROM part
"""

VIEWS["class_preds"] = """
SELECT vec_id AS idx, concat('http://kg.example/C', label) AS y_true, concat('http://kg.example/c', CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END) AS y_pred
FROM embeddings
"""

VIEW_DEPS = {
    "kg_lines": [], "triples": [], "literals": ["triples"], "links": ["triples"],
    "disambig": ["emb_literals"], "emb_literals": [], "ent_links": ["emb_literals"],
    "vectors": ["emb_literals"], "mentions": ["emb_literals"], "preds": [], "class_preds": [],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in VIEW_DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    order = list(VIEWS)
    return sorted(out, key=order.index)


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs of the named fixture views (for DuckDB)."""
    views = _closure(names)
    if not views:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in views)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    from entlink.session import ship_package
    ship_package(spark)
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def load(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame | tuple[DataFrame, ...]:
    """Register driver tables of ``sf_dir`` and return the named fixture views."""
    register_tables(spark, sf_dir)
    for n in _closure(list(names)):
        spark.sql(VIEWS[n]).createOrReplaceTempView(n)
    dfs = tuple(spark.table(n) for n in names)
    return dfs[0] if len(dfs) == 1 else dfs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from entlink.session import ship_package
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
