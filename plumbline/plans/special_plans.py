"""Vector, graph, paging and history operators bound to the supplied tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import graph, history, vectors
from plumbline.operators import state_rules as sr
from plumbline.operators.ordered import time_bucket
from plumbline.plans.registry import query

CENT = """em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  sp AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM em), mn AS (SELECT label, pos, avg(x) AS m FROM sp GROUP BY 1, 2),
  q AS (SELECT label AS query_id, list(m ORDER BY pos) AS qv FROM mn GROUP BY 1)"""
DIST = {"cosine": "1 - list_cosine_similarity(v, qv)", "l2": "list_distance(v, qv)", "ip": "-list_inner_product(v, qv)"}


def knn_sql(name: str, metric: str, k: int, source: str = "em", where: str = "") -> str:
    return f"""{name} AS (SELECT q.query_id, vec_id AS id, round({DIST[metric]}, 9) AS d FROM {source} JOIN q ON true {where}
       QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY d, vec_id) <= {k})"""


def label_queries(i):
    return vectors.centroids(i.embeddings, "label", "embedding")


def _knn(metric):
    @query(
        f"knn_exact_{metric}",
        f"""WITH {CENT}, {knn_sql('n', metric, 10)} SELECT CAST(query_id AS BIGINT) AS query_id, id, round(d, 4) AS distance,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS INT) AS rank FROM n""",
    )
    def _(i):
        out = vectors.knn_exact(i.embeddings, "vec_id", "embedding", label_queries(i), 10, metric)
        return out.withColumn("distance", F.round("distance", 4))


for _metric in vectors.METRICS:
    _knn(_metric)


ODD = "CASE vec_id % 7 WHEN 0 THEN {zero} WHEN 1 THEN {short} WHEN 2 THEN {nan} WHEN 3 THEN NULL ELSE embedding END"


@query(
    "comparable_vectors",
    """SELECT CASE vec_id % 7 WHEN 0 THEN 'zero' WHEN 1 THEN 'dimension' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'null' ELSE 'ok' END AS status,
       CAST(count(*) AS BIGINT) AS vectors FROM embeddings GROUP BY 1""",
)
def _(i):
    odd = ODD.format(
        zero="transform(embedding, x -> CAST(0 AS FLOAT))", short="slice(embedding, 1, 63)", nan="transform(embedding, (x, k) -> IF(k = 5, CAST('NaN' AS FLOAT), x))"
    )
    return vectors.comparable_vectors(i.embeddings.withColumn("embedding", F.expr(odd)), "embedding", 64)


@query(
    "vector_dim_check",
    "SELECT CAST(len(embedding) AS INT) AS dim, CAST(count(*) AS BIGINT) AS vectors, len(embedding) = 64 AS matches FROM embeddings GROUP BY len(embedding)",
)
def _(i):
    return vectors.dim_check(i.embeddings, "embedding", 64)


@query(
    "vector_norm_check",
    """SELECT label, CAST(count(*) AS BIGINT) AS vectors, CAST(count(*) FILTER (abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.00001) AS BIGINT) AS unit_vectors,
       count(*) = count(*) FILTER (abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.00001) AS normalized FROM embeddings GROUP BY 1""",
)
def _(i):
    return vectors.norm_check(i.embeddings, "embedding", "label")


@query(
    "vector_metric_agreement",
    f"""WITH {CENT.replace('CAST(embedding AS DOUBLE[]) AS v', 'list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 3)) AS v')},
        {knn_sql('a', 'cosine', 10)}, {knn_sql('b', 'l2', 10)}
        SELECT CAST(a.query_id AS BIGINT) AS query_id, CAST(count(*) AS BIGINT) AS neighbours, CAST(count(b.id) AS BIGINT) AS shared FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.id = b.id GROUP BY 1""",
)
def _(i):
    scaled = i.embeddings.withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3 + 1).cast("double"))
    )
    centers = vectors.centroids(scaled, "label", "embedding")
    return vectors.metric_agreement(scaled, "vec_id", "embedding", centers, 10, "cosine", "l2")


@query(
    "vector_filter_recall",
    f"""WITH {CENT}, {knn_sql('a', 'cosine', 10, where='AND em.label = q.query_id')}, {knn_sql('b', 'cosine', 10)}
        SELECT CAST(a.query_id AS BIGINT) AS query_id, CAST(count(*) AS BIGINT) AS wanted, CAST(count(b.id) AS BIGINT) AS kept FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.id = b.id GROUP BY 1""",
)
def _(i):
    return vectors.filter_recall(i.embeddings, "vec_id", "embedding", "label", label_queries(i), 10)


@query(
    "vector_dimension",
    """SELECT label % 4 AS model, CAST(CASE WHEN label % 4 = 3 THEN 128 ELSE 64 END AS INT) AS declared_dim, CAST(count(*) AS BIGINT) AS vectors,
       CAST(count(*) FILTER (len(embedding) <> CASE WHEN label % 4 = 3 THEN 128 ELSE 64 END) AS BIGINT) AS mismatched FROM embeddings GROUP BY 1, 2""",
)
def _(i):
    measured = i.embeddings.select((F.col("label") % 4).alias("model"), F.size("embedding").alias("dim"))
    models = measured.select("model").distinct().withColumn("declared_dim", F.when(F.col("model") == 3, 128).otherwise(64))
    return sr.vector_dimension(measured, models)


# --- graphs of data -----------------------------------------------------------------------------

DEGREE = "dg AS (SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM {edges_fx} UNION ALL SELECT dst FROM {edges_fx}) e GROUP BY 1)"


@query(
    "supernode_degree",
    f"""WITH {DEGREE}, m AS (SELECT CAST(quantile_disc(degree, 0.5) AS BIGINT) AS median_degree FROM dg)
        SELECT node, degree, median_degree, CAST(10000 * degree // median_degree AS BIGINT) AS ratio_bp FROM dg, m ORDER BY degree DESC, node LIMIT 20""",
)
def _(i):
    return graph.supernode_degree(i.edges_fx, 20)


@query(
    "k_hop",
    f"""WITH {DEGREE}, b AS (SELECT src, dst FROM {{edges_fx}} UNION SELECT dst, src FROM {{edges_fx}}), h0 AS (SELECT node FROM dg ORDER BY degree DESC, node LIMIT 1),
        h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (FROM h0) AND dst NOT IN (FROM h0)),
        h2 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (FROM h1) AND dst NOT IN (FROM h0) AND dst NOT IN (FROM h1))
        SELECT node, CAST(0 AS INT) AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
)
def _(i):
    seeds = graph.degrees(i.edges_fx).orderBy(F.desc("degree"), "node").limit(1)
    return graph.k_hop(i.edges_fx, seeds, 2)


# --- history and paging -------------------------------------------------------------------------


@query(
    "validity_overlap",
    """WITH p AS (SELECT v.entity_id, e.version_id AS previous_version, v.version_id AS version,
                 CASE WHEN e.valid_to IS NULL OR v.valid_from < e.valid_to THEN 'overlap' WHEN v.valid_from > e.valid_to THEN 'gap' END AS problem
          FROM {validity_fx} v JOIN {validity_fx} e ON v.entity_id = e.entity_id AND (e.valid_from < v.valid_from OR (e.valid_from = v.valid_from AND e.version_id < v.version_id))
          QUALIFY row_number() OVER (PARTITION BY v.version_id ORDER BY e.valid_to DESC NULLS FIRST, e.version_id DESC) = 1)
       SELECT * FROM p WHERE problem IS NOT NULL""",
)
def _(i):
    bucket = time_bucket("valid_from", 90 * 86400)
    return history.validity_overlap(i.validity_fx, "entity_id", "valid_from", "valid_to", "version_id", bucket)


@query("keyset_page", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 499 ORDER BY o_orderkey LIMIT 50")
def _(i):
    return history.keyset_page(i.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 499, 50)


@query("offset_page", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 500")
def _(i):
    return history.offset_page(i.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 500, 50)


@query(
    "backfill_batches",
    "SELECT CAST(o_orderkey // 1000 AS BIGINT) AS batch, min(o_orderkey) AS from_key, max(o_orderkey) AS to_key, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 1",
)
def _(i):
    return history.backfill_batches(i.orders, "o_orderkey", 1000)
