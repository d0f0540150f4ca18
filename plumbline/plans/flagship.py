"""The whole audit on the supplied warehouse: how healthy is it, and what to fix first?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.audit import Audit
from plumbline.session import TABLES, read_table

PRIMARY_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]
INDEXES = [
    ("orders", "ix_orders_customer", ["o_custkey"], False),
    ("lineitem", "ix_line", ["l_orderkey", "l_linenumber"], False),
    ("lineitem", "ix_line_again", ["l_orderkey", "l_linenumber"], False),
    ("lineitem", "ix_line_order", ["l_orderkey"], False),
]
UNIQUE = [
    ("orders", ["o_orderkey"]),
    ("lineitem", ["l_orderkey", "l_linenumber"]),
    ("conversations", ["conv_id", "turn"]),
]


def warehouse_audit(spark: SparkSession, sf_dir: str) -> Audit:
    frames = {t: read_table(spark, sf_dir, t) for t in TABLES}
    return Audit(spark, "warehouse").catalog(frames, PRIMARY_KEYS, FOREIGN_KEYS, INDEXES).rules().evidence(UNIQUE)


def warehouse_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every open finding with its priority, most pressing first."""
    return warehouse_audit(spark, sf_dir).next_actions().orderBy("priority", "id")
