"""Graphs: dependency levels and cycles of table catalogs, degrees and bounded traversal of data.

The keys of one store are a small graph, so stores of up to ``together`` edges are each worked off in one go, all
in one job.  Larger stores take rounds that are bounded by path length; every round is written to the shared folder, so a
lost executor re-reads the last round instead of replaying all of them.  No closure is built.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import with_totals
from plumbline.session import cut_lineage


def _edges(fks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct child -> parent edges inside a store; self-references do not order anything."""
    known = nodes.select("store", F.col("table_name").alias("parent"))
    return (
        fks.select("store", F.col("table_name").alias("child"), F.col("ref_table").alias("parent"))
        .where("child <> parent")
        .distinct()
        .join(known, ["store", "parent"], "left_semi")
    )


def _peel(nodes: DataFrame, edges: DataFrame, head: str, tail: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeatedly remove nodes without an edge from ``head``; returns (removed with level, left
    nodes, left edges).  ``tail`` is the other end of each edge."""
    removed = None
    level = 0
    while True:
        blocked = edges.select("store", F.col(head).alias("table_name")).distinct()
        free = nodes.join(blocked, ["store", "table_name"], "left_anti").withColumn("level", F.lit(level))
        free = cut_lineage(free, f"{label}-free")
        if free.isEmpty():
            return (removed if removed is not None else free), nodes, edges
        removed = free if removed is None else removed.unionByName(free)
        nodes = cut_lineage(nodes.join(free, ["store", "table_name"], "left_anti"), f"{label}-nodes")
        gone = free.select("store", F.col("table_name").alias(tail))
        edges = cut_lineage(edges.join(gone, ["store", tail], "left_anti"), f"{label}-edges")
        level += 1


TOGETHER = 50_000  # edges of a store that a task takes at once


def _by_size(edges: DataFrame, together: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of stores that have at most ``together`` of them, and the larger stores, if there are any."""
    large = cut_lineage(edges.groupBy("store").count().where(F.col("count") > together).select("store"), "large-stores")
    return (edges, None) if large.isEmpty() else (edges.join(large, "store", "left_anti"), large)


def _of_each(edges: pd.DataFrame, head: str, tail: str) -> dict[str, list[str]]:
    """Nodes at the ``tail`` of the edges of each node at their ``head``."""
    out: dict[str, list[str]] = {}
    for a, b in zip(edges[head], edges[tail], strict=True):
        out.setdefault(a, []).append(b)
    return out


def levels_of(edges: pd.DataFrame) -> dict[str, int]:
    """Level of every node of ``child, parent`` edges: one more than the highest of its parents; -1 on or behind a cycle."""
    children, waits = _of_each(edges, "parent", "child"), edges.groupby("child")["parent"].size().to_dict()
    levels = dict.fromkeys([*edges["child"], *edges["parent"]], -1)
    front, level = [n for n in levels if n not in waits], 0
    while front:
        following = []
        for node in front:
            levels[node] = level
            for child in children.get(node, ()):
                waits[child] -= 1
                if not waits[child]:
                    following.append(child)
        front, level = following, level + 1
    return levels


def components_of(edges: pd.DataFrame) -> list[list[str]]:
    """Strongly connected components of ``child, parent`` edges: in the reverse of the order in which a walk leaves the
    nodes, each is reached backward from its first."""
    forward, backward = _of_each(edges, "child", "parent"), _of_each(edges, "parent", "child")
    seen, left = set(), []
    for start in forward:
        walk = [] if start in seen else [(start, iter(forward[start]))]
        seen.add(start)
        while walk:
            node, rest = walk[-1]
            step = next((n for n in rest if n not in seen), None)
            if step is None:
                left.append(node)
                walk.pop()
            else:
                seen.add(step)
                walk.append((step, iter(forward.get(step, ()))))
    out, taken = [], set()
    for start in reversed(left):
        if start not in taken:
            taken.add(start)
            out.append([start])
            for node in out[-1]:  # grows as it is walked
                new = [n for n in backward.get(node, ()) if n not in taken]
                taken.update(new)
                out[-1] += dict.fromkeys(new)
    return out


def load_order(nodes: DataFrame, fks: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Topological level per table, parents first; -1 for tables on or behind a cycle."""
    nodes = cut_lineage(nodes.select("store", "table_name").distinct(), "order-nodes")
    edges = cut_lineage(_edges(fks, nodes), "order-edges")
    small, large = _by_size(edges, together)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = levels_of(group)
        return pd.DataFrame({"store": key[0], "table_name": list(found), "level": list(found.values())})

    found = small.groupBy("store").applyInPandas(run, "store string, table_name string, level int")
    rest = nodes if large is None else nodes.join(large, "store", "left_anti")
    order = rest.join(found, ["store", "table_name"], "left").select("store", "table_name", F.coalesce("level", F.lit(0)).alias("level"))
    if large is None:
        return order
    placed, left, _ = _peel(nodes.join(large, "store"), edges.join(large, "store"), "child", "parent", "order")
    return order.unionByName(placed).unionByName(left.withColumn("level", F.lit(-1)))


def fk_cycles(nodes: DataFrame, fks: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Tables on a foreign-key cycle with the cycle's size (strongly connected components of two or more)."""
    nodes = cut_lineage(nodes.select("store", "table_name").distinct(), "cycle-nodes")
    edges = cut_lineage(_edges(fks, nodes), "cycle-edges")
    small, large = _by_size(edges, together)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], n, len(c)) for c in components_of(group) if len(c) > 1 for n in c]
        return pd.DataFrame(rows, columns=["store", "table_name", "cycle_tables"])

    found = small.groupBy("store").applyInPandas(run, "store string, table_name string, cycle_tables long")
    found = found.withColumn("severity", F.lit(4))
    return found if large is None else found.unionByName(_cycles_in_rounds(nodes.join(large, "store"), edges.join(large, "store")))


def _cycles_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cycles of stores too large for a task.

    Tables outside any cycle are peeled off from both ends.  What is left is split into strongly
    connected components: spread the largest label forward, then collect, backward from each
    label's owner, the tables that carry it.
    """
    found = None
    while True:
        _, nodes, edges = _peel(nodes, edges, "child", "parent", "cycle-down")
        _, nodes, edges = _peel(nodes, edges, "parent", "child", "cycle-up")
        if nodes.isEmpty():
            break
        colors = _spread(nodes, edges)
        members = _collect(colors, edges)
        found = members if found is None else found.unionByName(members)
        nodes = cut_lineage(nodes.join(members, ["store", "table_name"], "left_anti"), "cycle-nodes")
        for end in ("child", "parent"):
            gone = members.select("store", F.col("table_name").alias(end))
            edges = edges.join(gone, ["store", end], "left_anti")
        edges = cut_lineage(edges, "cycle-edges")
    if found is None:
        found = nodes.withColumn("color", F.col("table_name"))
    sizes = found.groupBy("store", "color").agg(F.count(F.lit(1)).alias("cycle_tables"))
    cyclic = sizes.where("cycle_tables > 1")
    return found.join(cyclic, ["store", "color"]).select("store", "table_name", "cycle_tables", F.lit(4).alias("severity"))


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest table name that reaches each table along child -> parent edges."""
    colors = nodes.withColumn("color", F.col("table_name")).withColumn("moved", F.lit(True))
    while True:
        sent = edges.join(colors.withColumnRenamed("table_name", "child"), ["store", "child"]).select(
            "store", F.col("parent").alias("table_name"), F.col("color").alias("offer")
        )
        best = sent.groupBy("store", "table_name").agg(F.max("offer").alias("offer"))
        step = colors.select("store", "table_name", "color").join(best, ["store", "table_name"], "left")
        colors = cut_lineage(
            step.select(
                "store",
                "table_name",
                F.greatest("color", "offer").alias("color"),
                F.coalesce(F.col("offer") > F.col("color"), F.lit(False)).alias("moved"),
            ),
            "cycle-colors",
        )
        if colors.where("moved").isEmpty():
            return colors.drop("moved")


def _collect(colors: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables that reach the owner of their own color: exactly the owner's component."""
    inside = (
        edges.join(colors.withColumnRenamed("table_name", "child").withColumnRenamed("color", "cc"), ["store", "child"])
        .join(colors.withColumnRenamed("table_name", "parent").withColumnRenamed("color", "pc"), ["store", "parent"])
        .where("cc = pc")
        .select("store", "child", "parent")
    )
    inside = cut_lineage(inside, "cycle-inside")
    reached = cut_lineage(colors.where("color = table_name").withColumn("round", F.lit(0)), "cycle-reached")
    rounds = 0
    while True:
        edge = reached.where(F.col("round") == rounds).select("store", F.col("table_name").alias("parent"))
        new = (
            inside.join(edge, ["store", "parent"], "left_semi")
            .select("store", F.col("child").alias("table_name"))
            .distinct()
            .join(reached, ["store", "table_name"], "left_anti")
            .join(colors, ["store", "table_name"])
        )
        rounds += 1
        new = cut_lineage(new.withColumn("round", F.lit(rounds)), "cycle-new")
        if new.isEmpty():
            return reached.select("store", "table_name", "color")
        reached = reached.unionByName(new)


def degrees(edges: DataFrame) -> DataFrame:
    """Degree per node of an undirected edge list, counted map-side before the shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def supernode_degree(edges: DataFrame, k: int) -> DataFrame:
    """Top ``k`` nodes with the ratio of their degree to the median (basis points)."""
    per_node = degrees(edges)
    median = per_node.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY degree)").cast("long").alias("median_degree"))
    top = per_node.orderBy(F.desc("degree"), "node").limit(k)
    return with_totals(top, median).withColumn("ratio_bp", F.expr("CAST((10000 * degree) div median_degree AS BIGINT)"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` of any seed, each with its distance.

    Every round joins only the new frontier (one row per node) to the edges; paths are never listed.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut_lineage(both, "hop-edges")
    reached = cut_lineage(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "hop-seeds")
    for hop in range(1, hops + 1):
        frontier = reached.where(F.col("hop") == hop - 1).select(F.col("node").alias("src"))
        new = both.join(frontier, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = new.join(reached, "node", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(cut_lineage(new, "hop-new"))
    return reached
