"""Near copies by SimHash: every fingerprint meets others in the middle, on variants within half the radius."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import components, map_batches, sliced, texts_of
from plumbline.session import cut_lineage, drop_stage

BITS = 64


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) text's shingles of ``words`` words, repeats included.

    A text of fewer words is one shingle; a text of no words has fingerprint zero.  A bit is set
    if it is set in over half of the shingles' XXH64.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - words].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a long) and ``digest`` (MD5 of the text) of every whole text; null
    texts count as empty, rows that repeat stay, an empty table gives no rows."""
    source = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches):
            prints = np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64)
            digests = [hashlib.md5(t.encode(), usedforsecurity=False).hexdigest() for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "fingerprint": pa.array(prints.view(np.int64)), "digest": pa.array(digests, pa.string())})

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint long, digest string")


@functools.lru_cache(maxsize=256)
def flips(width: int, most: int) -> np.ndarray:
    """Masks of at most ``most`` of ``width`` low bits."""
    masks = [sum(1 << b for b in at) for k in range(most + 1) for at in combinations(range(width), k)]
    return np.array(masks, dtype=np.uint64)


def forest(prints: np.ndarray, cell: int, depth: int, half: int, limit: int = 3_000_000) -> np.ndarray:
    """Least fingerprint each of ``prints`` is linked to by variants whose first ``depth`` bits are ``cell``.

    Two fingerprints collide on a variant within ``half`` bits of both.  Instead of all pairs, the
    owners of a variant are checked against its least owner and united.  A cell of more than
    ``limit`` variants is worked off in halves, so memory stays bounded however dense it is.
    """
    root = np.arange(len(prints))
    work = [(np.arange(len(prints)), cell, depth)]
    while work:
        of, cell, depth = work.pop()
        rest = BITS - depth
        away = np.bitwise_count((prints[of] >> np.uint64(rest)) ^ np.uint64(cell)).astype(int)
        sizes = np.array([len(flips(rest, half - k)) if k <= half else 0 for k in range(BITS + 1)])
        if sizes[away].sum() > limit and depth < BITS - 1:
            for child in (2 * cell, 2 * cell + 1):
                near = np.bitwise_count((prints[of] >> np.uint64(rest - 1)) ^ np.uint64(child)) <= half
                if near.sum() > 1:
                    work.append((of[near], child, depth + 1))
            continue
        low = np.uint64((1 << rest) - 1)
        variants, owners = [], []
        for k in range(half + 1):
            mine = of[away == k]
            masks = flips(rest, half - k)
            variants.append(((prints[mine] & low)[:, None] ^ masks).ravel())
            owners.append(np.repeat(mine, len(masks)))
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variant)
        variant, owner = variant[order], owner[order]
        same = variant[1:] == variant[:-1]
        if not same.any():
            continue
        kept = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        variant, owner = variant[kept], owner[kept]
        first = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
        group = np.cumsum(np.concatenate([[False], variant[1:] != variant[:-1]]))
        least = np.minimum.reduceat(owner, first)[group]
        ok = np.bitwise_count(prints[owner] ^ prints[least]) <= 2 * half
        owner, least = owner[ok], least[ok]
        while True:  # unite: the lower of two roots takes over the other
            low_root = np.minimum(root[owner], root[least])
            before = root.copy()
            np.minimum.at(root, owner, low_root)
            np.minimum.at(root, least, low_root)
            np.minimum.at(root, before[owner], low_root)
            root = root[root]
            if (root == before).all():
                break
    return prints[root]


def cells_of(distinct: DataFrame, half: int, depth: int) -> DataFrame:
    """``cell, fingerprint``: every prefix of ``depth`` bits that a variant of the fingerprint can have."""
    masks = F.array(*[F.lit(int(m)) for m in flips(depth, half)])
    prefix = F.shiftrightunsigned("fingerprint", BITS - depth)
    return distinct.select(F.explode(F.transform(masks, lambda m: prefix.bitwiseXOR(m))).alias("cell"), "fingerprint")


def deeper(cells: DataFrame, half: int, depth: int, more: int) -> DataFrame:
    """The rows of cells of ``depth`` bits by the cells of ``more`` further bits that their variants reach."""
    prefix = F.shiftrightunsigned("fingerprint", BITS - depth)
    left = F.lit(half) - F.bit_count(prefix.bitwiseXOR(F.col("cell")))
    masks = F.array(*[F.struct(F.lit(int(m)).alias("mask"), F.lit(int(m).bit_count()).alias("cost")) for m in flips(more, half)])
    following = F.shiftrightunsigned("fingerprint", BITS - depth - more).bitwiseAND((1 << more) - 1)
    children = F.transform(F.filter(masks, lambda m: m["cost"] <= left), lambda m: F.shiftleft("cell", more).bitwiseOR(following.bitwiseXOR(m["mask"])))
    return cells.select(F.explode(children).alias("cell"), "fingerprint")


def links(distinct: DataFrame, radius: int, depth: int, crowd: int = 200_000) -> DataFrame:
    """``a, b``: fingerprints within ``radius`` bits of each other, as a forest over all such pairs.

    The variants of a fingerprint travel by their first ``depth`` bits: one row per prefix that a
    variant can have, from which the receiving task makes the variants with that prefix.  Cells of more
    than ``crowd`` fingerprints are dealt out by further bits before anything is gathered, as often as it takes.
    """
    half = radius // 2

    def joined(cells: DataFrame, depth: int) -> DataFrame:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            prints = np.unique(table.column("fingerprint").to_numpy().view(np.uint64))
            found = forest(prints, key[0].as_py(), depth, half)
            linked = found != prints
            return pa.table({"a": prints[linked].view(np.int64), "b": found[linked].view(np.int64)})

        return cells.groupBy("cell").applyInArrow(run, "a long, b long")

    cells, out = cells_of(distinct, half, depth), None
    while True:
        crowded = cells.groupBy("cell").count().where(F.col("count") > crowd).select("cell")
        crowded = cut_lineage(crowded, "crowded-cells")
        if depth + 8 >= BITS or crowded.isEmpty():
            found = joined(cells, depth)
            return found if out is None else out.union(found)
        found = joined(cells.join(crowded, "cell", "left_anti"), depth)
        out = found if out is None else out.union(found)
        cells, depth = deeper(cells.join(crowded, "cell", "left_semi"), half, depth, 8), depth + 8


def _depth(nodes: int) -> int:
    """Bits that part the cells: a cell holds about a hundred fingerprints before the variants of their
    neighbours come in, or fewer."""
    return min(24, max(11, nodes.bit_length() - 7))


def linked_prints(prints: DataFrame, radius: int) -> DataFrame:
    """``fingerprint, component_id, component`` of every distinct fingerprint, written to the shared folder."""
    if radius % 2:
        raise ValueError("half the radius must be whole")
    nodes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "prints")
    found = components(links(nodes.select("fingerprint"), radius, _depth(nodes.count())), "print-links")
    grouped = nodes.join(found, nodes["fingerprint"] == found["node"], "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    grouped = cut_lineage(grouped, "print-groups")
    names = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut_lineage(grouped.join(names, "component").select("fingerprint", "component_id", "component"), "print-names")
    drop_stage(grouped)
    drop_stage(nodes)
    return named


def near_copies(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, component, digest`` of every document (``component``: a fingerprint of it).

    Documents whose fingerprints differ in at most ``radius`` (even) bits are linked.  A component is everything
    reachable, named after its least id.  Equal fingerprints are one node, however many documents share it.  Null
    and empty texts have fingerprint zero and are linked like any other; null ids are never a
    component's name unless it has no other; rows that repeat stay; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    return prints.join(linked_prints(prints, radius), "fingerprint").select("doc_id", "fingerprint", "component_id", "component", "digest")


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, with all its columns: that of the least id.

    Rows are told apart by id and text, so unlike texts that share an id are documents of their own; of
    a group's rows with the least id the one of the least digest stays, of exact repeats of a row one.  A row
    without an id stays only where no row of its group has one.
    """
    found = near_copies(docs, words, radius, seed, id_col, text_col)
    of_row = found.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    least = of_row.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest", "n")).alias("kept"))
    kept = cut_lineage(least.select(F.col("kept.doc_id").alias("__id"), F.col("kept.digest").alias("__digest"), F.col("kept.n").alias("__n")), "kept")
    digest = F.md5(F.coalesce(docs[text_col], F.lit("")))
    chosen = docs.join(kept, docs[id_col].eqNullSafe(F.col("__id")) & (digest == F.col("__digest")))
    if not kept.where("__n > 1").isEmpty():
        order = Window.partitionBy("__id", "__digest").orderBy(F.lit(0))
        chosen = chosen.withColumn("__row", F.row_number().over(order)).where("__row = 1")
    return chosen.select(*[chosen[c] for c in docs.columns])


def hex_digits(fingerprint) -> F.Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
