"""What the operators share: the document frame, ids as bytes and groups of linked rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, drop_stage

UINT32 = np.dtype("<u4")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` alone, with a null text as the empty one; all other columns stay behind,
    so their names cannot clash with those an operator adds."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``, after which a task gives back the memory it has freed: Python workers live on,
    and what their allocators keep would be missing in later stages."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return df.mapInArrow(released, schema)


def release_memory() -> None:
    """Return free pages of Arrow's pool and, where the C library can, of its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (the first two columns) in slices of about ``chars`` bytes."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = np.diff(np.frombuffer(_offsets(texts), dtype=np.int32 if pa.types.is_string(texts.type) else np.int64))
        edges = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // chars)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if hi > lo:
                yield ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)
                if chars >= 4_000_000:
                    release_memory()


def sliced(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """The same with texts as Python strings, so that a batch of long texts is not turned into them at once."""
    for ids, texts in slices(batches, chars):
        yield ids, texts.to_pylist()


def _offsets(texts: pa.Array) -> memoryview:
    width = 4 if pa.types.is_string(texts.type) else 8
    start = texts.offset * width
    return memoryview(texts.buffers()[1])[start : start + (len(texts) + 1) * width] if len(texts) else memoryview(bytes(width))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """``node, component`` for all nodes of ``edges(a, b)``; the component is its least node.

    Large-star and small-star rounds: every round is written to the shared folder, links each node
    to the least of its neighbours, and ends when a round changes nothing.  A star is one row per
    node, so a hub costs what its rows cost; the least neighbour is a map-side combined minimum.
    """
    current = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    seen = _state(current)
    while True:
        # every node larger than the centre moves to the least neighbour of the centre
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        large = cut_lineage(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label
        )
        # every node smaller than the centre, and the centre, move to the least of them
        smaller = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")), label)
        moved = large.join(smaller, "a")
        following = cut_lineage(
            moved.select("a", F.col("m").alias("b")).union(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(),
            label,
        )
        for stage in (current, least, large, smaller):
            drop_stage(stage)
        current, before, seen = following, seen, _state(following)
        if seen == before:
            break
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and sums of hashes of the edges: equal sets have equal states."""
    pair = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(pair.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())
