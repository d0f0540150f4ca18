"""Ranked lexical search: best-first document intervals bounded by range maxima of posting lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import UINT32, map_batches, sliced, texts_of
from plumbline.session import cut_lineage

# ASCII letters fold to lower case; every other ASCII byte but a digit parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "doc_ids binary, lengths binary, null_ids long, n_docs long, n_terms long, terms binary, counts binary, docs binary, tfs binary"
INDEX_NAMES = ["doc_ids", "lengths", "null_ids", "n_docs", "n_terms", "terms", "counts", "docs", "tfs"]


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split()


class Shard:
    """Documents that are indexed together: a bounded number of postings."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.docs: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, ids: list, texts: list[str]) -> None:
        known = self.vocabulary
        for doc_id, text in zip(ids, texts, strict=True):
            words = terms_of(text)
            if not words:
                continue
            for w in set(words).difference(known):
                known[w] = len(known)
            codes, tfs = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)
            self.docs.append(np.full(len(codes), len(self.ids), dtype=np.int32))
            self.codes.append(codes)
            self.tfs.append(tfs.astype(np.int32))
            self.postings += len(codes)
            self.ids.append(doc_id)
            self.lengths.append(len(words))

    def row(self) -> pa.RecordBatch:
        """The shard's row: documents in ascending order of id (nulls last), postings by term and document."""
        has_id = np.array([i is not None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        order = np.lexsort((ids, ~has_id))
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        codes, docs, tfs = np.concatenate(self.codes), place[np.concatenate(self.docs)], np.concatenate(self.tfs)
        by = np.lexsort((docs, codes))
        counts = np.bincount(codes, minlength=len(self.vocabulary)).astype(UINT32)
        lengths = np.array(self.lengths, dtype=np.int64)[order]
        values = [
            ids[order].tobytes(), lengths.tobytes(), int((~has_id).sum()), len(ids), int(lengths.sum()),
            b" ".join(self.vocabulary), counts.tobytes(), docs[by].astype(UINT32).tobytes(), tfs[by].astype(UINT32).tobytes(),
        ]
        kinds = [pa.binary() if isinstance(v, bytes) else pa.int64() for v in values]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], INDEX_NAMES)


def build_index(docs: DataFrame, postings: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, one row per shard, written to the shared folder: every term of every document.

    A task closes a shard when it has ``postings`` postings, so a shard is bounded whatever the
    partitions are; nothing is shuffled.  Documents without a term, null texts among them, are not
    indexed.  Rows that repeat an id are documents of their own; an empty table gives no shard.
    """
    source = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for ids, texts in sliced(batches):
            shard.add(ids.to_pylist(), texts)
            if shard.postings >= postings:
                yield shard.row()
                shard = Shard()
        if shard.postings:
            yield shard.row()

    return cut_lineage(map_batches(source, run, INDEX), "lexical-index")


class RangeMaximum:
    """Sparse tables over posting lists that lie in a row: the place of the greatest value of any range of a list."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        span = 1
        while 2 * span <= longest:
            at = self.levels[-1]
            left, right = at[: len(at) - span], at[span:]
            self.levels.append(np.where(values[left] >= values[right], left, right))
            span *= 2
        self.width = len(values)
        self.table = np.concatenate([np.append(level, np.zeros(len(values) - len(level), np.int32)) for level in self.levels])

    def places(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the greatest value from ``start`` up to ``end`` (ties: the first); ranges must not be empty."""
        level = np.frexp(end - start)[1] - 1
        a = self.table[level * self.width + start]
        b = self.table[level * self.width + end - (1 << level)]
        return np.where(self.values[a] >= self.values[b], a, b)


class Best:
    """The best documents so far: highest score first, ties by ascending id (nulls last)."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, dtype=bool)

    def add(self, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        some = score > 0
        score, key, null = (np.concatenate([a, b[some]]) for a, b in ((self.score, score), (self.key, key), (self.null, null)))
        order = np.lexsort((key, null, -score))[: self.k]
        self.score, self.key, self.null = score[order], key[order], null[order]

    def may_enter(self, bound: np.ndarray, key: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Whether documents of at most this score and at least this id could still enter."""
        if len(self.score) < self.k:
            return bound > 0
        tied = (bound == self.score[-1]) & (~null & self.null[-1] | (null == self.null[-1]) & (key < self.key[-1]))
        return (bound > self.score[-1]) | tied


def best_first(best: Best, lists: list[tuple[int, int, int]], postings: np.ndarray, maxima: RangeMaximum, ids: np.ndarray, null: np.ndarray, width: int = 256) -> None:
    """Add to ``best`` the best documents of one shard for one item.

    ``lists`` are the item's terms: start and end of the posting list, and how often the item says
    the term.  The bound of an interval of documents is the sum of its terms' maxima.  The intervals
    of the highest bounds, up to ``width`` of them at a time, are split at the document where the greatest of these maxima stands:
    that document is scored, and what is left and right of it are intervals of their own.
    """
    n = len(ids)
    start = np.array([s for s, _, _ in lists], dtype=np.int64)[:, None]
    times = np.array([c for _, _, c in lists], dtype=np.int64)[:, None]
    # how many postings of each list stand before each document
    before = np.zeros((len(lists), n + 1), dtype=np.int32)
    for k, (s, e, _) in enumerate(lists):
        before[k, postings[s:e] + 1] = 1
    np.cumsum(before, axis=1, out=before)
    before += start.astype(np.int32)
    values = maxima.values

    def bounded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = before[:, lo], before[:, hi]
        held = b > a
        rows, cols = np.nonzero(held)
        at = maxima.places(a[rows, cols], b[rows, cols])
        top = np.zeros(a.shape, dtype=np.int64)
        place = np.zeros(a.shape, dtype=np.int64)
        top[rows, cols] = values[at] * times[rows, 0]
        place[rows, cols] = at
        split = postings[place[np.argmax(top, axis=0), np.arange(len(lo))]]
        return lo, hi, top.sum(axis=0), split

    def score(docs: np.ndarray) -> np.ndarray:
        a, b = before[:, docs], before[:, docs + 1]
        return (np.where(b > a, values[np.minimum(a, len(values) - 1)], 0) * times).sum(axis=0)

    frontier = bounded(np.array([0]), np.array([n]))
    at_once = 1
    while True:
        keep = best.may_enter(frontier[2], ids[frontier[0]], null[frontier[0]])
        frontier = tuple(a[keep] for a in frontier)
        if not len(frontier[0]):
            return
        chosen = np.zeros(len(frontier[0]), dtype=bool)
        if len(chosen) > at_once:
            chosen[np.argpartition(-frontier[2], at_once)[:at_once]] = True
        else:
            chosen[:] = True
        lo, hi, _, split = (a[chosen] for a in frontier)
        best.add(score(split), ids[split], null[split])
        left, right = np.concatenate([lo, split + 1]), np.concatenate([split, hi])
        some = right > left
        children = bounded(left[some], right[some])
        frontier = tuple(np.concatenate([a[~chosen], b]) for a, b in zip(frontier, children, strict=True))
        at_once = min(width, at_once * 4)


def weights(df: dict[bytes, int], n_docs: int) -> dict[bytes, int]:
    """``floor(1000 * ln((2N + 2) / (2 df + 1)))`` of every term."""
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def search_shard(row: dict, items: list[dict[bytes, int]], weight: dict[bytes, int], n_docs: int, n_terms: int, best: list[Best]) -> None:
    """Add the best documents of a shard to those of each item."""
    counts = np.frombuffer(row["counts"], UINT32).astype(np.int64)
    ends = np.cumsum(counts)
    there = {t: k for k, t in enumerate(row["terms"].split(b" ")) if weight.get(t)}
    used = sorted(there.values())
    if not used:
        return
    docs, tfs = (np.frombuffer(row[c], UINT32) for c in ("docs", "tfs"))
    parts = [slice(int(ends[k] - counts[k]), int(ends[k])) for k in used]
    docs, tfs = (np.concatenate([a[p] for p in parts]).astype(np.int64) for a in (docs, tfs))
    sizes = counts[used]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    of = {k: j for j, k in enumerate(used)}
    terms = {t: of[k] for t, k in there.items()}
    w = np.zeros(len(used), dtype=np.int64)
    for t, j in terms.items():
        w[j] = weight[t]
    lengths = np.frombuffer(row["lengths"], np.int64)
    m = 75 + 25 * lengths * n_docs // n_terms
    maxima = RangeMaximum(impacts(np.repeat(w, sizes), tfs, m[docs]), int(sizes.max()))
    ids = np.frombuffer(row["doc_ids"], np.int64)
    null = np.arange(len(ids)) >= len(ids) - row["null_ids"]
    for found, item in zip(best, items, strict=True):
        lists = [(int(edges[terms[t]]), int(edges[terms[t] + 1]), c) for t, c in item.items() if t in terms]
        if lists:
            best_first(found, lists, docs, maxima, ids, null)


def blocks(items: DataFrame, rows: int, chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``rows`` rows and about ``chars`` characters, as the driver streams over them."""
    block, held = [], 0
    for item in items.toLocalIterator():
        block.append(tuple(item))
        held += len(item[1])
        if len(block) >= rows or held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(
    index: DataFrame, items: DataFrame, k: int = 20, block_rows: int = 1_000, block_chars: int = 4_000_000, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above zero.

    Items go to the shards in blocks of bounded size; in a block, every task keeps the best of its shards
    for each item, and what a shard cannot better is never split further.  Equal scores rank by
    ascending id, null ids last.  Every row of ``items`` is an item of its own: rows that repeat an id have
    ranks of their own under the same id.  Items and documents without terms have no rows, nor has
    an empty table.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    asked = items.select(items[id_col].cast("long").alias("item_id"), F.coalesce(items[text_col], F.lit("")).alias("text"))
    results = []
    for number, block in enumerate(blocks(asked, block_rows, block_chars)):
        results.append(cut_lineage(_search_block(index, block, k, n_docs, n_terms).withColumn("block", F.lit(number)), "lexical-hits"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select("item_id", "rank", "doc_id", "score")


def _search_block(index: DataFrame, block: list[tuple], k: int, n_docs: int, n_terms: int) -> DataFrame:
    items: list[dict[bytes, int]] = []
    for _, text in block:
        terms: dict[bytes, int] = {}
        for t in terms_of(text):
            terms[t] = terms.get(t, 0) + 1
        items.append(terms)
    vocabulary = sorted(set().union(*items))
    known = {t: j for j, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t, c in zip(terms.split(b" "), np.frombuffer(counts, UINT32).tolist(), strict=True):
                    if t in known:
                        df[known[t]] += c
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    counted = map_batches(index.select("terms", "counts"), count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = weights({vocabulary[r.term]: r.df for r in counted.collect()}, n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                search_shard(row, items, weight, n_docs, n_terms, best)
        rows = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        keys = [np.concatenate([getattr(b, c) for b in best]) if best else np.zeros(0, np.int64) for c in ("key", "score", "null")]
        columns = [pa.array(rows), pa.array(keys[0], mask=keys[2].astype(bool)), pa.array(keys[1])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    wanted = ["doc_ids", "lengths", "null_ids", "terms", "counts", "docs", "tfs"]
    hits = map_batches(index.select(*wanted), run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = index.sparkSession.createDataFrame([(j, i) for j, (i, _) in enumerate(block)], "item long, item_id long")
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
