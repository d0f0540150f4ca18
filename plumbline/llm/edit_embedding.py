"""Document fingerprints by a randomised edit embedding: edit distance becomes Hamming distance."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import components, map_batches, sliced, texts_of
from plumbline.session import cut_lineage, drop_stage

SYMBOLS = 256
PERIOD = 1 << 14
SAMPLES = 128
SEED = 20160614
GROUP_CHARS = 6_000_000
LEAST_LONG = -(1 << 63)


@functools.lru_cache(maxsize=2)
def walk_table(seed: int) -> np.ndarray:
    """The random walk that all texts share, as ``waits[symbol * PERIOD + step]``.

    At every step a walk writes the character it stands on, and goes on to the next one if the
    coin of that step and character says so.  The table says after how many steps a walk leaves a
    symbol that it comes to at a step; the coins repeat after ``PERIOD`` steps.
    """
    coins = np.random.default_rng(seed).random((SYMBOLS, PERIOD)) < 0.5
    coins[:, 0] = True
    goes = np.where(np.concatenate([coins, coins], axis=1), np.arange(2 * PERIOD, dtype=np.int32), 2 * PERIOD)
    goes = np.minimum.accumulate(goes[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (goes - np.arange(PERIOD) + 1).astype(np.uint8).ravel()


def symbols(text: str) -> np.ndarray:
    """Characters by a hash to one byte; ASCII is one to one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, 128 + (points * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)


def walk(texts: list[np.ndarray], starts: list[int], seed: int) -> list[np.ndarray]:
    """The step at which each walk comes to each character, and its end.  All walks go side by
    side, a character at a time; ``starts`` is the step each begins at."""
    waits = walk_table(seed)
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
    flat = np.concatenate([texts[i] for i in order]).astype(np.int32) * PERIOD
    offsets = np.cumsum(lengths) - lengths
    places = offsets + np.arange(len(order))
    reached = np.empty(len(flat) + len(order), dtype=np.int32)
    step = np.array(starts, dtype=np.int32)[order]
    reached[places] = step
    # walks that have a character k, the longest first
    going = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left").tolist()
    for k, n in enumerate(going):
        part = step[:n]
        part += waits[flat[offsets[:n] + k] + (part & PERIOD - 1)]
        reached[places[:n] + (k + 1)] = part
    out: dict[int, np.ndarray] = {i: reached[p : p + n + 1] for i, p, n in zip(order.tolist(), places.tolist(), lengths.tolist(), strict=True)}
    return [out[i] for i in range(len(texts))]


def _child(level: int, block: np.ndarray, seed: int) -> np.ndarray:
    """Which half of a block its sample lies in."""
    h = (block.astype(np.uint64) + np.uint64(level << 40) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40) & np.uint64(1)).astype(np.int64)


@functools.lru_cache(maxsize=256)
def sampled_steps(level: int, seed: int) -> np.ndarray:
    """The sampled step of each block of ``2**level`` steps.  A block's sample is that of one of its
    halves, so the samples of a level are among those of the level below."""
    at = np.arange(2 * SAMPLES)
    for k in range(level, 0, -1):
        at = 2 * at + _child(k, at, seed)
    return at


def sample(text: np.ndarray, reached: np.ndarray, seed: int) -> bytes:
    """Fingerprint: the level, and the symbol the walk writes at the sample of each whole block; a
    walk of at least ``SAMPLES`` steps has as many to twice as many blocks."""
    steps = int(reached[-1])
    level = max(0, (steps // SAMPLES).bit_length() - 1)
    at = sampled_steps(level, seed)[: steps >> level]
    return bytes([level]) + text[np.searchsorted(reached, at, side="right") - 1].tobytes()


def at_level(print_: bytes, level: int, seed: int) -> np.ndarray:
    """Samples of a fingerprint at its own or a higher level."""
    found = np.frombuffer(print_, np.uint8, offset=1)
    for k in range(print_[0] + 1, level + 1):
        block = np.arange(len(found) // 2)
        found = found[2 * block + _child(k, block, seed)]
    return found


def likeness(a: bytes, b: bytes, seed: int = SEED) -> float:
    """Share of equal samples, at the level of the longer text; equal fingerprints are alike by 1."""
    if a == b:
        return 1.0
    level = max(a[0], b[0])
    x, y = at_level(a, level, seed), at_level(b, level, seed)
    most, least = max(len(x), len(y)), min(len(x), len(y))
    return float((x[:least] == y[:least]).sum() / most) if most else 0.0


def fingerprints(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (binary) of every whole text.

    Equal texts have equal fingerprints; a null or empty text has that of no steps; rows that
    repeat have one each; an empty table gives no rows.
    """
    source = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches, GROUP_CHARS):
            codes = [symbols(t) for t in texts]
            prints = [sample(c, r, seed) for c, r in zip(codes, walk(codes, [0] * len(codes), seed), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints, pa.binary())], ["doc_id", "fingerprint"])

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint binary")


def _chained(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, ahead, doc_id, text``: ranges of ids, each followed by the first row of the next
    range (``ahead``), the last by the first of all.  Only the bounds of the ranges, one or two ids
    for each, go through the driver."""
    keyed = docs.withColumn("at", F.coalesce(F.col("doc_id"), F.lit(LEAST_LONG)))
    buckets = max(2, buckets)
    bounds = keyed.select(F.col("at").cast("double")).approxQuantile("at", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))
    splits = [float("-inf"), *sorted(set(bounds or [0.0])), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="place", outputCol="range")
    keyed = cut.transform(keyed.withColumn("place", F.col("at").cast("double"))).withColumn("bucket", F.col("range").cast("int"))
    heads = [(r["bucket"], r["head"]) for r in keyed.groupBy("bucket").agg(F.min("at").alias("head")).orderBy("bucket").collect()]
    turned = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    before = docs.sparkSession.createDataFrame(turned, "head long, follows int")
    joined = keyed.join(F.broadcast(before), keyed["at"] == before["head"], "left")
    copies = F.filter(
        F.array(F.struct(F.col("bucket"), F.lit(0).alias("ahead")), F.struct(F.col("follows").alias("bucket"), F.lit(1).alias("ahead"))),
        lambda c: c["bucket"].isNotNull(),
    )
    return joined.select(F.explode(copies).alias("c"), "at", "doc_id", "text").select("c.bucket", "c.ahead", "at", "doc_id", "text")


def compare_with_next(docs: DataFrame, seed: int = SEED, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``.

    ``edited`` is the text whose last half (rounded down) is replaced by as many first characters
    of the next document by id, the last one's by those of the first.  Ids are integers; null ids
    come first, rows that repeat an id follow each other in text order, null texts are empty,
    and an empty table gives no rows.  A lone document follows itself.
    """
    source = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chained = _chained(source, buckets or 4 * partitions)
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, after = zip(*rows, strict=True)
        # a row's next text is mostly the row that follows, which is walked anyway
        own = [symbols(t) for t in texts]
        extra = [k for k in range(len(rows)) if k + 1 == len(rows) or after[k] is not texts[k + 1]]
        codes = own + [symbols(after[k]) for k in extra]
        walked = walk(codes, [0] * len(codes), seed)
        prints = [sample(c, r, seed) for c, r in zip(codes, walked, strict=True)]
        following = {k: len(rows) + j for j, k in enumerate(extra)}
        halves = [len(c) // 2 for c in own]
        tails = [codes[following.get(k, k + 1)][:h] for k, h in enumerate(halves)]
        kept = [len(c) - h for c, h in zip(own, halves, strict=True)]
        ends = walk(tails, [int(r[n]) for r, n in zip(walked, kept, strict=False)], seed)
        edited_prints = [
            sample(np.concatenate([c[:n], t]), np.concatenate([r[:n], e]), seed) for c, n, t, r, e in zip(own, kept, tails, walked, ends, strict=False)
        ]
        edited = [t[:n] + a[:h] for t, n, a, h in zip(texts, kept, after, halves, strict=True)]
        near_edited = [likeness(a, b, seed) for a, b in zip(prints, edited_prints, strict=False)]
        near_next = [likeness(prints[k], prints[following.get(k, k + 1)], seed) for k in range(len(rows))]
        columns = [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(edited, pa.string())]
        columns += [pa.array(prints[: len(rows)], pa.binary()), pa.array(edited_prints, pa.binary()), pa.array(near_edited), pa.array(near_next)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, pending = [], 0, None
        for batch in batches:
            bucket, ahead, doc_id, texts = batch.columns
            for row in zip(bucket.to_pylist(), ahead.to_pylist(), doc_id.to_pylist(), texts, strict=True):
                text = row[3].as_py()
                if pending is not None and pending[0] == row[0]:
                    rows.append((pending[1], pending[2], text))
                    held += len(pending[2])
                    if held >= GROUP_CHARS:
                        yield compared(rows)
                        rows, held = [], 0
                pending = None if row[1] else (row[0], row[2], text)
        if rows:
            yield compared(rows)

    sorted_rows = chained.repartition(partitions, "bucket").sortWithinPartitions("bucket", "ahead", "at", "text")
    schema = "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return map_batches(sorted_rows.select("bucket", "ahead", "doc_id", "text"), run, schema)


@functools.lru_cache(maxsize=4096)
def _width(n: int, least: float) -> int:
    """Samples in a block of the keys for pairs whose shorter side has ``n`` samples.

    Such a pair differs in at most ``wrong`` of them.  Of three blocks, two are equal unless two differ,
    so some key of two blocks is equal if there are more than ``wrong`` / 2 threes: the widest block of
    which there are as many is taken; without any, single samples are keys (0).
    """
    wrong = n - math.ceil(least * n - 1e-9)
    return next((w for w in range(8, 0, -1) if 2 * (n // (3 * w)) > wrong), 0)


@functools.lru_cache(maxsize=65536)
def _places(level: int, n: int, least: float) -> tuple[tuple[int, int], ...]:
    """``level, width`` of the keys of a fingerprint of ``n`` samples: on its own level those of every
    length that its shorter partners may have, on higher ones, where its partners are longer, those of its own."""
    own = {_width(m, least) for m in range(max(1, math.ceil(least * n - 1e-9)), n + 1)}
    found, up = [(level, w) for w in sorted(own)], 1
    while n >> up and n >> up >= least * SAMPLES - 1e-9:
        found.append((level + up, _width(n >> up, least)))
        up += 1
    return tuple(found)


def _spans(print_: bytes, least: float) -> Iterator[tuple[int, int]]:
    """``level, width``: on which levels a fingerprint has keys, and of which blocks."""
    yield from _places(print_[0], len(print_) - 1, least)


def _mixed(v: np.ndarray) -> np.ndarray:
    v = (v ^ v >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ v >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return v ^ v >> np.uint64(32)


def _padded(prints: list[np.ndarray], blank: int = 0) -> np.ndarray:
    out = np.full((len(prints), 2 * SAMPLES), blank, dtype=np.int16 if blank else np.uint8)
    for row, p in zip(out, prints, strict=True):
        row[: len(p)] = p
    return out


def _place_keys(prints: list[np.ndarray], level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, key``: two equal blocks of every whole three, or single samples if ``width`` is 0."""
    size, blocks = (3 * width, 3) if width else (1, 1)
    threes = np.array([len(p) for p in prints]) // size
    most = int(threes.max(initial=0))
    cells = _padded(prints)[:, : most * size].reshape(len(prints), most, blocks, -1).astype(np.uint64)
    codes = (cells << np.arange(0, 8 * cells.shape[3], 8, dtype=np.uint64)).sum(axis=3, dtype=np.uint64)
    row, three = np.nonzero(np.arange(most) < threes[:, None])
    keys = []
    for k, (x, y) in enumerate([(0, 1), (0, 2), (1, 2)] if width else [(0, 0)]):
        place = _mixed(np.uint64(level << 32 | width << 24 | k << 16) + three.astype(np.uint64))
        keys.append(_mixed(_mixed(place + codes[row, three, x]) + codes[row, three, y]).view(np.int64))
    return np.tile(row, len(keys)), np.concatenate(keys)


def _keys(nodes: DataFrame, least: float, seed: int) -> DataFrame:
    """``key, member``: the keys of every fingerprint; two alike by ``least`` or more share one.

    These rows are shuffled, so each is two numbers: the last five bits of a key are its level (below 32), the last eight
    of a member the samples it has on that level (below 256), behind its node (below 2**55).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, at = batch.column(0).to_numpy(), {}
            for k, p in enumerate(batch.column(1).to_pylist()):
                for place in _spans(p, least):
                    at.setdefault(place, []).append((k, p))
            for (level, width), found in at.items():
                for lo in range(0, len(found), 2_000):
                    part = found[lo : lo + 2_000]
                    seen = [at_level(p, level, seed) for _, p in part]
                    row, key = _place_keys(seen, level, width)
                    node, size = numbers[np.array([k for k, _ in part])[row]], np.array([len(p) for p in seen])[row]
                    yield pa.RecordBatch.from_arrays([pa.array(key & ~31 | level), pa.array(node << 8 | size)], ["key", "member"])

    return map_batches(nodes.select("node", "fingerprint"), run, "key long, member long")


TILE = 512


class Joined:
    """Components as a task's links have joined them; it starts anew when it holds ``most`` of them."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.above: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if len(self.above) >= self.most:
            self.above.clear()
        self.above[max(x, y)] = min(x, y)
        return True


def _parted(rest: DataFrame, least: float, seed: int) -> DataFrame:
    """``a, b``: links that join the components which pairs alike by ``least`` or more join, of all pairs between the
    components of each key, of ``rest(key, level, n, node, component, fingerprint)``.

    A task gives a link only where its earlier ones have not joined the two components (``Joined``).  A key's members are dealt out to parts of about ``TILE``, and every two parts meet in a tile of their own, so
    that a key of many members is work for many tasks.
    """
    parts = F.ceil(F.col("n") / TILE).cast("int")
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tiles = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "level", "node", "component", "fingerprint")

    def near(tile: pa.Table, joined: Joined) -> tuple[np.ndarray, np.ndarray]:
        i, j, part, node, component = (tile.column(c).to_numpy() for c in ("i", "j", "part", "node", "component"))
        prints, level = tile.column("fingerprint").to_pylist(), tile.column("level")[0].as_py()
        seen = [at_level(p, level, seed) for p in prints]
        sizes, own = np.array([len(p) for p in seen]), np.array([p[0] == level for p in prints])
        ours, theirs = _padded(seen, -1), _padded(seen, -2)
        a, b = [], []
        for k in range(len(node)):
            # within a part each pair once; between parts the first with the second
            against = np.arange(k + 1, len(node)) if i[0] == j[0] else np.flatnonzero(part == j[0]) if part[k] == i[0] else np.zeros(0, dtype=np.int64)
            # two of a lower level compare on that one
            against = against[(component[against] != component[k]) & (own[against] | own[k])]
            if len(against):
                equal = (theirs[against] == ours[k]).sum(axis=1)
                for other in against[equal / np.maximum(sizes[against], sizes[k]) >= least].tolist():
                    if joined.join(int(component[k]), int(component[other])):
                        a.append(node[k])
                        b.append(node[other])
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        joined = Joined()

        def checked(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            found = [near(table.slice(lo, hi - lo), joined) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tile = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")])
            edges = np.concatenate([[0], np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1])
            if len(edges) > 1:  # the last tile may go on in the next batch
                yield checked(held, edges)
                held = held.slice(int(edges[-1]))
        if held is not None and held.num_rows:
            yield checked(held, np.array([0, held.num_rows]))

    return map_batches(tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long")


def _alike(pairs: DataFrame, nodes: DataFrame, least: float, seed: int) -> DataFrame:
    """``a, b``: the pairs whose fingerprints are alike by ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            near = pa.array([likeness(x, y, seed) >= least for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(near)

    x = nodes.select(F.col("node").alias("a"), F.col("fingerprint").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("fingerprint").alias("y"))
    return map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), run, "a long, b long")


def linked_prints(prints: DataFrame, least: float = 0.8, seed: int = SEED) -> DataFrame:
    """``fingerprint, component_id`` for every distinct fingerprint of ``prints(doc_id, fingerprint)``: components of
    the links between fingerprints alike by ``least`` (above 0) or more, named by their least ``doc_id``.

    All such links count: two fingerprints alike share a key for certain (``_width``).  Each key's head is its member of
    the least hash, which the keys of a group have in common, and all members are checked against it.  A key whose
    members are by then in one component is done; of the others, all members of different components are checked against each other.  So groups
    of copies cost a row per member and key, and a key that many unlike fingerprints share, as those of one
    long heading, costs their pairs.

    Rows that repeat count once; an empty table gives no rows; the fingerprint of the empty text is alone.
    """
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    nodes = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()), "edit-nodes")  # numbers are fixed by being written
    within = Window.partitionBy("key")
    chosen = F.min(F.struct(F.xxhash64("node").alias("h"), "node", F.col("size").alias("of"))).over(within)
    # dealt out first: what the window is asked for would travel with each row
    dealt = _keys(nodes, least, seed).repartition("key").select("key", F.shiftright("member", 8).alias("node"), F.col("member").bitwiseAND(F.lit(255)).alias("size"))
    members = dealt.withColumns({"n": F.count(F.lit(1)).over(within), "chosen": chosen})
    # of so unlike sizes no two are alike on the level; they may be with other members
    likely = F.least("size", "chosen.of") >= F.lit(least) * F.greatest("size", "chosen.of") - 1e-9
    members = members.withColumns({"head": F.col("chosen.node"), "likely": likely}).where("n > 1 AND node <> head AND (likely OR n > 2)")
    members = cut_lineage(members.select("key", "node", F.col("key").bitwiseAND(F.lit(31)).cast("int").alias("level"), "n", "head", "likely"), "edit-members")
    pairs = members.where("likely").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    found = cut_lineage(_alike(pairs, nodes, least, seed), "edit-found")
    named = cut_lineage(components(found, "edit-links"), "edit-named")
    # heads have met everyone who shares their key; keys of one component have nothing left to link
    labelled = members.where("n > 2").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    unsettled = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = labelled.join(unsettled, "key").join(nodes.select("node", "fingerprint"), "node")
    more = cut_lineage(_parted(rest, least, seed), "edit-more")
    if not more.isEmpty():  # a component so far is a star; what was found ties stars together
        named = cut_lineage(components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "edit-links"), "edit-named")
    for stage in (members, found, more):
        drop_stage(stage)
    grouped = nodes.join(named, "node", "left").select("fingerprint", "first", F.coalesce("component", "node").alias("component"))
    names = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return cut_lineage(grouped.join(names, "component").select("fingerprint", "component_id"), "edit-names")


def near_copies(docs: DataFrame, least: float = 0.8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id``: documents linked by fingerprints alike by ``least`` or more (``linked_prints``).

    Null texts count as empty, and are alike; rows that repeat stay, in one component; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, seed, id_col, text_col), "edit-prints")
    return prints.join(linked_prints(prints, least, seed=seed), "fingerprint").select("doc_id", "component_id")
