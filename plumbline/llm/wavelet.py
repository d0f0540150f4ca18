"""Token ids as wavelet matrices: one compressed file per shard, with rank and select on its bit planes."""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from plumbline.llm.common import UINT32, map_batches, slices, texts_of
from plumbline.llm.encoding import text_encoder, vocabulary
from plumbline.session import cut_lineage, scratch_path

HEAD = struct.Struct("<4sBQQI")
MAGIC = b"WMX1"


class BitPlane:
    """Bits of one level in 64-bit words, with the ones before each word."""

    def __init__(self, packed: np.ndarray, n: int):
        words = np.zeros(n // 64 + 1, dtype="<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.packed, self.words, self.n = packed, words, n

    @functools.cached_property
    def before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, end: np.ndarray) -> np.ndarray:
        """Ones in ``[0, end)``."""
        mask = (np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[end >> 6] + np.bitwise_count(self.words[end >> 6] & mask)

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the ``k``-th (from 0) bits that equal ``bit``."""
        before = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(before, k, side="right") - 1
        inside = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
        nth = np.cumsum(inside, axis=1) == (k - before[word] + 1)[:, None]
        return word * 64 + np.argmax(nth & inside, axis=1)


class WaveletMatrix:
    """A sequence of ids below ``2**width``: access, rank, select and counts in ``width`` steps."""

    def __init__(self, planes: list[BitPlane], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.width = planes, zeros, n, len(planes)

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        width = max(1, top.bit_length())
        level = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for shift in range(width - 1, -1, -1):
            ones = (level >> shift & 1).astype(bool)
            planes.append(BitPlane(np.packbits(ones, bitorder="little"), len(ids)))
            low = level.take(np.flatnonzero(~ones))
            zeros.append(len(low))
            level = np.concatenate([low, level.take(np.flatnonzero(ones))])
        return cls(planes, zeros, len(ids))

    def to_array(self) -> np.ndarray:
        """All ids: every level is the stable partition of the one above, undone from below."""
        ids = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for depth in range(self.width - 1, -1, -1):
            ones, upper = self.planes[depth].bits(), np.empty_like(ids)
            upper[np.flatnonzero(~ones)] = ids[: self.zeros[depth]]
            upper[np.flatnonzero(ones)] = ids[self.zeros[depth] :] | (1 << self.width - 1 - depth)
            ids = upper
        return ids.astype(UINT32)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given places, without unpacking the rest."""
        at, out = np.asarray(at, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.get(at), plane.ones(at)
            at = np.where(bit, zeros + ones, at - ones)
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        ends = np.array([lo, hi], dtype=np.int64)
        for depth, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.ones(ends)
            ends = zeros + ones if token >> self.width - 1 - depth & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` occurs in ``[lo, hi)``."""
        start, end = self._range(token, lo, self.n if hi is None else hi)
        return end - start

    def rank(self, token: int, end: int) -> int:
        return self.count(token, 0, end)

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of ``token`` in ``[lo, hi)``, ascending."""
        start, end = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(start, end, dtype=np.int64)
        for depth in range(self.width - 1, -1, -1):
            bit = token >> self.width - 1 - depth & 1
            at = self.planes[depth].select(bit, at - self.zeros[depth] if bit else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``token``; -1 if there is none."""
        start, end = self._range(token, 0, self.n)
        if not 0 <= k < end - start:
            return -1
        at = np.array([start + k], dtype=np.int64)
        for depth in range(self.width - 1, -1, -1):
            bit = token >> self.width - 1 - depth & 1
            at = self.planes[depth].select(bit, at - self.zeros[depth] if bit else at)
        return int(at[0])


class Shard:
    """Documents in one file: ids of the documents, their lengths and the matrix of their tokens."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix
        self.starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        null = np.array([d is None for d in self.doc_ids], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], dtype="<i8")
        parts = [pack(null.tobytes() + ids.tobytes() + self.lengths.astype("<u8").tobytes())]
        parts += [struct.pack("<Q", z) + pack(p.packed.tobytes()) for p, z in zip(self.matrix.planes, self.matrix.zeros, strict=True)]
        body = b"".join(struct.pack("<Q", len(p)) + p for p in parts)
        return HEAD.pack(MAGIC, self.matrix.width, self.matrix.n, len(self.doc_ids), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, width, n, docs, crc = HEAD.unpack_from(data)
        body = memoryview(data)[HEAD.size :]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a whole shard file")
        parts, at = [], 0
        for _ in range(width + 1):
            (size,) = struct.unpack_from("<Q", body, at)
            parts.append(body[at + 8 : at + 8 + size])
            at += 8 + size
        unpack = zstandard.ZstdDecompressor().decompress
        table = unpack(parts[0])
        null = np.frombuffer(table, np.uint8, docs)
        ids = np.frombuffer(table, "<i8", docs, docs)
        lengths = np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
        planes = [BitPlane(np.frombuffer(unpack(p[8:]), np.uint8), n) for p in parts[1:]]
        zeros = [struct.unpack_from("<Q", p)[0] for p in parts[1:]]
        return cls([None if x else i for x, i in zip(null.tolist(), ids.tolist(), strict=True)], lengths, WaveletMatrix(planes, zeros, n))

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document, by access alone."""
        return self.matrix.access(np.arange(self.starts[k], self.starts[k + 1]))


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def load_shard(path: str) -> Shard:
    store, place = _open(path)
    with store.open_input_stream(place) as f:
        return Shard.from_bytes(f.read())


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    end_id: int = 2,
    shard_tokens: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode all documents and write them to shard files in ascending id order.

    Returns the manifest ``part, shard, path, n_docs, n_tokens, start``: one row per file, where
    ``start`` counts the tokens in all files before it.  Ids are integers; null ids come first,
    rows that repeat an id follow each other in text order, a null or empty text is the end id
    alone, and an empty table has an empty manifest.

    A shard closes with the document that reaches ``shard_tokens``.  Each attempt of a task writes files
    of its own names, and only those of the attempt that succeeded are in the manifest, so a lost
    executor leaves at worst files that nobody reads.
    """
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], dtype=UINT32).tobytes()
    source = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    target = (folder or scratch_path(docs.sparkSession, "shards")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = text_encoder(path), TaskContext.get().partitionId()
        store, place = _open(target)
        store.create_dir(place, recursive=True)
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = shard = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(t) // 4 for t in tokens], dtype=np.int64)
            data = Shard(ids, lengths, WaveletMatrix.of(np.frombuffer(b"".join(tokens), UINT32))).to_bytes()
            name = f"{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wmx"
            with store.open_output_stream(f"{place}/{name}") as f:
                f.write(data)
            row = {"part": part, "shard": shard, "path": f"{target}/{name}", "n_docs": len(ids), "n_tokens": held}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for some, texts in slices(batches, 8_000_000):
            values, edges = encoder.encode(texts)
            data, edges = values.tobytes(), (4 * edges).tolist()
            for doc_id, lo, hi in zip(some.to_pylist(), edges, edges[1:], strict=False):
                ids.append(doc_id)
                tokens.append(data[lo:hi] + end)
                held += (hi - lo) // 4 + 1
                if held >= shard_tokens:
                    yield close()
                    ids, tokens, held, shard = [], [], 0, shard + 1
        if ids:
            yield close()

    written = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut_lineage(map_batches(written, run, "part int, shard int, path string, n_docs long, n_tokens long"), "manifest")
    # one row per partition of the sort, then one per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return inside.join(parts, "part").select("part", "shard", "path", "n_docs", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))


def _over_shards(manifest: DataFrame, columns: str, rows) -> DataFrame:
    """``rows(path, start)`` of every file, dealt out so that each file is a task's work."""
    manifest = manifest.select("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from rows(load_shard(row["path"]), row["start"])

    files = max(1, manifest.count())
    return map_batches(manifest.repartition(min(files, 20_000)), run, columns)


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document, read back from the files; ``start`` counts the
    tokens of all documents before it."""

    def rows(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        data = shard.matrix.to_array().tobytes()
        edges = (4 * shard.starts).tolist()
        ids = pa.array([data[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(start + shard.starts[:-1]), ids], ["doc_id", "start", "ids"])

    return _over_shards(manifest, "doc_id long, start long, ids binary", rows)


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each of these tokens occurs in all files, by rank alone.

    A token asked for twice is one row, one that occurs nowhere has ``n`` 0; without files there are no rows."""
    tokens = sorted(set(tokens))

    def rows(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.matrix.count(t) for t in tokens], pa.int64())})

    return _over_shards(manifest, "token long, n long", rows).groupBy("token").agg(F.sum("n").alias("n"))


def find_token(manifest: DataFrame, token: int) -> DataFrame:
    """``doc_id, position, place``: every occurrence of a token, in its document and overall.

    Rows that shared an id, or had none, are documents of their own under that id; without files, or where
    the token does not occur, there are no rows."""

    def rows(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        at = shard.matrix.occurrences(token)
        doc = np.searchsorted(shard.starts, at, side="right") - 1
        ids = pa.array(shard.doc_ids, pa.int64()).take(pa.array(doc))
        yield pa.RecordBatch.from_arrays([ids, pa.array(at - shard.starts[doc]), pa.array(start + at)], ["doc_id", "position", "place"])

    return _over_shards(manifest, "doc_id long, position long, place long", rows)
