"""Cost-balanced packing: descending pieces go to the cheapest sequence that still has room."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from plumbline.llm.common import UINT32, map_batches, slices, texts_of
from plumbline.llm.encoding import text_encoder, vocabulary

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def attention_cost(length, linear: float = 1.0, quadratic: float = 1.0 / 1024):
    """What a piece costs to train on: a linear part, and attention within the piece."""
    return linear * length + quadratic * length * length


def pack(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, int]:
    """Pieces ``(document, start, length, sequence, offset)`` and the number of sequences.

    Whole sequences are cut off long documents first.  The rests, longest first (ties: earlier
    document), go to the sequence of the lowest cost that has room for them; a rest that fits
    nowhere is cut at the room of the cheapest.  The room of all sequences is just the number of
    tokens: the last tokens that fill no sequence get sequences of powers of two.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    full, rest = lengths // capacity, lengths % capacity
    sequence = 0
    for d in np.flatnonzero(full).tolist():
        for k in range(int(full[d])):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
    total = int(rest.sum())
    tail = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if tail >> b & 1], dtype=np.int64)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    for d in np.lexsort((np.arange(len(rest)), -rest)).tolist():
        start, left = int(full[d]) * capacity, int(rest[d])
        while left:
            fits = room - used >= left
            if not fits.any():
                fits = room > used
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(left, int(room[at] - used[at]))
            pieces.append((d, start, take, sequence + at, int(used[at])))
            used[at] += take
            cost[at] += attention_cost(take, linear, quadratic)
            start, left = start + take, left - take
    return np.array(pieces, dtype=np.int64).reshape(-1, 5), sequence + len(room)


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    group_tokens: int = 2_000_000,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, start, length, ids`` (little-endian 32-bit), ``doc_tokens,
    sequence_id, offset``.  A document is its tokens and ``end_id``; every id lies in one piece.
    A task packs its documents in groups of about ``group_tokens`` tokens as they come, so nothing
    is shuffled and a lost task is just done again; sequence ids are unique, not dense.

    Null and empty texts are the end id alone.  Rows that repeat an id are documents of their own.
    An empty table gives no rows.
    """
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], dtype=UINT32).tobytes()
    source = texts_of(docs, id_col, text_col)

    def group_rows(ids: list, tokens: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(t) // 4 for t in tokens], dtype=np.int64)
        pieces, sequences = pack(lengths, capacity, linear, quadratic)
        doc, start, length, sequence, offset = pieces.T
        cut = [tokens[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        columns = [pa.concat_arrays(ids).take(pa.array(doc)), start, length, pa.array(cut, pa.binary()), lengths[doc], sequence + base, offset]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names), sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = text_encoder(path), TaskContext.get().partitionId() << 40
        ids, tokens, held = [], [], 0
        for some, texts in slices(batches, 8_000_000):
            values, edges = encoder.encode(texts)
            data, edges = values.tobytes(), (4 * edges).tolist()
            encoded = [data[a:b] + end for a, b in zip(edges, edges[1:], strict=False)]
            ids.append(some)
            tokens += encoded
            held += sum(map(len, encoded)) // 4
            if held >= group_tokens:
                rows, sequences = group_rows(ids, tokens, base)
                yield rows
                ids, tokens, held, base = [], [], 0, base + sequences
        if tokens:
            yield group_rows(ids, tokens, base)[0]

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, run, f"doc_id {kind}, {PIECES}")
