"""Byte-level BPE by prefix dynamic programming: each byte prefix has one valid last token."""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import map_batches, slices, texts_of
from plumbline.llm.encoding import ChunkEncoder, vocabulary


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """The merges behind a rank file: how each token was made, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.data = {rank: token for token, rank in ranks.items()}
        self.left, self.right, self.made = {}, {}, {}
        for token, rank in ranks.items():
            a, b = self._parts(token, rank) if len(token) > 1 else (rank, rank)
            self.left[rank], self.right[rank] = a, b
            if len(token) > 1:
                self.made[a, b] = rank
        self._pairs: dict[int, bool] = {}

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``: what the lower-ranked merges leave of it."""
        cuts = [(a, b) for k in range(1, len(token)) if (a := self.ranks.get(token[:k], rank)) < rank and (b := self.ranks.get(token[k:], rank)) < rank]
        if len(cuts) == 1:
            return cuts[0]
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            _, k = min((self.ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether BPE can leave ``a`` and ``b`` side by side, remembered for each pair."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            known = self._pairs[key] = self._adjacent(a, b)
        return known

    def _adjacent(self, a: int, b: int) -> bool:
        # Undo the merges on both sides of the seam, latest first.  At each step the two tokens at
        # the seam lived side by side until `until`; a merge of the two that ranks before that
        # would have happened.  Of equal ranks the left one merges first, so the right is undone first.
        until = len(self.ranks) + 1
        while True:
            across = self.made.get((a, b))
            if across is not None and across < until:
                return False
            a_whole, b_whole = self.right[a] == a, self.left[b] == b
            if a_whole and b_whole:
                return True
            if b_whole or (a > b and not a_whole):
                until, a = a, self.right[a]
            else:
                until, b = b + 1, self.left[b]


    def extend(self, piece: bytes, last: list[int], upto: int) -> None:
        """Continue ``last``, the last tokens of the prefixes of ``piece``, to the prefix of ``upto`` bytes.

        A token ends a prefix if it may follow the last token of what is before it; just one does.
        """
        get, known, longest = self.ranks.get, self._pairs.get, self.longest
        for end in range(len(last), upto + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = get(piece[start:end])
                if token is None:
                    continue
                if not start:
                    break
                before = last[start]
                fits = known(before << 32 | token)
                if fits or fits is None and self.adjacent(before, token):
                    break
            last.append(token)


class PrefixTable:
    """The last token of every prefix of a piece.  Appends cost what is appended; an edit is
    encoded anew from its start until the table runs as before."""

    def __init__(self, merges: Merges, piece: bytes = b""):
        self.merges, self.piece, self.last = merges, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        piece = self.piece + more
        self.merges.extend(piece, self.last, len(piece))
        self.piece = piece

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``[start, end)``; returns how many prefixes had to be encoded anew."""
        old, shift = self.last, len(new) - (end - start)
        piece = self.piece[:start] + new + self.piece[end:]
        last, same = old[: start + 1], 0
        for at in range(start + 1, len(piece) + 1):
            self.merges.extend(piece, last, at)
            before = at - shift
            # as many equal entries as the longest token is long settle all that follows
            same = same + 1 if at > start + len(new) + self.merges.longest and last[at] == old[before] else 0
            if same == self.merges.longest:
                last += old[before + 1 :]
                break
        done = at - start if start < len(piece) else 0
        self.piece, self.last = piece, last
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end])
            end -= len(self.merges.data[self.last[end]])
        return out[::-1]


class PrefixEncoder(ChunkEncoder):
    """Encodes texts by a rank file, each match of ``pattern`` on its own, without special tokens."""

    def __init__(self, path: str, pattern: str, limit: int = 40_000_000):
        import regex

        super().__init__(limit)
        self.merges = Merges(read_ranks(path))
        self.split = regex.compile(pattern).findall
        size = max(self.merges.data) + 1
        self.vocabulary = [self.merges.data.get(i, b"") for i in range(size)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one match, as bytes."""
        data = piece.encode()
        token = self.merges.ranks.get(data)
        ids = [token] if token is not None else PrefixTable(self.merges, data).tokens()
        return array("i", ids).tobytes()

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = [self.split(t) for t in new.to_pylist()]
        pieces = {p: self._piece(p) for p in set().union(*split)}
        ids = [b"".join(map(pieces.__getitem__, s)) for s in split]
        return np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def whole(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.split(text)))

    def append(self, text: str, ids: list[int], tail: str) -> list[int]:
        """Ids of ``text + tail`` from the ids of ``text``.

        Only the last match can grow, or the last two become a contraction (``'`` and ``l`` before
        an ``l``), so no more than those two are split again.
        """
        ends = self.split(text)[-2:]
        kept, back = list(ids), "".join(ends)
        size = len(back.encode())
        while size:
            size -= len(self.vocabulary[kept.pop()])
        for match in self.split(back + tail):
            if ends and match.startswith(ends[-1]):
                table = PrefixTable(self.merges, ends[-1].encode())
                table.append(match[len(ends[-1]) :].encode())
                kept += table.tokens()
            else:
                kept += np.frombuffer(self._piece(match), np.int32).tolist()
        return kept

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def prefix_encoder(path: str, pattern: str) -> PrefixEncoder:
    return PrefixEncoder(path, pattern)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or vocabulary("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int32)))


def encode_documents(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids``: token ids of every whole text.

    A null or empty text has no ids; rows that repeat are encoded each; an empty table gives no rows.
    """
    place, splitter = _defaults(path, pattern)
    source = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(place, splitter)
        for ids, texts in slices(batches, 8_000_000):
            yield pa.RecordBatch.from_arrays([ids, _lists(*encoder.encode(texts))], ["doc_id", "ids"])

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for.  No ids, or null ones, are no bytes."""
    place, splitter = _defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(place, splitter)
        for batch in batches:
            ids = batch.column(1)
            values, edges = ids.values.to_numpy(), ids.offsets.to_pylist()
            decoded = [encoder.decode(values[lo:hi].tolist()) for lo, hi in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, ids array<int>, decoded binary")


def append_documents(
    docs: DataFrame, tail_col: str, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """``doc_id, ids`` of text and tail together, from the ids that the text already has.

    Null texts, ids and tails count as empty; rows that repeat and null ids stay; an empty table gives no rows."""
    place, splitter = _defaults(path, pattern)
    source = texts_of(docs, id_col, text_col).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(place, splitter)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            longer = [encoder.append(text or "", ids or [], tail or "") for text, ids, tail in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(longer, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select(docs[id_col], docs[text_col], docs[ids_col], docs[tail_col]), run, f"doc_id {source}, ids array<int>")
