"""Elements of JSON files that run over many lines, cut out as the text streams by."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARK = _STEP != 0
_MARK[ord(",")] = True
_COMMA, _OPEN, _CLOSE = ord(","), ord("["), ord("]")


class Cutter:
    """The text of one file, fed in pieces that end with a line, comes back as texts ``(element, inner)``.

    Elements of an outermost array come singly, as do those of the array ``key`` of an outermost object
    (``inner``); such an object comes last, its array empty.  What is held is one element, or what an object has beside
    its array.  Only brackets, commas and strings are looked at: whether an element is JSON is for its reader to say.
    """

    def __init__(self, key: str):
        self.key = re.compile(rb'(?<!\\)"' + re.escape(key.encode()) + rb'"\s*:\s*$')
        self.depth = self.quotes = self.level = self.cuts = 0  # quotes: 1 within a string; level: depth of the array that is cut
        self.held: list[bytes] = []
        self.shell = b""
        self.texts: list[tuple[pa.Array, bool]] = []

    def _fail(self, text: bytes) -> None:
        raise ValueError(f"Malformed JSON, brackets or commas do not match, near {text[-200:].decode(errors='replace')!r}")

    def _take(self, text: bytes) -> bytes:
        """What is held with the text that ends it."""
        whole, self.held = b"".join([*self.held, text]), []
        return whole

    def _give(self, text: bytes, inner: bool) -> None:
        self.texts.append((pa.array([text.decode()], pa.string()), inner))

    def _split(self, data: np.ndarray, start: int, commas: np.ndarray) -> int:
        """Gives the elements that end at ``commas``; where the next one starts."""
        if not len(commas):
            return start
        inner = self.level == 2
        self._give(self._take(data[start : commas[0]].tobytes()), inner)
        self.cuts += len(commas)
        if len(commas) > 1:  # each with the comma after it, as a space
            data[commas] = ord(" ")
            text = data[commas[0] + 1 : commas[-1] + 1].tobytes()
            ends = (commas - commas[0]).astype(np.int32)
            self.texts.append((pa.StringArray.from_buffers(len(commas) - 1, pa.py_buffer(ends), pa.py_buffer(text)), inner))
        return int(commas[-1]) + 1

    def feed(self, text: bytes | np.ndarray) -> None:
        data = np.array(np.frombuffer(text, np.uint8))
        quote = data == ord('"')
        slashes = data == ord("\\")
        if slashes.any():
            plain = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
            at = np.flatnonzero(quote)
            before = np.where(at > 0, at - 1 - plain[at - 1], 0)
            quote[at[before % 2 == 1]] = False
        at = np.flatnonzero(_MARK[data])
        inside = np.bitwise_xor.accumulate(quote.view(np.uint8))
        at = at[inside[at] == self.quotes]
        self.quotes ^= int(inside[-1]) if len(data) else 0
        kind = data[at]
        after = self.depth + np.cumsum(_STEP[kind])
        before = after - _STEP[kind]
        ends = {1: np.flatnonzero(after < 1), 2: np.flatnonzero(after < 2)}
        turns = np.flatnonzero((after < 1) | ((kind == _OPEN) & (before == 1)))
        start, k, n = 0, 0, len(at)
        while k < n:
            if self.level:
                found = ends[self.level]
                end = int(found[j]) if (j := np.searchsorted(found, k)) < len(found) else n
                start = self._split(data, start, at[k:end][(kind[k:end] == _COMMA) & (after[k:end] == self.level)])
                if end == n:
                    break
                p = int(at[end])
                last = self._take(data[start:p].tobytes())
                if kind[end] != _CLOSE:
                    self._fail(last)
                if last.strip() or self.cuts:
                    self._give(last, self.level == 2)
                start = p if self.level == 2 else p + 1
                self.held, self.level, k = [self.shell] if self.level == 2 else [], 0, end + 1
            elif before[k] == 0:
                between = self._take(data[start : at[k]].tobytes())
                if between.removeprefix(b"\xef\xbb\xbf").strip() or after[k] != 1:
                    self._fail(between + b" " + bytes([kind[k]]))
                listed = kind[k] == _OPEN
                self.level, self.cuts, start, k = int(listed), 0, int(at[k]) + int(listed), k + 1
            else:
                if (j := np.searchsorted(turns, k)) == len(turns):
                    break
                k = int(turns[j])
                p = int(at[k])
                if after[k] == 0:
                    self._give(self._take(data[start : p + 1].tobytes()), False)
                    start = p + 1
                else:
                    self.held = [self._take(data[start:p].tobytes())]
                    if self.key.search(self.held[0][-1000:]):
                        self.shell, self.held, self.level, self.cuts = self.held[0] + b"[", [], 2, 0
                        p += 1
                    start = p
                k += 1
        self.depth = int(after[-1]) if n else self.depth
        self.held.append(data[start:].tobytes())

    def end(self) -> None:
        rest = self._take(b"")
        if self.depth or self.level or rest.removeprefix(b"\xef\xbb\xbf").strip():
            self._fail(rest)

    def given(self) -> list[tuple[pa.Array, bool]]:
        texts, self.texts = self.texts, []
        return texts


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(file, text) of each run of lines of one file."""
    files, lines = batch.column(0).to_numpy(), batch.column(1)
    _, offsets, data = lines.buffers()
    wide = np.int64 if pa.types.is_large_string(lines.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[lines.offset : lines.offset + len(lines) + 1]
    runs = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)]
    for a, b in zip(runs, runs[1:]):
        yield int(files[a]), np.frombuffer(data, np.uint8, count=int(offsets[b] - offsets[a]), offset=int(offsets[a]))


def file_elements(spark: SparkSession, paths: str | list[str], key: str) -> DataFrame:
    """(text, inner): what a ``Cutter`` gives for each file; a file is one task's, which holds an element of it at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cutter = None, Cutter(key)

        def out() -> Iterator[pa.RecordBatch]:
            for texts, inner in cutter.given():
                yield pa.RecordBatch.from_arrays([texts, pa.array(np.full(len(texts), inner))], ["text", "inner"])

        for batch in batches:
            for file, text in _lines(batch) if batch.num_rows else ():
                if file != at:
                    cutter.end()
                    yield from out()
                    at, cutter = file, Cutter(key)
                cutter.feed(text)
                yield from out()
        cutter.end()
        yield from out()

    # Of Spark's readers only this one gives the lines of a file in order, to one task, without holding the file:
    # rows of one column, with separators that no JSON text has.
    reader = spark.read.schema("line string").option("multiLine", True).option("lineSep", "\n").option("sep", "\x01").option("quote", "")
    lines = reader.csv(paths).where("line IS NOT NULL")
    named = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.concat("line", F.lit("\n")).alias("line"))
    return named.mapInArrow(cut, "text string, inner boolean")
