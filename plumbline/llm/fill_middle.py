"""Fill-in-middle by displacement scatter: difference arrays give every byte of a batch its shift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, slices, texts_of

MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])
# order of the pieces (0 prefix, 1 middle, 2 suffix) in the output of each form
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
# the mark that opens a piece
MARK_OF = {0: 0, 1: 2, 2: 1}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each text starts (one more for the end)."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[edges[0] : edges[-1]], edges - edges[0]


def strings_of(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The texts whose bytes these are."""
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))


def mark_places(data: np.ndarray) -> np.ndarray:
    """Where a mark stands, ascending."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    letter = data[1:-1]
    named = (letter == ord("P")) | (letter == ord("S")) | (letter == ord("M"))
    return np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & named)


def unit_ends(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where units end, ascending: a unit is white space and the word after it, or the white space a text ends in."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    space = _SPACE[data]
    last = np.zeros(len(data), dtype=bool)
    last[edges[1:][edges[1:] > edges[:-1]] - 1] = True
    following = np.append(space[1:], True)
    return np.flatnonzero(last | (~space & following)) + 1


def displaced(cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces go: ``starts`` of pieces in the input with their ``shifts``, output ``edges`` of texts,
    and places of marks as rows ``(place, mark)``.

    ``cuts`` holds four columns: start, end of the prefix, end of the middle, end of each text.
    """
    marked = form != PLAIN
    sizes = np.diff(cuts, axis=1)
    edges = np.concatenate([[0], np.cumsum(sizes.sum(axis=1) + 9 * marked)])
    to = np.repeat(edges[:-1, None], 3, axis=1)
    to[:, 1] += sizes[:, 0]
    to[:, 2] += sizes[:, 0] + sizes[:, 1]
    marks = []
    for kind, order in ORDER.items():
        rows = np.flatnonzero(form == kind)
        at = edges[:-1][rows]
        for piece in order:
            marks.append(np.stack([at, np.full(len(rows), MARK_OF[piece])], axis=1))
            to[rows, piece] = at + 3
            at = at + 3 + sizes[rows, piece]
    return cuts[:, :3].ravel(), (to - cuts[:, :3]).ravel(), edges, np.concatenate(marks)


def shift_of_each(size: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The shift of every byte: changes of shift at the starts of pieces, summed up.

    Pieces that share a start are empty but for the last, whose shift their changes add up to."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    return np.cumsum(change[:size])


def scatter(data: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of the outputs."""
    starts, shifts, edges, marks = displaced(cuts, form)
    out = np.zeros(edges[-1], dtype=np.uint8)
    out[np.arange(len(data)) + shift_of_each(len(data), starts, shifts)] = data
    letters = np.array([list(m) for m in MARKS], dtype=np.uint8)
    for k in range(3):
        out[marks[:, 0] + k] = letters[marks[:, 1], k]
    return out, edges


def gather(data: np.ndarray, edges: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and edges of the texts whose outputs these are: the inverse of ``scatter``.

    The pieces are found by the three marks of each output alone; no text that has a form other
    than plain holds a mark of its own, and none can arise where a piece meets a mark.
    """
    sizes = np.diff(edges)
    marked = np.flatnonzero(form != PLAIN)
    places = mark_places_within(data, edges)
    owner = np.searchsorted(edges, places, side="right") - 1
    places = places[form[owner] != PLAIN].reshape(len(marked), 3)
    ends = np.concatenate([places[:, 1:], edges[1:][marked, None]], axis=1)
    piece_from, piece_size = np.zeros((len(form), 3), np.int64), np.zeros((len(form), 3), np.int64)
    piece_from[:, :] = edges[:-1, None]
    piece_size[:, 0] = sizes
    piece_size[marked, 0] = 0
    for kind, order in ORDER.items():
        rows, of = np.flatnonzero(form == kind), np.flatnonzero(form[marked] == kind)
        for k, piece in enumerate(order):
            piece_from[rows, piece] = places[of, k] + 3
            piece_size[rows, piece] = ends[of, k] - places[of, k] - 3
    text_edges = np.concatenate([[0], np.cumsum(piece_size.sum(axis=1))])
    starts = text_edges[:-1, None] + np.cumsum(piece_size, axis=1) - piece_size
    shift = shift_of_each(int(text_edges[-1]), starts.ravel(), (piece_from - starts).ravel())
    return data[np.arange(len(shift)) + shift], text_edges


def draw(seed: int = 42):
    """``h1`` to ``h4``: the first 8-digit groups of the sha256 of ``seed:doc_id``; a null id counts as empty."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every document.

    A text is cut into ``n`` units (white space and the word after it; white space at the end); its
    prefix, middle and suffix are cut at two numbers of units drawn from the id.  ``rate`` per cent of the
    texts are transformed, of these ``spm_rate`` per cent suffix first; the others, empty ones and those
    that hold a mark stay plain, and have null ``prefix_chars`` and ``middle_chars``.

    Null texts count as empty; rows that repeat stay and are drawn alike; a null id draws as an empty one; an
    empty table gives no rows.  A task holds a slice of whole texts at a time, however long one is.
    """
    source = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in slices(iter([batch])):
                drawn = [batch.column(2 + k).slice(at, len(ids)).to_numpy() for k in range(4)]
                at += len(ids)
                yield _transformed(ids, texts, drawn, rate, spm_rate)

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(source.select("doc_id", "text", *draw(seed)), run, schema)


def _transformed(ids: pa.Array, texts: pa.Array, drawn: list[np.ndarray], rate: int, spm_rate: int) -> pa.RecordBatch:
    data, edges = bytes_of(texts)
    ends = unit_ends(data, edges)
    before = np.searchsorted(ends, edges, side="right")  # units that end before each text does
    n = np.diff(before)
    h1, h2, h3, h4 = drawn
    form = np.where(h4 % 100 < spm_rate, SPM, PSM)
    form[(n == 0) | (h3 % 100 >= rate)] = PLAIN
    form[np.searchsorted(edges, mark_places_within(data, edges), side="right") - 1] = PLAIN
    places = np.concatenate([ends, [0]])
    cuts = [edges[:-1]]
    for units in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        cuts.append(np.where(units > 0, places[before[:-1] + units - 1], edges[:-1]))
    cuts = np.stack([*cuts, edges[1:]], axis=1)
    cuts[form == PLAIN, 1:3] = edges[1:][form == PLAIN, None]
    out, out_edges = scatter(data, cuts, form)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    plain = form == PLAIN
    counts = [pa.array(chars[cuts[:, k + 1]] - chars[cuts[:, k]], mask=plain) for k in (0, 1)]
    columns = [ids, pa.array(n), FORMS.take(pa.array(form)), *counts, strings_of(out, out_edges).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def mark_places_within(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where a mark stands inside one text, not across two."""
    places = mark_places(data)
    return places[np.searchsorted(edges, places, side="right") == np.searchsorted(edges, places + 2, side="right")]


def restore(rows: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``: the text, rebuilt from ``output`` and ``form`` alone.

    Null outputs count as empty; an unknown or null form as plain."""
    others = [c for c in rows.columns if c not in ("form", "output", "restored")]
    source = rows.select(F.coalesce("form", F.lit("plain")).alias("form"), F.coalesce("output", F.lit("")).alias("output"), *others)
    names = [*source.columns, "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for forms, outputs in slices(iter([batch])):
                part = batch.slice(at, len(forms))
                at += len(forms)
                form = pa.compute.fill_null(pa.compute.index_in(forms, FORMS.cast(forms.type)), 0).to_numpy()
                data, edges = bytes_of(outputs)
                texts = strings_of(*gather(data, edges, form)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names)

    return map_batches(source, run, source.withColumn("restored", F.lit("")).schema)
