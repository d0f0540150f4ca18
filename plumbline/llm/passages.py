"""Repeated passages by compact windows: text whose min-hashes agree is found without comparing texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, sliced, texts_of
from plumbline.session import cut_lineage, drop_stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
LEAST_LONG = -(1 << 63)


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ v >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    v = (v ^ v >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return v ^ v >> np.uint64(32)


SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Numbers for bytes, the same for A-Z as for a-z, and for the first places of a word.
BYTES = _mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
BYTES[65:91] = BYTES[97:123]
PLACES = _mix(np.arange(32, dtype=np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
BLOCK = 1 << 20


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word in lower case (A-Z), and where it begins.

    The hash of a word is the sum of its bytes' numbers times those of their places, mixed with its length; that of a
    word longer than ``PLACES`` is xxHash.  All words of a block are summed as one column.
    """
    data = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[0], SOLID[data].view(np.int8), [0]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(len(begin), dtype=np.uint64)
    cuts = np.unique(np.searchsorted(begin, [*range(0, len(data), BLOCK), len(data)])).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part, sizes = data[begin[lo] : end[hi - 1]], (end - begin)[lo:hi]
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(first, sizes)
        sums = np.add.reduceat(BYTES[part[SOLID[part]]] * PLACES[np.minimum(place, len(PLACES) - 1)], first)
        out[lo:hi] = _mix(sums + sizes.astype(np.uint64))
    for k in np.flatnonzero(end - begin > len(PLACES)).tolist():
        out[k] = xxhash.xxh64_intdigest(text[begin[k] : end[k]].lower())
    return out, begin


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, from the hashes of words."""
    if len(codes) < width:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for k in range(width):
        hashes = hashes * np.uint64(0x9FB21C651E98DF25) + codes[k : len(codes) - width + 1 + k]
    return _mix(hashes)


def shingles_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    """A hash for each run of ``width`` words of each text; words are told by ASCII white space, in lower case (A-Z)."""
    codes, begin = word_hashes(b" ".join(texts))
    ends = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    starts = np.concatenate([[0], ends])[:-1]
    hashes = shingle_hashes(codes, width)
    return [hashes[lo : max(lo, hi - width + 1)] for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]


def compact_windows(hashes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``centre, value, first, last`` of the compact windows of passages of ``length`` shingles.

    A node of the Cartesian tree over the hashes groups the passages that have it as their least.
    Only nodes that span ``length`` shingles group any, and those are the runs of a sliding
    minimum: all passages that start from ``first`` to ``last`` have their minimum at ``centre``
    (ties: the first).  Passages never cross from one owner to the next.
    """
    n = len(hashes)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    bits = np.uint64(n.bit_length())
    packed = hashes >> bits << bits | np.arange(n, dtype=np.uint64)
    padded = np.concatenate([packed, np.full(-n % length, np.iinfo(np.uint64).max)]).reshape(-1, length)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
    if not len(start):
        return none, none.astype(np.uint64), none, none
    centre = (np.minimum(after[start], before[start + length - 1]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.diff(centre)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(centre)]]) - 1
    centre = centre[first]
    return centre, hashes[centre], start[first], start[last]


def _windows_of(ids: pa.Array, texts: list[str], width: int, length: int, hashes: int) -> dict[str, np.ndarray]:
    """Windows of some documents under all hash functions: ``value`` (with the number of the
    function in its low byte), ``doc`` and ``pos`` (centre, and how far before it passages start)."""
    found = shingles_of([t.encode() for t in texts], width)
    sizes = np.array([len(f) for f in found])
    shingles, owner = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
    offset = np.repeat(np.cumsum(sizes) - sizes, sizes)
    doc_ids = ids.to_numpy(zero_copy_only=False)
    value, doc, pos = [], [], []
    for j in range(hashes):
        centre, least, first, last = compact_windows(_mix(shingles ^ np.uint64(SEEDS[j])), owner, length)
        at = centre - offset[centre] if len(centre) else centre
        # stretches of one repeated shingle have a centre at every step: two in a length are enough
        kept = np.ones(len(centre), dtype=bool)
        kept[1:] = (least[1:] != least[:-1]) | (at[1:] // length != at[:-1] // length) | (owner[centre[1:]] != owner[centre[:-1]])
        centre, least, at, first, last = centre[kept], least[kept], at[kept], first[kept], last[kept]
        value.append((least & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(j)).view(np.int64))
        doc.append(doc_ids[owner[centre]] if len(centre) else np.zeros(0, dtype=np.int64))
        pos.append(at << 32 | centre - first << 16 | centre - last)
    return {"value": np.concatenate(value), "doc": np.concatenate(doc), "pos": np.concatenate(pos)}


def _heads(value: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by value, document and place, which of them are the first of their value, and
    for each row the first of its value."""
    order = np.lexsort((pos, doc, value))
    new = np.concatenate([[True], value[order][1:] != value[order][:-1]])
    return order, new, np.flatnonzero(new)[np.cumsum(new) - 1]


LINK = "value long, doc long, pos long, head long, head_pos long"
_NAMES = ["value", "doc", "pos", "head", "head_pos"]


def window_links(docs: DataFrame, width: int, length: int, hashes: int) -> DataFrame:
    """``value, doc, pos, head, head_pos``: every window with the first one that has its value; a document's
    own later windows of a value lead to itself.

    Windows meet by one shuffle on their value.  Within a slice of a task, only the first window
    of a value travels on its own; the others are already linked to it, so a passage that a third
    of all documents share is one row per slice.  The receiving task streams over sorted windows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches):
            w = _windows_of(ids, texts, width, length, hashes)
            if not len(w["value"]):
                continue
            order, new, head = _heads(w["value"], w["doc"], w["pos"])
            value, doc, pos = (w[c][order] for c in ("value", "doc", "pos"))
            heads = [pa.array(a[head], mask=new) for a in (doc, pos)]
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(doc), pa.array(pos), *heads], _NAMES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            linked = np.asarray(batch.column(3).is_valid())
            if linked.any():
                yield batch.filter(pa.array(linked))
            value, doc, pos = (batch.column(k).to_numpy()[~linked] for k in range(3))
            if not len(value):
                continue
            new = np.concatenate([[last is None or value[0] != last[0]], value[1:] != value[:-1]])
            at = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            head_doc = np.concatenate([[last[1] if last else 0], doc[first]])[at + 1]
            head_pos = np.concatenate([[last[2] if last else 0], pos[first]])[at + 1]
            if not new.all():
                yield pa.RecordBatch.from_arrays([pa.array(a[~new]) for a in (value, doc, pos, head_doc, head_pos)], _NAMES)
            last = value[-1], head_doc[-1], head_pos[-1]

    windows = map_batches(docs, emit, LINK)
    return map_batches(windows.repartition("value").sortWithinPartitions("value", "doc", "pos"), meet, LINK)


CHAIN = "doc long, head long, lo long, hi long, head_lo long, head_hi long"


def chains(links: DataFrame, width: int, length: int, enough: int) -> DataFrame:
    """``doc, head, lo, hi, head_lo, head_hi``: stretches of two documents whose windows agree, as word
    ranges that reach a passage beyond the outer centres.

    The interval join: of a document's linked windows those count that hold a start of a passage
    which windows of ``enough`` hash functions hold, whichever earlier documents they lead to (of
    many near copies, the first is another one for each window).  Windows that lead to the same
    document, within a passage of each other and on nearly the same diagonal, form a chain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            doc = table.column("doc").to_numpy()
            cut = int(np.searchsorted(doc, doc[-1]))  # the last document may go on in the next batch
            if cut:
                yield _chained(table.slice(0, cut), width, length, enough)
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield _chained(held, width, length, enough)

    return map_batches(links.repartition("doc").sortWithinPartitions("doc", "pos"), run, CHAIN)


def _chained(table: pa.Table, width: int, length: int, enough: int) -> pa.RecordBatch:
    doc, head, pos, head_pos = (table.column(c).to_numpy() for c in ("doc", "head", "pos", "head_pos"))
    at, head_at = pos >> 32, head_pos >> 32
    first, last = at - (pos >> 16 & 0xFFFF), at - (pos & 0xFFFF)
    # how many windows hold each start of a passage, document after document on one line
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    sizes = np.maximum.reduceat(last, np.flatnonzero(new)) + 2
    offset = (np.cumsum(sizes) - sizes)[np.cumsum(new) - 1]
    change = np.zeros(int(sizes.sum()), dtype=np.int64)
    np.add.at(change, offset + first, 1)
    np.add.at(change, offset + last + 1, -1)
    held = np.concatenate([[0], np.cumsum(np.cumsum(change) >= enough)])
    ok = held[offset + last + 1] > held[offset + first]
    doc, head, at, head_at = (a[ok] for a in (doc, head, at, head_at))
    names = ["doc", "head", "lo", "hi", "head_lo", "head_hi"]
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 6, names)
    order = np.lexsort((at, (at - head_at) // length, head, doc))  # by diagonal, then along it
    doc, head, at, head_at = (a[order] for a in (doc, head, at, head_at))
    step, drift = np.diff(at), np.abs(np.diff(at - head_at))
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(head) != 0) | (step > length) | (step < 0) | (drift > length)])
    starts, reach = np.flatnonzero(new), length + width
    lows = [np.maximum(0, np.minimum.reduceat(a, starts) - length) for a in (at, head_at)]
    highs = [np.maximum.reduceat(a, starts) + reach for a in (at, head_at)]
    columns = [doc[starts], head[starts], lows[0], highs[0], lows[1], highs[1]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _longest(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch of which at least ``share`` is equal (ties: the first)."""
    if equal.all():
        return 0, len(equal)
    total = np.zeros(len(equal) + 1)
    np.cumsum(np.where(equal, 1.0 - share, -share), out=total[1:])
    least = np.minimum.accumulate(total)
    start = (-least).searchsorted(-total - 1e-9)  # the first place from where the sum is not below zero
    end = int((np.arange(len(total)) - start).argmax())
    return int(start[end]), end


def _trimmed(equal: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
    """The range without unequal ends."""
    inside = equal[lo:hi].nonzero()[0]
    return (lo + int(inside[0]), lo + int(inside[-1]) + 1) if len(inside) else (0, 0)


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch of which at least ``share`` is equal (ties: the first), without unequal ends."""
    return _trimmed(equal, *_longest(equal, share))


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of ``x`` stand in ``y``; for short arrays, where ``np.isin`` costs several times as much."""
    if not len(y):
        return np.zeros(len(x), dtype=bool)
    known = np.sort(y)
    at = known.searchsorted(x)
    at[at == len(known)] = 0
    return known[at] == x


def matching(x: np.ndarray, y: np.ndarray, length: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches ``(x from, x to, y from, y to, Jaccard)`` of at least ``length`` shingles in ``x`` that
    have a counterpart in ``y``.

    Two sets of equal size have Jaccard ``s`` if a share of ``2s / (1 + s)`` of each is in the other, so the
    longest stretches of that share are tried.  One that is too short for want of a shingle at its ends gets it
    back; one whose sets fall short of ``similarity`` is searched for stretches of higher shares, at last for equal ones.
    Ranges with fewer shared shingles than the shortest stretch of a share has are not searched.
    """
    levels = [similarity + (1 - similarity) * k / 4 for k in range(5)]
    shares = [2 * s / (1 + s) for s in levels]
    if np.count_nonzero(_within(y, x)) < shares[0] * length * similarity - 1e-6:
        return []
    there, out, work = _within(x, y), [], [(0, len(x), 0)]
    while work:
        lo, hi, level = work.pop()
        if hi - lo < length or np.count_nonzero(there[lo:hi]) < shares[level] * length * similarity - 1e-6:
            continue
        a, b = _longest(there[lo:hi], shares[level])
        if b - a < length * similarity:  # nor is one of a higher share longer
            continue
        a, b = (lo + k for k in _trimmed(there[lo:hi], a, b))
        if b - a < length * similarity:
            if level + 1 < len(levels) and b > a:
                work.append((lo, hi, level + 1))
            continue
        if b - a < length:  # a change near an end: the passage reaches over it
            a = max(lo, min(a, b - length))
            b = min(hi, max(b, a + length))
        c, d = longest_stretch(_within(y, x[a:b]), shares[level])
        ours, theirs = set(x[a:b].tolist()), set(y[c:d].tolist())
        jaccard = len(ours & theirs) / len(ours | theirs) if theirs else 0.0
        if b - a >= length and jaccard >= similarity and d - c >= similarity * length:
            out.append((a, b, c, d, jaccard))
        elif level + 1 < len(levels):
            work.append((a, b, level + 1))
        work += [(lo, a, level), (b, hi, level)]
    return out


def _again(text: np.ndarray, length: int) -> np.ndarray:
    """Which places have the shingle of a place less than ``length`` before."""
    order, out = np.argsort(text, kind="stable"), np.zeros(len(text), dtype=bool)
    out[order[1:]] = (text[order][1:] == text[order][:-1]) & (np.diff(order) < length)
    return out


def equal_runs(x: np.ndarray, y: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Ranges of ``length`` or more places of ``x`` that stand in ``y`` as they are, on the diagonal of both starts or
    of both ends.  None holds a shingle twice within ``length``, so the same windows are drawn from both."""
    n, out, once = min(len(x), len(y)), set(), ~_again(x, length)
    for lead, skip in {(0, 0), (len(x) - n, len(y) - n)}:
        equal = (x[lead : lead + n] == y[skip : skip + n]) & once[lead : lead + n]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
        out |= {(lead + lo, lead + hi) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if hi - lo >= length}
    return sorted(out)


TILE = 1024
SHARED = "key long, doc long, at long, first long, last long, low long, high long"


def _shared_starts(table: pa.Table, hashes: int, enough: int) -> pa.RecordBatch:
    """``SHARED`` rows of whole documents' windows ``value, doc, at, first, last, low, high``: the starts from ``first`` to
    ``last`` that windows of two functions hold, by a key of both values; of them ``low`` to ``high`` are open."""
    value, doc, at, first, last, low, high = (table.column(c).to_numpy() for c in ("value", "doc", "at", "first", "last", "low", "high"))
    order = np.lexsort((first, doc))
    value, doc, at, first, last, low, high = (a[order] for a in (value, doc, at, first, last, low, high))
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    sizes = np.maximum.reduceat(last, np.flatnonzero(new)) + 1
    line = (np.cumsum(sizes) - sizes)[np.cumsum(new) - 1]  # document after document on one line
    rows = [np.flatnonzero((value & 0xFF) == j) for j in range(hashes)]
    xs, ys = [], []
    for i in range(hashes):
        for j in range(i + 1, hashes) if enough > 1 else [i]:
            x, y = rows[i], rows[j]
            if enough > 1 and len(y):  # windows of one function share no start
                lo = np.searchsorted((line + last)[y], (line + first)[x])
                n = np.maximum(0, np.searchsorted((line + first)[y], (line + last)[x], side="right") - lo)
                x, y = np.repeat(x, n), y[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            elif enough > 1:
                x = y
            xs.append(x)
            ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys)
    key = _mix(_mix(value[x].view(np.uint64)) + value[y].view(np.uint64)).view(np.int64)
    columns = [key, doc[x], at[x], np.maximum(first[x], first[y]), np.minimum(last[x], last[y]), np.maximum(low[x], low[y]), np.minimum(high[x], high[y])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "at", "first", "last", "low", "high"])


def _first_places(text: np.ndarray, length: int) -> np.ndarray:
    """For each place and start of a passage 1 if the place is in it, as the first with its shingle, else 0."""
    order = np.argsort(text, kind="stable")
    before = np.full(len(text), -1)
    again = np.flatnonzero(text[order][1:] == text[order][:-1]) + 1
    before[order[again]] = order[again - 1]
    start, place = np.arange(len(text) - length + 1), np.arange(len(text))[:, None]
    return ((place >= start) & (place < start + length) & (before[:, None] < start)).astype(np.float32)


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of binary rows one after the other, and where each row begins and the last one ends."""
    rows = column.combine_chunks()
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1] // np.dtype(kind).itemsize
    return np.frombuffer(rows.buffers()[2], kind)[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def _leading(part: np.ndarray) -> np.ndarray:
    """How many leading places of each row are true."""
    n = part.argmin(axis=1)
    n[part[np.arange(len(part)), n]] = part.shape[1]
    return n


PAIRS = 20_000  # compared at once
ROWS = 2_000  # of tiles taken together
KNOWN = 20_000  # pairs of texts


def _partners(table: pa.Table, edges: list[int], length: int, similarity: float) -> tuple[list[int], list[int]]:
    """Rows of tiles (from one of ``edges`` to the next) that ask, and for each as many earlier ones of its tile as it takes
    to give all its open starts that have a similar passage one.

    Equal text around the centre is tried first, then those that share the most shingles, of which one has to be ``beyond``
    what the row's own head has as it is.  Small tiles are taken together, and their pairs compared as columns.
    """
    ours, heads, known, lo = [], [], {}, 0
    for k in range(1, len(edges)):
        if k + 1 == len(edges) or edges[k + 1] - edges[lo] > ROWS:
            base = edges[lo]
            tile = np.repeat(np.arange(k - lo), np.diff(edges[lo : k + 1]))
            found = _partners_of(table.slice(base, edges[k] - base), tile, length, similarity, known)
            ours += [base + u for u in found[0]]
            heads += [base + v for v in found[1]]
            lo = k
    return ours, heads


def _partners_of(rows: pa.Table, tile: np.ndarray, length: int, similarity: float, known: dict) -> tuple[list[int], list[int]]:
    """``_partners`` of all rows, each of a ``tile``; ``known`` keeps what ``matching`` gave for texts, which come again under other keys and as copies."""
    asks, doc, at, first, low, high = (rows.column(c).to_numpy() for c in ("asks", "doc", "at", "first", "low", "high"))
    # an asking row meets the others of its tile whose documents are before its own: rows are sorted by tile and document
    new_tile = np.concatenate([[True], tile[1:] != tile[:-1]])
    new_doc = new_tile | np.concatenate([[True], doc[1:] != doc[:-1]])
    others, before = np.flatnonzero(~asks), np.cumsum(~asks) - ~asks
    start_of = [before[np.flatnonzero(new)[np.cumsum(new) - 1]] for new in (new_tile, new_doc)]
    asking = np.flatnonzero(asks & (start_of[1] > start_of[0]))
    if not len(asking):
        return [], []
    flat, edges = _flat(rows.column("shingles"), "<u4")
    owner = np.repeat(np.arange(len(asks)), np.diff(edges))
    place = np.arange(len(flat)) - edges[owner]
    packed, code = np.unique(tile[owner].astype(np.uint64) << np.uint64(32) | flat, return_inverse=True)  # one code for each tile's shingle
    code = code.astype(np.int32)
    width = 2 * length - 1
    # rows of a key have their centre's shingle in common, and no passage reaches further from it than its length
    aligned = np.empty((len(asks), width), dtype=np.int32)
    aligned[:] = np.where(asks, -1, -2)[:, None]
    aligned[owner, place + (first - at)[owner] + length - 1] = code
    ours, heads, rest, meets = [], [], {}, []
    sizes, lead = np.diff(edges) - length + 1, length - 1 + first - at
    n = (start_of[1] - start_of[0])[asking]
    for part in np.split(asking, np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
        n = (start_of[1] - start_of[0])[part]
        edge = np.cumsum(n) - n
        u, v = np.repeat(part, n), others[np.arange(n.sum()) - np.repeat(edge, n) + np.repeat(start_of[0][part], n)]
        equal = aligned[v] == aligned[u]
        runs = [_leading(equal[:, length - 1 :: -1]), _leading(equal[:, length - 1 :])]
        from_, to = np.maximum(length - runs[0] - lead[u], (low - first)[u]), np.minimum(runs[1] - lead[u], (high - first)[u] + 1)
        gaining = np.flatnonzero(to > from_)
        alike = equal[gaining].sum(axis=1)
        bounds = np.searchsorted(u[gaining], part, side="left").tolist(), np.searchsorted(u[gaining], part, side="right").tolist()
        for k, a, b in zip(part.tolist(), *bounds, strict=True):
            starts = np.zeros(sizes[k], dtype=bool)
            starts[low[k] - first[k] : high[k] - first[k] + 1] = True
            g, close = gaining[a:b], alike[a:b]
            while len(g):
                total = np.concatenate([[0], starts.cumsum()])
                gains = total[to[g]] - total[from_[g]]
                m = int(np.where(gains, 2 * length * gains + close, 0).argmax())
                if not gains[m]:
                    break
                ours.append(k)
                heads.append(int(v[g[m]]))
                starts[from_[g[m]] : to[g[m]]] = False
            if starts.any():
                rest[k] = starts
        still = np.isin(part, list(rest))
        meets.append((u[np.repeat(still, n)], v[np.repeat(still, n)]))
    if not rest:
        return ours, heads
    # shingles that asking rows share with others, numbered in each tile
    asked = np.zeros(len(asks), dtype=bool)
    asked[list(rest)] = True
    sides = np.zeros((2, len(packed)), dtype=bool)
    sides[0, code[asked[owner]]] = True
    sides[1, code[~asks[owner]]] = True
    shared = sides.all(axis=0)
    tile_of = (packed >> np.uint64(32)).astype(np.int64)
    number = np.cumsum(shared) - shared
    number -= number[np.searchsorted(tile_of, tile_of)]
    vocabulary = int(number[shared].max(initial=-1)) + 1
    has = np.zeros((len(others), vocabulary + 1), dtype=bool)
    kept = ~asks[owner] & shared[code]
    has[before[owner[kept]], number[code[kept]]] = True
    order = np.argsort(owner * len(packed) + code, kind="stable")
    again = np.zeros(len(flat), dtype=bool)
    again[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    repeats = np.bincount(owner[again], minlength=len(asks))
    least = np.maximum(1, length - repeats)  # no passage has fewer distinct shingles
    # the same for each asking row, by columns
    row_of = np.cumsum(asked) - 1
    mine = asked[owner]
    cell = row_of[owner[mine]], place[mine]
    codes, once, beyond = np.full((len(rest), width), vocabulary), *np.zeros((2, len(rest), width), dtype=bool)
    codes[cell] = np.where(shared[code[mine]], number[code[mine]], vocabulary)
    once[cell] = ~again[mine]
    flags, flag_edges = _flat(rows.column("beyond"), "?")
    beyond[cell] = flags[np.arange(len(flat))[mine] - edges[owner[mine]] + flag_edges[owner[mine]]]
    opened = np.zeros((len(rest), length), dtype=bool)
    for k, starts in rest.items():
        opened[row_of[k], : len(starts)] = starts
    for u, v in meets:
        if not len(u):
            continue
        inside = has.ravel()[codes[row_of[u]] + (before[v] * (vocabulary + 1))[:, None]]
        shares = (inside & once[row_of[u]]).sum(axis=1)
        near = (shares >= np.maximum(1.0, similarity * least[u] - 1e-4)) & (inside & beyond[row_of[u]]).any(axis=1)
        u, v, inside, shares = u[near], v[near], inside[near], shares[near]
        # without a shingle twice, what passages share is a sliding sum; sets of x and y shingles that are similar share as many as the bound
        total = np.zeros((len(u), width + 1), dtype=np.int16)
        np.cumsum(inside, axis=1, out=total[:, 1:])
        common = (total[:, length:] - total[:, :-length]).astype(np.float32)
        bound = np.maximum(similarity * length, similarity / (1 + similarity) * (length + least[v])) - 1e-4
        common[common < bound[:, None]] = 0
        likely = (repeats[u] > 0) | ((common > 0) & opened[row_of[u]]).any(axis=1)
        u, v, inside, shares, common = u[likely], v[likely], inside[likely], shares[likely], common[likely]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(u)) + 1, [len(u)]]).tolist() if len(u) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(u[a])
            starts, text = rest[k], flat[edges[k] : edges[k + 1]]
            found = common[a:b, : len(starts)]
            if repeats[k]:
                places = _first_places(text, length)
                distinct = places.sum(axis=0)
                found = inside[a:b, : len(text)].astype(np.float32) @ places
                found[found < np.maximum(similarity * distinct, similarity / (1 + similarity) * (distinct + least[v[a:b], None])) - 1e-4] = 0
            best = np.where(starts, 0, np.inf)  # shared with a partner so far; more is another passage, as much is the same again
            order = np.lexsort((doc[v[a:b]], -shares[a:b]))
            for m in order[(found > best).any(axis=1)[order]].tolist():
                if not (found[m] > best).any():
                    continue
                other = int(v[a + m])
                theirs = flat[edges[other] : edges[other + 1]]
                both = text.tobytes(), theirs.tobytes()
                if both not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[both] = matching(text, theirs, length, similarity)
                stretches = known[both]
                done = np.zeros(len(starts), dtype=bool)
                for x, y, *_ in stretches:
                    done[x : y - length + 1] = True
                if stretches:
                    best = np.maximum(best, found[m])
                if (done & starts).any():
                    ours.append(k)
                    heads.append(other)
                    starts &= ~done
                    best[done] = np.inf
    return ours, heads


def _several(rows: dict[str, np.ndarray], runs: dict[str, np.ndarray], length: int) -> np.ndarray:
    """Which rows' places more than one run meets, of those that are in no other."""
    found = np.zeros(len(rows["first"]), dtype=np.int64)
    for lo, hi in zip(runs["start"].tolist(), runs["end"].tolist(), strict=True):
        if not ((runs["start"] <= lo) & (runs["end"] >= hi) & ((runs["start"] < lo) | (runs["end"] > hi))).any():
            found += (rows["first"] < hi) & (rows["last"] + length > lo)
    return found > 1


def _rows(column: pa.Array, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each list of a column of lists of rows of longs."""
    offsets, flat = column.offsets.to_pylist(), {c: column.values.field(c).to_numpy() for c in names}
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield {c: values[lo:hi] for c, values in flat.items()}


def _covered(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in a range from ``first`` to before ``end``."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, np.minimum(first, size), 1)
    np.add.at(change, np.minimum(end, size), -1)
    return np.cumsum(change[:-1]) > 0


def _asking(rows: dict[str, np.ndarray], runs: dict[str, np.ndarray], at: np.ndarray, text: np.ndarray, shared: np.ndarray, length: int, similarity: float) -> np.ndarray:
    """Which of a document's rows have an open start that an earlier document may have a similar passage to.

    ``text`` are the shingles at the places ``at``, ``shared`` those that earlier documents have too; what lies in a
    run stands in its head as it is.  Too many places of its own rule a passage out; one that shares nothing beyond one run
    is, as far as it is shared, in the head of that run, so there no other is asked for.
    """
    size = int(at[-1]) + 1
    inside = _covered(size, runs["start"], runs["end"])
    also, own, again = (np.zeros(size, dtype=bool) for _ in range(3))
    also[at] = np.isin(text, shared)
    again[at] = _again(text, length)
    own[at] = ~also[at] & ~inside[at] & ~again[at]
    total = np.concatenate([[0], np.cumsum(own)])
    lacks = total[length:] - total[:-length]
    likely = np.concatenate([[0], np.cumsum(lacks <= length - similarity * length + 1e-9)])
    beyond = np.concatenate([[0], np.cumsum(also & ~inside)])
    first, end, low, high = rows["first"], rows["last"] + length, rows["low"], rows["high"]
    opened = low <= high
    possible = likely[np.where(opened, high + 1, 0)] > likely[np.where(opened, low, 0)]
    return opened & possible & ((beyond[end] > beyond[first]) | _several(rows, runs, length))


def hidden_links(source: DataFrame, links: DataFrame, found: DataFrame, width: int, length: int, similarity: float, hashes: int, enough: int) -> DataFrame:
    """Links as of ``window_links`` to earlier documents that the first one of a value hides.

    A window whose passages lie in what was found has its repeat; where it stands in an earlier document as it is
    (``equal_runs``), that document has its windows too, and neither side needs it.  Of the others, and of all windows of
    the values that more than two windows have, starts that windows of two functions hold meet under
    both values.  Of the open ones those ask that share enough shingles with any earlier documents (``_asking``), and are
    compared with all earlier ones of their key, by the shingles around them.  A
    key's rows are dealt out to parts of about ``TILE``; each part that asks meets each part of all in a tile of their own.
    """
    words = length + width - 1
    every = links.select("value", "doc", "pos").union(links.select("value", F.col("head").alias("doc"), F.col("head_pos").alias("pos"))).distinct()
    # a document may have a value more than once, and what repeats there need not be its first place
    crowded = every.groupBy("value").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 2 AND least < most").select("value")
    cuts = found.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("cuts"), F.array_distinct(F.flatten(F.collect_list("same"))).alias("same"))
    place = F.shiftright("pos", 32)
    windows = every.join(crowded, "value").join(cuts, "doc", "left").withColumns(
        {"at": place, "first": place - F.shiftright("pos", 16).bitwiseAND(F.lit(0xFFFF)), "last": place - F.col("pos").bitwiseAND(F.lit(0xFFFF))}
    )

    def without(ranges: str) -> tuple[Column, Column]:
        # a repeat that begins before the first start settles starts from there on, one that ends behind the last up to it
        before = F.array_max(F.transform(F.filter(ranges, lambda c: c["start"] <= F.col("first")), lambda c: c["end"] - words + 1))
        behind = F.array_min(F.transform(F.filter(ranges, lambda c: c["end"] >= F.col("last") + words), lambda c: c["start"] - 1))
        return F.greatest("first", before), F.least("last", behind)

    (low, high), (first, last) = without("cuts"), without("same")
    windows = windows.select("value", "doc", "at", first.alias("first"), last.alias("last"), low.alias("low"), high.alias("high")).where("first <= last")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["doc"]):
            yield _shared_starts(table, hashes, enough)

    shared = map_batches(windows.repartition("doc").sortWithinPartitions("doc"), meet, SHARED)
    key = Window.partitionBy("key")
    opened = F.col("low") <= F.col("high")
    shared = shared.withColumns({"least": F.min("doc").over(key), "asking": F.max(F.when(opened, F.col("doc"))).over(key)})
    columns = ["key", "at", "first", "last", "low", "high"]
    by_doc = shared.where("asking > least").groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    by_doc = by_doc.join(cuts.select("doc", "same"), "doc", "left").withColumn("same", F.coalesce("same", F.array()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows, same = batch.column(0).to_pylist(), _rows(batch.column(2), columns), _rows(batch.column(3), ["start", "end"])
            out = []
            for text, r, runs in zip(batch.column(1), rows, same, strict=True):
                hashed = shingles_of([text.as_buffer().to_pybytes()], width)[0]
                asks = r["low"] <= r["high"]
                wanted = _covered(len(hashed), r["first"][asks], r["last"][asks] + length) & ~_covered(len(hashed), runs["start"], runs["end"] - width + 1)
                at = np.flatnonzero(_covered(len(hashed), r["first"], r["last"] + length))
                out.append((at.astype("<i4").tobytes(), hashed[at].tobytes(), wanted[at].tobytes()))
            parts = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), batch.column(2), batch.column(3), *parts], ["doc", "rows", "same", "at", "shingles", "wanted"])

    row_type = "array<struct<" + ", ".join(f"{c}: bigint" for c in columns) + ">>"
    around = source.withColumnRenamed("doc_id", "doc").join(by_doc, "doc").select("doc", "text", "rows", "same")
    around = cut_lineage(map_batches(around, places, f"doc long, rows {row_type}, same array<struct<start: bigint, `end`: bigint>>, at binary, shingles binary, wanted binary"), "places")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, at = np.unique(np.frombuffer(text, "<i8"), return_inverse=True)
                wants = np.zeros(len(found), dtype=bool)
                wants[at[np.frombuffer(wanted, bool)]] = True
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), doc)), pa.array(wants)], ["shingle", "doc", "wanted"])

    shingles = map_batches(around.select("doc", "shingles", "wanted"), spread, "shingle long, doc long, wanted boolean")
    earlier = shingles.withColumn("least", F.min("doc").over(Window.partitionBy("shingle"))).where("wanted AND least < doc")
    common = earlier.groupBy("doc").agg(F.collect_list("shingle").alias("common"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at, text = (batch.column(k).to_pylist() for k in (0, 3, 4))
            out = {c: [np.zeros(0, dtype=np.int64)] for c in [*columns, "doc", "asks"]}
            rows, same = _rows(batch.column(1), columns), _rows(batch.column(2), ["start", "end"])
            for doc, r, runs, a, t, shared in zip(docs, rows, same, at, text, batch.column(5), strict=True):
                runs["end"] = runs["end"] - width + 1
                shared = shared.values.to_numpy() if shared.is_valid else np.zeros(0, dtype=np.int64)
                asks = _asking(r, runs, np.frombuffer(a, "<i4"), np.frombuffer(t, "<i8"), shared, length, similarity)
                for c, values in (r | {"doc": np.full(len(asks), doc), "asks": asks}).items():
                    out[c].append(values)
            yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(parts).astype(bool if c == "asks" else np.int64)) for c, parts in out.items()})

    asked = map_batches(
        around.select("doc", "rows", "same", "at", "shingles").join(common, "doc", "left"), ask, ", ".join(f"{c} long" for c in [*columns, "doc"]) + ", asks boolean"
    )
    asked = asked.withColumns({"n": F.count(F.lit(1)).over(key), "n_asks": F.count_if("asks").over(key), "least": F.min("doc").over(key), "asking": F.max(F.when(F.col("asks"), F.col("doc"))).over(key)})
    # none after the last that asks is an earlier one
    live = asked.where("asking > least AND (asks OR doc < asking)").drop("least", "asking")
    carried = [*columns, "n", "n_asks"]
    by_doc = live.groupBy("doc").agg(F.collect_list(F.struct(*carried, F.col("asks").cast("long").alias("asks"))).alias("live"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in [*carried, "doc", "asks", "shingles", "beyond"]}
            docs, at, text = (batch.column(k).to_pylist() for k in (0, 1, 2))
            same, rows = _rows(batch.column(3), ["start", "end"]), _rows(batch.column(4), [*carried, "asks"])
            for doc, a, t, runs, r in zip(docs, at, text, same, rows, strict=True):
                a, hashed = np.frombuffer(a, "<i4"), np.frombuffer(t, "<u8").astype("<u4")
                runs["end"] = runs["end"] - width + 1
                outside, several = ~_covered(int(a[-1]) + 1, runs["start"], runs["end"])[a], _several(r, runs, length)
                los = np.searchsorted(a, r["first"]).tolist()
                for lo, n, asks, any_place in zip(los, (r["last"] - r["first"] + length).tolist(), r["asks"].tolist(), several.tolist(), strict=True):
                    out["shingles"].append(hashed[lo : lo + n].tobytes())
                    out["beyond"].append((outside[lo : lo + n] | any_place).tobytes() if asks else None)
                for c, values in (r | {"doc": np.full(len(los), doc)}).items():
                    out[c].append(values)
            kinds = {"asks": bool, "shingles": pa.binary(), "beyond": pa.binary()}
            yield pa.RecordBatch.from_pydict(
                {c: pa.array(v, kinds[c]) if c in ("shingles", "beyond") else pa.array(np.concatenate(v).astype(kinds.get(c, np.int64))) for c, v in out.items()}
            )

    schema = ", ".join(f"{c} long" for c in [*carried, "doc"]) + ", asks boolean, shingles binary, beyond binary"
    rows = map_batches(around.select("doc", "at", "shingles", "same").join(by_doc, "doc"), contexts, schema)
    parts, asking = (F.ceil(F.col(c) / TILE).cast("int") for c in ("n", "n_asks"))

    def dealt(count: Column) -> Column:
        return F.pmod(F.xxhash64("doc"), count).cast("int")

    def against(count: Column) -> Column:
        return F.sequence(F.lit(0), count - 1)

    served = F.transform(against(asking), lambda i: F.struct(F.lit(False).alias("asks"), i.alias("i"), dealt(parts).alias("j")))
    asks = F.transform(F.when(F.col("asks"), against(parts)).otherwise(F.array().cast("array<int>")), lambda j: F.struct(F.lit(True).alias("asks"), dealt(asking).alias("i"), j.alias("j")))
    tiles = rows.withColumn("role", F.explode(F.concat(served, asks))).select("key", "role.i", "role.j", "role.asks", "doc", "at", "first", "last", "low", "high", "shingles", F.when(F.col("role.asks"), F.col("beyond")).alias("beyond"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["key", "i", "j"]):
            cells = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            edges = np.flatnonzero(np.concatenate([[True], (cells[:, 1:] != cells[:, :-1]).any(axis=0), [True]])).tolist()
            ours, heads = _partners(table, edges, length, similarity)
            at, first, last, doc, value = (table.column(c).to_numpy() for c in ("at", "first", "last", "doc", "key"))
            pos = at << 32 | at - first << 16 | at - last
            mine, theirs = np.array(ours, dtype=np.int64), np.array(heads, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (value[mine], doc[mine], pos[mine], doc[theirs], pos[theirs])], _NAMES)

    more = cut_lineage(map_batches(tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc", "at"), compare, LINK), "hidden-links")
    drop_stage(around)
    return more


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a group of these columns ends."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cells = np.stack([held.column(c).to_numpy() for c in columns])
        edges = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
        if len(edges):
            yield held.slice(0, int(edges[-1]))
            held = held.slice(int(edges[-1]))
    if held is not None and held.num_rows:
        yield held


REPEAT = "doc long, start long, end long, head long, head_start long, head_end long, similarity double, same array<struct<start: bigint, `end`: bigint>>"


def repeated_passages(
    docs: DataFrame,
    words: int = 50,
    width: int = 5,
    similarity: float = 0.8,
    hashes: int = 4,
    enough: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc, start, end, head, head_start, head_end, similarity``: passages (ranges of words) that an
    earlier document has too.

    A passage has ``words`` words or more; the two ranges' sets of shingles of ``width`` words have a
    Jaccard similarity of ``similarity`` or more, which is computed from the texts.  Words are
    separated by ASCII white space and compare in lower case (A-Z).  ``head`` is an earlier document
    by id.  Ids are integers, a null id is the least; rows that share an id, or have none, are documents of
    their own, in the order of their texts.  Null, empty and short texts have no passages.
    """
    options = (words, width, similarity, hashes, enough)
    source = texts_of(docs, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_LONG)))
    if distinct_ids(source, "doc_id"):
        return _repeats(source, *options)
    rows = keyed(source, "doc_id", "text")
    found = _repeats(rows.select(F.col(KEY).alias("doc_id"), "text"), *options)
    own = rows.select(F.col(KEY).alias("doc"), F.col("doc_id").alias("__doc"))
    theirs = rows.select(F.col(KEY).alias("head"), F.col("doc_id").alias("__head"))
    named = found.join(own, "doc").join(theirs, "head")
    return named.select(*[F.col(f"__{c}").alias(c) if c in ("doc", "head") else F.col(c) for c in found.columns])


KEY = "__passage_key"


def distinct_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether no two rows share an id or have none."""
    return docs.groupBy(docs[id_col]).count().where("count > 1").isEmpty()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with a key of their own that ascends with the id (nulls first) and the text, written to the shared folder."""
    order = [F.col(id_col), F.col(text_col)]
    return cut_lineage(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def _repeats(source: DataFrame, words: int, width: int, similarity: float, hashes: int, enough: int) -> DataFrame:
    """``repeated_passages`` of ``doc_id, text`` whose ids are distinct."""
    length = words - width + 1
    links = cut_lineage(window_links(source, width, length, hashes), "window-links")
    found = _verified(source, chains(links.where("doc <> head"), width, length, enough), width, length, similarity)
    more = hidden_links(source, links, found, width, length, similarity, hashes, enough)
    drop_stage(links)
    if more.isEmpty():
        return found.drop("same")
    # each of these starts of passages is held by as many functions as are asked for
    return cut_lineage(found.union(_verified(source, chains(more, width, length, 1), width, length, similarity)).drop("same").distinct(), "repeats")


def _verified(source: DataFrame, chained: DataFrame, width: int, length: int, similarity: float) -> DataFrame:
    """The passages of ``repeated_passages`` in these chains, by their texts, and which ranges of words of each (``same``)
    its head has as they are."""
    found = cut_lineage(chained, "chains")
    ranges = found.select(F.col("doc").alias("doc_id"), "lo", "hi").union(found.select("head", "head_lo", "head_hi")).distinct()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, split = None, []
        for batch in batches:
            out = []
            for text, lo, hi in zip(batch.column(3), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                if data != last:
                    last, split = data, data.lower().split()
                out.append(b" ".join(split[lo:hi]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "lo", "hi", "words"])

    parts = source.join(ranges, "doc_id").select("doc_id", "lo", "hi", "text")
    parts = cut_lineage(map_batches(parts, texts, "doc_id long, lo long, hi long, words binary"), "passage-words")
    own = parts.select(F.col("doc_id").alias("doc"), "lo", "hi", F.col("words").alias("own"))
    theirs = parts.select(F.col("doc_id").alias("head"), F.col("lo").alias("head_lo"), F.col("hi").alias("head_hi"), F.col("words").alias("theirs"))
    both = found.join(own, ["doc", "lo", "hi"]).join(theirs, ["head", "head_lo", "head_hi"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1_000) for b in batches for lo in range(0, b.num_rows, 1_000)):
            rows = []
            ours, theirs = (shingles_of(batch.column(c).to_pylist(), width) for c in ("own", "theirs"))
            for doc, lo, head, head_lo, a, b in zip(*(c.to_pylist() for c in batch.columns[:4]), ours, theirs, strict=True):
                for s, e, hs, he, j in matching(a, b, length, similarity):
                    same = [{"start": lo + s + x, "end": lo + s + y + width - 1} for x, y in equal_runs(a[s:e], b[hs:he], length)]
                    rows.append((doc, lo + s, lo + e + width - 1, head, head_lo + hs, head_lo + he + width - 1, j, same))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["doc", "start", "end", "head", "head_start", "head_end", "similarity", "same"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    verified = map_batches(both.select("doc", "lo", "head", "head_lo", "own", "theirs"), verify, REPEAT).distinct()
    verified = cut_lineage(verified, "repeats")  # small beside the texts, and read more than once
    for stage in (found, parts):
        drop_stage(stage)
    return verified


def passage_rows(repeats: DataFrame) -> DataFrame:
    """``doc_id, start, n_words, first_doc_id, first_start, first_n_words, similarity``: every passage
    that repeats, and once those it repeats, which are their own first."""
    own = repeats.select(
        F.col("doc").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("n_words"),
        F.col("head").alias("first_doc_id"), F.col("head_start").alias("first_start"), (F.col("head_end") - F.col("head_start")).alias("first_n_words"), "similarity",
    )
    first = own.select("first_doc_id", "first_start", "first_n_words").distinct()
    heads = first.select(
        F.col("first_doc_id").alias("doc_id"), F.col("first_start").alias("start"), F.col("first_n_words").alias("n_words"), "*", F.lit(1.0).alias("similarity")
    )
    return own.unionByName(heads).withColumns({c: F.nullif(F.col(c), F.lit(LEAST_LONG)) for c in ("doc_id", "first_doc_id")})


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these ranges of words and the white space that follows them."""
    places = [m.start() for m in WORD.finditer(text)] + [len(text)]
    gone = np.zeros(len(places), dtype=bool)
    for start, end in ranges:
        gone[start : min(end, len(places) - 1)] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    at, out = 0, []
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : places[lo]])
        at = places[hi]
    return ("".join(out) + text[at:]).rstrip() if out else text


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", **options) -> DataFrame:
    """The documents with every passage that an earlier document has cut out; all rows and columns
    stay, and ``size_col``, where there is one, is the new length.  Null texts stay null; rows that share an id are
    cut each by its own text."""
    schema = docs.schema
    if distinct_ids(docs, id_col):
        found, key = repeated_passages(docs, id_col=id_col, text_col=text_col, **options), F.coalesce(docs[id_col].cast("long"), F.lit(LEAST_LONG))
    else:
        docs = keyed(docs, id_col, text_col)
        found, key = repeated_passages(docs, id_col=KEY, text_col=text_col, **options), docs[KEY]
    # a document has at most as many ranges as it has windows
    cuts = found.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("__cuts"))
    joined = docs.join(cuts, key == cuts["doc"], "left").select(*[docs[f.name] for f in schema], "__cuts")
    at, names = schema.names.index(text_col), schema.names
    size_at = names.index(size_col) if size_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = batch.column(at), batch.column(len(names))
            if cut.null_count < len(cut):
                pairs = zip(texts.to_pylist(), cut.to_pylist(), strict=True)
                new = [cut_words(t, [(c["start"], c["end"]) for c in cs]) if t is not None and cs else t for t, cs in pairs]
                texts = pa.array(new, texts.type)
            columns = list(batch.columns[: len(names)])
            columns[at] = texts
            if size_at is not None:
                sizes = pa.compute.utf8_length(texts).cast(columns[size_at].type)
                columns[size_at] = pa.compute.if_else(cut.is_valid(), sizes, columns[size_at])
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(joined, run, schema)
