"""Token ids of whole texts through a public tokenizer file, with the ids of repeated chunks remembered."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import UINT32

# A space inside a run of white space is the only place where cutting before a space changes tokens.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A word of letters alone and the marks after it, which no contraction starts with.
_MARKS = r"[.,;:!?]+$"
_MARKED = r"^\pL+" + _MARKS
_UNSAFE = f"{_SPACE}{_SPACE}{_SPACE}|{_SPACE}{_SPACE}\\z"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """Chunks and their ids, as arrays of bounded size: what the last texts did not hold is forgotten."""

    def __init__(self, limit: int):
        self.limit = limit
        self.keys, self.values, self.edges = pa.array([], pa.string()), np.zeros(0, UINT32), np.zeros(1, np.int64)

    def places(self, keys: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where the keys are; ``learn`` gives ids and sizes of those not known, each once."""
        found = pc.index_in(keys, value_set=self.keys)
        if found.null_count:
            new, base = keys.filter(found.is_null()).unique(), len(self.keys)
            values, sizes = learn(new)
            self.keys = pa.concat_arrays([self.keys, new])
            self.values = np.concatenate([self.values, values.astype(UINT32)])
            self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes)])
            found = pc.coalesce(found, pc.add(pc.index_in(keys, value_set=new), base))
        return found.to_numpy()

    def lists(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these chunks in a row, and their sizes."""
        every = pa.LargeListArray.from_arrays(pa.array(self.edges), pa.array(self.values))
        return every.take(pa.array(places)).flatten().to_numpy(), np.diff(self.edges)[places]

    def forget(self, places: np.ndarray) -> None:
        """Keep these alone, once the limit is passed."""
        if self.keys.nbytes + self.values.nbytes + self.edges.nbytes > self.limit:
            kept = np.unique(places)
            values, sizes = self.lists(kept)
            self.keys, self.values, self.edges = self.keys.take(pa.array(kept)), values.copy(), np.concatenate([[0], np.cumsum(sizes)])


class ChunkEncoder:
    """Encodes texts by chunks that start at a space, each distinct one once.

    A pattern of the kind ``' ?letters| ?digits| ?others|spaces'`` splits a chunk as it splits it
    within the text, unless the space stands in a longer run of white space; texts with such a
    run are encoded whole.  Marks that end a word are a match of their own, so the word is remembered without them.
    ``limit`` bytes are remembered, and what the texts at hand hold.
    """

    def __init__(self, limit: int):
        self.known = Remembered(limit)

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in a row, and their sizes."""
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        """Ids of a text."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one more for the end)."""
        if not len(texts):
            return np.zeros(0, UINT32), np.zeros(1, np.int64)
        parts = pc.split_pattern(texts.cast(pa.string()), " ")
        first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        chunks, at = coded.dictionary, coded.indices.to_numpy().copy()
        opening = flat.take(pa.array(first)).dictionary_encode()
        marked = pc.match_substring_regex(chunks, _MARKED)
        words = pc.if_else(marked, pc.replace_substring_regex(chunks, _MARKS, ""), chunks)
        marks = pc.if_else(marked, pc.replace_substring_regex(chunks, r"^\pL+", ""), "")
        keys = pa.concat_arrays([pc.binary_join_element_wise("", words, " "), marks, opening.dictionary])
        places = self.known.places(keys, self.learn)
        # a chunk is its word and its marks
        n = len(chunks)
        table = np.concatenate([places[: 2 * n].reshape(2, n).T.ravel(), places[2 * n :]])
        values, sizes = self.known.lists(table)
        self.known.forget(table)
        sizes = np.concatenate([sizes[: 2 * n].reshape(n, 2).sum(axis=1), sizes[2 * n :], [0]])
        nothing, wholes = len(sizes) - 1, []
        at[first] = opening.indices.to_numpy() + n
        ends = np.append(first[1:], len(at))
        for k in np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)).tolist():
            at[first[k] : ends[k]] = nothing
            at[first[k]] = len(sizes) + len(wholes)
            wholes.append(self.whole(texts[k].as_py()))
        sizes = np.concatenate([sizes, [len(w) // 4 for w in wholes]]).astype(np.int64)
        values = pa.array(np.concatenate([values, np.frombuffer(b"".join(wholes), UINT32)]))
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), values)
        lengths = np.add.reduceat(sizes[at], first)
        return lists.take(pa.array(at)).flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])


class TextEncoder(ChunkEncoder):
    """The ``tokenizers`` library: special tokens are never added, and their strings in a text are ordinary text."""

    def __init__(self, path: str, limit: int = 48_000_000):
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = byte_letters()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=UINT32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return self._library([text])[0]

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and their sizes: a space and letters is one match, which goes to the merges as it is;
        other chunks are encoded as texts."""
        word = pc.match_substring_regex(new, r"^ \pL+$").to_numpy(zero_copy_only=False)
        # each byte is a character of the vocabulary; a space, which starts every word, is the same one
        written = "".join(new.filter(pa.array(word)).to_pylist()).encode().decode("latin-1").translate(self.letters)
        space = self.letters[32]
        merged = list(map(self.tokenizer.model.tokenize, [space + w for w in written.split(space)[1:]]))
        rest = self._library(new.filter(pa.array(~word)).to_pylist())
        values = [np.array([t.id for tokens in merged for t in tokens], UINT32), np.frombuffer(b"".join(rest), UINT32)]
        sizes, first = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        sizes[word], sizes[~word] = list(map(len, merged)), [len(r) // 4 for r in rest]
        order = np.argsort(~word, kind="stable")  # the words' ids lie before the others'
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.concatenate(values)[at], sizes


@functools.cache
def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each file and Python worker; it keeps what it remembers between batches."""
    return TextEncoder(path)
