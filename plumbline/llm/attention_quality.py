"""Document quality by attention over passages: labels of documents teach which passages count."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, sliced, texts_of

PASSAGE_WORDS = 64
CLASSES = 56


def _byte_classes() -> np.ndarray:
    """A class for each byte: small letters and ASCII punctuation of their own; capitals, digits,
    white space, control characters and bytes beyond ASCII by kind."""
    classes, following = np.zeros(256, dtype=np.int64), 6
    for b in range(128):
        c = chr(b)
        if c.isupper():
            classes[b] = 1
        elif c.isdigit():
            classes[b] = 2
        elif c.isspace():
            classes[b] = 3 if c != "\n" else 4
        elif c.islower() or c.isprintable():
            classes[b] = min(following, CLASSES - 1)
            following += c.islower() or c in "!#$%&*|<>.,;:?@-+/()\"'=_"
    classes[128:] = 5
    return classes


BYTE_CLASS = _byte_classes()
FEATURES = CLASSES + 6


def encode_passages(text: str, words: int = PASSAGE_WORDS) -> np.ndarray:
    """One row of features per passage of ``words`` words; a text of no words is one zero row.

    Shares of byte classes, mean word length, share of distinct words, of words equal to the one
    before, of word pairs seen earlier in the text, of words that end in no letter, and lone words.
    """
    tokens = text.encode().split()
    n = len(tokens)
    if not n:
        return np.zeros((1, FEATURES), dtype=np.float32)
    passages = max(1, n // words)  # what is left over belongs to the last passage
    of_word = np.minimum(np.arange(n) // words, passages - 1)
    first = np.arange(passages) * words
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(t, len(known)) for t in tokens], dtype=np.int64)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    data = np.frombuffer(b" ".join(tokens), np.uint8)
    of_byte = np.repeat(of_word, lengths + 1)[:-1]
    out = np.zeros((passages, FEATURES), dtype=np.float32)
    counts = np.bincount(of_byte * CLASSES + BYTE_CLASS[data], minlength=passages * CLASSES).reshape(passages, CLASSES)
    out[:, :CLASSES] = counts / counts.sum(axis=1, keepdims=True)
    size = np.bincount(of_word, minlength=passages)
    pair = codes[:-1] * n + codes[1:]
    seen = np.ones(n, dtype=bool)
    seen[0] = False
    seen[1 + np.unique(pair, return_index=True)[1]] = False
    distinct = np.unique(of_word * n + codes) // n
    ends = data[np.cumsum(lengths + 1) - 2]
    odd_end = ~(((ends | 32) >= 97) & ((ends | 32) <= 122) | (ends >= 128))
    same = np.concatenate([[False], codes[1:] == codes[:-1]])
    sums = [lengths / 10, None, same, seen, odd_end, lengths == 1]
    for k, values in enumerate(sums):
        total = np.bincount(distinct, minlength=passages) if values is None else np.add.reduceat(values.astype(np.float64), first)
        out[:, CLASSES + k] = total / size
    return out


@dataclass(frozen=True)
class GatedAttention:
    """Passages ``h = tanh(x We + be)``, weights softmax of ``w (tanh(h V) * sigmoid(h U))`` within a
    document, and the score of the weighted sum."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["We"] + p["be"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts, bag = _layout(bags)
        return self.forward(np.concatenate(bags), starts, bag)["y"]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _layout(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bags])
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
    """Fit by Adam on the documents' cross entropy; the same bags in the same order give the same model."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    shapes = {"We": (FEATURES, hidden), "be": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    model = GatedAttention(mean, scale, weights)
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            some = [bags[i] for i in order[lo : lo + batch]]
            starts, bag = _layout(some)
            f = model.forward(np.concatenate(some), starts, bag)
            dy = (f["y"] - labels[order[lo : lo + batch]]) / len(some)
            dz = dy[:, None] * weights["c"]
            da = (dz[bag] * f["h"]).sum(axis=1)
            ds = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
            dt = ds[:, None] * weights["w"] * f["g"] * (1 - f["t"] ** 2)
            dg = ds[:, None] * weights["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dz[bag] + dt @ weights["V"].T + dg @ weights["U"].T
            dx = dh * (1 - f["h"] ** 2)
            slopes = {"We": f["x"].T @ dx, "be": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dy, "d": dy.sum()}
            step += 1
            for k, slope in slopes.items():
                slope = slope + decay * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the checksum of the id as text, never teaches."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_bags(
    docs: DataFrame, labels: DataFrame, label: str, sample: int, passages: int, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``sample`` documents that may teach, ``passages`` evenly
    spread passages of each at most: a bounded sample, chosen by a hash of the id."""
    usable = labels.select(labels[id_col].alias("doc_id"), labels[label].cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    chosen = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [encode_passages(t) for t in batch.column(1).to_pylist()]
            rows = [r[np.unique(np.linspace(0, len(r) - 1, passages).astype(int))] for r in rows]
            x = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], ["doc_id", "y", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    # rows that repeat an id could exceed the bound
    found = map_batches(texts, run, f"doc_id {kind}, y int, x binary").orderBy("doc_id", "x").limit(sample).collect()
    return [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in found], np.array([r["y"] for r in found], dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4_000, passages: int = 48, id_col: str = "doc_id", text_col: str = "text") -> GatedAttention:
    """A model of the labels, taught by a bounded sample (at most ``sample`` documents).

    Without any label that may teach, the model scores every text 0.5.
    """
    bags, y = labelled_bags(docs, labels, label, sample, passages, id_col, text_col)
    if not bags:
        blank = train([np.zeros((1, FEATURES), dtype=np.float32)], np.array([0.5]), epochs=0)
        return GatedAttention(blank.mean, blank.scale, {**blank.weights, "c": 0 * blank.weights["c"], "d": np.zeros(())})
    return train(bags, y)


def score_documents(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text, from 0 to 1.

    A null or empty text is scored as one passage without words; rows that repeat are scored
    each; an empty table gives no rows.
    """
    source = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.score([encode_passages(t) for t in texts]))], ["doc_id", "score"])

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: GatedAttention, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``least``, with all their columns, in one pass.

    Null texts score as empty ones and stay null; rows that repeat are judged alike and all stay or go; ids play
    no part, null ones neither; an empty table stays empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                scores = model.score([encode_passages(t or "") for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(scores >= least))

    return map_batches(docs, run, docs.schema)
