"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, policies are masks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, sliced, texts_of

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_as_before", "n_letters", "n_capitals", "n_exclaimed"]

# The rules, in the order of their bits: a name and the condition under which a text fails.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    ("odd_word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("stammering", "100 * n_same_as_before > 20 * n_words"),
    ("shouting", "100 * n_capitals > 50 * n_letters"),
    ("exclamations", "100 * n_exclaimed > 30 * n_words"),
    ("few_letters", "100 * n_letters < 50 * word_chars"),
]


def repeated(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur twice or more.

    Windows are numbered by doubling: equal pairs of equal halves are equal, so nothing is hashed.
    """
    n = len(codes)
    if n < window:
        return 0
    rank, span = codes, 1
    while span < window:
        _, rank = np.unique(rank[:-span] * (n + 1) + rank[span:], return_inverse=True)
        span *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    edges[: len(twice)] += twice
    edges[window : window + len(twice)] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str) -> list[int]:
    """The measurements of one text, in the order of ``MEASURES``."""
    data = text.encode()
    words = data.split()
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    lines = [line for line in data.split(b"\n") if line.strip()]
    letters = np.frombuffer(data, np.uint8)
    small = int(((letters >= 97) & (letters <= 122)).sum())
    large = int(((letters >= 65) & (letters <= 90)).sum())
    if text.isascii():
        other = capitals = 0
    else:
        beyond = [c for c in text if c > "\x7f"]
        other, capitals = sum(map(str.isalpha, beyond)), sum(map(str.isupper, beyond))
    return [
        len(words),
        len(text) - sum(data.count(c) for c in SPACES),
        sum(data.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated(codes),
        int((codes[1:] == codes[:-1]).sum()),
        small + large + other,
        large + capitals,
        sum(w.endswith(b"!") for w in words),
    ]


def ledger(docs: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, every measurement, and ``failed``: one bit for each rule the text fails.

    A null or empty text measures zero everywhere and fails the rules that zero fails (of the
    given ones ``few_words`` alone); rows that repeat are kept; an empty table gives no rows.
    """
    source = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches):
            table = np.array([measure(t) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, np.ascontiguousarray(table.T))], ["doc_id", *MEASURES])

    kind = source.schema["doc_id"].dataType.simpleString()
    measured = map_batches(source, run, ", ".join([f"doc_id {kind}", *(f"{m} long" for m in MEASURES)]))
    failed = F.lit(0).cast("long")
    for bit, (_, condition) in enumerate(rules or RULES):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


@dataclass(frozen=True)
class Policy:
    """A version of what must not fail: names of rules."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: list[tuple[str, str]] | None = None) -> int:
        names = [name for name, _ in rules or RULES]
        return sum(1 << names.index(r) for r in self.rules)

    def passes(self, failed: Column, rules: list[tuple[str, str]] | None = None) -> Column:
        return failed.bitwiseAND(F.lit(self.mask(rules)).cast("long")) == 0


POLICIES = {
    "base-1": Policy("base-1", ("few_words", "repeated_passages")),
    "full-1": Policy("full-1", tuple(name for name, _ in RULES)),
}


def ablations(book: DataFrame, policies: list[Policy], rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """What each rule of each policy does: ``version, rule, n_docs, n_failed, n_only, n_kept,
    n_kept_without``.

    Rows that repeat count each; an empty ledger gives no rows.  The ledger is counted once by its bits, before any shuffle; policies and rules are then
    bitwise sums over at most as many rows as there are combinations of bits.
    """
    counts = book.groupBy("failed").agg(F.count("*").alias("n"))
    names = [name for name, _ in rules or RULES]
    cases = [
        F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
        for p in policies
        for r in p.rules
    ]
    each = counts.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("c.*", F.expr("failed & c.mask").alias("hit"), "n")

    def total(condition: str) -> Column:
        return F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0))

    return each.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        total("hit & bit <> 0").alias("n_failed"),
        total("hit = bit").alias("n_only"),
        total("hit = 0").alias("n_kept"),
        total("hit & ~bit = 0").alias("n_kept_without"),
    )
