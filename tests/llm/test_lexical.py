"""Ranked lexical search against a plain recount, over ties, shards, blocks and empty input."""

import math
import random
import re

import numpy as np
import pytest

from plumbline.llm.lexical import RangeMaximum, build_index, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "rank int, item_id long, text string, score double"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(documents, items, k):
    docs = [(i, terms(t)) for i, t in documents if terms(t)]
    total = sum(len(ts) for _, ts in docs)
    df = {}
    for _, ts in docs:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        scored = []
        for i, ts in docs:
            m = 75 + 25 * len(ts) * len(docs) // total
            score = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 12 * m)) for t in terms(text) if t in ts)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item_id, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def asked(spark, items):
    return spark.createDataFrame([(1, i, t, 0.5) for i, t in items], ITEMS)


def found(rows):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("postings", [40, 2_000_000])
def test_ranks_by_hand(spark, make, postings):
    draw = random.Random(7)
    words = [*"abcdefghij", "Ünï", "日本", "x1", "The", "the"] + [f"w{k}" for k in range(200)]
    weight = [20] * 15 + [1] * 200
    documents = [(k % 390, draw.choice([" ", "-", "\n", "."]).join(draw.choices(words, weight, k=draw.choice([0, 1, 3, 30, 30, 200])))) for k in range(400)]
    documents += [(None, "the w1 w2"), (None, "the w1 w2"), (500, None), (501, "..."), *[(600 + k, "w5 w6 same") for k in range(30)]]
    items = [(k, " ".join(draw.choices(words, weight, k=draw.choice([1, 2, 8, 40])))) for k in range(25)]
    items += [(3, "w1 w1 w2"), (90, "same"), (91, "nowhere"), (92, None), (93, ""), (None, "w7 the")]
    got = found(search(build_index(make(documents), postings), asked(spark, items), k=5, block_rows=11))
    assert got == by_hand(documents, items, 5)


def test_more_asked_than_there_are(spark, make):
    documents = [(2, "one two"), (1, "one two"), (3, "three"), (1, "two")]
    items = [(1, "one"), (2, "two three")]
    assert found(search(build_index(make(documents)), asked(spark, items))) == by_hand(documents, items, 20)


def test_edges(spark, edge, nothing):
    from tests.llm.conftest import EDGE

    items = [(1, "alpha beta tie 日本語 example"), (2, "TIE")]
    assert found(search(build_index(edge), asked(spark, items))) == by_hand(EDGE, items, 20)
    assert search(build_index(nothing), asked(spark, items)).collect() == []
    assert search(build_index(edge), asked(spark, [])).collect() == []


def test_range_maxima_of_all_ranges():
    values = np.random.default_rng(1).integers(0, 9, 37)
    maxima = RangeMaximum(values, 37)
    start, end = (np.array(x) for x in zip(*[(a, b) for a in range(37) for b in range(a + 1, 38)], strict=True))
    assert maxima.places(start, end).tolist() == [a + int(np.argmax(values[a:b])) for a, b in zip(start, end, strict=True)]
