"""Near copies, passages and edit fingerprints against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from plumbline.llm import edit_embedding, passages, simhash
from plumbline.llm.common import components
from tests.llm.conftest import EDGE, prose


def groups(pairs):
    """Groups of ids by transitive links, as a set of frozen sets."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for x in parent:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def plain_fingerprint(text):
    words = simhash_words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_words(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def test_fingerprint_is_plain_simhash():
    texts = ["", " \n ", "One", "one two three", "A b C d", prose(3, 90), "É Ünï 日本\x85語 x\x0by z z z z", *(t or "" for _, t in EDGE[:9])]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize(("depth", "limit"), [(3, 3_000_000), (6, 3_000_000), (4, 5_000)])
def test_ball_meets_every_pair(depth, limit):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    prints = [base]
    for _ in range(5):  # dense balls around a few of them
        near = base[rng.integers(0, 12, 60)].copy()
        for _ in range(5):
            near ^= np.where(rng.random(60) < 0.6, np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64), np.uint64(0))
        prints.append(near)
    prints = np.unique(np.concatenate(prints))
    far = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = groups((int(prints[a]), int(prints[b])) for a, b in zip(*np.where(far <= 4), strict=True))
    found = [(int(p), int(p)) for p in prints]
    for cell in range(1 << depth):
        near = prints[np.bitwise_count((prints >> np.uint64(64 - depth)) ^ np.uint64(cell)) <= 2]
        found += list(zip(near.tolist(), simhash.forest(near, cell, depth, 2, limit).tolist(), strict=True))
    assert groups(found) == want


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1_000, 1_000 + k) for k in range(1, 300)] + [(5_000, 5_000)]
    edges += [(rng.randrange(2_000, 2_200), rng.randrange(2_000, 2_200)) for _ in range(120)]
    frame = spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")
    got = {}
    for r in components(frame).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert all(min(g) == c for c, g in got.items())
    assert {frozenset(g) for g in got.values()} == {g for g in groups(edges) if len(g) > 1}


def copies():
    """Texts with exact copies, near copies, chains of those, and others."""
    texts = [(k, prose(k, 120)) for k in range(0, 40)]
    texts += [(100 + k, prose(k % 3, 120)) for k in range(60)]  # a third are copies
    for k in range(30):
        words = prose(5 + k % 2, 400).split()
        words[k] = "changed"
        texts.append((200 + k, " ".join(words)))
    return texts + [(300, ""), (301, None), (302, "one two"), (303, "One\ttwo")]


def test_near_copies_against_all_pairs(make):
    texts = copies()
    rows = simhash.near_copies(make(texts)).collect()
    prints = {i: plain_fingerprint(t or "") for i, t in texts}
    links = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4]
    name = {i: min(g) for g in groups(links) for i in g}
    assert {r["doc_id"]: (r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in rows} == {i: (prints[i], name[i]) for i in prints}


def test_one_of_each_group_stays(make, edge, nothing):
    texts = copies()
    prints = {i: plain_fingerprint(t or "") for i, t in texts}
    links = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4]
    kept = simhash.keep_one(make(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups(links))
    rows = simhash.keep_one(edge).collect()
    # 2, 9 and 9 are copies; 3 and 7 and the null without an id are without words
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 2, 3, 4, 6, 8]
    assert rows[0].asDict().keys() == {"start", "doc_id", "ids", "text", "key", "fingerprint", "spans", "n_chars", "band"}
    assert simhash.near_copies(nothing).collect() == simhash.keep_one(nothing).collect() == []


def test_unlike_texts_of_one_id_all_stay(make):
    texts = [(1, prose(1, 90)), (1, prose(2, 90)), (1, prose(1, 90)), (2, prose(2, 90)), (None, prose(3, 90)), (None, prose(4, 90)), (None, prose(1, 90))]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(make(texts)).collect()), key=repr)
    assert kept == sorted([texts[0], texts[1], texts[4], texts[5]], key=repr)


@pytest.mark.parametrize("crowd", [3, 40])
def test_crowded_cells_are_dealt_out(spark, crowd):
    rng = np.random.default_rng(crowd)
    prints = rng.integers(0, 1 << 62, 60)
    near = [int(p) ^ sum(1 << int(b) for b in rng.integers(0, 64, 2)) for p in np.repeat(prints[:4], 40)]
    values = sorted({int(np.int64(np.uint64(v & (1 << 64) - 1))) if v < 1 << 63 else v - (1 << 64) for v in [*prints.tolist(), *near]})
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), 4, 6, crowd).collect()
    every = [(a, b) for a in values for b in values if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert groups([(r["a"], r["b"]) for r in found] + [(v, v) for v in values]) == groups(every)


def test_odd_radius_is_refused(edge):
    with pytest.raises(ValueError):
        simhash.near_copies(edge, radius=3)


def test_windows_group_all_passages():
    rng = np.random.default_rng(3)
    for n, length in ((200, 7), (50, 50), (30, 40)):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        owner = np.repeat([0, 1], [n // 3, n - n // 3])
        centre, value, first, last = passages.compact_windows(hashes, owner, length)
        found = {}
        for c, v, a, b in zip(centre, value, first, last, strict=True):
            assert v == hashes[c]
            found.update({s: c for s in range(a, b + 1)})
        want = {s: s + int(np.argmin(hashes[s : s + length])) for s in range(n - length + 1) if owner[s] == owner[s + length - 1]}
        assert found == want


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def planted():
    """Unlike documents, some of which share passages of more than 50 words."""
    shared = {k: prose(900 + k, 60).split() for k in range(3)}
    texts = []
    for k in range(90):
        words = prose(k, 150).split()
        if k % 3 == 0:  # a third share the first
            words[40:40] = shared[0]
        elif k % 10 == 1:
            words[5:5] = shared[1]
        elif k % 10 == 2:
            words += shared[2][: 54 if k < 50 else 60]
        texts.append((k, " ".join(words)))
    near = prose(950, 200).split()
    texts.append((95, " ".join(prose(95, 80).split() + near)))
    near[90] = "other"
    texts.append((96, " ".join(prose(96, 70).split() + near)))
    texts.append((97, texts[1][1].upper()))
    return texts + [(98, "again and " * 200), (99, None)]


def test_planted_passages_are_found(make):
    texts = dict(planted())
    rows = passages.repeated_passages(make(texts.items())).collect()
    words = {k: (t or "").lower().split() for k, t in texts.items()}
    seen, want = {}, set()
    for k in sorted(words):
        for s in range(len(words[k]) - 49):
            seen.setdefault(tuple(words[k][s : s + 50]), k)
            if seen[tuple(words[k][s : s + 50])] != k:
                want |= {(k, s + j) for j in range(50)}
    got = {(r["doc"], j) for r in rows for j in range(r["start"], r["end"])}
    assert want <= got
    assert {d for d, _ in got} == {d for d, _ in want} | {96}
    for r in rows:
        a, b = shingles(words[r["doc"]][r["start"] : r["end"]]), shingles(words[r["head"]][r["head_start"] : r["head_end"]])
        assert r["head"] < r["doc"] and r["end"] - r["start"] >= 50
        assert r["similarity"] == pytest.approx(len(a & b) / len(a | b)) and r["similarity"] >= 0.8
    both = {r["doc_id"] for r in passages.passage_rows(make(texts.items()).limit(0).transform(lambda d: passages.repeated_passages(d))).collect()}
    assert both == set()


def test_repeats_are_cut_and_the_rest_stays(make, edge, nothing):
    texts = dict(planted())
    rows = {r["doc_id"]: r for r in passages.remove_repeats(make(texts.items())).collect()}
    assert rows[0]["text"] == texts[0] and rows[99]["text"] is None
    assert rows[3]["text"].split() == texts[3].split()[:40] + texts[3].split()[100:]
    assert rows[97]["text"] == "" and rows[97]["n_chars"] == 0
    assert rows[4]["text"] == texts[4] and rows[4]["n_chars"] == len(texts[4])
    got = passages.remove_repeats(edge).collect()
    assert len(got) == len(EDGE) and got[0].asDict().keys() == edge.first().asDict().keys()
    # 9 repeats 2 in both its rows; the long text and the repeated word stay
    assert sorted(r["doc_id"] for r in got if r["text"] == "" and r["doc_id"] != 3) == [9, 9]
    assert passages.remove_repeats(nothing).collect() == passages.passage_rows(passages.repeated_passages(nothing)).collect() == []


def near_pairs():
    """Pairs of documents that share a passage but for some words, by its length and the number of changes."""
    draw, texts, cells = random.Random(11), {}, {}

    def words(n):
        return [f"v{draw.randrange(30_000)}" for _ in range(n)]

    for n, changes in ((55, 0), (60, 1), (80, 1), (100, 2), (150, 3), (300, 6)):
        for _ in range(30):
            passage = words(n)
            other = list(passage)
            for at in draw.sample(range(n), changes):
                other[at] = f"u{draw.randrange(30_000)}"
            k = len(texts)
            texts[k] = " ".join(words(draw.randrange(40)) + passage + words(draw.randrange(40)))
            start = draw.randrange(40)
            texts[k + 1] = " ".join(words(start) + other + words(draw.randrange(40)))
            a, b = shingles(passage), shingles(other)
            if len(a & b) >= 0.8 * len(a | b):
                cells.setdefault((n, changes), []).append((k, k + 1, start, n))
    return texts, cells


def test_near_passages_are_found(make):
    texts, cells = near_pairs()
    found = {}
    for r in passages.repeated_passages(make(texts.items())).collect():
        found.setdefault((r["head"], r["doc"]), set()).update(range(r["start"], r["end"]))
    for cell, pairs in cells.items():
        caught = [len(found.get((a, b), set()) & set(range(s, s + n))) >= 0.8 * n for a, b, s, n in pairs]
        assert sum(caught) >= 0.9 * len(pairs), (cell, sum(caught), len(pairs))
    assert {p for p in found} <= {(a, b) for pairs in cells.values() for a, b, _, _ in pairs} | {(k, k + 1) for k in texts}


def test_longest_stretch_by_hand():
    rng = np.random.default_rng(4)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 40)) < rng.random()
        lo, hi = passages.longest_stretch(equal, 0.8)
        sizes = [b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a:b].mean() >= 0.8 and equal[a] and equal[b - 1]]
        assert hi - lo >= max((s for s in sizes), default=0) - 1 and (hi == lo or equal[lo:hi].mean() >= 0.8)


def test_rows_of_one_id_are_cut_by_their_own_text(make):
    shared, other = prose(700, 60), prose(701, 80)
    texts = [(1, prose(5, 40) + " " + shared), (2, shared + " " + prose(6, 40)), (2, other), (None, other + " end"), (None, prose(9, 30))]
    got = sorted(((r["doc_id"], r["text"]) for r in passages.remove_repeats(make(texts)).collect()), key=repr)
    assert got == sorted([texts[0], (2, prose(6, 40)), (2, ""), texts[3], texts[4]], key=repr)
    pairs = {(r["doc"], r["head"]) for r in passages.repeated_passages(make(texts)).collect()}
    assert pairs == {(2, 1), (2, passages.LEAST_LONG)}


def test_cut_words_keeps_what_is_around():
    text = " a b\nc  d e\n"
    assert passages.cut_words(text, []) == text
    assert passages.cut_words(text, [(1, 3)]) == " a d e"
    assert passages.cut_words(text, [(0, 2), (1, 9)]) == ""


def edited(texts):
    """Texts in id order with the last half taken from the next one."""
    return [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_next_document_by_id(make, buckets):
    texts = [(k, prose(k, 5 + 37 * (k % 9))) for k in random.Random(1).sample(range(1_000), 60)] + [(-5, None), (2_000, "x")]
    rows = {r["doc_id"]: r for r in edit_embedding.compare_with_next(make(texts), buckets=buckets).collect()}
    order = sorted((i, t or "") for i, t in texts)
    want = edited([t for _, t in order])
    assert [rows[i]["edited"] for i, _ in order] == want
    prints = {r["doc_id"]: r["fingerprint"] for r in edit_embedding.fingerprints(make(texts)).collect()}
    again = {r["doc_id"]: r["fingerprint"] for r in edit_embedding.fingerprints(make([(i, w) for (i, _), w in zip(order, want, strict=True)])).collect()}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][0]
        assert (rows[i]["n_chars"], rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (len(t), prints[i], again[i])
        assert rows[i]["near_next"] == edit_embedding.likeness(prints[i], prints[after])
        assert rows[i]["near_edited"] == edit_embedding.likeness(prints[i], again[i])


def test_edit_fingerprint_edge_cases(edge, nothing):
    rows = edit_embedding.compare_with_next(edge).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in EDGE))
    want = edited([t for _, _, t in order])
    assert sorted(r["edited"] for r in rows) == sorted(want)
    prints = {}
    for r in edit_embedding.fingerprints(edge).collect():
        prints.setdefault(r["doc_id"], set()).add(bytes(r["fingerprint"]))
    assert prints[9] == prints[2] and prints[3] < prints[None]
    assert edit_embedding.compare_with_next(nothing).collect() == []
    lone = edit_embedding.compare_with_next(edge.where("doc_id = 8")).collect()
    assert lone[0]["near_next"] == 1.0 and len(lone) == 1


def test_walk_against_the_step_by_step_embedding():
    seed, text = edit_embedding.SEED, edit_embedding.symbols("a walk of many steps " * 20)
    reached = edit_embedding.walk([text], [0], seed)[0]
    waits = edit_embedding.walk_table(seed)
    step, written = 0, []
    for c in text:  # one character at a time, as long as its coins say to stay
        stay = int(waits[int(c) * edit_embedding.PERIOD + step % edit_embedding.PERIOD])
        written += [c] * stay
        step += stay
    assert reached[-1] == len(written)
    level = edit_embedding.sample(text, reached, seed)
    at = edit_embedding.sampled_steps(level[0], seed)[: len(written) >> level[0]]
    assert level[1:] == bytes(np.array(written, np.uint8)[at])


def test_likeness_falls_with_edits():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4_000))

    def print_of(t):
        codes = edit_embedding.symbols(t)
        return edit_embedding.sample(codes, edit_embedding.walk([codes], [0], edit_embedding.SEED)[0], edit_embedding.SEED)

    def changed(n):
        out = list(text)
        for _ in range(n):
            at = rng.randrange(len(out))
            out[at : at + rng.randrange(2)] = rng.choice(["x", ""])
        return "".join(out)

    near = [edit_embedding.likeness(print_of(text), print_of(changed(n))) for n in (0, 12, 3_000)]
    assert near[0] == 1.0 > near[1] > 0.7 > 0.4 > near[2]
    half = edit_embedding.likeness(print_of(text), print_of(text[:2_000] + changed(4_000)[:2_000]))
    assert 0.4 < half < 0.75


def test_near_copies_by_edit_fingerprints(make):
    texts = [(k, prose(k, 150)) for k in range(20)] + [(100 + k, prose(k % 2, 150)) for k in range(20)]
    texts += [(200, prose(3, 150)[:-1] + "?"), (201, prose(4, 150)[:-3]), (300, None), (301, "")]
    got = {}
    for r in edit_embedding.near_copies(make(texts)).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
    want = groups([(k, k) for k, _ in texts] + [(k % 2, 100 + k) for k in range(20)] + [(3, 200), (4, 201), (300, 301)])
    assert {frozenset(g) for g in got.values()} == want and all(min(g) == c for c, g in got.items())


def test_near_copies_against_all_pairs(make):
    """Texts of 20 to 2,000 characters around the bound: all links are kept, and none is made up."""
    draw = random.Random(11)
    texts = []
    for g in range(14):
        base = prose(1_000 + g, draw.choice([4, 8, 20, 60, 120, 250]))
        for _ in range(10):
            t = list(base)
            for _ in range(int(len(t) * draw.choice([0, 0.005, 0.01, 0.02, 0.04]))):
                at, change = draw.randrange(len(t)), draw.randrange(3)
                t[at : at + (change != 1)] = [] if change == 2 else [draw.choice("xyz")]
            texts.append((len(texts), "".join(t)))
    docs = make(texts)
    prints = {r["doc_id"]: r["fingerprint"] for r in edit_embedding.fingerprints(docs).collect()}
    links = [(a, b) for a in prints for b in prints if a <= b and edit_embedding.likeness(prints[a], prints[b]) >= 0.8]
    got = {}
    for r in edit_embedding.near_copies(docs).collect():
        got.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == groups(links) and all(min(g) == c for c, g in got.items())
    assert len(links) > 400 and len(got) > 20
    assert edit_embedding.near_copies(docs.limit(0)).collect() == []


def test_near_copies_of_a_text_and_a_longer_one_meet_on_one_level():
    least = 0.8
    for n in range(1, 2 * edit_embedding.SAMPLES):
        for m in range(n, 2 * edit_embedding.SAMPLES):
            if n >= least * m:
                a, b = (set(edit_embedding._spans(bytes([0]) + bytes(x), least)) for x in (n, m))
                assert a & b, (n, m)
    for n in range(2 * edit_embedding.SAMPLES - 60, 2 * edit_embedding.SAMPLES):
        for m in range(edit_embedding.SAMPLES, edit_embedding.SAMPLES + 60):
            if n // 2 >= least * m:
                a, b = set(edit_embedding._spans(bytes([4]) + bytes(n), least)), set(edit_embedding._spans(bytes([5]) + bytes(m), least))
                assert a & b, (n, m)


def near_prints():
    """Fingerprints at the bound by chance, some a level apart, and many that are alike in their first half alone."""
    rng = np.random.default_rng(21)
    prints = []

    def add(level, samples):
        prints.append(bytes([level]) + samples.astype(np.uint8).tobytes())

    for k in range(1_500):
        n = int(rng.integers(4, 256))
        text = rng.integers(0, 40, n)
        other = text.copy()
        other[rng.permutation(n)[: n // 5]] += 40  # as many as a pair may differ in
        level = 0 if n < 128 else int(rng.integers(0, 5))
        add(level, text)
        add(level, other[: n if k % 3 else max(1, n - n // 40)])
    for _ in range(200):
        lower = rng.integers(0, 40, int(rng.integers(220, 256)))
        add(2, lower)
        half = edit_embedding.at_level(prints[-1], 3, edit_embedding.SEED).copy()
        half[rng.permutation(len(half))[: len(half) // 20]] += 40
        add(3, np.concatenate([half, rng.integers(0, 40, 128 - len(half) if len(half) < 128 else 0)]))
    heading = rng.integers(0, 40, 70)
    tails = rng.integers(0, 40, (700, 70))
    tails[600:] = tails[:100]
    tails[600:, rng.permutation(70)[:25]] += 40
    for tail in tails:
        add(1, np.concatenate([heading, tail]))
    return sorted(set(prints))


def test_all_links_between_edit_fingerprints_are_kept(spark):
    prints = near_prints()
    links = [(k, k) for k in range(len(prints))]
    for level in {p[0] for p in prints}:
        mine = [k for k, p in enumerate(prints) if p[0] in (level - 1, level)]
        views = [edit_embedding.at_level(prints[k], level, edit_embedding.SEED) for k in mine]
        size, ours = np.array([len(v) for v in views]), np.full((len(mine), 256), -1)
        for row, v in zip(ours, views, strict=True):
            row[: len(v)] = v
        theirs, own = np.where(ours < 0, -2, ours), np.array([prints[k][0] == level for k in mine])
        for x, k in enumerate(mine):
            if own[x]:
                alike = (theirs == ours[x]).sum(axis=1) / np.maximum(size, size[x]) >= 0.8
                links += [(k, mine[y]) for y in np.flatnonzero(alike) if mine[y] != k]
    assert all(edit_embedding.likeness(prints[a], prints[b]) >= 0.8 for a, b in links)
    assert len(links) > len(prints) + 2_000
    docs = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(prints)], "doc_id long, fingerprint binary")
    got = {}
    for r in edit_embedding.linked_prints(docs).collect():
        got.setdefault(r["component_id"], set()).add(prints.index(bytes(r["fingerprint"])))
    assert {frozenset(g) for g in got.values()} == groups(links) and all(min(g) == c for c, g in got.items())


def test_fingerprints_alike_share_a_key_however_they_differ():
    rng = np.random.default_rng(22)
    for m in range(4, 256):
        for n in {m, -(-4 * m // 5), (m + -(-4 * m // 5)) // 2}:
            equal, longer = -(-4 * m // 5), rng.integers(0, 200, m)
            shorter = longer[:n].copy()
            for wrong in (rng.permutation(n)[: n - equal], np.arange(0, n, max(1, n // max(1, n - equal)))[: n - equal], np.arange(n - equal)):
                other = shorter.copy()
                other[wrong] += 40
                shared = [set(), set()]
                for side, samples in zip(shared, (other, longer), strict=True):
                    for level, width in edit_embedding._spans(bytes([0]) + samples.astype(np.uint8).tobytes(), 0.8):
                        if not level:
                            side.update(edit_embedding._place_keys([samples.astype(np.uint8)], level, width)[1].tolist())
                assert shared[0] & shared[1], (n, m)


def test_decoys_hide_no_passage(make):
    """Pairs that share a passage come after texts that hold parts of it, which are the first to have its windows."""
    draw, texts, pairs = random.Random(31), [], []

    def words(n):
        return [f"v{draw.randrange(30_000)}" for _ in range(n)]

    for k in range(40):
        passage, changed = words(60), k % 2
        for lo in (0, 30, 0, 30):
            texts.append(words(30) + passage[lo : lo + 30] + words(30))
        for _ in range(2):
            start = draw.randrange(40)
            pairs.append((len(texts), start))
            texts.append(words(start) + passage + words(20))
        if changed:
            texts[-1][pairs[-1][1] + 20] = "changed"
    found = {}
    for r in passages.repeated_passages(make([(i, " ".join(t)) for i, t in enumerate(texts)])).collect():
        found.setdefault((r["head"], r["doc"]), set()).update(range(r["start"], r["end"]))
    caught = [set(range(s, s + 60)) <= found.get((a, b), set()) for (a, _), (b, s) in zip(pairs[::2], pairs[1::2], strict=True)]
    assert all(caught[::2]) and sum(caught[1::2]) >= 18
    assert set(found) <= {(a, b) for (a, _), (b, _) in zip(pairs[::2], pairs[1::2], strict=True)}


def test_equal_runs_by_hand():
    x = np.arange(200)
    y = np.concatenate([x[:80], [900], x[81:]])
    assert passages.equal_runs(x, y, 46) == [(0, 80), (81, 200)]
    assert passages.equal_runs(x, np.concatenate([x[:80], [900, 901], x[81:]]), 46) == [(0, 80), (81, 200)]
    again = x.copy()
    again[60] = again[50]  # a shingle that comes again within a passage ends a run
    assert passages.equal_runs(again, again, 46) == [(0, 60), (61, 200)]


def test_word_hashes_tell_words_as_split_does(monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 97)
    rng = random.Random(6)
    texts = [b"", b" ", b"A b\tc\x0bd  e\x1cf G", b"a B c D e\x1cF g", b"y" * 40 + b" Z y z w", "\u00a0q \u00c9 r t y".encode()]
    texts += [" ".join("".join(rng.choice("abXY\u00e9") for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(0, 60))).encode() for _ in range(200)]
    seen = {}
    for text, hashes in zip(texts, passages.shingles_of(texts, 5), strict=True):
        words = text.lower().split()
        assert len(hashes) == max(0, len(words) - 4)
        assert all(seen.setdefault(tuple(words[k : k + 5]), h) == h for k, h in enumerate(hashes.tolist()))
    assert len(set(seen.values())) == len(seen) > 2_000
    assert passages.shingles_of([], 5) == []


def test_equal_texts_of_tiles_are_compared_once(monkeypatch):
    x = np.arange(1, 47, dtype="<u4")
    apart = np.stack([x, x + 1_000], axis=1).ravel()[:91]  # has all of its shingles, and none within a passage
    rows = []
    for tile in range(2):
        rows += [(tile, False, doc, 46, 0, 1, 0, apart.tobytes(), None) for doc in range(20)]
        rows += [(tile, False, 20, 23, 0, 1, 0, np.concatenate([x[:22], [900 + tile], x[23:]]).astype("<u4").tobytes(), None)]
        rows += [(tile, True, 30, 23, 0, 0, 0, x.tobytes(), b"\1" * 46)]
    names = ["tile", "asks", "doc", "at", "first", "low", "high", "shingles", "beyond"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    compared, matching = [], passages.matching
    monkeypatch.setattr(passages, "matching", lambda x, y, *rest: compared.append((x.tobytes(), y.tobytes())) or matching(x, y, *rest))
    ours, heads = passages._partners(table, [0, 22, 44], 46, 0.8)
    assert (ours, heads) == ([21, 43], [20, 42])
    assert len(compared) == len(set(compared)) <= 3


def test_keys_travel_as_two_numbers(make, monkeypatch):
    plans, cut = {}, edit_embedding.cut_lineage
    monkeypatch.setattr(edit_embedding, "cut_lineage", lambda df, label: plans.setdefault(label, df) is None or cut(df, label))
    prints = edit_embedding.fingerprints(make([(k, prose(k % 7, 60 + 40 * (k % 5))) for k in range(30)])).cache()
    edit_embedding.linked_prints(prints)
    plan = plans["edit-members"]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(key.*\n\W*MapInArrow", plan)  # nothing is added to the rows before
    nodes = prints.select("fingerprint", "doc_id").withColumnRenamed("doc_id", "node").select("node", "fingerprint")
    found = {(r["key"] & 31, r["member"] >> 8, r["member"] & 255) for r in edit_embedding._keys(nodes, 0.8, edit_embedding.SEED).collect()}
    expected = {
        (level, r["node"], len(edit_embedding.at_level(bytes(r["fingerprint"]), level, edit_embedding.SEED)))
        for r in nodes.collect() for level, _ in edit_embedding._spans(bytes(r["fingerprint"]), 0.8)
    }
    assert found == expected


def test_links_of_a_task_join_each_component_once():
    joined = edit_embedding.Joined()
    assert [joined.join(a, b) for a, b in [(5, 3), (3, 5), (4, 3), (5, 4), (9, 8), (8, 4), (9, 3)]] == [True, False, True, False, True, True, False]
