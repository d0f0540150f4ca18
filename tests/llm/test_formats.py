"""Chat formatting and fill-in-middle: round trips on hostile and empty input, brute force beside."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm.chat import escape, format_conversations, loss_text, parse, unescape
from plumbline.llm.fill_middle import fill_in_middle, restore

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[AS]"]
CHAT = "conv_id long, turn long, role string, text string, formatted string, segments string, source int"


def chat(spark, rows):
    return spark.createDataFrame([(*r, "f", "s", 1) for r in rows], CHAT).repartition(3)


def read(rows):
    out = parse(format_conversations(rows)).withColumn("loss", loss_text())
    return {r.conv_id: r for r in out.collect()}


def test_hostile_conversations_round_trip(spark):
    draw = random.Random(3)
    parts = [*CONTROLS, "\\", " ", "\n", "ok", "é😀", "$1", "<", "[", "]", "x"]
    rows = [
        (c, t, draw.choice(["user", "assistant", "system", "tool", "a [AS] b", "[ROLE]", "", " ", "user "]), "".join(draw.choices(parts, k=draw.randint(0, 9))))
        for c in range(60)
        for t in range(draw.randint(1, 5))
    ]
    got = read(chat(spark, rows))
    assert len(got) == 60
    for c, row in got.items():
        source = sorted((t, r, x) for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in source]
        assert row.loss == "".join(x for _, r, x in source if r == "assistant")
        assert row.formatted == "".join(s.text for s in row.segments)
        for s in row.segments:
            if s.loss:
                assert not re.search(r"(?<!\\)(?:</?s>|\[/?(?:SYS|INST|ROLE)\]|\[AS\])", s.text)


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "a < b [1] \\ c"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "user", "\\<s>")]
    got = read(chat(spark, rows))
    assert got[1].formatted == "[INST] a < b [1] \\ c [/INST]\n<s> \\</s>\\[INST] ok \\[/INST] </s>"
    assert got[2].formatted == "[INST] \\\\<s> [/INST]"


def test_nulls_ties_and_empty_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", None), (4, 2, "user", "b"), (4, 2, "user", "b"), (4, 2, "assistant", ""), (4, None, "user", "first")]
    got = read(chat(spark, rows))
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("user", "")]
    assert [(t.role, t.text) for t in got[4].turns] == [("user", "first"), ("assistant", ""), ("user", "b"), ("user", "b")]
    assert got[4].loss == ""
    assert format_conversations(chat(spark, [])).collect() == []


def test_parser_takes_nothing_else(spark):
    texts = ["", None, "[INST] a [/INST]", "x[INST] a [/INST]", "[INST] a", "[INST] a [/INST][INST] b [/INST]", "<s> a [INST] b </s>"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, formatted string")
    got = {r.k: r.turns for r in parse(rows).collect()}
    assert got[0] == [] and got[1] is None and [tuple(t) for t in got[2]] == [("user", "a")]
    assert [got[k] for k in (3, 4, 5, 6)] == [None] * 4


def test_escape_is_undone(spark):
    texts = ["".join(random.Random(k).choices([*CONTROLS, "\\", "$", "a"], k=8)) for k in range(100)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(escape(F.col("t"))).alias("u"))
    assert all(r.t == r.u for r in rows.collect())


def test_chat_is_native(spark):
    plan = parse(format_conversations(chat(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def same_by_hand(rows, texts):
    got = restore(rows).collect()
    out = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in got), key=repr)
    assert out == sorted(((i, by_hand(i, t), t or "") for i, t in texts), key=repr)


def test_pieces_by_hand(make):
    draw = random.Random(5)
    parts = [" ", "a", "é", "日", "\n", "<", "P", "S", ">", "M", "😀", "\t", "bc", "\x85", "<S>", "word "]
    texts = [(k, "".join(draw.choices(parts, k=draw.choice([0, 1, 2, 5, 40])))) for k in range(600)]
    same_by_hand(fill_in_middle(make(texts)), texts)


def test_marks_that_only_neighbours_make_are_none(make):
    texts = [(k, t) for k, t in enumerate(["a <", "P> b", "<S", "> c", "<", "M", ">", " "] * 20)]
    same_by_hand(fill_in_middle(make(texts)), texts)


def test_edges(edge, nothing):
    from tests.llm.conftest import EDGE

    same_by_hand(fill_in_middle(edge), EDGE)
    assert restore(fill_in_middle(nothing)).collect() == []


@pytest.mark.parametrize(("rate", "forms"), [(0, {"plain"}), (100, {"plain", "spm", "psm"})])
def test_rates(make, rate, forms):
    rows = fill_in_middle(make([(k, "some words in a row") for k in range(100)] + [(200, "")]), rate=rate).collect()
    assert {r.form for r in rows} == forms
    assert all((r.form == "plain") == (rate == 0 or r.doc_id == 200) for r in rows)
