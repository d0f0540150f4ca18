"""Privacy, rules, classifier, extraction and the pipeline."""

import html
import random
import re
import zlib

import numpy as np
import pytest


import corpus_pipeline
from plumbline.llm import attention_quality, disclosure, html_blocks, rule_ledger
from plumbline.session import read_table
from tests.llm.conftest import EDGE, prose

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    def valid(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "phone":
            return 8 <= len(digits) <= 15
        if kind == "card":
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return True

    return [(k, m.start(), m.end()) for k, p in KINDS for m in re.finditer(p, text) if valid(k, m[0])]


SCRAPS = ["a@b.co", "x.y+z%@mail-1.example.com", "@", "a@b", "@@c.d", ".", "..", "%", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "12", "9" * 40, "+1 (212) 555-0100", "+1234567", "+(1) 2", "+12345678901234567", "é", "😀", " ", "\n", "word", "-", "a@b.c%d@e.f", "0" * 17]


def test_personal_data_against_plain_search(make):
    rng = random.Random(8)
    texts = ["".join(rng.choice(SCRAPS) + rng.choice(["", "", " "]) for _ in range(rng.randrange(16))) for _ in range(400)]
    texts += [*SCRAPS, "7" * 30_000, "a" * 30_000, "1." * 9_000, "1 " * 9_000]
    rows = {r["doc_id"]: r for r in disclosure.base_spans(make(enumerate(texts))).collect()}
    for k, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in rows[k]["spans"]] == plain_spans(t), t[:200]
        assert all(t[s["start"] : s["end"]] == s["value"] for s in rows[k]["spans"])


def private_texts():
    texts = [(k, f"{prose(k, 30)} ends. Ask Zorblax here 10.0.0.{k % 2} thanks for {prose(k + 50, 20)}") for k in range(0, 12)]
    texts += [(100 + k, f"{prose(k, 40)} ends. Ask thanks here for all") for k in range(60)]
    texts += [(200, "10.0.0.9 Onlyonce " + prose(1, 3))] + [(201 + k, "Quux me@once.org " + prose(2, 9)) for k in range(5)]
    return texts


def test_disclosing_terms_are_found(make):
    rows = {r["doc_id"]: r for r in disclosure.find_private(make(private_texts())).collect()}
    for k, text in private_texts()[:12]:
        assert [text[t["start"] : t["end"]] for t in rows[k]["terms"]] == ["Zorblax"]
        assert [s["kind"] for s in rows[k]["spans"]] == ["ip"]
    # a value seen once, copies of one context, and documents without personal data disclose nothing
    assert all(not rows[k]["terms"] for k in rows if k >= 100)


def test_sanitised_texts(make, edge, nothing):
    rows = {r["doc_id"]: r for r in disclosure.sanitise(make(private_texts()), remove=2.0, generalise=0.5).collect()}
    assert "Ask <TERM> here <IP> thanks" in rows[3]["text"] and rows[3]["n_chars"] == len(rows[3]["text"])
    assert dict(private_texts())[100] == rows[100]["text"]
    removed = {r["doc_id"]: r["text"] for r in disclosure.sanitise(make(private_texts()), remove=0.5, generalise=0.4).collect()}
    assert "Ask  here <IP> thanks" in removed[3] and removed[201].startswith("Quux <EMAIL> ")
    got = disclosure.sanitise(edge).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got if r["doc_id"] != 6) == sorted(str(x) for x in EDGE if x[0] != 6)
    assert next(r["text"] for r in got if r["doc_id"] == 6) == "<|endoftext|> <EMAIL> <PHONE>"  # one number, by its pattern
    assert got[0].asDict().keys() == edge.first().asDict().keys()
    assert disclosure.sanitise(nothing).collect() == disclosure.find_private(nothing).collect() == []


def test_terms_far_from_the_value_and_without_it(make):
    texts = [(k, f"Kwyjibo {prose(k, 60)} write to one@acme.org {prose(k + 50, 30)}") for k in range(8)]
    texts += [(100 + k, f"write to {prose(k + 200, 40)}") for k in range(80)] + [(300, "a kwyjibo, alone: Kwyjibo")]
    rows = {r["doc_id"]: r for r in disclosure.find_private(make(texts)).collect()}
    assert [(t["start"], t["end"]) for t in rows[3]["terms"]] == [(0, 7)]  # 400 characters before it
    assert [(t["start"], t["end"]) for t in rows[300]["terms"]] == [(2, 9), (18, 25)]
    got = {r["doc_id"]: r["text"] for r in disclosure.sanitise(make(texts), remove=2.0).collect()}
    assert got[300] == "a <TERM>, alone: <TERM>" and got[3].startswith("<TERM> ")


def test_copies_do_not_hide_a_term_and_entities_link_values(make):
    texts = [(k, f"{prose(k, 20)} ask Zorblax 10.0.0.1 {prose(k + 50, 20)}") for k in range(4)]
    texts += [(50 + k, texts[0][1]) for k in range(30)] + [(100 + k, f"{prose(k + 100, 30)}") for k in range(80)]
    texts += [(200 + k, f"{prose(k + 300, 20)} Kwyjibo p{k}@acme.org {prose(k + 400, 20)}") for k in range(4)]
    texts += [(210 + k, f"{prose(k + 500, 20)} Quuxor 10.7.7.{k} {prose(k + 600, 20)}") for k in range(4)]
    rows = {r["doc_id"]: r for r in disclosure.find_private(make(texts)).collect()}
    for k, text in texts:
        want = {"Zorblax", "Kwyjibo", "Quuxor"}.intersection(text.split())
        assert want <= {text[t["start"] : t["end"]] for t in rows[k]["terms"]}


def test_words_of_a_template_and_chance_disclose_nothing(make):
    draw = random.Random(12)
    words = [f"word{k}" for k in range(4_000)]
    texts = [(k, f"please write to info{k}@acme.org about the {' '.join(draw.sample(words, 6))} tickets") for k in range(300)]
    texts += [(1_000 + k, f"the museum sells tickets at the {' '.join(draw.sample(words, 6))}") for k in range(25)]
    texts += [(2_000 + k, "wrote from " + " ".join(draw.sample(words, 12))) for k in range(3_000)]
    # long texts share rare words by chance with a number that stands in several of them
    texts += [(6_000 + k, f"{' '.join(draw.sample(words, 300))} 10.9.8.7") for k in range(8)]
    texts += [(7_000 + k, f"Kwyjibo {' '.join(draw.sample(words, 8))} wrote from k{k % 2}@home.net") for k in range(10)]
    texts += [(8_000, "kwyjibo alone")]
    rows = disclosure.find_private(make(texts)).collect()
    text = dict(texts)
    found = {(r["doc_id"], text[r["doc_id"]][t["start"] : t["end"]]) for r in rows for t in r["terms"]}
    assert {w for _, w in found} == {"Kwyjibo", "kwyjibo"} and {d for d, _ in found} == {7_000 + k for k in range(10)} | {8_000}
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(make(texts)).collect()}
    assert all(clean[i] == t for i, t in texts if 1_000 <= i < 6_000)


def test_a_value_in_many_texts_is_still_someones(make):
    draw = random.Random(13)
    words = [f"word{k}" for k in range(4_000)]
    texts = [(k, f"Kwyjibo {' '.join(draw.sample(words, 12))} wrote from one@home.net {' '.join(draw.sample(words, 12))}") for k in range(60)]
    texts += [(100 + k, f"tickets {' '.join(draw.sample(words, 12))} wrote from p{k}@mail.org {' '.join(draw.sample(words, 12))}") for k in range(60)]
    texts += [(1_000 + k, "wrote from " + " ".join(draw.sample(words, 24))) for k in range(1_000)] + [(3_000, "kwyjibo, alone")]
    text = dict(texts)
    found = {(r["doc_id"], text[r["doc_id"]][t["start"] : t["end"]]) for r in disclosure.find_private(make(texts)).collect() for t in r["terms"]}
    assert found >= {(k, "Kwyjibo") for k in range(60)} | {(3_000, "kwyjibo")}
    assert not {w for _, w in found} & {"tickets"} and not any(100 <= d < 3_000 for d, _ in found)


def test_native_plan(make):
    found = disclosure.find_private(make(private_texts()))
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())


def plain_repeats(words):
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    return len({k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)})


def test_measures_against_plain_counts():
    rng = random.Random(9)
    texts = [t or "" for _, t in EDGE] + ["a b c d e f g h " * 3, "# x\n\n# x\n  \n# x\r\n y|z", "ÀÉ ß! STOP!!"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(80)]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = dict(zip(rule_ledger.MEASURES, rule_ledger.measure(text), strict=True))
        assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words))
        assert m["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert m["n_dup_lines"] == sum(x in lines[:k] for k, x in enumerate(lines)) and m["n_lines"] == len(lines)
        assert m["n_repeat_words"] == plain_repeats(words)
        assert m["n_letters"] == sum(map(str.isalpha, text)) and m["n_capitals"] == sum(map(str.isupper, text))


def test_policies_and_ablations(make, edge, nothing):
    texts = [(1, prose(1, 60)), (2, "few"), (3, "again and again " * 30), (4, " ".join("#" + w for w in prose(2, 60).split())), (5, "STOP! NOW! " * 4)]
    book = rule_ledger.ledger(make(texts)).cache()
    failed = {r["doc_id"]: {n for k, (n, _) in enumerate(rule_ledger.RULES) if r["failed"] >> k & 1} for r in book.collect()}
    assert failed[1] == set() and "few_words" in failed[2] and "repeated_passages" in failed[3] and failed[4] == {"symbols"}
    for row in rule_ledger.ablations(book, list(rule_ledger.POLICIES.values())).collect():
        rules = set(rule_ledger.POLICIES[row["version"]].rules)
        hits = [f & rules for f in failed.values()]
        want = (len(hits), sum(row["rule"] in h for h in hits), sum(h == {row["rule"]} for h in hits), sum(not h for h in hits), sum(not h - {row["rule"]} for h in hits))
        assert (row["n_docs"], row["n_failed"], row["n_only"], row["n_kept"], row["n_kept_without"]) == want
    rows = rule_ledger.ledger(edge).collect()
    assert len(rows) == len(EDGE) and all(r["failed"] & 1 for r in rows if r["doc_id"] in (3, 5, 7))
    assert rule_ledger.ledger(nothing).collect() == []


def test_gradient_of_the_model():
    rng = np.random.default_rng(1)
    bags = [rng.random((n, attention_quality.FEATURES)).astype(np.float32) for n in (1, 4, 9, 2)]
    labels = np.array([0.0, 1.0, 1.0, 0.0])

    def loss(model):
        y = model.score(bags)
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    start = attention_quality.train(bags, labels, epochs=0)
    step = attention_quality.train(bags, labels, epochs=1, rate=1e-4, decay=0.0)
    for name, weights in start.weights.items():  # the first step of Adam goes against the sign of the slope
        flat = np.atleast_1d(weights).ravel()
        for at in rng.integers(0, len(flat), 3):
            moved = []
            for change in (1e-5, -1e-5):
                other = flat.copy()
                other[at] += change
                moved.append(loss(attention_quality.GatedAttention(start.mean, start.scale, {**start.weights, name: other.reshape(weights.shape)})))
            slope = (moved[0] - moved[1]) / 2e-5
            if abs(slope) > 1e-6:
                assert np.sign(np.atleast_1d(step.weights[name]).ravel()[at] - flat[at]) == -np.sign(slope)
    assert loss(attention_quality.train(bags, labels, epochs=200)) < 0.1


def test_held_out_quality(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = attention_quality.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in attention_quality.score_documents(docs, model).collect()}
    unseen = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(scores[r["doc_id"]] >= 0.3) == (r["quality"] == 1) for r in unseen]
    assert len(unseen) > 50 and np.mean(right) > 0.95
    again = attention_quality.fit(docs.repartition(7), labels)
    assert all((again.weights[k] == w).all() for k, w in model.weights.items())


def test_classifier_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame([(9, 1, 0), (9, None, 0), (None, 1, 0), (4, 0, 0), (4, 0, 0), (1, 1, 1), (555, 1, 0)], "doc_id long, quality int, toxic int")
    model = attention_quality.fit(edge, labels)
    scores = attention_quality.score_documents(edge, model).collect()
    assert len(scores) == len(EDGE) and all(0 <= r["score"] <= 1 for r in scores)
    kept = attention_quality.keep_good(edge, model).collect()
    good = sorted(str(r["doc_id"]) for r in scores if r["score"] >= 0.3)
    assert sorted(str(r["doc_id"]) for r in kept) == good
    untaught = attention_quality.fit(edge, labels.limit(0))
    assert {round(r["score"], 6) for r in attention_quality.score_documents(edge, untaught).collect()} == {0.5}
    assert attention_quality.score_documents(nothing, model).collect() == attention_quality.keep_good(nothing, model).collect() == []


PARAGRAPHS = ["A first paragraph with enough words to count as text of an article, it seems.", "Short one.", "Tom &amp; Ann said 1 &lt; 2; " + "and so on " * 20]


def page(article, rest=""):
    return f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x}}</style><script>if (a<b) "</p>"</script></head><body>
    <header><p>Site header with a few words that say who we are and what we do.</p></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">All news</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this page, please agree to that before you go on reading.</p></div>{article}
    <aside class=sidebar><p>Other things to read that are long enough to look like a paragraph of text.</p></aside>{rest}
    <div id="comments"><p>I liked this article a lot, thank you for writing it down for all of us.</p></div>
    <form><p>Subscribe to this letter today</p><input name=q></form><footer>&copy; 2024 A company with a name</footer></body></html>"""


def test_main_text_of_pages(spark):
    body = "".join(f"<p>{p}\n  <i>x</i></p>" for p in PARAGRAPHS)
    want = "\n".join(html.unescape(p).strip() + " x" for p in PARAGRAPHS)
    pages = [
        (1, "u", page(f"<article><h1>A title</h1>{body}</article>")),
        (2, "u", page(f"<main><h1>A <b>title</b></h1>{body.replace('</p>', '')}</main>")),
        (3, "u", page(f'<article><div class="ad">Buy this now</div><h1>A title</h1>{body}<!-- <p>no</p> --><p hidden>hidden words</p></article>')),
        (4, None, None), (5, "u", ""), (6, "u", page("")), (7, "u", "<p" * 3), (8, "u", "<script>never closed <p>x"),
    ]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r["text"] for r in html_blocks.extract(frame).collect()}
    assert rows[1] == rows[2] == rows[3] == "A title\n" + want
    assert rows[4] == rows[5] == rows[6] == rows[8] == ""
    assert html_blocks.extract(frame.limit(0)).collect() == []


LONG = ["The museum opened its new wing on Monday, and many people came to see what had been built there over the last three years.", "Most of them stayed for hours; the guides said that they had never seen the rooms so full, not even on the first day of the year."]
TWO = "".join(f"<p>{p}</p>" for p in LONG)


@pytest.mark.parametrize(
    "made",
    [
        f"<html><head><title>t</title><meta charset=utf-8><body><article>{TWO}</article></body></html>",
        f"<head><title>t</title><link rel=x><article>{TWO}</article>",
        f'<body class="single has-sidebar"><article>{TWO}</article></body>',
        f'<html class="no-js login"><body id=search><main class="site-header">{TWO}</main></body></html>',
        f'<article class="post no-comments">{TWO}</article>',
        f'<div id="login-security-report">{TWO}</div>',
        f"<article><div><button>Share it</div>{TWO}</article>",
        f"<article><button>Share it {TWO}</article>",
        f"<article><svg><g><svg><text>inner</text></svg><text>outer words</text></g></svg>{TWO}</article>",
        f"<article><svg><title>t</title><style>x</style><path d=0 /></svg>{TWO}<noscript><p>Turn scripts on</p></noscript></article>",
        f'<div class="content-with-sidebar"><div class=entry>{TWO}</div></div><div class="widget-area"><p>{LONG[0]}</p></div>',
        f'{TWO}<div class="comment-list"><p>{LONG[1]}</p></div><div id="site-footer"><p>{LONG[1]}</p></div>',
        f'<article>{TWO}</article><article class="comment even"><p>{LONG[0]}</p></article>',
        f'<select><option>One<option>Two</select>{TWO}<ul class="nav-menu"><li><a href=x>{LONG[0]}</a></ul>',
        f"<template><article><p>{LONG[0]}</p></article></template><article>{TWO}</article>",
        f'<div class="row col-8"><section>{TWO}</section></div><aside>{TWO}</aside><div role="complementary">{TWO}</div>',
    ],
)
def test_pages_of_other_makes(made):
    assert html_blocks.main_blocks(made, html_blocks.grow_tree()) == LONG


def test_pages_against_their_markup(spark):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages").collect()
    tree = html_blocks.grow_tree()
    for r in pages:
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(x).split()) for x in re.split("<br>|</?p>|</?h1>", re.sub("</?b>", "", article))]
        assert html_blocks.main_blocks(r["html"], tree) == [p for p in parts if p]


def test_tree_learns_its_table():
    table = np.array(html_blocks.LABELLED, dtype=float)
    assert ((html_blocks.grow_tree().predict(table[:, :-1]) >= 0.5) == table[:, -1]).all()


def test_pipeline_keeps_columns_and_clean_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    quality = {r["doc_id"]: r["quality"] for r in read_table(spark, sf_dir, "labels").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns, name
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before and all(len(r["text"]) == r["n_chars"] for r in docs.collect())
        if name == "quality classifier":
            lost = [quality[i] for i in before - after if i in quality]
            assert np.mean(lost) < 0.2 and before - after
        if name == "simhash near-dedup":
            by_text = {}
            for i in sorted(before):
                by_text.setdefault(texts[i], i)
            assert after <= set(by_text.values()) and len(after) > 0.8 * len(by_text)
        before = after
    left = docs.collect()
    assert not any(plain_spans(r["text"]) for r in left)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == before


def test_pipeline_on_odd_documents(spark, edge, nothing, tmp_path):
    for k, docs in enumerate((edge, nothing)):
        folder = f"{tmp_path}/{k}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(9, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert (corpus_pipeline.run(spark, folder).count() > 0) == (k == 0)


