"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import constant_frame, cut_lineage, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query
def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.wavelet import read_documents, write_shards

    documents = read_documents(write_shards(read_table(spark, sf_dir, "documents")))
    return documents.select(
        "doc_id", "start", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op2_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.simhash import hex_digits, near_copies

    rows = near_copies(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.prefix_bpe import decode_documents, encode_documents

    rows = decode_documents(encode_documents(read_table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_disclosure_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.disclosure import KINDS, find_private, span_list

    found = find_private(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    every = found.withColumn("every", F.concat("spans", "terms"))
    return every.select("doc_id", *counts, F.sha2(span_list("spans"), 256).alias("base_sha256"), span_list("every").alias("spans"))


@query
def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.rule_ledger import POLICIES, ledger

    book = ledger(read_table(spark, sf_dir, "documents"))
    passes = POLICIES["base-1"].passes(F.col("failed"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes).alias("base_failed"), (passes & POLICIES["full-1"].passes(F.col("failed"))).alias("kept"), "failed",
    )


@query
def op10_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.packing import pack_documents

    pieces = pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.attention_quality import fit, held_out, score_documents

    documents = read_table(spark, sf_dir, "documents")
    scores = score_documents(documents, fit(documents, read_table(spark, sf_dir, "labels")))
    return scores.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op8_block_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.html_blocks import extract

    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op9_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.edit_embedding import compare_with_next, linked_prints

    compared = compare_with_next(read_table(spark, sf_dir, "documents")).withColumn("edited", F.sha2("edited", 256))
    rows = cut_lineage(compared, "edit-rows")
    return rows.join(linked_prints(rows), "fingerprint").select(
        "doc_id", "n_chars", F.col("edited").alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next", "component_id",
    )


@query
def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.passages import passage_rows, repeated_passages

    return passage_rows(repeated_passages(read_table(spark, sf_dir, "documents")))


@query
def op11_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.lexical import build_index, search

    return search(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


@query
def op12_grammar_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.chat import format_conversations, loss_text, parse

    said = "</s>[INST] ok [/INST]"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = constant_frame(spark, [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = parse(format_conversations(turns.unionByName(planted))).withColumn("loss", loss_text())
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op13_displacement_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.fill_middle import fill_in_middle, restore

    rows = restore(fill_in_middle(read_table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


ORACLES["op5_rule_ledger"] = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, array_to_string(ws[k:k + 7], ' ')) AS times FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS k FROM w) x),
rep AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(k, k + 8)) AS pos FROM win WHERE times > 1) x GROUP BY 1),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS n_same,
    length(regexp_replace(t, '[^\pL]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_capitals, len(list_filter(ws, lambda x: suffix(x, '!'))) AS n_exclaimed
  FROM w JOIN l USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * n_words THEN 8 ELSE 0 END
    + CASE WHEN n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END + CASE WHEN 100 * n_same > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 50 * n_letters THEN 64 ELSE 0 END + CASE WHEN 100 * n_exclaimed > 30 * n_words THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_letters < 50 * word_chars THEN 256 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

ORACLES["op12_grammar_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '</?s>|\[/?(?:SYS|INST|ROLE)\]|\[AS\]')) AS n_text,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
      ELSE 21 + length(role) + len(regexp_extract_all(role, '</?s>|\[/?(?:SYS|INST|ROLE)\]|\[AS\]')) END AS n_marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + n_marks) + count(*) - 1 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op13_displacement_fim"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

ORACLES["op11_range_maximum_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
tf AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY t),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
q AS (SELECT iid, item_id, t, count(*) AS times FROM (SELECT iid, item_id, unnest(ts) AS t FROM i) x GROUP BY ALL),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN w USING (t), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
