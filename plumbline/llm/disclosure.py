"""Personal data and what gives it away: terms whose co-occurrence with a protected value discloses it.

Built from DataFrame and SQL functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import texts_of
from plumbline.session import cut_lineage

# Kinds in the order of their spans. The patterns are those of the contract, written so that a
# match never has to be given back: runs are possessive, and an address or a number starts where
# its run of characters starts, or where the match before it ended.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"\p{L}[\p{L}\p{N}]++"
OCTETS = r"^(0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.|$)){4}$"

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


def placed(text: str, found: str, between: str, kind: str, offset: str = "0") -> Column:
    """Spans of ``found`` in code points: matches and the pieces between them alternate."""
    return F.expr(
        f"""aggregate(zip_with({found}, slice({between}, 1, size({found})), (m, p) -> named_struct('m', m, 'p', p)),
            named_struct('at', CAST({offset} AS int), 'out', CAST(array() AS array<{SPAN}>)),
            (a, x) -> named_struct(
                'at', a.at + char_length(x.p) + char_length(x.m),
                'out', concat(a.out, array(named_struct('kind', '{kind}', 'start', a.at + char_length(x.p),
                    'end', a.at + char_length(x.p) + char_length(x.m), 'value', x.m)))),
            a -> a.out)"""
    )


def _matches(text: str, pattern: str, needs: str | None = None) -> Column:
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    return F.expr(f"CASE WHEN contains({text}, '{needs}') THEN {found} ELSE CAST(array() AS array<string>) END" if needs else found)


def _between(text: str, found: str, pattern: str) -> Column:
    return F.expr(f"CASE WHEN size({found}) > 0 THEN split({text}, {_quoted(pattern)}, -1) ELSE CAST(array() AS array<string>) END")


def _valid(kind: str) -> str:
    """Condition on a match ``s.value`` of a kind."""
    if kind == "ip":
        return f"s.value RLIKE {_quoted(OCTETS)}"
    if kind == "phone":
        return "char_length(regexp_replace(s.value, '[^0-9]', '')) BETWEEN 8 AND 15"
    if kind == "card":
        digits = "regexp_replace(s.value, '[^0-9]', '')"
        # from the right, every second digit counts twice, less nine from ten on
        return f"""CASE WHEN char_length({digits}) BETWEEN 16 AND 19 THEN
            aggregate(split(reverse({digits}), ''), named_struct('k', 0, 'sum', 0), (a, d) -> named_struct('k', a.k + 1, 'sum', a.sum +
                CASE WHEN d = '' THEN 0 WHEN a.k % 2 = 0 THEN int(d) WHEN int(d) > 4 THEN 2 * int(d) - 9 ELSE 2 * int(d) END),
                a -> a.sum % 10 = 0) ELSE false END"""
    return "true"


def spanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, spans`` (personal data by kind, then start) and ``masked``: the text with blanks in
    their place, so that places stay."""
    rows = texts_of(docs, id_col, text_col)
    rows = rows.select("*", *[_matches("text", p, NEEDS.get(k)).alias(f"{k}_m") for k, p in KINDS.items()])
    rows = rows.select("*", *[_between("text", f"{k}_m", p).alias(f"{k}_p") for k, p in KINDS.items()])
    rows = rows.select("doc_id", "text", *[placed("text", f"{k}_m", f"{k}_p", k).alias(f"{k}_s") for k in KINDS])
    kept = F.concat(*[F.expr(f"filter({k}_s, s -> {_valid(k)})") for k in KINDS])
    rows = rows.select("doc_id", "text", kept.alias("spans"))
    return rows.select("*", F.expr(
        """CASE WHEN size(spans) = 0 THEN text ELSE aggregate(
            array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end))), named_struct('at', 0, 'out', ''),
            (a, s) -> CASE WHEN s.end <= a.at THEN a ELSE named_struct('at', s.end, 'out', concat(a.out,
                substring(text, a.at + 1, greatest(s.start - a.at, 0)), repeat(' ', s.end - greatest(s.start, a.at)))) END,
            a -> concat(a.out, substring(text, a.at + 1))) END"""
    ).alias("masked"))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 120) -> DataFrame:
    """``doc_id, key, text_key, spans, links, terms`` of every text, read once.

    ``key`` is equal for equal rows alone, ``text_key`` for equal texts.  ``links`` are the entities of each
    span (its value, mailbox and domain of an address, subnet of a number, digits of others) with the
    context, the hash of the value and ``reach`` code points before and after it, and the hash of the value in lower case.  ``terms`` are the
    distinct words outside personal data, for texts that have any.
    """
    rows = spanned(docs, id_col, text_col)
    around = f"substring(text, greatest(s.start - {reach}, 0) + 1, least({reach}, s.start)), substring(text, s.end + 1, {reach})"
    near = f"""transform(spans, s -> named_struct('context', xxhash64(s.value, {around}), 'value', xxhash64(lower(s.value)), 'entities', CASE
        WHEN s.kind = 'email' THEN array(concat('value:', s.value), concat('mailbox:', lower(substring_index(s.value, '@', 1))), concat('domain:', lower(substring_index(s.value, '@', -1))))
        WHEN s.kind = 'ip' THEN array(concat('value:', s.value), concat('subnet:', substring_index(s.value, '.', 3)))
        ELSE array(concat('value:', s.value), concat(s.kind, ':', regexp_replace(s.value, '[^0-9]', ''))) END))"""
    links = f"flatten(transform({near}, n -> transform(n.entities, e -> named_struct('entity', e, 'context', n.context, 'value', n.value))))"
    return rows.select(
        "doc_id", row_key("doc_id", "text").alias("key"), F.md5(F.col("text").cast("binary")).alias("text_key"), "spans",
        F.expr(links).alias("links"), F.when(F.size("spans") > 0, words_of("masked")).alias("terms"),
    )


def row_key(doc_id: str, text: str) -> Column:
    return F.md5(F.concat_ws("\0", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(text)).cast("binary"))


def words_of(text: str) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.transform(_matches(text, TERM), F.lower))


def term_counts(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, n_docs`` over all distinct texts: over all rows, less the further copies of each text."""
    rows = spanned(docs, id_col, text_col)
    every = rows.select(F.explode(words_of("masked")).alias("term"), F.lit(1).cast("long").alias("n"))
    copied = found.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1")
    further = docs.withColumn("__key", F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))).join(copied, F.col("__key") == copied["text_key"])
    once = further.groupBy("text_key").agg(F.first(text_col).alias("text"), F.first("copies").alias("doc_id"))
    less = spanned(once, "doc_id", "text").select(F.explode(words_of("masked")).alias("term"), (1 - F.col("doc_id")).alias("n"))
    return every.union(less).groupBy("term").agg(F.sum("n").alias("n_docs"))


def disclosures(
    found: DataFrame, counts: DataFrame, n_texts: Column, min_contexts: int = 3, generalise: float = 0.7, remove: float = 0.9,
    public_from: int = 25, posterior: float = 0.5, bits: float = 3.0, clean: float = 0.95,
) -> DataFrame:
    """``entity, term, disclosure, action, everywhere`` of the terms that give a protected entity away.

    Disclosure is the pointwise mutual information of term and entity over the information of the
    entity itself: 1 if the term occurs nowhere else.  Everything is counted in distinct texts, over
    the whole of each.  A term is marked if all of this holds:

    * The entity identifies: it stands in ``min_contexts`` different contexts, so that rare words of a text whose
      value occurs once are not taken for its sign.  Copies of a passage are one context.  A mailbox, domain or
      subnet that ``public_from`` or more different values share, as the domain of a mail service, is public and no
      one's; a value is someone's however often it stands.
    * The term shares ``min_contexts`` of them.
    * The term singles the entity out: at least a share ``posterior`` of all texts that hold the term hold the entity.
    * That is no accident: were words dealt out by chance, fewer than ``2 ** -bits`` pairs of all terms and
      entities were expected to agree as much (Chernoff's bound).

    ``everywhere`` says that the disclosure is at least ``clean``: only such a term is treated in texts
    without personal data too.
    """
    units = found.where("size(links) > 0").dropDuplicates(["text_key"])
    each = units.select("text_key", F.explode("links").alias("l"), F.size("terms").alias("words"))
    each = each.groupBy("text_key", "l.entity").agg(F.min("l.context").alias("context"), F.first("words").alias("words"), F.collect_set("l.value").alias("values"))
    each = cut_lineage(each, "private-entities")
    members = each.where("entity RLIKE '^(mailbox|domain|subnet):'").select("entity", F.explode("values").alias("value")).distinct()
    public = members.groupBy("entity").count().where(F.col("count") >= public_from).select("entity")
    each = each.drop("values")
    # a pair has no more contexts than its entity
    entities = each.groupBy("entity").agg(F.count("*").alias("n_value"), F.count_distinct("context").alias("n"), F.sum("words").alias("words"))
    entities = cut_lineage(entities.where(F.col("n") >= min_contexts).drop("n").join(public, "entity", "left_anti"), "linked-entities")
    kept = each.join(entities.select("entity"), "entity").join(units.select("text_key", "terms"), "text_key")
    alike = kept.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = alike.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts")).where(F.col("contexts") >= min_contexts)
    tried = counts.agg(F.count("*").alias("n_terms"), F.sum("n_docs").alias("n_words")).first()
    n_entities = entities.count()
    scored = pairs.join(entities, "entity").join(counts, "term").withColumn("n_all", n_texts)
    information = F.log2(F.col("n_all") / F.col("n_value"))
    shared = F.col("n_both") * F.col("n_all") / (F.col("n_docs") * F.col("n_value"))
    scored = scored.withColumn("disclosure", F.when(information > 0, F.log2(shared) / information))
    share, chance = F.col("n_both") / F.col("n_docs"), F.col("words") / F.lit(float(tried["n_words"] or 1))
    apart = F.when(share < 1, (1 - share) * F.log2((1 - share) / (1 - chance))).otherwise(0.0)
    evidence = F.col("n_docs") * (share * F.log2(share / chance) + apart)
    tests = F.log2(F.lit(float(max(1, (tried["n_terms"] or 0) * n_entities))))
    scored = scored.where((share >= posterior) & (share > chance) & (evidence - tests >= bits))
    action = F.when(F.col("disclosure") >= remove, "remove").when(F.col("disclosure") >= generalise, "generalise")
    return scored.select("entity", "term", "disclosure", action.alias("action"), (F.col("disclosure") >= clean).alias("everywhere")).where("action IS NOT NULL")


def marked_terms(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, terms``: all places of marked terms, of the rows that have any; without personal data only those marked everywhere."""
    rows = spanned(docs, id_col, text_col).select(row_key("doc_id", "text").alias("key"), "masked", (F.size("spans") > 0).alias("private"))
    hits = rows.select("key", "private", F.explode(words_of("masked")).alias("term")).join(marks, "term").where("private OR everywhere").groupBy("key")
    hits = hits.agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("hits"))
    there = rows.join(hits, "key").select("key", "hits", "masked", _matches("masked", TERM).alias("m"))
    there = there.select("key", "hits", "m", _between("masked", "m", TERM).alias("p"))
    spans = F.expr(
        f"""aggregate(zip_with(m, slice(p, 1, size(m)), (m, p) -> named_struct('m', m, 'p', p)),
            named_struct('at', 0, 'out', CAST(array() AS array<{SPAN}>)),
            (a, x) -> named_struct(
                'at', a.at + char_length(x.p) + char_length(x.m),
                'out', CASE WHEN map_contains_key(hits, lower(x.m)) THEN concat(a.out, array(named_struct('kind', 'term', 'start', a.at + char_length(x.p),
                    'end', a.at + char_length(x.p) + char_length(x.m), 'value', try_element_at(hits, lower(x.m))))) ELSE a.out END),
            a -> a.out)"""
    )
    return there.select("key", spans.alias("terms")).dropDuplicates(["key"])


def find_private(
    docs: DataFrame, min_contexts: int = 3, generalise: float = 0.7, remove: float = 0.9, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``doc_id, key, spans, terms`` of every document: personal data, and the terms that disclose it.

    ``spans`` and ``terms`` are arrays of ``kind, start, end, value`` in code points (``terms`` with
    the action as value).  A term that gives any entity away is listed wherever it occurs beside personal data, and in
    documents without any if it gives it away nearly for certain; ``options`` go to ``disclosures``.  Null and empty texts have neither; rows that repeat have the same spans
    each; an empty table gives no rows.
    """
    found = cut_lineage(base_spans(docs, id_col, text_col), "private-spans")
    total = found.agg(F.count_distinct("text_key").alias("n")).first()["n"]
    counts = cut_lineage(term_counts(docs, found, id_col, text_col), "term-counts")
    marks = disclosures(found, counts, F.lit(total), min_contexts, generalise, remove, **options)
    marks = cut_lineage(marks.groupBy("term").agg(F.max("action").alias("action"), F.max("everywhere").alias("everywhere")), "private-terms")
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    if marks.isEmpty():
        return found.select("doc_id", "key", "spans", none.alias("terms"))
    terms = marked_terms(docs, marks, id_col, text_col)
    return found.select("doc_id", "key", "spans").join(terms, "key", "left").select("doc_id", "key", "spans", F.coalesce("terms", none).alias("terms"))


def span_list(spans: str) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def sanitise(
    docs: DataFrame, min_contexts: int = 3, generalise: float = 0.7, remove: float = 0.9, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars",
    **options,
) -> DataFrame:
    """The documents with personal data replaced by its kind, and disclosing terms by ``<TERM>`` or
    nothing.  All columns stay, and ``size_col``, where there is one, is the new length; null texts
    stay null; overlapping spans are replaced as one."""
    found = find_private(docs, min_contexts, generalise, remove, id_col, text_col, **options)
    spans = found.where("size(spans) > 0 OR size(terms) > 0").dropDuplicates(["key"]).select(
        F.col("key").alias("__key"), F.expr("array_sort(transform(concat(spans, terms), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'value', s.value)))").alias("__spans")
    )
    keyed = docs.withColumn("__text", F.coalesce(docs[text_col], F.lit(""))).withColumn("__key", row_key(id_col, "__text"))
    joined = keyed.join(spans, "__key", "left")
    cleaned = F.expr(
        """aggregate(__spans, named_struct('at', 0, 'out', ''), (a, s) -> CASE
            WHEN s.start >= a.at THEN named_struct('at', s.end, 'out', concat(a.out, substring(__text, a.at + 1, s.start - a.at),
                CASE WHEN s.kind = 'term' AND s.value = 'remove' THEN '' ELSE concat('<', upper(s.kind), '>') END))
            ELSE named_struct('at', greatest(a.at, s.end), 'out', a.out) END,
            a -> concat(a.out, substring(__text, a.at + 1)))"""
    )
    changed = F.col("__spans").isNotNull()
    done = joined.withColumn("__new", F.when(changed, cleaned).otherwise(F.col(text_col)))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("__new").alias(name)
        if name == size_col:
            return F.when(changed, F.char_length("__new")).otherwise(F.col(name)).cast(docs.schema[name].dataType).alias(name)
        return F.col(name)

    return done.select(*map(column, docs.columns))
