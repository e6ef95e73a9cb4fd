"""Text structure: normalisation, tokens, sentences, sections, lines, chunks, overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators.chunk import overlap_join, recursive_chunks
from spanlake.operators.fusion import section_index
from spanlake.operators.lexical import chunk_terms, collection_stats, document_frequencies
from spanlake.operators.lines import annotate_documents, document_lines, line_offsets, pattern_counts, top_prefixes
from spanlake.operators.segment import is_heading, line_section
from spanlake.operators import segment
from spanlake.registry import inputs, query
from spanlake.registry import sqltext as S


def _lines_sql(name: str = "ln") -> str:
    return f"""
    {name} AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS l,
                      len(string_split(text, chr(10))) - 1 AS last_l FROM documents),
    {name}_s AS (SELECT doc_id, l, line, {S.strip('line')} AS s FROM {name} WHERE NOT (l = last_l AND line = ''))"""


@query("normalize_text", f"SELECT doc_id, {S.norm('text')} AS normalized_text FROM documents")
def normalize_text(spark, folder):
    return inputs.table(spark, folder, "documents").select("doc_id", T.normalize_sentence("text").alias("normalized_text"))


@query(
    "tokenize_counts",
    f"SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_tokens FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)",
)
def tokenize_counts(spark, folder):
    tokens = inputs.table(spark, folder, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return tokens.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("distinct_tokens")
    )


@query("normalize_answer", f"SELECT conv_id, turn, {S.norm_answer('text')} AS answer FROM conversations")
def normalize_answer(spark, folder):
    return inputs.table(spark, folder, "conversations").select("conv_id", "turn", T.normalize_answer("text").alias("answer"))


@query(
    "slugify",
    f"""WITH a AS (SELECT page_id, regexp_replace(lower({S.strip('url')}), '[^0-9a-z._-]+', '-', 'g') AS s FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(s, '-+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS s FROM a)
    SELECT p.page_id, CASE WHEN b.s = '' THEN 'value' ELSE b.s END AS slug,
           upper(regexp_replace(regexp_replace(p.url, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name
    FROM pages p JOIN b USING (page_id)""",
)
def slugify(spark, folder):
    return inputs.table(spark, folder, "pages").select("page_id", T.slugify("url").alias("slug"), T.identifier("url").alias("name"))


@query(
    "category_text",
    """SELECT item_id, regexp_extract('Highlight the parts related to "' || replace(text, '"', '') || '" if any', 'related to "([^"]+)"', 1) AS extracted,
              lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normalized,
              regexp_replace(CASE WHEN starts_with('Category: ' || text, 'Category:') THEN substr('Category: ' || text, 10) END, '^\\s+|\\s+$', '', 'g') AS stripped
       FROM benchmark""",
)
def category_text(spark, folder):
    items = inputs.table(spark, folder, "benchmark")
    question = F.concat(F.lit('Highlight the parts related to "'), F.replace("text", F.lit('"'), F.lit("")), F.lit('" if any'))
    return items.select(
        "item_id",
        T.extract_category(question).alias("extracted"),
        T.normalize_category("text").alias("normalized"),
        T.drop_prefix(F.concat(F.lit("Category: "), "text"), "Category:").alias("stripped"),
    )


@query(
    "sentence_spans",
    f"""WITH {S.SENTENCES} SELECT id || ':s:' || idx AS sentence_id, id AS document_row_id, idx AS sentence_index, start_char, end_char,
        raw AS raw_text, norm AS normalized_text FROM sent""",
)
def sentence_spans(spark, folder):
    spans = segment.sentence_spans(inputs.documents(spark, folder))
    return spans.select(
        "sentence_id", "document_row_id", F.col("sentence_index").cast("bigint").alias("sentence_index"),
        F.col("start_char").cast("bigint").alias("start_char"), F.col("end_char").cast("bigint").alias("end_char"),
        "raw_text", "normalized_text",
    )


@query(
    "sentence_stats",
    f"""WITH {S.SENTENCES} SELECT count(*) AS sentence_count, count(DISTINCT id) AS contract_count,
        round(count(*) / count(DISTINCT id), 6) AS average_sentences FROM sent""",
)
def sentence_stats(spark, folder):
    per_document = inputs.spans(spark, folder).groupBy("document_row_id").agg(F.count(F.lit(1)).alias("n"))
    return per_document.agg(
        F.sum("n").alias("sentence_count"), F.count(F.lit(1)).alias("contract_count"), F.round(F.avg("n"), 6).alias("average_sentences")
    )


@query("heading_lines", f"WITH {_lines_sql()} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {S.heading('line')}) AS headings FROM ln_s GROUP BY doc_id")
def heading_lines(spark, folder):
    lines = document_lines(inputs.documents(spark, folder))
    flags = lines.select(F.col("document_row_id").alias("doc_id"), is_heading(F.col("line")).alias("h"))
    return flags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("h").alias("headings"))


_CLASSES = f"""
    cls AS (SELECT *, CASE
        WHEN s = '' THEN NULL
        WHEN regexp_matches(s, '^(?:EXHIBIT|Exhibit|SCHEDULE|Schedule|ANNEX|Annex){S.WS}+[\\p{{Nd}}.\\pL\\pN_]') THEN 'exhibit'
        WHEN regexp_matches(s, '^(?:ARTICLE|Article){S.WS}+(?:[IVXLCDM]+|\\p{{Nd}}+)') THEN 'article'
        WHEN regexp_matches(s, '^(?:WHEREAS|WITNESSETH|RECITALS?|NOW,?{S.WS}+THEREFORE)($|[^\\pL\\pN_])') THEN 'whereas'
        WHEN length(s) <= 80 AND upper(s) = s AND regexp_matches(s, '\\pL') AND NOT regexp_matches(s, '[.;,]$') THEN 'allcaps'
        WHEN regexp_matches(s, '^(?:SECTION|Section){S.WS}+\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*(?:\\([a-z]\\))?\\.?{S.WS}+\\S') THEN 'section'
        WHEN regexp_matches(s, '^\\p{{Nd}}+\\.{S.WS}+[A-Z]') THEN 'top_numbered'
        WHEN regexp_matches(s, '^\\p{{Nd}}+\\.\\p{{Nd}}+') THEN 'subsection'
        WHEN regexp_matches(s, '^\\([ivxlIVXL]+\\){S.WS}+\\S') THEN 'roman_paren'
        WHEN regexp_matches(s, '^\\([a-z]\\){S.WS}+\\S') THEN 'alpha_paren_lower'
        WHEN regexp_matches(s, '^\\([A-Z]\\){S.WS}+\\S') THEN 'alpha_paren_upper'
        WHEN regexp_matches(s, '^\\(\\p{{Nd}}+\\){S.WS}+\\S') THEN 'num_paren'
        WHEN regexp_matches(s, '^[a-z]\\){S.WS}+\\S') THEN 'bare_letter' END AS pattern, len({S.words('line')}) AS words FROM ln_s),
    pre AS (SELECT *, CASE WHEN pattern IS NULL THEN nullif(regexp_extract(s,
        '^(\\([a-zA-Z0-9]+\\)|[A-Za-z]{{1,4}}\\.|\\p{{Nd}}+\\.|[A-Za-z0-9]{{1,3}}\\)|[•\\-–—*])', 1), '') END AS prefix FROM cls)"""


@query(
    "line_classify",
    f"WITH {_lines_sql()}, {_CLASSES} SELECT doc_id, l + 1 AS line_number, pattern, words, prefix FROM pre",
)
def line_classify(spark, folder):
    lines = document_lines(inputs.documents(spark, folder))
    return lines.select(
        F.col("document_row_id").alias("doc_id"), F.col("line_number").cast("bigint").alias("line_number"), "pattern",
        F.col("words").cast("bigint").alias("words"), "prefix",
    )


@query(
    "line_prefix_topk",
    f"""WITH {_lines_sql()}, {_CLASSES}, c AS (SELECT doc_id, prefix, count(*) AS lines, min(l) AS f FROM pre WHERE prefix IS NOT NULL GROUP BY ALL)
    SELECT doc_id, prefix, lines, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lines DESC, f) AS rank FROM c) WHERE rank <= 25""",
)
def line_prefix_topk(spark, folder):
    top = top_prefixes(inputs.documents(spark, folder))
    return top.select(F.col("document_row_id").alias("doc_id"), "prefix", "lines", F.col("rank").cast("bigint").alias("rank"))


@query(
    "line_patterns",
    f"WITH {_lines_sql()}, {_CLASSES} SELECT doc_id, pattern, count(*) AS lines FROM pre WHERE pattern IS NOT NULL GROUP BY ALL",
)
def line_patterns(spark, folder):
    return pattern_counts(inputs.documents(spark, folder)).select(F.col("document_row_id").alias("doc_id"), "pattern", "lines")


@query(
    "annotate_documents",
    f"""WITH {_lines_sql()}, {_CLASSES}, a AS (
      SELECT doc_id, count(*) AS total_lines, sum(words) AS total_words,
             coalesce(sum(words) FILTER (WHERE pattern IS NOT NULL), 0) AS classified_words,
             count(*) FILTER (WHERE pattern IS NOT NULL) AS classified_lines,
             count(*) FILTER (WHERE s <> '') AS filled,
             any_value(s) FILTER (WHERE l = 0) AS first_line FROM pre GROUP BY doc_id)
    SELECT doc_id, total_lines, regexp_matches(first_line, '^(?:EXHIBIT|Exhibit|exhibit|SCHEDULE|Schedule)\\s+[\\d.]+') AS starts_with_exhibit,
           total_words::BIGINT AS total_words, classified_words::BIGINT AS classified_words, classified_lines,
           round(CASE WHEN total_words > 0 THEN 100.0 * classified_words / total_words ELSE 0 END, 1) AS word_coverage,
           round(CASE WHEN filled > 0 THEN 100.0 * classified_lines / filled ELSE 0 END, 1) AS line_coverage FROM a""",
)
def annotate(spark, folder):
    notes = annotate_documents(inputs.documents(spark, folder))
    return notes.select(
        F.col("document_row_id").alias("doc_id"), F.col("total_lines").cast("bigint").alias("total_lines"), "starts_with_exhibit",
        "total_words", "classified_words", "classified_lines", "word_coverage", "line_coverage",
    )


@query(
    "line_offsets",
    f"""WITH {_lines_sql()}, z AS (SELECT doc_id, l, length(line) + CASE WHEN l < last_l THEN 1 ELSE 0 END AS n FROM ln WHERE NOT (l = last_l AND line = ''))
    SELECT doc_id, l AS line_no, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start,
           n AS line_length FROM z""",
)
def offsets(spark, folder):
    rows = line_offsets(inputs.documents(spark, folder))
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select(F.col("document_row_id").alias("doc_id"), big("line_no"), big("line_start"), big("line_length"))


@query(
    "section_carry_forward",
    f"""WITH {_lines_sql()}, h AS (
      SELECT doc_id, l, s, regexp_matches(s, '(?i)^(?:Section{S.WS}+)?(\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*(?:\\([a-zA-Z0-9]+\\))?|ARTICLE{S.WS}+[IVXLC]+)\\.?{S.WS}+.{{1,120}}$') AS numbered,
             length(s) <= 80 AND s <> '' AND upper(s) = s AND regexp_matches(s, '\\pL') AND NOT regexp_matches(s, '[.;,]$') AS caps FROM ln_s),
    g AS (SELECT doc_id, l, s, sum(CASE WHEN numbered OR caps THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY l ROWS UNBOUNDED PRECEDING) AS section_pos FROM h)
    SELECT doc_id, l AS line_no, section_pos::BIGINT AS section_pos FROM g""",
)
def section_carry_forward(spark, folder):
    """Number of the section current at each line, as an inclusive running count inside the document row."""
    from spanlake.functions.arrays import explode_rows, running_starts

    lines = inputs.documents(spark, folder).select("document_row_id", T.split_lines("text").alias("lines"))
    marked = lines.withColumn("marks", F.transform("lines", lambda v: line_section(v).isNotNull().cast("int")))
    counted = marked.withColumn("before", running_starts(F.col("marks")))
    current = F.zip_with("marks", "before", lambda m, b: (m + b).cast("bigint"))
    out = explode_rows(counted, current, F.col("document_row_id").alias("doc_id"), names=("line_no", "section_pos"))
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "section_pos")


@query(
    "section_index",
    f"""WITH {S.SENTENCES} SELECT id AS doc_id, 'part ' || (idx // 5) AS section_title, min(idx) AS first_index, count(*) AS sentences,
        string_agg(id || ':s:' || idx, ',' ORDER BY idx) AS sentence_ids FROM sent GROUP BY id, idx // 5""",
)
def sections(spark, folder):
    spans = inputs.spans(spark, folder)
    part = F.concat(F.lit("part "), F.floor(F.col("sentence_index") / 5).cast("string"))
    index = section_index(spans.withColumns({"section_title": part, "clause_path": F.array(part)}))
    return index.select(
        F.col("document_row_id").alias("doc_id"), "section_title", F.col("first_index").cast("bigint").alias("first_index"),
        F.size("sentence_ids").cast("bigint").alias("sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
    )


@query(
    "overlap_join",
    f"""WITH {S.SENTENCES}, {_lines_sql()}, z AS (SELECT doc_id, l, length(line) + CASE WHEN l < last_l THEN 1 ELSE 0 END AS n FROM ln WHERE NOT (l = last_l AND line = '')),
    o AS (SELECT doc_id, l, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, n FROM z)
    SELECT doc_id, l AS line_no, idx AS sentence_index FROM o JOIN sent s ON s.id = o.doc_id AND s.start_char < o.a + o.n AND s.end_char > o.a""",
)
def overlaps(spark, folder):
    documents = inputs.documents(spark, folder)
    lines = line_offsets(documents).select(
        "document_row_id", "line_no", F.col("line_start").alias("start_char"), (F.col("line_start") + F.col("line_length")).alias("end_char")
    )
    sentences = inputs.spans(spark, folder).select("document_row_id", "sentence_index", "start_char", "end_char")
    pairs = overlap_join(lines, sentences, "document_row_id")
    return pairs.select(
        F.col("document_row_id").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"),
        F.col("other_sentence_index").cast("bigint").alias("sentence_index"),
    )


@query(
    "term_statistics",
    f"""WITH {S.SENTENCES}, t AS (SELECT id, idx, {S.tokens('norm')} AS toks FROM sent)
    SELECT term, count(*) AS df FROM (SELECT DISTINCT id, idx, unnest(toks) AS term FROM t) GROUP BY term""",
)
def term_statistics(spark, folder):
    return document_frequencies(chunk_terms(inputs.chunks(spark, folder)))


@query(
    "collection_statistics",
    f"WITH {S.SENTENCES} SELECT count(*) AS n_chunks, round(avg(len({S.tokens('norm')})), 6) AS avgdl FROM sent",
)
def collection_statistics(spark, folder):
    stats = collection_stats(chunk_terms(inputs.chunks(spark, folder)))
    return stats.select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query("recursive_chunks")
def chunks(spark, folder):
    rows = recursive_chunks(inputs.documents(spark, folder))
    return rows.select("chunk_id", "document_row_id", "chunk_pos", "start_char", "end_char", "sentence_ids", "normalized_text")
