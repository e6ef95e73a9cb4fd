"""SQL fragments (DuckDB dialect) that the oracle queries share; written independently of the operators."""

from __future__ import annotations

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def norm(c: str) -> str:
    plain = f"translate(coalesce({c}, ''), chr(160) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212), ' ''''\"\"--')"
    return f"regexp_replace({collapse(plain)}, ' ([,.;:!?])', '\\1', 'g')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({norm(c)}), '[A-Za-z0-9_]+')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def norm_answer(c: str) -> str:
    bare = f"translate(lower(coalesce({c}, '')), '{PUNCT}', '')"
    article = "'(^|[^\\pL\\pN\\pM_])(a|an|the)($|[^\\pL\\pN\\pM_])', '\\1 \\3', 'g'"
    once = f"regexp_replace({bare}, {article})"
    return collapse(f"regexp_replace({once}, {article})")


def answer_tokens(c: str) -> str:
    return f"list_filter(string_split({norm_answer(c)}, ' '), lambda w: w <> '')"


_ABBR = "|".join(
    r"inc corp ltd llc co no sec art ex u\.s\.a u\.s e\.g i\.e mrs mr ms dr".split()
)
_OPEN = r"\p{Lu}\p{Nd}\"''(\[•‣▪▫◦●○"


def heading(c: str) -> str:
    s = strip(c)
    letters = f"length(regexp_replace({s}, '[^\\pL]', '', 'g'))"
    upper = f"length(regexp_replace({s}, '[^\\p{{Lu}}]', '', 'g'))"
    titled = (
        f"(regexp_matches({s}, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches({s}, '[\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}][\\p{{Lu}}\\p{{Lt}}]')"
        f" AND NOT regexp_matches({s}, '(^|[^\\p{{Lu}}\\p{{Lt}}\\p{{Ll}}])\\p{{Ll}}'))"
    )
    return (
        f"({s} <> '' AND length({s}) <= 120 AND NOT regexp_matches({s}, '[.!?;:]$') AND len({words(s)}) <= 14"
        f" AND {letters} > 0 AND ({upper} >= 0.65 * {letters} OR {titled}))"
    )


def sentences(source: str, name: str) -> str:
    """CTEs ending in ``name(id, idx, start_char, end_char, raw, norm)`` for a relation ``source(id, text)``."""
    n = name
    return f"""
    {n}_safe AS (
      SELECT id, regexp_replace(text, '(^|{WS})((?i:{_ABBR})|\\p{{Nd}}{{1,3}})\\.', '\\1\\2' || chr(1), 'g') AS t FROM {source}),
    {n}_cut AS (
      SELECT id, regexp_replace(regexp_replace(t, '([.?!]["'')\\]}}]*)({WS}+)([{_OPEN}])', '\\1' || chr(2) || '\\2\\3', 'g'),
                                '(\\n[ \\t]*\\n+)', '\\1' || chr(3), 'g') AS t FROM {n}_safe),
    {n}_par AS (SELECT id, unnest(string_split(t, chr(3))) AS par, unnest(range(len(string_split(t, chr(3))))) AS p FROM {n}_cut),
    {n}_line AS (
      SELECT id, p, unnest(string_split(par, chr(10))) AS line, unnest(range(len(string_split(par, chr(10))))) AS l,
             len(string_split(regexp_replace(par, '[\\s\\x{{02}}]+$', ''), chr(10))) - 1 AS last_line,
             len(string_split(par, chr(10))) - 1 AS final_line FROM {n}_par),
    {n}_lead AS (
      SELECT *, l < last_line AND bool_and({heading("replace(replace(line, chr(2), ''), chr(1), '.')")})
                OVER (PARTITION BY id, p ORDER BY l ROWS UNBOUNDED PRECEDING) AS lead FROM {n}_line),
    {n}_join AS (
      SELECT id, string_agg(line || CASE WHEN l < final_line THEN chr(10) ELSE '' END
                            || CASE WHEN lead OR l = final_line THEN chr(2) ELSE '' END, '' ORDER BY p, l) AS t
      FROM {n}_lead GROUP BY id),
    {n}_piece AS (SELECT id, unnest(string_split(t, chr(2))) AS piece, unnest(range(len(string_split(t, chr(2))))) AS n FROM {n}_join),
    {n}_off AS (
      SELECT id, n, replace(piece, chr(1), '.') AS piece,
             coalesce(sum(length(piece)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM {n}_piece),
    {n}_raw AS (
      SELECT id, n, off + length(piece) - length(regexp_replace(piece, '^{WS}+', '')) AS start_char, {strip("piece")} AS raw FROM {n}_off),
    {name} AS (
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS idx, start_char, start_char + length(raw) AS end_char, raw,
             {norm("raw")} AS norm FROM {n}_raw WHERE raw <> '')"""


DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
SENTENCES = f"{DOCS}, {sentences('docs', 'sent')}"

ROWS = """
    eval_rows AS (
      SELECT d.doc_id || ':' || (2 * b.item_id) AS row_id, d.doc_id AS document_row_id, 2 * b.item_id AS question_index, d.lang AS category,
             d.source AS category_description, b.text AS question, b.text AS answer, false AS is_impossible
      FROM documents d JOIN benchmark b ON contains(d.text, b.text)
      UNION ALL
      SELECT d.doc_id || ':' || (2 * c.turn + 1), d.doc_id, 2 * c.turn + 1, d.lang, d.source, c.text, NULL, true
      FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'user')"""

QUERIES = f"""
    qry AS (SELECT row_id AS query_id, document_row_id AS doc,
                   concat_ws(' ', {strip('category')}, {strip('category_description')}, {strip('question')}) AS query FROM eval_rows)"""


def bm25(query_relation: str = "qry", name: str = "bm25") -> str:
    """CTE ``name(query_id, doc, pos, score)``: every sentence of the query's document with its score."""
    n = name
    return f"""
    {n}_tok AS (SELECT id AS doc, idx AS pos, {tokens('norm')} AS toks FROM sent),
    {n}_stat AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {n}_tok),
    {n}_post AS (SELECT doc, pos, greatest(len(toks), 1) AS dl, term, count(*) AS tf
                 FROM (SELECT doc, pos, toks, unnest(toks) AS term FROM {n}_tok) GROUP BY doc, pos, toks, term),
    {n}_df AS (SELECT term, count(*) AS df FROM {n}_post GROUP BY term),
    {n}_q AS (SELECT query_id, doc, term, count(*) AS qtf FROM (SELECT query_id, doc, unnest({tokens('query')}) AS term FROM {query_relation})
              GROUP BY ALL),
    {n}_hit AS (
      SELECT q.query_id, q.doc, p.pos, sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5
                                           / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
      FROM {n}_q q JOIN {n}_post p ON p.doc = q.doc AND p.term = q.term JOIN {n}_df d ON d.term = q.term, {n}_stat s GROUP BY ALL),
    {n} AS (SELECT q.query_id, q.doc, t.pos, coalesce(h.score, 0.0) AS score
            FROM {query_relation} q JOIN {n}_tok t ON t.doc = q.doc
            LEFT JOIN {n}_hit h ON h.query_id = q.query_id AND h.pos = t.pos)"""


def tfidf(query_relation: str = "qry", name: str = "tfidf") -> str:
    n = name
    uni = "regexp_extract_all(lower({0}), '[\\pL\\pN_]{{2,}}')"
    grams = "list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]))"
    return f"""
    {n}_tok AS (SELECT doc, pos, {grams} AS toks FROM (SELECT id AS doc, idx AS pos, {uni.format('norm')} AS u FROM sent)),
    {n}_n AS (SELECT count(*) AS n FROM {n}_tok),
    {n}_post AS (SELECT doc, pos, term, count(*) AS tf FROM (SELECT doc, pos, unnest(toks) AS term FROM {n}_tok) GROUP BY ALL),
    {n}_idf AS (SELECT term, ln((1 + any_value(c.n)) / (1.0 + count(*))) + 1 AS idf FROM {n}_post, {n}_n c GROUP BY term),
    {n}_w AS (SELECT p.doc, p.pos, p.term, p.tf * i.idf AS w FROM {n}_post p JOIN {n}_idf i USING (term)),
    {n}_norm AS (SELECT doc, pos, sqrt(sum(w * w)) AS norm FROM {n}_w GROUP BY ALL),
    {n}_qt AS (SELECT query_id, doc, term, count(*) AS qtf FROM (
                 SELECT query_id, doc, unnest({grams}) AS term FROM (SELECT query_id, doc, {uni.format('query')} AS u FROM {query_relation})) GROUP BY ALL),
    {n}_q AS (SELECT query_id, doc, term, qtf * idf AS w FROM {n}_qt JOIN {n}_idf USING (term)),
    {n}_qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM {n}_q GROUP BY ALL),
    {n}_dot AS (SELECT q.query_id, q.doc, w.pos, sum(q.w * w.w) AS dot FROM {n}_q q JOIN {n}_w w ON w.doc = q.doc AND w.term = q.term GROUP BY ALL),
    {n} AS (SELECT q.query_id, q.doc, t.pos, coalesce(d.dot / (m.norm * k.norm), 0.0) AS score
            FROM {query_relation} q JOIN {n}_tok t ON t.doc = q.doc
            LEFT JOIN {n}_dot d ON d.query_id = q.query_id AND d.pos = t.pos
            LEFT JOIN {n}_norm m ON m.doc = t.doc AND m.pos = t.pos LEFT JOIN {n}_qn k ON k.query_id = q.query_id)"""


def top(source: str, name: str, k: int) -> str:
    return f"""
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM {source})
               WHERE rank <= {k})"""


def golds(name: str = "gold") -> str:
    """CTE of golden sentences with their match, whole-text flag and reason."""
    return f"""
    {name}_src AS (SELECT row_id AS id, answer AS text FROM eval_rows WHERE NOT is_impossible), {sentences(f'{name}_src', f'{name}_sent')},
    {name}_first AS (SELECT id AS doc, norm, min(idx) AS idx FROM sent GROUP BY ALL),
    {name} AS (
      SELECT r.row_id, r.document_row_id, r.question_index, r.category, g.idx AS piece_pos, g.raw AS text, g.norm,
             CASE WHEN f.idx IS NOT NULL THEN r.document_row_id || ':s:' || f.idx END AS matched_sentence_id,
             contains({norm('d.text')}, g.norm) AS raw_match,
             CASE WHEN f.idx IS NULL THEN
               CASE WHEN EXISTS (SELECT 1 FROM sent s WHERE s.id = r.document_row_id AND contains(s.norm, g.norm))
                    THEN 'partial_span_inside_sentence' ELSE 'gold_answer_not_found' END END AS reason
      FROM eval_rows r JOIN {name}_sent g ON g.id = r.row_id JOIN documents d ON d.doc_id = r.document_row_id
      LEFT JOIN {name}_first f ON f.doc = r.document_row_id AND f.norm = g.norm),
    {name}_agg AS (
      SELECT row_id, count(*) AS gold, count(matched_sentence_id) AS matched, count(*) FILTER (WHERE raw_match) AS raw,
             arg_min(reason, piece_pos) FILTER (WHERE reason IS NOT NULL) AS reason FROM {name} GROUP BY row_id),
    eligible AS (
      SELECT r.row_id, r.document_row_id, r.question_index, r.category, coalesce(a.gold = a.matched, false) AS is_eligible,
             coalesce(a.gold, 0) AS gold, coalesce(a.matched, 0) AS matched, coalesce(a.raw, 0) AS raw,
             CASE WHEN r.is_impossible THEN 'no_answer_row' WHEN a.gold IS NULL THEN 'gold_answer_not_found'
                  WHEN a.gold <> a.matched THEN a.reason END AS reason
      FROM eval_rows r LEFT JOIN {name}_agg a USING (row_id))"""


def f1_over(relation: str, name: str, pred: str = "prediction", gold: str = "gold") -> str:
    """CTE ``name``: the relation (with a unique ``id``) plus token_f1."""
    n = name
    markers = "('', 'no answer', 'none', 'not found', 'n/a', 'na', 'not applicable', 'no_answer', 'noanswer')"
    return f"""
    {n}_t AS (SELECT *, {answer_tokens(pred)} AS pt, {answer_tokens(gold)} AS gt, {norm_answer(pred)} AS pn FROM {relation}),
    {n}_p AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(pt) AS t FROM {n}_t) GROUP BY ALL),
    {n}_g AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(gt) AS t FROM {n}_t) GROUP BY ALL),
    {n}_s AS (SELECT p.id, sum(least(p.c, g.c)) AS same FROM {n}_p p JOIN {n}_g g ON p.id = g.id AND p.t = g.t GROUP BY ALL),
    {name} AS (
      SELECT a.* EXCLUDE (pt, gt, pn), pn IN {markers} AS no_answer_text,
             CASE WHEN len(gt) = 0 THEN CASE WHEN pn IN {markers} THEN 1.0 ELSE 0.0 END
                  WHEN len(pt) = 0 THEN 0.0 ELSE coalesce(2.0 * s.same / (len(pt) + len(gt)), 0.0) END::DOUBLE AS token_f1
      FROM {n}_t a LEFT JOIN {n}_s s ON s.id = a.id)"""
