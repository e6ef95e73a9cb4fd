"""Golden answers, coverage, enrichment, answer scoring, failure analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators import coverage as C
from spanlake.operators import enrichment as E
from spanlake.operators import failures as X
from spanlake.operators import gold as G
from spanlake.operators import scoring as R
from spanlake.operators.sampling import stratified_split
from spanlake.plans.retrieval_benchmark import benchmark_methods, compare_queries
from spanlake.registry import inputs, query
from spanlake.registry import sqltext as S

_GOLD = f"WITH {S.SENTENCES}, {S.ROWS}, {S.golds()}"
_BIG = "bigint"


def _records(spark, folder, rows: DataFrame | None = None) -> DataFrame:
    rows = inputs.stored_rows(spark, folder) if rows is None else rows
    return G.eligibility(rows, inputs.spans(spark, folder), inputs.documents(spark, folder))


@query(
    "gold_containment_join",
    "SELECT d.doc_id, b.item_id, strpos(d.text, b.text) AS first_position FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def gold_containment(spark, folder):
    pairs = inputs.gold_pairs(spark, folder)
    return pairs.select(F.col("document_row_id").alias("doc_id"), "item_id", F.position("needle", "text").cast(_BIG).alias("first_position"))


@query(
    "evaluation_rows",
    f"WITH {S.ROWS} SELECT row_id, document_row_id, question_index, category, question, answer, is_impossible FROM eval_rows",
)
def evaluation_rows(spark, folder):
    rows = inputs.evaluation_rows(spark, folder)
    return rows.select(
        "row_id", "document_row_id", "question_index", "category", "question", F.get("answers", F.lit(0))["text"].alias("answer"), "is_impossible"
    )


@query(
    "gold_sentences",
    f"{_GOLD} SELECT row_id, piece_pos, text, norm AS normalized_text, matched_sentence_id, raw_match AS raw_contract_match, reason FROM gold",
)
def gold_sentences(spark, folder):
    golds = G.gold_sentences(inputs.stored_rows(spark, folder))
    matches = G.match_gold(golds, inputs.spans(spark, folder), inputs.documents(spark, folder))
    return matches.select(
        "row_id", F.col("piece_pos").cast(_BIG).alias("piece_pos"), "text", "normalized_text", "matched_sentence_id", "raw_contract_match", "reason"
    )


@query(
    "exact_match_first_lookup",
    f"WITH {S.SENTENCES} SELECT id AS document_row_id, norm AS normalized_text, min(idx) AS sentence_index, count(*) AS copies FROM sent GROUP BY ALL",
)
def first_lookup(spark, folder):
    spans = inputs.spans(spark, folder)
    copies = spans.groupBy("document_row_id", "normalized_text").agg(F.count(F.lit(1)).alias("copies"))
    first = G.first_sentences(spans).join(copies, ["document_row_id", "normalized_text"])
    return first.select("document_row_id", "normalized_text", F.col("sentence_index").cast(_BIG).alias("sentence_index"), "copies")


@query(
    "eligibility_rows",
    f"""{_GOLD} SELECT row_id, document_row_id, question_index, category, is_eligible, gold AS gold_sentence_count, matched AS matched_sentence_count,
        raw AS raw_contract_sentence_match_count, round(coalesce(matched / nullif(gold, 0), 0), 6) AS coverage, reason FROM eligible""",
)
def eligibility_rows(spark, folder):
    return _records(spark, folder).select(
        "row_id", "document_row_id", "question_index", "category", "is_eligible", "gold_sentence_count", "matched_sentence_count",
        "raw_contract_sentence_match_count", F.round("per_row_gold_sentence_contract_coverage", 6).alias("coverage"), "reason",
    )


@query(
    "eligibility_summary",
    f"""{_GOLD} SELECT count(*) AS rows_total, count(*) FILTER (WHERE gold > 0) AS rows_with_gold_sentences,
        count(*) FILTER (WHERE is_eligible) AS eligible_rows, count(*) FILTER (WHERE NOT is_eligible) AS non_eligible_rows,
        round(count(*) FILTER (WHERE is_eligible) / count(*) FILTER (WHERE gold > 0), 6) AS eligible_rate, sum(gold)::BIGINT AS gold_sentence_count,
        sum(matched)::BIGINT AS matched_sentence_count, sum(raw)::BIGINT AS raw_contract_sentence_match_count,
        round(sum(raw) / sum(gold), 6) AS raw_contract_sentence_match_rate FROM eligible""",
)
def eligibility_summary(spark, folder):
    summary = G.summarize_eligibility(_records(spark, folder))
    return summary.withColumns({c: F.round(c, 6) for c in ("eligible_rate", "raw_contract_sentence_match_rate")})


@query(
    "eligibility_by_question",
    f"""{_GOLD}, q AS (SELECT question_index, count(*) AS n, count(*) FILTER (WHERE gold > 0) AS wg, count(*) FILTER (WHERE gold > 0 AND is_eligible) AS fm,
        sum(gold)::BIGINT AS g, sum(matched)::BIGINT AS m, sum(raw)::BIGINT AS r FROM eligible GROUP BY ALL)
        SELECT question_index, n AS evaluated_contract_rows, wg AS rows_with_split_golden_answer_sentences, fm AS full_match_rows,
          round(coalesce(fm / nullif(wg, 0), 0), 4) AS full_match_rate, g AS split_golden_sentence_count, m AS matched_split_golden_sentence_count,
          round(coalesce(m / nullif(g, 0), 0), 4) AS split_sentence_match_rate, wg > 0 AND fm = wg AS strict_sentence_extraction_question,
          CASE WHEN wg > 0 AND fm = wg THEN 'strict_sentence_extraction' WHEN wg > 0 AND fm / wg >= 0.9 THEN 'strong_sentence_rag_candidate'
               WHEN wg > 0 AND fm / wg >= 0.5 THEN 'mixed_sentence_rag_candidate' ELSE 'not_sentence_rag_suitable' END AS rag_suitability FROM q""",
)
def eligibility_by_question(spark, folder):
    return G.eligibility_by_question(_records(spark, folder)).select(
        "question_index", "evaluated_contract_rows", "rows_with_split_golden_answer_sentences", "full_match_rows", "full_match_rate",
        "split_golden_sentence_count", "matched_split_golden_sentence_count", "split_sentence_match_rate",
        "strict_sentence_extraction_question", "rag_suitability",
    )


@query(
    "chunk_matching_by_question",
    f"""{_GOLD} SELECT question_index, count(*) AS rows_with_split_golden_answer_sentences, count(*) FILTER (WHERE matched = gold) AS full_match_rows,
        count(*) FILTER (WHERE matched > 0 AND matched < gold) AS partial_match_rows, count(*) FILTER (WHERE matched = 0) AS no_match_rows,
        round(count(*) FILTER (WHERE matched = 0) / count(*), 4) AS no_match_rate, round(sum(raw) / sum(gold), 4) AS raw_contract_match_rate
        FROM eligible WHERE gold > 0 GROUP BY question_index""",
)
def chunk_matching(spark, folder):
    return G.chunk_matching_by_question(_records(spark, folder)).select(
        "question_index", "rows_with_split_golden_answer_sentences", "full_match_rows", "partial_match_rows", "no_match_rows",
        "no_match_rate", "raw_contract_match_rate",
    )


@query(
    "compare_versions",
    f"""{_GOLD}, b AS (SELECT question_index, count(*) FILTER (WHERE matched = gold) AS f, sum(matched) / sum(gold) AS rate
                       FROM eligible WHERE gold > 0 GROUP BY ALL),
        c AS (SELECT question_index, count(*) FILTER (WHERE raw = gold) AS f, sum(raw) / sum(gold) AS rate FROM eligible WHERE gold > 0 GROUP BY ALL)
        SELECT question_index, coalesce(b.f, 0) AS baseline_full_match_rows, coalesce(c.f, 0) AS comparison_full_match_rows,
               coalesce(b.f, 0) - coalesce(c.f, 0) AS full_match_row_delta,
               round(coalesce(b.rate, 0) - coalesce(c.rate, 0), 4) AS split_sentence_match_rate_delta
        FROM b FULL JOIN c USING (question_index)""",
)
def compare_versions(spark, folder):
    """Sentence matches against whole-text matches as the other version."""
    records = _records(spark, folder)
    other = records.withColumn("matched_sentence_count", F.col("raw_contract_sentence_match_count"))
    compared = G.compare_versions_by_question(records, other, "sentence", "raw")
    return compared.select(
        "question_index", "baseline_full_match_rows", "comparison_full_match_rows", "full_match_row_delta", "split_sentence_match_rate_delta"
    )


@query(
    "review_rows",
    f"""{_GOLD} SELECT e.row_id, r.question, CASE WHEN matched = gold THEN 'full_match' WHEN matched > 0 THEN 'partial_match' ELSE 'no_match' END AS match_status
        FROM eligible e JOIN eval_rows r USING (row_id) WHERE gold > 0""",
)
def review_rows(spark, folder):
    rows = inputs.stored_rows(spark, folder)
    return G.review_rows(_records(spark, folder, rows), rows).select("row_id", "question", "match_status")


# ---- coverage ---------------------------------------------------------------------------------------------

_METHODS = ["bm25_sentence", "dense_sentence", "bm25_hierarchical"]
_CUTS = (1, 10, 30)


def _covered(spark, folder) -> DataFrame:
    rows = inputs.stored_rows(spark, folder)
    return benchmark_methods(rows, inputs.chunks(spark, folder), _records(spark, folder, rows), _METHODS, 30, _CUTS, index=inputs.index(spark, folder))


def _covered_sql() -> str:
    return f"""{_GOLD}, qry AS (SELECT r.row_id AS query_id, r.document_row_id AS doc,
        concat_ws(' ', {S.strip('r.category')}, {S.strip('r.category_description')}, {S.strip('r.question')}) AS query
        FROM eval_rows r JOIN eligible e USING (row_id) WHERE e.is_eligible), {S.bm25()}, {S.tfidf()}, {S.top('bm25', 'b30', 30)}, {S.top('tfidf', 't30', 30)},
    {S.top('bm25', 'leaf', 50)},
    sec AS (SELECT query_id, pos // 5 AS section, sum(score) AS s, min(rank) AS f FROM leaf GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, f) AS n FROM sec) WHERE n <= 5),
    inside AS (SELECT x.* FROM bm25 x JOIN best b ON b.query_id = x.query_id AND b.section = x.pos // 5), {S.top('inside', 'h30', 30)},
    ranked AS (SELECT 'bm25_sentence' AS retriever, * FROM b30 UNION ALL SELECT 'dense_sentence', * FROM t30 UNION ALL SELECT 'bm25_hierarchical', * FROM h30),
    want AS (SELECT DISTINCT g.row_id, g.matched_sentence_id AS sid, m.retriever FROM gold g JOIN eligible e USING (row_id),
             (SELECT unnest(['bm25_sentence', 'dense_sentence', 'bm25_hierarchical']) AS retriever) m WHERE e.is_eligible),
    cov AS (SELECT w.row_id, w.retriever, count(*) AS gold_sentence_count, min(r.rank) AS first_covering_rank,
            {', '.join(f"count(*) FILTER (WHERE r.rank <= {k}) / count(*) AS gold_sentence_coverage_at_{k}, count(*) FILTER (WHERE r.rank <= {k}) = count(*) AS covered_at_{k}" for k in _CUTS)}
            FROM want w LEFT JOIN ranked r ON r.query_id = w.row_id AND r.retriever = w.retriever AND r.doc || ':s:' || r.pos = w.sid GROUP BY ALL)"""


@query("coverage_at_k", f"{_covered_sql()} SELECT * FROM cov")
def coverage_at_k(spark, folder):
    return _covered(spark, folder).withColumn("first_covering_rank", F.col("first_covering_rank").cast(_BIG))


@query(
    "retrieval_summary",
    f"""{_covered_sql()} SELECT retriever, count(*) AS rows, {', '.join(f"round(avg(gold_sentence_coverage_at_{k}), 6) AS gold_sentence_coverage_at_{k}, round(avg(covered_at_{k}::INT), 6) AS all_gold_covered_rate_at_{k}" for k in _CUTS)}
        FROM cov GROUP BY retriever UNION ALL SELECT 'unused', 0, 0, 0, 0, 0, 0, 0""",
)
def retrieval_summary(spark, folder):
    summary = C.summarize_methods(_covered(spark, folder), [*_METHODS, "unused"], _CUTS)
    return summary.select("retriever", "rows", *[F.round(c, 6).alias(c) for c in summary.columns if c not in ("retriever", "rows")])


def _pivot_sql() -> str:
    order = "array_position(['bm25_sentence', 'dense_sentence', 'bm25_hierarchical'], retriever)"
    parts = ["row_id", "max(gold_sentence_count) AS gold_sentence_count", "count(*) AS retriever_count", "min(first_covering_rank) AS best_first_covering_rank"]
    for k in (10, 30):
        c = f"gold_sentence_coverage_at_{k}"
        parts += [
            f"max({c}) AS best_{c}", f"bool_or(covered_at_{k}) AS any_covered_at_{k}",
            f"first(retriever ORDER BY {c} DESC, {order}) AS best_retriever_at_{k}",
        ]
    for m in sorted(_METHODS):
        for k in (10, 30):
            parts.append(f"max(gold_sentence_coverage_at_{k}) FILTER (WHERE retriever = '{m}') AS {m}_coverage_at_{k}")
            parts.append(f"bool_or(covered_at_{k}) FILTER (WHERE retriever = '{m}') AS {m}_covered_at_{k}")
        parts.append(f"min(first_covering_rank) FILTER (WHERE retriever = '{m}') AS {m}_first_covering_rank")
    return f"{_covered_sql()} SELECT {', '.join(parts)} FROM cov GROUP BY row_id"


@query("doc_question_pivot", _pivot_sql())
def doc_question_pivot(spark, folder):
    wide = C.summarize_rows(_covered(spark, folder), _METHODS, (10, 30))
    return wide.withColumns({c: F.col(c).cast(_BIG) for c in wide.columns if c.endswith("_rank")})


@query(
    "technique_macro_mean",
    f"""{_covered_sql()}, g AS (SELECT c.retriever, e.question_index, avg(gold_sentence_coverage_at_10) AS a, avg(gold_sentence_coverage_at_30) AS b
        FROM cov c JOIN eligible e USING (row_id) GROUP BY ALL)
        SELECT retriever, count(*) AS groups, round(avg(a), 6) AS at_10, round(avg(b), 6) AS at_30 FROM g GROUP BY retriever""",
)
def macro_mean(spark, folder):
    covered = _covered(spark, folder).withColumn("question_index", F.element_at(F.split("row_id", ":"), 2).cast(_BIG))
    means = C.macro_means(covered, "question_index", (10, 30))
    return means.select(
        "retriever", "groups", F.round("gold_sentence_coverage_at_10", 6).alias("at_10"), F.round("gold_sentence_coverage_at_30", 6).alias("at_30")
    )


@query(
    "delta_to_base",
    f"""{_covered_sql()}, s AS (SELECT retriever, avg(gold_sentence_coverage_at_10) AS v FROM cov GROUP BY retriever)
        SELECT s.retriever, round(s.v, 6) AS value, round(s.v - (SELECT v FROM s WHERE retriever = 'bm25_sentence'), 6) AS delta_to_default,
               CASE WHEN s.retriever = 'bm25_hierarchical' THEN round(s.v - (SELECT v FROM s WHERE retriever = 'bm25_sentence'), 6) END AS delta_to_base FROM s""",
)
def delta_to_base(spark, folder):
    summary = C.summarize_methods(_covered(spark, folder), _METHODS, _CUTS)
    deltas = C.against_base(summary, {"bm25_hierarchical": "bm25_sentence"}, "gold_sentence_coverage_at_10")
    return deltas.select("retriever", *[F.round(c, 6).alias(c) for c in ("value", "delta_to_default", "delta_to_base")])


@query(
    "coverage_of_lists",
    """WITH l AS (SELECT conv_id, list(turn ORDER BY turn) AS r, list(turn % 3 ORDER BY turn) AS g FROM conversations GROUP BY conv_id)
       SELECT conv_id, len(list_distinct(g)) AS gold_sentence_count, len(list_filter(list_distinct(g), lambda x: list_contains(r[1:2], x))) AS covered_sentence_count,
              (SELECT min(list_position(r[1:2], x)) FROM (SELECT unnest(list_filter(list_distinct(g), lambda y: list_contains(r[1:2], y))) AS x)) AS first_covering_rank FROM l""",
)
def coverage_of_lists(spark, folder):
    turns = inputs.table(spark, folder, "conversations")
    pair = F.sort_array(F.collect_list("turn"))  # the turns of one conversation, ordered
    lists = turns.groupBy("conv_id").agg(pair.alias("r")).withColumn("g", F.transform("r", lambda t: t % 3))
    c = lists.select("conv_id", C.coverage_of_lists(F.col("g"), F.col("r"), 2).alias("c"))
    return c.select("conv_id", *[F.col(f"c.{n}").cast(_BIG).alias(n) for n in ("gold_sentence_count", "covered_sentence_count", "first_covering_rank")])


# ---- enrichment -------------------------------------------------------------------------------------------


@query(
    "offline_enrichment",
    f"""WITH t AS (SELECT o_orderpriority AS category, p_name AS question, p_type AS description, p_partkey FROM part JOIN orders ON o_orderkey = p_partkey),
    k AS (SELECT *, {S.words(S.norm("category || ' ' || description || ' the exclusive license'"))} AS w,
                 lower(category || ' ' || question || ' ' || description || ' the exclusive license') AS txt FROM t)
    SELECT p_partkey, 'license; licensed; non-transferable; sublicense; scope' AS with_keyword,
           array_to_string(list_slice(list_filter({S.words(S.norm("category || ' ' || description"))}, lambda x: length(x) > 4), 1, 12), '; ') AS without_keyword FROM k""",
)
def offline_enrichment(spark, folder):
    part, orders = inputs.table(spark, folder, "part"), inputs.table(spark, folder, "orders")
    rows = part.join(orders, part["p_partkey"] == orders["o_orderkey"])
    hint = F.concat("p_type", F.lit(" the exclusive license"))
    return rows.select(
        "p_partkey",
        E.offline_terms("o_orderpriority", "p_name", hint).alias("with_keyword"),
        E.offline_terms("o_orderpriority", "p_name", "p_type").alias("without_keyword"),
    )


@query(
    "text_similarity",
    f"""WITH {S.SENTENCES}, {S.ROWS}, {S.golds()},
    texts AS (SELECT row_id, 0 AS pos, {S.strip('question')} AS text FROM eval_rows WHERE NOT is_impossible
              UNION ALL SELECT row_id, piece_pos + 1, norm FROM gold),
    u AS (SELECT row_id, pos, regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}') AS u FROM texts),
    tok AS (SELECT row_id, pos, list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1])) AS toks FROM u),
    post AS (SELECT row_id, pos, term, count(*) AS tf FROM (SELECT row_id, pos, unnest(toks) AS term FROM tok) GROUP BY ALL),
    n AS (SELECT row_id, count(*) AS n FROM texts GROUP BY ALL),
    w AS (SELECT p.row_id, p.pos, p.term, p.tf * (ln((1 + n.n) / (1.0 + count(*) OVER (PARTITION BY p.row_id, p.term))) + 1) AS w FROM post p JOIN n USING (row_id)),
    norms AS (SELECT row_id, pos, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
    sims AS (SELECT t.row_id, t.pos, coalesce(max(d.dot) / (max(a.norm) * max(b.norm)), 0) AS sim FROM texts t
             LEFT JOIN (SELECT x.row_id, x.pos, sum(x.w * q.w) AS dot FROM w x JOIN w q ON q.row_id = x.row_id AND q.term = x.term AND q.pos = 0 GROUP BY ALL) d
               ON d.row_id = t.row_id AND d.pos = t.pos
             LEFT JOIN norms a ON a.row_id = t.row_id AND a.pos = 0 LEFT JOIN norms b ON b.row_id = t.row_id AND b.pos = t.pos WHERE t.pos > 0 GROUP BY ALL)
    SELECT row_id, round(avg(sim), 6) AS mean_similarity, round(max(sim), 6) AS max_similarity FROM sims GROUP BY row_id""",
)
def text_similarity(spark, folder):
    rows = inputs.evaluation_rows(spark, folder).where(~F.col("is_impossible"))
    golds = G.gold_sentences(rows).groupBy("row_id").agg(F.collect_list("text").alias("golds"))  # sentences of one answer
    asked = rows.select("row_id", F.trim("question").alias("query")).join(golds, "row_id")
    similar = E.text_similarity(asked)
    return similar.select("row_id", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("max_similarity", 6).alias("max_similarity"))


@query("enrichment_eval")
def enrichment_eval(spark, folder):
    """Base against enriched queries, dense and fused, over all eligible rows."""
    stored = inputs.stored_rows(spark, folder)
    rows = stored.withColumn(
        "enriched_query", E.enriched_query("question", E.offline_terms("category", "question", "category_description"))
    )
    return compare_queries(rows, inputs.chunks(spark, folder), _records(spark, folder, stored), index=inputs.index(spark, folder))


# ---- answer scoring ---------------------------------------------------------------------------------------


def _results_sql(name: str, shift: int) -> str:
    n = name
    return f"""
    {n}_src AS (
      SELECT q.conv_id || ':' || q.turn AS id, q.conv_id AS document_row_id, q.turn AS question_index, coalesce(d.lang, '') AS category,
             CASE WHEN coalesce(l.toxic = 1, false) THEN '' ELSE q.text END AS gold, coalesce(a.text, '') AS prediction,
             coalesce(l.quality = 0, false) AS flagged, coalesce(l.toxic = 1, false) AS impossible
      FROM (SELECT * FROM conversations WHERE role = 'user') q
      LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = q.conv_id AND a.turn = q.turn + {1 + 2 * shift}
      LEFT JOIN labels l ON l.doc_id = q.conv_id LEFT JOIN documents d ON d.doc_id = q.conv_id),
    {S.f1_over(f'{n}_src', n)}"""


@query("token_f1", f"WITH {_results_sql('r', 0)} SELECT id AS row_id, round(token_f1, 6) AS token_f1, token_f1 >= 0.5 AS correct_at_0_5 FROM r")
def token_f1(spark, folder):
    return inputs.results(spark, folder).select("row_id", F.round("token_f1", 6).alias("token_f1"), "correct_at_0_5")


@query(
    "multiset_intersect",
    f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
                   WHERE a.role = 'assistant' AND b.role = 'user'),
    x AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest({S.answer_tokens('x')}) AS t FROM p) GROUP BY ALL),
    y AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest({S.answer_tokens('y')}) AS t FROM p) GROUP BY ALL)
    SELECT p.conv_id, p.turn, coalesce(sum(z.c), 0)::BIGINT AS shared
    FROM p LEFT JOIN (SELECT conv_id, turn, least(x.c, y.c) AS c FROM x JOIN y USING (conv_id, turn, t)) z ON z.conv_id = p.conv_id AND z.turn = p.turn
    GROUP BY ALL""",
)
def multiset(spark, folder):
    from spanlake.functions.text import answer_tokens, multiset_overlap

    pairs = inputs.turn_pairs(spark, folder).select("conv_id", "turn", answer_tokens("predicted_answer").alias("x"), answer_tokens("gold_text").alias("y"))
    return pairs.select("conv_id", "turn", multiset_overlap(F.col("x"), F.col("y")).cast(_BIG).alias("shared"))


_DETECT = """count(*) FILTER (WHERE impossible) AS gold_no_answer_count, count(*) FILTER (WHERE NOT impossible) AS gold_answer_count,
    count(*) FILTER (WHERE flagged OR no_answer_text) AS predicted_no_answer_count,
    round(100.0 * count(*) FILTER (WHERE impossible AND (flagged OR no_answer_text)) / nullif(count(*) FILTER (WHERE impossible), 0), 6) AS no_answer_detection_accuracy,
    round(100.0 * count(*) FILTER (WHERE NOT impossible AND NOT (flagged OR no_answer_text)) / nullif(count(*) FILTER (WHERE NOT impossible), 0), 6) AS answer_detection_accuracy,
    round(100.0 * count(*) FILTER (WHERE impossible = (flagged OR no_answer_text)) / count(*), 6) AS detection_accuracy"""


def _round_all(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_ACCURACIES = ("no_answer_detection_accuracy", "answer_detection_accuracy", "detection_accuracy")


@query("detection_metrics", f"WITH {_results_sql('r', 0)} SELECT category, {_DETECT} FROM r GROUP BY category")
def detection_metrics(spark, folder):
    return _round_all(R.detection(inputs.results(spark, folder), "category"), *_ACCURACIES)


@query(
    "per_category_summary",
    f"""WITH {_results_sql('r', 0)} SELECT CASE WHEN grouping(category) = 0 THEN 'group' ELSE 'overall' END AS level, question_index, category,
        count(*) AS count, round(100 * avg(token_f1), 6) AS mean_token_f1, round(100 * avg((token_f1 >= 0.5)::INT), 6) AS correct_at_0_5, {_DETECT}
        FROM r GROUP BY GROUPING SETS ((), (question_index, category))""",
)
def per_category(spark, folder):
    return _round_all(R.summarize(inputs.results(spark, folder)), "mean_token_f1", "correct_at_0_5", *_ACCURACIES)


@query(
    "baseline_compare",
    f"""WITH {_results_sql('r', 0)}, {_results_sql('b', 1)}, j AS (SELECT r.category, r.question_index, r.token_f1 AS c, b.token_f1 AS o, (r.token_f1 >= 0.5)::INT AS cc, (b.token_f1 >= 0.5)::INT AS oc
        FROM r JOIN b USING (id))
        SELECT CASE WHEN grouping(category) = 0 THEN 'group' ELSE 'overall' END AS level, question_index, category, count(*) AS matched_examples,
        round(100 * avg(o), 6) AS baseline_mean_token_f1, round(100 * avg(c), 6) AS candidate_mean_token_f1, round(100 * avg(c - o), 6) AS mean_token_f1_delta,
        round(100 * avg(oc), 6) AS baseline_correct_at_0_5, round(100 * avg(cc), 6) AS candidate_correct_at_0_5, round(100 * avg(cc - oc), 6) AS correct_at_0_5_delta
        FROM j GROUP BY GROUPING SETS ((), (question_index, category))""",
)
def baseline_compare(spark, folder):
    compared = R.compare_to_baseline(inputs.results(spark, folder), inputs.results(spark, folder, shift=1))
    return _round_all(compared, *[c for c in compared.columns if c not in ("level", "question_index", "category", "matched_examples")])


@query(
    "evaluation_page_rows",
    f"""WITH {_results_sql('r', 0)}, {_results_sql('b', 1)}, s AS (SELECT question_index, category, count(*) AS n, 100 * avg(token_f1) AS m FROM r GROUP BY ALL)
        SELECT r.id AS row_id, s.n AS category_count, round(s.m, 6) AS category_mean_token_f1, round(b.token_f1, 6) AS baseline_token_f1,
               round(r.token_f1 - b.token_f1, 6) AS token_f1_delta
        FROM r JOIN s ON s.question_index = r.question_index AND s.category = r.category LEFT JOIN b ON b.id = r.id""",
)
def evaluation_page_rows(spark, folder):
    """Rows of a run with their category's size and mean, and the shifted answers as the baseline; rows it lacks keep nulls."""
    page = R.page_rows(inputs.results(spark, folder), inputs.results(spark, folder, shift=1))
    return _round_all(
        page.select("row_id", "category_count", "category_mean_token_f1", "baseline_token_f1", "token_f1_delta"),
        "category_mean_token_f1", "baseline_token_f1", "token_f1_delta",
    )


@query(
    "align_runs",
    f"""WITH {_results_sql('r', 0)}, {_results_sql('b', 1)}, s AS (SELECT 'run_a' AS label, category, avg(token_f1) AS v FROM r GROUP BY ALL
        UNION ALL SELECT 'run_b', category, avg(token_f1) FROM b GROUP BY ALL)
        SELECT category, round(max(v) FILTER (WHERE label = 'run_a'), 6) AS run_a, round(max(v) FILTER (WHERE label = 'run_b'), 6) AS run_b FROM s GROUP BY category""",
)
def align_runs(spark, folder):
    runs = [inputs.results(spark, folder, i).groupBy("category").agg(F.avg("token_f1").alias("mean_token_f1")) for i in (0, 1)]
    both = runs[0].withColumn("label", F.lit("run_a")).unionByName(runs[1].withColumn("label", F.lit("run_b")))
    return _round_all(R.align_runs(both, ["run_a", "run_b"]), "run_a", "run_b")


@query(
    "best_run_per_category",
    f"""WITH {_results_sql('r', 0)}, {_results_sql('b', 1)}, s AS (SELECT 'run_a' AS label, category, round(avg(token_f1), 6) AS v FROM r GROUP BY ALL
        UNION ALL SELECT 'run_b', category, round(avg(token_f1), 6) FROM b GROUP BY ALL)
        SELECT category, first(label ORDER BY v DESC, label) AS best_label, max(v) AS best_value FROM s GROUP BY category""",
)
def best_run(spark, folder):
    runs = [
        inputs.results(spark, folder, i).groupBy("category").agg(F.round(F.avg("token_f1"), 6).alias("value")).withColumn("label", F.lit(n))
        for i, n in ((0, "run_a"), (1, "run_b"))
    ]
    return C.best_per_row(runs[0].unionByName(runs[1]), "category", "value", "label", "label")


_ERRORS = f"""{_results_sql('r', 0)},
    w AS (SELECT *, {S.strip('prediction')} AS p, len({S.words(S.strip('prediction'))}) AS pw, len({S.words('gold')}) AS gw,
                 trim(regexp_replace(lower({S.strip('prediction')}), '[^a-z0-9_]+', ' ', 'g')) AS marker FROM r WHERE NOT token_f1 >= 0.5),
    errs AS (SELECT *, CASE
        WHEN lower(p) IN ('yes', 'no') AND NOT impossible THEN 'classification_instead_of_span'
        WHEN flagged AND NOT impossible THEN 'false_no_answer'
        WHEN impossible AND marker NOT IN ('', 'no answer', 'none', 'not found', 'n/a', 'na', 'not applicable', 'no_answer', 'noanswer') THEN 'false_positive_span'
        WHEN token_f1 = 0 THEN CASE WHEN impossible THEN 'format_error' ELSE 'false_positive_span' END
        WHEN gw > 0 AND pw > 3 * gw THEN 'overlong_span' WHEN token_f1 > 0 AND token_f1 < 0.5 THEN 'partial_span' ELSE 'format_error' END AS failure_mode FROM w)"""


@query("failure_modes", f"WITH {_ERRORS} SELECT id AS row_id, category, failure_mode, round(token_f1, 6) AS token_f1 FROM errs")
def failure_modes(spark, folder):
    return X.error_rows(inputs.results(spark, folder)).select("row_id", "category", "failure_mode", F.round("token_f1", 6).alias("token_f1"))


@query(
    "main_failure_mode",
    f"""WITH {_ERRORS}, h AS (SELECT category, failure_mode, count(*) AS rows, min(id) AS f FROM errs GROUP BY ALL)
        SELECT category, failure_mode AS main_failure_mode, rows FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rows DESC, f) AS n FROM h) WHERE n = 1""",
)
def main_failure(spark, folder):
    return X.main_failure_mode(X.error_rows(inputs.results(spark, folder)))


@query("failure_histogram", f"WITH {_ERRORS} SELECT category, failure_mode, count(*) AS rows, min(id) AS first_row FROM errs GROUP BY ALL")
def failure_histogram(spark, folder):
    return X.failure_histogram(X.error_rows(inputs.results(spark, folder)))


@query(
    "stratified_split",
    f"""WITH {_ERRORS}, z AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) AS p, count(*) OVER (PARTITION BY category) AS n FROM errs)
        SELECT category, id AS row_id, CASE WHEN n <= 40 THEN CASE WHEN p <= greatest(1, n // 2) THEN 'generator_dev' ELSE 'evaluator_dev' END
               WHEN p <= 20 THEN 'generator_dev' WHEN p <= 40 THEN 'evaluator_dev' ELSE 'holdout_eval' END AS split FROM z""",
)
def split(spark, folder):
    return stratified_split(X.error_rows(inputs.results(spark, folder))).select("category", "row_id", "split")


@query(
    "format_profile",
    f"""WITH {S.ROWS}, p AS (SELECT r.category, r.is_impossible, {S.strip('r.answer')} AS a, d.text FROM eval_rows r JOIN documents d ON d.doc_id = r.document_row_id),
    f AS (SELECT category, is_impossible, a IS NOT NULL AND a <> '' AS has, lower(a) IN ('yes', 'no') AS label, contains(text, a) AS verbatim,
                 len(list_filter(string_split(regexp_replace(a, '([.!?]){S.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda u: u <> '')) AS units FROM p)
    SELECT category, bool_or(is_impossible OR NOT has) AS allows_no_answer,
           CASE WHEN count(*) FILTER (WHERE has) = 0 THEN 'no_answer_only' WHEN bool_and(label) FILTER (WHERE has) THEN 'label_only'
                WHEN bool_or(label) FILTER (WHERE has) THEN 'mixed' ELSE 'verbatim_contract_span' END AS gold_answer_type,
           CASE WHEN count(*) FILTER (WHERE has) = 0 THEN 'none' WHEN count(DISTINCT units > 1) FILTER (WHERE has) > 1 THEN 'mixed'
                WHEN bool_or(units > 1) FILTER (WHERE has) THEN 'multi_sentence' ELSE 'single_sentence' END AS typical_span_shape,
           count(*) FILTER (WHERE has AND verbatim) AS exact_contract_match_count, count(*) FILTER (WHERE has) AS contract_match_check_count
    FROM f GROUP BY category""",
)
def format_profile(spark, folder):
    rows = inputs.evaluation_rows(spark, folder).withColumns(
        {"golds": G.raw_answer_texts(F.col("answers")), "gold_marked_impossible": F.col("is_impossible"), "answer_format": F.lit("")}
    )
    return X.format_profiles(rows, inputs.documents(spark, folder)).select(
        "category", "allows_no_answer", "gold_answer_type", "typical_span_shape", "exact_contract_match_count", "contract_match_check_count"
    )
