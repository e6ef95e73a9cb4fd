import json

import pytest
from pyspark.sql import functions as F

from spanlake.operators import coverage as C
from spanlake.operators import enrichment as E
from spanlake.operators import gold as G
from spanlake.operators import scoring as R
from spanlake.operators.failures import error_rows, is_complete_sentence, main_failure_mode, match_positions, review_patches
from spanlake.operators.incremental import merge_results, pending
from spanlake.operators.sampling import sample_ids, stratified_split
from spanlake.operators.segment import sentence_spans


def eligible(spark, text, answers, impossible=False):
    rows = spark.createDataFrame([("1:0", 1, 0, "c", [(a,) for a in answers], impossible)], "row_id string, document_row_id int, question_index int, category string, answers array<struct<text:string>>, is_impossible boolean")
    docs = spark.createDataFrame([(1, text)], "document_row_id int, text string")
    return G.eligibility(rows, sentence_spans(docs), docs).first()


def test_eligibility_cases(spark):
    text = "First sentence here. Assignment requires written consent.\nLast one."
    whole = eligible(spark, text, ["Assignment requires written consent."])
    assert whole.is_eligible and whole.matched_sentence_ids == ["1:s:1"] and whole.reason is None
    part = eligible(spark, text, ["requires written"])
    assert (part.is_eligible, part.reason) == (False, "partial_span_inside_sentence")
    assert (part.per_row_gold_sentence_contract_coverage, part.per_row_raw_contract_sentence_coverage) == (0.0, 1.0)
    assert eligible(spark, text, ["Absent words."]).reason == "gold_answer_not_found"
    assert eligible(spark, text, [" ", ""]).reason == "gold_answer_not_found"
    assert eligible(spark, text, ["x"], impossible=True).reason == "no_answer_row"
    assert eligible(spark, "One line\ncontinues here.", ["line\ncontinues"]).gold_sentence_count == 1


def test_coverage(spark):
    golds = spark.createDataFrame([("r", ["s2", "s4", "s2"]), ("z", ["s9"])], "row_id string, gold_ids array<string>")
    retrieved = spark.createDataFrame([("r", "m", 1, ["s0"]), ("r", "m", 2, ["s2"]), ("r", "m", 3, ["s3"])], "row_id string, retriever string, rank int, sentence_ids array<string>")
    rows = {(r.row_id, r.retriever): r for r in C.coverage(golds, retrieved, ["m", "n"], (1, 3)).collect()}
    assert len(rows) == 4
    hit = rows["r", "m"]
    assert (hit.gold_sentence_count, hit.gold_sentence_coverage_at_3, hit.covered_at_3, hit.first_covering_rank) == (2, 0.5, False, 2)
    assert rows["z", "n"].gold_sentence_coverage_at_3 == 0.0
    as_list = lambda v: F.array(*[F.lit(x) for x in v])
    c = spark.range(1).select(C.coverage_of_lists(as_list([2, 4]), as_list([0, 2, 3]), 3).alias("c")).first().c
    assert (c.covered_sentence_count, c.gold_sentence_coverage, c.all_gold_sentences_covered, c.first_covering_rank) == (1, 0.5, False, 2)


@pytest.mark.parametrize(
    "prediction, golds, score",
    [("The cat", ["cat!"], 1.0), ("cat dog", ["cat"], 2 / 3), ("NO_ANSWER", [], 1.0), ("text", [], 0.0), ("", ["x"], 0.0), ("a a a", ["the"], 1.0), ("a a b", ["the"], 0.0), ("x x", ["x", "x x"], 0.8)],
)
def test_token_f1(spark, prediction, golds, score):
    rows = spark.createDataFrame([(prediction, golds)], "p string, g array<string>")
    assert R.with_token_f1(rows, "p", F.col("g")).first().token_f1 == pytest.approx(score)


def results(spark, rows):
    base = [(f"{d}:{q}", d, q, c, g, p, m, i, f, f >= 0.5) for d, q, c, g, p, m, i, f in rows]
    return spark.createDataFrame(base, "row_id string, document_row_id int, question_index int, category string, golds array<string>, predicted_answer string, predicted_marked_impossible boolean, gold_marked_impossible boolean, token_f1 double, correct_at_0_5 boolean")


def test_detection_and_baseline(spark):
    rows = results(spark, [(1, 0, "a", [], "NO_ANSWER", True, True, 1.0), (2, 0, "a", [], "words", False, True, 0.0), (3, 0, "a", ["x"], "x", False, False, 1.0), (4, 0, "a", ["x"], "y", False, False, 0.0)])
    got = R.detection(rows, "category").first()
    assert (got.gold_no_answer_count, got.gold_answer_count) == (2, 2)
    assert (got.no_answer_detection_accuracy, got.answer_detection_accuracy, got.detection_accuracy) == (50.0, 100.0, 75.0)
    old = results(spark, [(1, 0, "a", ["x"], "y", False, False, 0.25)])
    new = results(spark, [(1, 0, "a", ["x"], "x", False, False, 0.75), (9, 9, "b", ["x"], "x", False, False, 1.0)])
    overall = R.compare_to_baseline(new, old).where("level = 'overall'").first()
    assert (overall.matched_examples, overall.mean_token_f1_delta, overall.correct_at_0_5_delta) == (1, 50.0, 100.0)
    with pytest.raises(ValueError):
        R.join_baseline(new.drop("category"), old)


def test_failures_and_split(spark):
    rows = [(i, 0, "big", ["x"], "yes", False, False, 0.0) for i in range(45)] + [(i, 1, "small", ["a b"], "", True, False, 0.0) for i in range(3)] + [(7, 2, "one", [], "words", False, True, 0.0)]
    errors = error_rows(results(spark, rows))
    modes = {r.category: r.main_failure_mode for r in main_failure_mode(errors).collect()}
    assert modes == {"big": "classification_instead_of_span", "small": "false_no_answer", "one": "false_positive_span"}
    split = {}
    for r in stratified_split(errors).collect():
        split.setdefault((r.category, r.split), []).append(r.row_id)
    ids = sorted(f"{i}:0" for i in range(45))
    assert sorted(split["big", "generator_dev"]) == ids[:20] and sorted(split["big", "holdout_eval"]) == sorted(ids[40:])
    assert len(split["small", "generator_dev"]) == 1 and len(split["small", "evaluator_dev"]) == 2 and split["one", "generator_dev"] == ["7:2"]


def test_review_and_span_checks(spark):
    base = ("c", "p", "quote", True, False, "Yes/No", 1, 10, 0)
    schema = "category string, current_prompt string, candidate_prompt string, requires_verbatim_contract_span boolean, yes_no_label_only boolean, csv_answer_format string, loop_index int, evaluator_examples int, false_positives int"
    rows = [base, (*base[:6], 3, 10, 0), ("c", "p", "exact span, never yes/no", True, False, "Yes/No", 1, 40, 1)]
    got = [(r.decision, round(r.generalization_score, 6)) for r in review_patches(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("revise", 0.55), ("reject", 0.55), ("accept", 0.75)]
    text = "Start. It is done. aXaXa (x) ends"
    check = lambda a: spark.range(1).select(is_complete_sentence(F.lit(a), F.lit(text))).first()[0]
    assert check("Start.") and not check("is done.") and not check("It is")
    assert spark.range(1).select(match_positions(F.lit("aXa"), F.lit(text))).first()[0] == 2


def test_enrichment(spark):
    term = lambda *v: spark.range(1).select(E.offline_terms(*[F.lit(x) for x in v])).first()[0]
    assert term("Governing Law", "which?", "x") == "governed by; laws of; jurisdiction; venue"
    assert term("Minimum Commitment", "q", "Some minimum order of things") == "Minimum; Commitment; minimum; order; things".replace("order; ", "order; ")
    rows = spark.createDataFrame([(1, "b", "q1", "d", 5), (1, "a", "q0", "d", 2)], "question_index int, category string, question string, category_description string, document_row_id int")
    got = E.enrich_questions(rows).first()
    assert got.category == "a" and got.enriched_query.startswith("q0 Contract words to look for:") and len(got.cache_key) == 64
    cache = spark.createDataFrame([(got.cache_key, "own terms", "model")], "cache_key string, enrichment_terms string, provider string")
    cached = E.enrich_questions(rows, cache).first()
    assert (cached.status, cached.enriched_query) == ("cached", "q0 Contract words to look for: own terms")


def test_merge_pending_sample(spark):
    a = spark.createDataFrame([("1:0", 0.1, 0), ("1:1", 0.2, 1)], "row_id string, f double, seq int")
    b = spark.createDataFrame([("1:0", 0.5, 0), ("1:0", 0.75, 1)], "row_id string, f double, seq int")
    assert {r.row_id: r.f for r in merge_results(a, b).collect()} == {"1:0": 0.75, "1:1": 0.2}
    assert [r.row_id for r in pending(a, b).collect()] == ["1:1"]
    import random

    ids = spark.range(510).select((F.col("id") * 3 + 5).alias("document_row_id"))
    drawn = [r.document_row_id for r in sample_ids(ids, 50, 42).orderBy("selection_pos").collect()]
    assert drawn == [i * 3 + 5 for i in random.Random(42).sample(range(510), k=50)]
    with pytest.raises(ValueError):
        sample_ids(ids, 511, 1)
    assert json.loads(spark.range(1).select(F.to_json(R.parse_gold_answers(F.lit('["a"]')))).first()[0]) == ["a"]


def test_flags_of_all_kinds(spark):
    from pyspark.sql import functions as F

    from spanlake.operators.incremental import require_complete
    from spanlake.operators.scoring import parse_answer, parse_bool

    numbers = spark.createDataFrame([(1.0, 2), (0.0, 0)], "x double, n int").select(parse_bool("x").alias("x"), parse_bool("n").alias("n"))
    assert [tuple(r) for r in numbers.collect()] == [(True, True), (False, False)]
    said = ['{"answer": "a", "marked_impossible": "yes"}', '```json\n{"answer": "b", "marked_impossible": false}\n```', '{"answer": "c", "marked_impossible": true}', "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", parse_answer(F.col("t")).alias("p")).orderBy("i").collect()
    assert [(r.p.answer, r.p.marked_impossible) for r in rows] == [("a", True), ("b", False), ("c", True), ("plain", False)]
    results = spark.createDataFrame([("1", None), ("2", "x")], "row_id string, value string")
    assert require_complete(results, results.select("row_id")).count() == 2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1000])
def test_permutation_is_exact_and_draws_are_disjoint(spark, n):
    from spanlake.operators.sampling import disjoint_draws, permuted_ids, share_split

    ids = spark.range(n).select((F.col("id") * 3 - 5).alias("document_row_id"))
    places = {seed: [r.draw_pos for r in permuted_ids(ids, seed).orderBy("document_row_id").collect()] for seed in (1, 2)}
    assert all(sorted(p) == list(range(n)) for p in places.values()) and (n < 50 or places[1] != places[2])
    sizes = [n // 2, n // 4]
    rows = disjoint_draws(ids, sizes, 1).collect()
    assert len({r.document_row_id for r in rows}) == len(rows) == sum(sizes)
    assert [sorted(r.selection_pos for r in rows if r.draw == d) for d in (0, 1)] == [list(range(s)) for s in sizes]
    assert sum(r.split == "train" for r in share_split(ids, 0.6, 1).collect()) == int(n * 0.6)
    with pytest.raises(ValueError, match="exceed"):
        disjoint_draws(ids, [n, 1], 1)


def test_only_sentences_that_equal_a_golden_one_are_grouped(spark, monkeypatch):
    from spanlake.operators import gold

    docs = spark.createDataFrame([(1, "One fish. Two fish. One fish."), (2, "One fish. Blue fish.")], "document_row_id long, text string")
    spans = spark.createDataFrame([(1, 0, "One fish."), (1, 1, "Two fish."), (1, 2, "One fish."), (2, 0, "One fish."), (2, 1, "Blue fish.")], "document_row_id long, sentence_index int, normalized_text string")
    golds = spark.createDataFrame([("a", 1, 0, 0, "One fish.", "One fish."), ("b", 2, 0, 0, "Red fish.", "Red fish.")], "row_id string, document_row_id long, answer_pos int, piece_pos int, text string, normalized_text string")
    seen, whole = [], gold.first_sentences
    monkeypatch.setattr(gold, "first_sentences", lambda rows: seen.extend((r.document_row_id, r.sentence_index) for r in rows.collect()) or whole(rows))
    found = {r.row_id: r.matched_sentence_id for r in gold.match_gold(golds, spans, docs).collect()}
    assert sorted(seen) == [(1, 0), (1, 2)] and found == {"a": "1:s:0", "b": None}


def test_evaluation_rows_are_found_once_for_coverage(spark, monkeypatch):
    from spanlake.registry import evaluation, inputs

    calls, given = [], object()
    monkeypatch.setattr(inputs, "evaluation_rows", lambda *a: calls.append(a) or given)
    monkeypatch.setattr(inputs, "cut_lineage", lambda rows: rows)
    for name in ("spans", "documents", "chunks", "index"):
        monkeypatch.setattr(inputs, name, lambda *a: None)
    monkeypatch.setattr(evaluation.G, "eligibility", lambda rows, *a: rows)
    monkeypatch.setattr(evaluation, "benchmark_methods", lambda rows, chunks, records, *a, **b: (rows, records))
    assert evaluation._covered(spark, "x") == (given, given) and len(calls) == 1
