import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanlake import cli
from spanlake.operators.sampling import select_rows
from spanlake.operators.scoring import RESULT_COLUMNS
from spanlake.operators.segment import sentence_spans
from spanlake.plans import answers, prompt_improvement
from spanlake.plans.stores import load_or_build
from spanlake.sources import corpus as S
from spanlake.sources import results as L
from spanlake.streaming import result_log


@pytest.fixture(scope="module")
def tables(spark, corpus):
    return S.load_tables(spark, corpus["corpus"], corpus["categories"])


def test_corpus_tables(spark, corpus, tables):
    rows = tables["questions"].orderBy("document_row_id", "question_index").collect()
    assert [(r.document_row_id, r.question_index, r.answers_len, r.is_impossible) for r in rows][2:4] == [(1, 0, 1, False), (1, 1, 2, False)]
    assert rows[0].category == "Anti-Assignment" and rows[0].category_description == "May it be assigned, or not?"
    assert rows[1].answer_format == "Name of state" and rows[1].category_group == "-"
    contracts = tables["contracts"].orderBy("document_row_id").collect()
    assert [c.paragraphs_len for c in contracts] == [1, 1, 1] and contracts[2].context == corpus["texts"][2]
    assert S.document_texts(tables["contracts"]).where("document_row_id = 0").first().title == "Contract 0"
    swapped = tables["questions"].select("document_row_id", "paragraph_index", (1 - F.col("question_index")).alias("question_index"), "question")
    with pytest.raises(ValueError):
        S.require_question_order(swapped, S.read_categories(spark, corpus["categories"]))
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        S.lookup_join(spark.createDataFrame([(1,)], "q int"), twice, "q", "k").collect()


def test_other_corpus_shapes(spark, tmp_path):
    record = {"title": "t", "paragraphs": None}
    (tmp_path / "one.json").write_text(json.dumps(record))
    (tmp_path / "list.json").write_text(json.dumps([record, {"title": "u", "paragraphs": []}]))
    one = S.contracts_from_records(S.read_corpus(spark, str(tmp_path / "one.json"))).collect()
    assert [(c.document_row_id, c.title, c.paragraphs_len, c.context) for c in one] == [(0, "t", 0, None)]
    many = S.contracts_from_records(S.read_corpus(spark, str(tmp_path / "list.json")))
    assert S.questions_from_paragraphs(S.paragraphs_from_contracts(many)).count() == 0


def test_every_record_of_every_corpus_shape_has_its_own_id(spark, tmp_path):
    records = [{"title": f"t{i}", "paragraphs": []} for i in range(7)]
    (tmp_path / "list.json").write_text(json.dumps(records[:3], indent=1))
    (tmp_path / "lines.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "a.json").write_text(json.dumps({"data": records[:2]}))
    (tmp_path / "folder" / "b.json").write_text(json.dumps({"data": records[2:5]}))
    spark.read.json(str(tmp_path / "lines.jsonl"), schema=S.RECORD_SCHEMA).write.parquet(f"file://{tmp_path}/c.parquet")
    for name, n in (("list.json", 3), ("lines.jsonl", 7), ("folder", 5), ("c.parquet", 7)):
        rows = S.contracts_from_records(S.read_corpus(spark, f"file://{tmp_path}/{name}")).collect()
        assert sorted((r.document_row_id, r.title) for r in rows) == [(i, f"t{i}") for i in range(n)], name


def test_splits_and_prompts_as_they_are_written(spark, tmp_path):
    place = f"file://{tmp_path}"
    spark.createDataFrame([("train", "1:0"), ("holdout", "2:0"), ("holdout", "2:1")], "split string, row_id string").write.partitionBy("split").json(f"{place}/splits")
    assert sorted(r.row_id for r in L.read_split_ids(spark, f"{place}/splits:holdout").collect()) == ["2:0", "2:1"]
    spark.createDataFrame([("A", "ask A", "A_SYSTEM_PROMPT")], "category string, prompt string, name string").write.json(f"{place}/prompts")
    assert [tuple(r) for r in L.read_prompts(spark, f"{place}/prompts").collect()] == [("A", "ask A")]
    (tmp_path / "p.json").write_text(json.dumps({"B": "ask B"}))
    assert [tuple(r) for r in L.read_prompts(spark, f"{place}/p.json").collect()] == [("B", "ask B")]


def test_layout_keeps_uris():
    from spanlake.sinks.tables import output_layout

    assert output_layout("s3a://bucket/out", "r")["results"] == "s3a://bucket/out/r/results"
    assert output_layout("s3a://bucket/out/", "r")["html"] == "s3a://bucket/dashboards/r.html"


def test_selection_and_splits(spark, tables, tmp_path):
    chosen = spark.createDataFrame([(0, 0), (1, 1)], "document_row_id int, selection_pos int")
    assert select_rows(tables["questions"], chosen).count() == 4
    (tmp_path / "s.json").write_text(json.dumps({"splits": {"holdout": ["1:0", "9:9"]}}))
    ids = L.read_split_ids(spark, f"{tmp_path}/s.json:holdout")
    assert [r.row_id for r in select_rows(tables["questions"], chosen, split_ids=ids).collect()] == ["1:0"]
    with pytest.raises(KeyError):
        L.read_split_ids(spark, f"{tmp_path}/s.json:other")
    with pytest.raises(ValueError):
        select_rows(tables["questions"], chosen, split_ids=spark.createDataFrame([("9:9",)], "row_id string"))


def test_retrieval_command(spark, corpus, tmp_path):
    args = ["retrieval", "--corpus", corpus["corpus"], "--categories", corpus["categories"], "--contract-ids", "0,1,2", "--output-dir", str(tmp_path / "out"),
            "--retrievers", "bm25_sentence,bm25_legal_recursive,bm25_hierarchical"]
    summary = cli.retrieval(spark, cli.parser().parse_args(args))
    assert summary["eligibility"]["rows_total"] == 6 and summary["eligibility"]["eligible_rows"] == 1
    ranking = {r["retriever"]: r for r in summary["ranking"]}
    assert ranking["bm25_sentence"]["rows"] == 1 and ranking["bm25_sentence"]["gold_sentence_coverage_at_30"] == 1.0
    page = (tmp_path / "dashboards" / "retrieval.html").read_text()
    assert "eligibility by question" in page and "enrichment effect" in page


def test_answer_runs_resume_and_log(spark, tables, tmp_path):
    rows = select_rows(tables["questions"], tables["contracts"])
    documents = S.document_texts(tables["contracts"])
    first = answers.run(rows.where("question_index = 0"), documents, str(tmp_path / "o"), "m")
    assert first["count"] == 3 and first["mean_token_f1"] == 100.0 and first["no_answer_detection_accuracy"] == 100.0
    calls = spark.sparkContext.accumulator(0)

    def complete(system, text):
        calls.add(1)
        assert "NO_ANSWER" in system and "Contract:" in text
        return '{"reasoning": "r", "answer": "The laws of Texas apply to this contract.", "marked_impossible": false}'

    summary = answers.run(rows, documents, str(tmp_path / "o"), "m", predict=lambda r: answers.model_predictions(r, complete, 2))
    assert calls.value == 3 and summary["count"] == 6  # only the three rows without a result were asked
    log = L.read_result_log(spark, str(tmp_path / "o" / "m" / "results_log"), rows, "m")
    assert log.count() == 6 and log.columns == list(RESULT_COLUMNS)
    saved = L.read_results_csv(spark, str(tmp_path / "o" / "m" / "results"))
    assert saved.where("row_id = '1:1'").first().token_f1 == pytest.approx(2 * 8 / (8 + 12), abs=0.2)
    table = cli.compare_runs(cli.parser().parse_args(["compare-runs", str(tmp_path / "o" / "m" / "summary.json"), "--label", "m"]))
    assert "Governing Law" in table and table.splitlines()[1].startswith("overall")


def test_variants_command(spark, corpus, tmp_path):
    args = ["answers", "--corpus", corpus["corpus"], "--categories", corpus["categories"], "--contract-ids", "0", "--question-indices", "1",
            "--compare-variants", "--output-dir", str(tmp_path / "out")]
    got = cli.answers(spark, cli.parser().parse_args(args))["variants"]
    assert len(got) == 10 and all(v["mean_token_f1"] == 1.0 for v in got)
    assert {"raw_q / raw_ctx", "enriched_v1 / rag_hier_dense"} <= {v["variant_name"] for v in got}


def test_prompt_improvement(spark, tables, tmp_path):
    rows = select_rows(tables["questions"], tables["contracts"])
    documents = S.document_texts(tables["contracts"])
    guess = lambda r: r.withColumns({"predicted_answer": F.lit("yes"), "predicted_marked_impossible": F.lit(False)})
    answers.run(rows, documents, str(tmp_path / "o"), "m", predict=guess)
    results = L.read_review_csv(spark, str(tmp_path / "o" / "m" / "results"))
    prompts = spark.createDataFrame([("Anti-Assignment", "Old prompt.")], "category string, prompt string")
    summary = prompt_improvement.run(results, documents, prompts, str(tmp_path / "p"))
    assert summary["categories"] == 2 and summary["decisions"] == {"accept": 2}
    status = L.read_category_status(spark, f"{tmp_path}/p/v2/rows_status").collect()
    assert {s.category: s.main_failure_mode for s in status} == {c: "classification_instead_of_span" for c in ("Anti-Assignment", "Governing Law")}
    assert all("exact span" in s.candidate_prompt for s in status)
    assert prompt_improvement.run(results, documents, prompts, str(tmp_path / "p"))["categories"] == 0  # all settled


def test_streamed_log_is_tolerant_and_last_write_wins(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda row, f1: json.dumps({"model_id": "m", "row_id": row, "token_f1": f1})
    (log / "a.json").write_text("\n".join([line("1:0", 0.1), "{broken", "", line("1:1", 0.2), line("1:0", 0.3)]))
    target, state = str(tmp_path / "table"), str(tmp_path / "state")
    result_log.apply_log(result_log.read_log(spark, str(log)), target, state).awaitTermination(120)
    assert {r.row_id: r.token_f1 for r in result_log.current(spark, target).collect()} == {"1:0": 0.3, "1:1": 0.2}
    time.sleep(1.1)
    (log / "b.json").write_text(line("1:1", 0.9))
    result_log.apply_log(result_log.read_log(spark, str(log)), target, state).awaitTermination(120)
    assert {r.row_id: r.token_f1 for r in result_log.current(spark, target).collect()} == {"1:0": 0.3, "1:1": 0.9}
    work = spark.createDataFrame([("1:0",), ("2:0",)], "row_id string")
    assert [r.row_id for r in result_log.missing(work, target).collect()] == ["2:0"]


def test_store_is_rebuilt_only_when_texts_change(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "document_row_id int, text string")
    assert load_or_build(first, path, "v1", sentence_spans)[1] is False
    rows, hit = load_or_build(first, path, "v1", sentence_spans)
    assert hit and rows.count() == 3
    other = spark.createDataFrame([(1, "One. Two. More."), (2, "Three.")], "document_row_id int, text string")
    rows, hit = load_or_build(other, path, "v1", sentence_spans)
    assert not hit and rows.count() == 4
    assert load_or_build(other, path, "v2", sentence_spans)[1] is False


def test_exploration_report(spark, corpus, tmp_path):
    args = cli.parser().parse_args(["explore", "--corpus", corpus["corpus"], "--categories", corpus["categories"], "--output-dir", str(tmp_path)])
    got = cli.explore(spark, args)
    assert got["contracts"]["rows"] == 3 and got["questions"]["rows"] == 6
    assert "top_numbered" in Path(got["report"]).read_text()


def test_store_rewrites_only_the_buckets_of_changed_documents(spark, tmp_path):
    from spanlake.operators.segment import sentence_spans
    from spanlake.plans import stores

    path = str(tmp_path / "store")
    texts = {i: f"One sentence {i}. And another one." for i in range(200)}
    docs = lambda t: spark.createDataFrame(sorted(t.items()), "document_row_id long, text string")
    load = lambda t, **k: stores.load_or_update(docs(t), path, "v1", sentence_spans, **k)
    shown = lambda rows: sorted((r.document_row_id, r.sentence_index, r.raw_text) for r in rows.select("document_row_id", "sentence_index", "raw_text").collect())
    rows, written = load(texts)
    assert written > 30 and shown(rows) == shown(sentence_spans(docs(texts)))
    files = set(rows.inputFiles())
    assert load(texts)[1] == 0
    changed = texts | {7: "Changed. Twice. Thrice."}
    rows, written = load(changed)
    assert written == 1 and len(set(rows.inputFiles()) - files) == 1 and shown(rows) == shown(sentence_spans(docs(changed)))
    fewer = {k: v for k, v in changed.items() if k != 11} | {500: "New.", 501: ""}
    rows, written = load(fewer)
    assert 1 <= written <= 3 and shown(rows) == shown(sentence_spans(docs(fewer)))
    rows, written = load({1: ""})
    assert shown(rows) == [] and load({1: "Back again."})[0].count() == 1
    assert shown(load(texts, rebuild=True)[0]) == shown(sentence_spans(docs(texts)))


def test_documents_are_dealt_out_by_bucket_before_their_rows_are_built(spark, tmp_path):
    from spanlake.plans import stores

    dealt = []

    def build(docs):
        dealt.append(docs.select(stores._bucket(F.lit(stores.BUCKETS)), F.spark_partition_id().alias("task")).distinct())
        return docs.select("document_row_id", F.explode(F.split("text", " ")).alias("word"))

    docs = spark.range(300).select(F.col("id").alias("document_row_id"), F.concat(F.lit("a b "), "id").alias("text"))
    rows, written = stores.load_or_update(docs, str(tmp_path / "words"), "v", build)
    assert rows.count() == 900 and rows.select("document_row_id").distinct().count() == 300
    # all documents of a bucket are in one task when they are built, so no row of the store is shuffled
    assert dealt[0].count() == written
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    # one changed document touches one bucket; no documents make no rows
    changed = docs.withColumn("text", F.when(F.col("document_row_id") == 7, F.lit("c")).otherwise(F.col("text")))
    rows, written = stores.load_or_update(changed, str(tmp_path / "words"), "v", build)
    assert (rows.count(), written) == (898, 1)
    rows, written = stores.load_or_update(docs.limit(0), str(tmp_path / "none"), "v", build)
    assert (rows.count(), written) == (0, 0)
