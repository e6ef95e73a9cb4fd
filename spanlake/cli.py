"""Command line: ``python -m spanlake.cli COMMAND ...`` or the same through spark-submit."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from spanlake.operators.enrichment import base_query, enrich_questions
from spanlake.operators.retrieve import HIERARCHICAL_METHODS, RECURSIVE_METHODS, SENTENCE_METHODS
from spanlake.operators.sampling import sample_ids, select_rows
from spanlake.session import build_session
from spanlake.sources.corpus import document_texts, load_tables
from spanlake.sources.results import find_summary, read_prompts, read_results_csv, read_review_csv, read_split_ids


def integers(text: str) -> list[int]:
    return [int(part) for part in text.split(",") if part.strip()]


def names(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def _corpus_arguments(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--corpus", required=True)
    parser.add_argument("--categories", required=True)
    parser.add_argument("--sample-size", type=int, default=50)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--contract-ids", type=integers, default=[])
    parser.add_argument("--question-indices", type=integers, default=[])
    parser.add_argument("--eval-split", default="")
    parser.add_argument("--output-dir", default="outputs")
    parser.add_argument("--top-k", type=int, default=30)
    parser.add_argument("--hierarchical-leaf-k", type=int, default=50)
    parser.add_argument("--hierarchical-top-sections", type=int, default=5)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="spanlake")
    commands = root.add_subparsers(dest="command", required=True)
    retrieval = commands.add_parser("retrieval", help="retrieval benchmark")
    _corpus_arguments(retrieval)
    retrieval.add_argument("--run-id", default="retrieval")
    retrieval.add_argument("--retrievers", type=names, default=list(SENTENCE_METHODS))
    retrieval.add_argument("--contract-scope", choices=("all", "eval-set"), default="all")
    retrieval.add_argument("--preflight-only", action="store_true")
    retrieval.add_argument("--rebuild-chunks", action="store_true")
    answers = commands.add_parser("answers", help="answer evaluation (dry run unless used as a library)")
    _corpus_arguments(answers)
    answers.add_argument("--model-id", default="dry-run")
    answers.add_argument("--context-mode", default="raw")
    answers.add_argument("--all-context-modes", action="store_true")
    answers.add_argument("--compare-variants", action="store_true")
    answers.add_argument("--question-mode", choices=("raw", "enriched"), default="raw")
    answers.add_argument("--prompts-file", default="")
    answers.add_argument("--baseline-results", default="")
    answers.add_argument("--no-resume", action="store_true")
    improve = commands.add_parser("improve-prompts", help="prompt improvement rounds")
    improve.add_argument("--source-results", required=True)
    improve.add_argument("--corpus", required=True)
    improve.add_argument("--categories", required=True)
    improve.add_argument("--prompts-file", required=True)
    improve.add_argument("--model-id", default="v2")
    improve.add_argument("--generator-examples", type=int, default=20)
    improve.add_argument("--evaluator-examples", type=int, default=20)
    improve.add_argument("--max-loops", type=int, default=3)
    improve.add_argument("--output-dir", default="outputs")
    compare = commands.add_parser("compare-runs", help="compare run summaries by category")
    compare.add_argument("paths", nargs="+")
    compare.add_argument("--label", action="append", default=[])
    explore = commands.add_parser("explore", help="corpus overview and line classes")
    explore.add_argument("--corpus", required=True)
    explore.add_argument("--categories", required=True)
    explore.add_argument("--output-dir", default="outputs")
    return root


def _selection(spark, args):
    tables = load_tables(spark, args.corpus, args.categories)
    ids = tables["contracts"].select("document_row_id")
    if args.contract_ids:
        chosen = spark.createDataFrame([(d, i) for i, d in enumerate(args.contract_ids)], "document_row_id int, selection_pos int")
    else:
        chosen = sample_ids(ids, args.sample_size, args.seed)
    rows = select_rows(tables["questions"], chosen, args.question_indices, read_split_ids(spark, args.eval_split))
    return document_texts(tables["contracts"]), rows, chosen


def retrieval(spark, args) -> dict:
    from spanlake.plans import retrieval_benchmark

    known = {*SENTENCE_METHODS, *RECURSIVE_METHODS, *HIERARCHICAL_METHODS}
    if set(args.retrievers) - known:
        raise ValueError(f"unsupported retrievers: {sorted(set(args.retrievers) - known)}")
    documents, rows, chosen = _selection(spark, args)
    if args.contract_scope == "eval-set":
        documents = documents.join(chosen, "document_row_id", "left_semi")
    return retrieval_benchmark.run(
        documents, rows, args.output_dir, args.run_id, args.retrievers, args.top_k, preflight_only=args.preflight_only,
        rebuild=args.rebuild_chunks, leaf_k=args.hierarchical_leaf_k, top_sections=args.hierarchical_top_sections,
    )


def answers(spark, args) -> dict:
    from spanlake.operators.chunk import sentence_chunks
    from spanlake.operators.gold import answer_texts
    from spanlake.plans import answers as plan
    from spanlake.plans import variants
    from spanlake.plans.stores import stored_index, stored_spans

    documents, rows, _ = _selection(spark, args)
    options = {"leaf_k": args.hierarchical_leaf_k, "top_sections": args.hierarchical_top_sections}
    cache = f"{args.output_dir}/rag_cache"
    chunks = sentence_chunks(stored_spans(documents, cache))
    enrichments = enrich_questions(rows).select("question_index", "enriched_query", "enrichment_terms")
    asked = rows.join(enrichments, "question_index", "left").withColumn("base_query", base_query())
    prompts = read_prompts(spark, args.prompts_file) if args.prompts_file else None
    modes = list(variants.CONTEXT_LABELS) if args.compare_variants or args.all_context_modes else [args.context_mode]
    options["index"] = stored_index(documents, chunks, cache) if set(modes) - {"raw"} else None
    if args.compare_variants:
        table = variants.run_variants(asked.withColumn("golds", answer_texts(F.col("answers"))), documents, chunks, prompts, top_k=args.top_k, **options)
        return {"variants": [r.asDict() for r in table.groupBy("variant_name").agg(F.avg("token_f1").alias("mean_token_f1")).collect()]}
    baseline = read_results_csv(spark, args.baseline_results) if args.baseline_results else None
    text = F.col("base_query") if args.question_mode == "raw" else F.coalesce("enriched_query", "base_query")
    out = {}
    for mode in modes:
        queries = asked.select(F.col("row_id").alias("query_id"), "document_row_id", text.alias("query"))
        contexts = None if mode == "raw" else variants.contexts(queries, chunks, documents, mode, args.top_k, **options)
        out[mode] = plan.run(
            rows, documents, args.output_dir, f"{args.model_id}-{mode}", prompts, resume=not args.no_resume, contexts=contexts, baseline=baseline
        )
    return {mode: {k: v for k, v in summary.items() if k != "per_category"} for mode, summary in out.items()}


def improve(spark, args) -> dict:
    from spanlake.plans import prompt_improvement

    documents = document_texts(load_tables(spark, args.corpus, args.categories)["contracts"])
    return prompt_improvement.run(
        read_review_csv(spark, args.source_results), documents, read_prompts(spark, args.prompts_file), args.output_dir, args.model_id,
        args.generator_examples, args.evaluator_examples, args.max_loops,
    )


def compare_runs(args) -> str:
    """Text table of overall and per-category scores of several run summaries."""
    from spanlake.sinks.report import console_table

    labels = args.label or [Path(p).stem for p in args.paths]
    if len(labels) != len(args.paths):
        raise ValueError("one label per path is required")
    runs = {label: json.loads(Path(find_summary(p, "summary.json")).read_text()) for label, p in zip(labels, args.paths)}
    lines: dict[tuple, dict] = {(-1, "overall"): {"category": "overall"}}
    for label, run in runs.items():
        lines[(-1, "overall")][label] = run.get("mean_token_f1")
        for row in run.get("per_category", []):
            lines.setdefault((row["question_index"], row["category"]), {"category": row["category"]})[label] = row["mean_token_f1"]
    return console_table([lines[key] for key in sorted(lines)], ["category", *labels])


def explore(spark, args) -> dict:
    from spanlake.plans.exploration import annotation_report, overview

    tables = load_tables(spark, args.corpus, args.categories)
    return {**overview(tables), "report": annotation_report(tables["contracts"], f"{args.output_dir}/lines.html")}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "compare-runs":
        print(compare_runs(args))
        return
    spark = build_session(f"spanlake-{args.command}")
    run = {"retrieval": retrieval, "answers": answers, "improve-prompts": improve, "explore": explore}[args.command]
    print(json.dumps(run(spark, args), indent=2, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
