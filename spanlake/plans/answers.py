"""Answer evaluation: prompts, predictions, resumable results, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import NO_ANSWER
from spanlake.operators.gold import raw_answer_texts
from spanlake.operators.incremental import merge_results, pending
from spanlake.operators.scoring import compare_to_baseline, parse_answer, result_rows, summarize
from spanlake.session import cut_lineage
from spanlake.sinks.report import write_report
from spanlake.sinks.tables import output_layout, write_csv, write_document, write_json_lines
from spanlake.sources.results import read_result_log


def system_prompt() -> Column:
    """Default system prompt of a row from its question and category columns."""
    blank = F.lit("")
    parts = {
        "Question": F.coalesce("question", blank),
        "Clause category": F.coalesce("category", blank),
        "What the category means": F.coalesce("category_description", blank),
        "Expected form of the answer": F.coalesce(F.nullif("answer_format", blank), F.lit("free form")),
    }
    rules = (
        "Answer only with wording quoted from the contract you are given, one quotation per line. "
        f"If the contract says nothing about the question, answer {NO_ANSWER} and set marked_impossible to true; "
        "otherwise set it to false."
    )
    body = [F.concat(F.lit(f"{title}: "), value) for title, value in parts.items()]
    return F.concat_ws("\n", F.lit("You review contracts and answer one question about each."), *body, F.lit(rules))


def with_prompts(rows: DataFrame, prompts: DataFrame | None) -> DataFrame:
    if prompts is None:
        return rows.withColumn("system_prompt", system_prompt())
    return rows.join(prompts.withColumnRenamed("prompt", "own_prompt"), "category", "left").withColumn(
        "system_prompt", F.coalesce("own_prompt", system_prompt())
    ).drop("own_prompt")


def evaluation_set(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with document title and text, golden answers as they are, and blank answer format for null."""
    texts = documents.select("document_row_id", "title", F.col("text").alias("context"))
    joined = rows.drop("title").join(texts, "document_row_id")
    return joined.withColumns(
        {"golds": raw_answer_texts(F.col("answers")), "answer_format": F.coalesce("answer_format", F.lit(""))}
    )


def dry_run_predictions(rows: DataFrame) -> DataFrame:
    """Echo the golden answers: needs no model and stays in the JVM."""
    none = F.size("golds") == 0
    return rows.withColumns(
        {
            "predicted_answer": F.when(none, NO_ANSWER).otherwise(F.array_join("golds", "\n")),
            "predicted_marked_impossible": none,
        }
    )


def model_predictions(rows: DataFrame, complete: Callable[[str, str], str], parallel: int | None = None) -> DataFrame:
    """Predictions of a model function ``complete(system_prompt, user_text) -> text``, called inside tasks.

    ``parallel`` bounds how many tasks call the model at once. A failing call becomes an empty answer with
    the error in ``prediction_error`` instead of failing the job.
    """
    user = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Contract:\n"), F.coalesce("context", F.lit(""))),
        F.concat(F.lit("Hint: "), F.nullif("hint_used", F.lit(""))) if "hint_used" in rows.columns else F.lit(None).cast("string"),
    )

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for system, question in zip(batch["system_prompt"], batch["user_text"]):
                try:
                    texts.append(complete(system, question))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001
                    texts.append("")
                    errors.append(str(error))
            yield pd.DataFrame({"row_id": batch["row_id"], "model_output": texts, "prediction_error": errors})

    asked = rows.select("row_id", "system_prompt", user.alias("user_text"))
    asked = asked.repartition(parallel) if parallel else asked
    # A model call is expensive and not repeatable: store its output before anything reads it twice.
    outputs = cut_lineage(asked.mapInPandas(call, "row_id string, model_output string, prediction_error string"))
    parsed = outputs.withColumn("parsed", parse_answer(F.col("model_output")))
    parsed = parsed.select(
        "row_id", "prediction_error", F.col("parsed.answer").alias("predicted_answer"),
        F.col("parsed.marked_impossible").alias("predicted_marked_impossible"),
    )
    return rows.join(parsed, "row_id")


def run(
    rows: DataFrame, documents: DataFrame, output: str, model_id: str, prompts: DataFrame | None = None, predict=dry_run_predictions,
    resume: bool = True, contexts: DataFrame | None = None, baseline: DataFrame | None = None,
) -> dict:
    """Evaluate the rows that have no result yet, append them to the log, and summarise everything."""
    spark, paths = rows.sparkSession, output_layout(output, model_id)
    work = with_prompts(evaluation_set(rows, documents), prompts)
    try:
        done = read_result_log(spark, paths["results_log"], rows, model_id) if resume else None
        done = done and cut_lineage(done)
    except Exception as error:  # a first run has no log yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = None
    todo = pending(work, done) if done is not None else work
    if contexts is not None:
        from spanlake.operators.retrieve import replace_context

        todo = replace_context(todo, contexts)
    fresh = cut_lineage(result_rows(predict(todo), model_id))
    write_json_lines(fresh, paths["results_log"], append=resume)
    results = cut_lineage(merge_results(*[t for t in (done, fresh) if t is not None]))
    expected, found = rows.count(), results.count()
    if found != expected:
        raise RuntimeError(f"incomplete evaluation: {found} results for {expected} rows")
    write_csv(results.orderBy("document_row_id", "question_index"), paths["results"])
    levels = [r.asDict() for r in summarize(results).collect()]
    overall = next(r for r in levels if r["level"] == "overall")
    summary = {**overall, "model_id": model_id, "per_category": sorted((r for r in levels if r["level"] == "group"), key=lambda r: r["question_index"])}
    if baseline is not None:
        compared = compare_to_baseline(results, baseline)
        summary["baseline_comparison"] = [r.asDict() for r in compared.collect()]
        if not any(r["level"] == "overall" and r["matched_examples"] for r in summary["baseline_comparison"]):
            raise ValueError("baseline results do not overlap the current rows")
    write_document(summary, paths["summary"] + ".json")
    write_report(paths["html"], f"Evaluation {model_id}", overall, {"results": results.orderBy("document_row_id", "question_index")})
    return summary


