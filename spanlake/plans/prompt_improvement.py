"""Prompt improvement: failures, profiles, splits, then rounds of proposing and reviewing prompts.

A round handles all categories at once as a DataFrame; categories that are accepted or rejected leave the
loop, so there are at most three short rounds whatever the number of result rows.
"""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanlake.operators.failures import error_rows, format_profiles, main_failure_mode, review_patches
from spanlake.operators.incremental import first_by_key, unfinished_categories
from spanlake.operators.sampling import stratified_split
from spanlake.plans.answers import system_prompt
from spanlake.session import cut_lineage
from spanlake.sinks.report import write_report
from spanlake.sinks.tables import named_prompts, output_layout, write_document, write_json_lines
from spanlake.sources.results import read_category_status

MAX_LOOPS = 3
_HEADING = "Guidance from reviewed answers:"
_ADVICE = {
    "classification_instead_of_span": "Do not answer with a label; quote the clause.",
    "false_no_answer": "Search related clauses before reporting that there is no answer.",
    "false_positive_span": "Quote a clause only if it answers the question directly.",
    "partial_span": "Quote the whole clause, up to its final punctuation.",
    "overlong_span": "Leave out neighbouring text that does not answer the question.",
    "format_error": "Keep to the requested form of the answer.",
}


@F.pandas_udf(StringType())
def prompt_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff of two prompts (one short text per category)."""
    pairs = zip(before.fillna(""), after.fillna(""))
    return pd.Series(["\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "v1", "candidate", lineterm="")) for a, b in pairs])


def category_inputs(results: DataFrame, documents: DataFrame, prompts: DataFrame, generator_size: int = 20, evaluator_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one row per category with everything a round needs, error rows with their split)."""
    errors = cut_lineage(stratified_split(error_rows(results), generator_size, evaluator_size))
    modes = errors.where("split = 'generator_dev'").groupBy("category").agg(F.collect_set("failure_mode").alias("modes"))  # six kinds at most
    reviewed = errors.where("split = 'evaluator_dev'").groupBy("category").agg(
        F.count(F.lit(1)).alias("evaluator_examples"), F.count_if(F.col("failure_mode") == "false_positive_span").alias("false_positives")
    )
    meta = first_by_key(results, ["category"], ["question_index", "document_row_id"]).select(
        "category", "question_index", "question", "category_description", "answer_format"
    )
    default = system_prompt()
    rows = (
        meta.join(prompts, "category", "left")
        .withColumn("current_prompt", F.coalesce("prompt", default))
        .join(format_profiles(results, documents), "category", "left")
        .join(modes, "category", "left")
        .join(reviewed, "category", "left")
        .join(main_failure_mode(errors).drop("rows"), "category", "left")
        .na.fill(0, ["evaluator_examples", "false_positives"])
    )
    return cut_lineage(rows.withColumn("main_failure_mode", F.coalesce("main_failure_mode", F.lit("none")))), errors


def propose(rows: DataFrame) -> DataFrame:
    """Candidate prompts: the current prompt with advice for its profile, its failures and the last review."""
    advice = [F.when(F.array_contains("modes", mode), F.lit(text)) for mode, text in _ADVICE.items()]
    profile = F.when(F.col("yes_no_label_only"), F.lit("Answer only with the label: yes or no.")).when(
        F.col("requires_verbatim_contract_span"), F.lit("Quote the exact span of the contract; yes/no labels are not accepted.")
    )
    several = F.when(F.col("typical_span_shape") == "multiple_spans", F.lit("Put every quotation on its own line."))
    lines = F.array_distinct(F.array_compact(F.array(profile, several, *advice)))
    block = F.concat(F.lit(f"\n\n{_HEADING}\n"), F.array_join(F.transform(lines, lambda v: F.concat(F.lit("- "), v)), "\n"))
    feedback = F.array_join(F.transform("feedback", lambda v: F.concat(F.lit("\n- "), v)), "")
    base = F.coalesce("candidate_prompt", "current_prompt")
    fresh = ~F.contains(base, F.lit(_HEADING))
    return rows.withColumn("candidate_prompt", F.concat(base, F.when(fresh, block).otherwise(F.lit("")), feedback))


def improve(inputs: DataFrame, max_loops: int = MAX_LOOPS, propose_with=propose, review_with=review_patches) -> DataFrame:
    """Final prompt, decision and number of rounds per category; ``*_with`` are the extension points."""
    blank = F.array().cast("array<string>")
    clean = inputs.where("main_failure_mode = 'none'").select(
        "category", "question_index", "current_prompt", F.col("current_prompt").alias("candidate_prompt"),
        F.lit("no_failures").alias("decision"), F.lit(0).alias("loop_count"), F.lit(None).cast("double").alias("generalization_score"),
        blank.alias("requested_changes"), "main_failure_mode",
    )
    open_rows = inputs.where("main_failure_mode <> 'none'").withColumns({"candidate_prompt": F.lit(None).cast("string"), "feedback": blank})
    closed = [clean]
    for loop in range(1, max_loops + 1):
        reviewed = cut_lineage(review_with(propose_with(open_rows).withColumn("loop_index", F.lit(loop))))
        final = reviewed if loop == max_loops else reviewed.where("decision <> 'revise'")
        closed.append(final.withColumn("loop_count", F.lit(loop)).select(*clean.columns))
        open_rows = reviewed.where("decision = 'revise'").withColumn("feedback", F.col("requested_changes"))
        open_rows = open_rows.drop("requested_changes", "likely_regressions", "decision", "generalization_score", "loop_index")
    return reduce(DataFrame.unionByName, closed).withColumn("prompt_diff", prompt_diff("current_prompt", "candidate_prompt"))


def run(results: DataFrame, documents: DataFrame, prompts: DataFrame, output: str, model_id: str = "v2", generator_size: int = 20, evaluator_size: int = 20, max_loops: int = MAX_LOOPS, resume: bool = True) -> dict:
    """Improve all prompts, skipping categories settled by an earlier run, and write prompts, splits and report."""
    if min(generator_size, evaluator_size, max_loops) < 1:
        raise ValueError("example sizes and loops must be 1 at least")
    spark, paths = results.sparkSession, output_layout(output, model_id)
    rows, errors = category_inputs(results, documents, prompts, generator_size, evaluator_size)
    status = f"{paths['rows']}_status"
    if resume:
        try:
            rows = cut_lineage(unfinished_categories(rows, read_category_status(spark, status)))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    done = cut_lineage(improve(rows, max_loops))
    log = done.select(
        "category", "decision", "loop_count", "candidate_prompt", F.col("current_prompt").alias("v1_prompt"), "main_failure_mode",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("completed_at"),
    )
    write_json_lines(log, status, append=True)
    errors.select("split", "category", "row_id").write.mode("overwrite").partitionBy("split").json(f"{paths['rows']}_splits")
    write_json_lines(named_prompts(done.select("category", F.col("candidate_prompt").alias("prompt"))), paths["prompts"])
    summary = {"model_id": model_id, "categories": done.count(), "decisions": {r["decision"]: r["count"] for r in done.groupBy("decision").count().collect()}}
    write_document(summary, paths["summary"] + ".json")
    write_report(paths["html"], f"Prompt review {model_id}", summary, {"prompts": done.orderBy("question_index"), "failures": errors.drop("golds")})
    return summary
