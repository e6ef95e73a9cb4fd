"""Corpus overview and line annotation report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.lines import SHOWN_LINES, annotate_documents, document_lines, pattern_counts, top_prefixes
from spanlake.sinks.report import write_report
from spanlake.sources.corpus import column_counts, document_texts


def overview(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Row and non-null counts of every table (one row each to the driver)."""
    counts = {name: column_counts(df).first().asDict() for name, df in tables.items()}
    if "contracts" in tables:
        counts["contracts"]["paragraphs"] = tables["contracts"].agg(F.sum("paragraphs_len")).first()[0]
    return counts


def annotation_report(contracts: DataFrame, path: str, shown: int = 50) -> str:
    """Class counts over all lines of all documents; the page lists the lines of the first ``shown`` documents only."""
    texts = document_texts(contracts)
    notes = annotate_documents(texts)
    totals = notes.agg(F.count("*").alias("documents"), F.sum("total_words").alias("words"), F.sum("classified_words").alias("classified_words")).first().asDict()
    first = texts.orderBy("document_row_id").limit(shown)
    tables = {
        "documents": notes.orderBy("document_row_id"),
        "patterns": pattern_counts(texts).orderBy("document_row_id", "pattern"),
        "prefixes": top_prefixes(texts).orderBy("document_row_id", "rank"),
        "lines": document_lines(first).where(F.col("line_number") <= SHOWN_LINES).orderBy("document_row_id", "line_number"),
    }
    return write_report(path, "Line classes", totals, tables)
