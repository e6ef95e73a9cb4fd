"""Line classification of documents and statistics over the classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import split_lines, strip, words
from spanlake.operators.segment import is_all_caps

# Line classes in order of precedence with their nesting level and pattern.
# The class without a pattern is a short line in capitals.
LINE_CLASSES = [
    ("exhibit", 0, r"^(?:EXHIBIT|Exhibit|SCHEDULE|Schedule|ANNEX|Annex)\s+[\d.\w]"),
    ("article", 1, r"^(?:ARTICLE|Article)\s+(?:[IVXLCDM]+|\d+)"),
    ("whereas", 1, r"^(?:WHEREAS|WITNESSETH|RECITALS?|NOW,?\s+THEREFORE)\b"),
    ("allcaps", 1, None),
    ("section", 2, r"^(?:SECTION|Section)\s+\d+(?:\.\d+)*(?:\([a-z]\))?\.?\s+\S"),
    ("top_numbered", 2, r"^\d+\.\s+[A-Z]"),
    ("subsection", 3, r"^\d+\.\d+"),
    ("roman_paren", 5, r"^\([ivxlIVXL]+\)\s+\S"),
    ("alpha_paren_lower", 4, r"^\([a-z]\)\s+\S"),
    ("alpha_paren_upper", 5, r"^\([A-Z]\)\s+\S"),
    ("num_paren", 4, r"^\(\d+\)\s+\S"),
    ("bare_letter", 4, r"^[a-z]\)\s+\S"),
]
# Fixed value: how every line of a class with a pattern begins.
_OPENING = r"^(?:EXHIBIT|Exhibit|SCHEDULE|Schedule|ANNEX|Annex|ARTICLE|Article|WHEREAS|WITNESSETH|RECITAL|NOW|SECTION|Section|\d|\(|[a-z]\))"
# Fixed value: leading token of a line that may be a list marker.
LINE_PREFIX = r"^(\([a-zA-Z0-9]+\)|[A-Za-z]{1,4}\.|\d+\.|[A-Za-z0-9]{1,3}\)|[•\-–—*])"
EXHIBIT_START = r"^(?:EXHIBIT|Exhibit|exhibit|SCHEDULE|Schedule)\s+[\d.]+"
# Lines of a document on a report page, prefixes listed per document.
SHOWN_LINES = 200
TOP_PREFIXES = 25


def line_class(stripped: Column) -> Column:
    """Name of the first class a stripped line belongs to, null for body text."""
    # Most lines are body text, which one pattern and the test for capitals tell.
    body = ~stripped.rlike("(?U)" + _OPENING) & ~is_all_caps(stripped)
    chain = F.when((stripped == "") | body, F.lit(None).cast("string"))
    for name, _, pattern in LINE_CLASSES:
        chain = chain.when(is_all_caps(stripped) if pattern is None else stripped.rlike("(?U)" + pattern), F.lit(name))
    return chain


def line_level(name: Column) -> Column:
    chain = F.when(name.isNull(), F.lit(None).cast("int"))
    for known, level, _ in LINE_CLASSES:
        chain = chain.when(name == known, F.lit(level))
    return chain


def line_prefix(stripped: Column) -> Column:
    return F.nullif(F.regexp_extract(stripped, "(?U)" + LINE_PREFIX, 1), F.lit(""))


def document_lines(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("document_row_id",)) -> DataFrame:
    """One row per line: number from 1, text, class, level, words, and the prefix of unclassified lines."""
    lines = explode_rows(documents, split_lines(F.col(text), keep_ends=False), *keep, names=("n", "line"))
    lines = lines.withColumns({"line_number": F.col("n") + 1, "stripped": strip("line")}).drop("n")
    lines = lines.withColumn("pattern", line_class(F.col("stripped")))
    return lines.withColumns(
        {
            "level": line_level(F.col("pattern")),
            "words": F.size(words("line")),
            "prefix": F.when(F.col("pattern").isNull(), line_prefix(F.col("stripped"))),
        }
    )


def line_offsets(documents: DataFrame, text: str = "text") -> DataFrame:
    """(document, line number from 0, start offset, length with terminator)."""
    from spanlake.functions.arrays import running_starts

    sized = documents.select("document_row_id", F.transform(split_lines(F.col(text)), F.length).alias("lengths"))
    paired = sized.select(
        "document_row_id", F.zip_with("lengths", running_starts(F.col("lengths")), lambda n, s: F.struct(s.alias("start"), n.alias("length"))).alias("rows")
    )
    rows = explode_rows(paired, F.col("rows"), "document_row_id", names=("line_no", "r"))
    return rows.select("document_row_id", "line_no", F.col("r.start").alias("line_start"), F.col("r.length").alias("line_length"))


def _lines_up_to(documents: DataFrame, text: str, shown: int | None) -> DataFrame:
    """All lines, or the first ``shown`` ones for a report page."""
    lines = document_lines(documents, text)
    return lines if shown is None else lines.where(F.col("line_number") <= shown)


def annotate_documents(documents: DataFrame, text: str = "text", shown: int | None = None) -> DataFrame:
    """Coverage of the lines by the classes; lines of one document combine before the shuffle."""
    lines = _lines_up_to(documents, text, shown)
    known, filled = F.col("pattern").isNotNull(), F.col("stripped") != ""
    counts = lines.groupBy("document_row_id").agg(
        F.sum("words").alias("total_words"),
        F.sum(F.when(known, F.col("words")).otherwise(0)).alias("classified_words"),
        F.count_if(filled).alias("nonempty_lines"),
        F.count_if(known).alias("classified_lines"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0)), 1)
    whole = split_lines(F.col(text), keep_ends=False)
    totals = documents.select(
        "document_row_id",
        F.size(whole).alias("total_lines"),
        F.coalesce(strip(F.get(whole, F.lit(0))), F.lit("")).alias("first_line"),
    )
    exhibit = F.col("first_line").rlike("(?U)" + EXHIBIT_START)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return totals.join(counts, "document_row_id", "left").select(
        "document_row_id",
        "total_lines",
        exhibit.alias("starts_with_exhibit"),
        F.when(exhibit, F.col("first_line")).alias("exhibit_header"),
        zero("total_words"),
        zero("classified_words"),
        zero("classified_lines"),
        share("classified_words", "total_words").alias("word_coverage"),
        share("classified_lines", "nonempty_lines").alias("line_coverage"),
    )


def pattern_counts(documents: DataFrame, text: str = "text", shown: int | None = None) -> DataFrame:
    lines = _lines_up_to(documents, text, shown).where(F.col("pattern").isNotNull())
    return lines.groupBy("document_row_id", "pattern").agg(F.count(F.lit(1)).alias("lines"))


def top_prefixes(documents: DataFrame, text: str = "text", shown: int | None = None, top: int = TOP_PREFIXES) -> DataFrame:
    """Most frequent prefixes of unclassified lines per document; ties keep first appearance."""
    lines = _lines_up_to(documents, text, shown).where(F.col("prefix").isNotNull())
    counts = lines.groupBy("document_row_id", "prefix").agg(F.count(F.lit(1)).alias("lines"), F.min("line_number").alias("first_line"))
    order = W.partitionBy("document_row_id").orderBy(F.col("lines").desc(), F.col("first_line"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
