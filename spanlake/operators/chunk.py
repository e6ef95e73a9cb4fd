"""Chunk tables: one chunk per sentence, or recursive chunks over a ladder of separators.

Every chunk table has ``document_row_id, chunk_pos, chunk_id, text, normalized_text, sentence_ids,
clause_path``; ``chunk_pos`` counts 0, 1, 2, ... without gaps inside a document, which the retrievers use
to complete short result lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import normalize_sentence
from spanlake.operators.segment import section_headers, sentence_array

# Separators from coarse to fine, chunk size and overlap in characters.
SEPARATORS = (
    r"\n\s*(?:ARTICLE|Article)\s+[IVXLC\d]+[^\n]*\n",
    r"\n\s*(?:SECTION|Section)\s+\d+(?:\.\d+)*[^\n]*\n",
    r"\n\s*\d{1,3}\.\s+",
    r"\n\s*\d{1,3}\)\s+",
    r"\n\s*\([A-Za-z0-9]{1,4}\)\s+",
    r"\n\s*[A-Za-z]\)\s+",
    r"\n\s*[•‣▪▫◦●○*-]\s+",
    r"\n\s*\n+",
    r"\n",
    r"(?<=[.;:!?])\s+",
    r"\s+",
    "",
)
CHUNK_SIZE = 1200
CHUNK_OVERLAP = 150


@dataclass(frozen=True)
class SplitRule:
    size: int = CHUNK_SIZE
    overlap: int = CHUNK_OVERLAP
    separators: tuple[str, ...] = SEPARATORS


def sentence_chunks(spans: DataFrame) -> DataFrame:
    """A chunk for each sentence span."""
    return spans.select(
        "document_row_id",
        F.col("sentence_index").alias("chunk_pos"),
        F.col("sentence_id").alias("chunk_id"),
        F.col("raw_text").alias("text"),
        "normalized_text",
        F.lit("sentence").alias("chunk_type"),
        F.array("sentence_id").alias("sentence_ids"),
        "start_char",
        "end_char",
        "page_number",
        "section_number",
        "section_title",
        "clause_path",
    )


def _pieces(text: str, lo: int, hi: int, pattern: str) -> Iterator[tuple[int, int]]:
    """Spans of text[lo:hi] that each begin at a separator (the first one at lo)."""
    if not pattern:
        yield from ((i, i + 1) for i in range(lo, hi))
        return
    begin = lo
    for match in re.finditer(pattern, text[lo:hi]):
        here = lo + match.start()
        if here > begin:
            yield begin, here
        begin = here
    if hi > begin:
        yield begin, hi


def _packed(text: str, spans: list[tuple[int, int]], rule: SplitRule) -> Iterator[str]:
    """Join neighbouring spans up to the chunk size, starting each chunk inside the overlap of the last."""
    first, total = 0, 0
    for i, (lo, hi) in enumerate(spans):
        width = hi - lo
        if total + width > rule.size:
            if i > first:
                chunk = text[spans[first][0] : spans[i - 1][1]].strip()
                if chunk:
                    yield chunk
            while total > rule.overlap or (total + width > rule.size and total > 0):
                total -= spans[first][1] - spans[first][0]
                first += 1
        total += width
    if first < len(spans):
        chunk = text[spans[first][0] : spans[-1][1]].strip()
        if chunk:
            yield chunk


def _split(text: str, lo: int, hi: int, ladder: tuple[str, ...], rule: SplitRule) -> Iterator[str]:
    part = text[lo:hi]
    step = next((i for i, sep in enumerate(ladder) if sep == "" or re.search(sep, part)), len(ladder) - 1)
    finer = ladder[step + 1 :] if ladder[step] else ()
    waiting: list[tuple[int, int]] = []
    for span in _pieces(text, lo, hi, ladder[step]):
        if span[1] - span[0] < rule.size:
            waiting.append(span)
            continue
        yield from _packed(text, waiting, rule)
        waiting = []
        if finer:
            yield from _split(text, *span, finer, rule)
        else:
            yield text[span[0] : span[1]]
    yield from _packed(text, waiting, rule)


def split_recursive(text: str, rule: SplitRule = SplitRule()) -> list[tuple[int, int, int, str]]:
    """(index, start, end, chunk) of one text; blank chunks keep their index but are left out."""
    out = []
    at, width = 0, 0
    for index, chunk in enumerate(_split(text, 0, len(text), rule.separators, rule) if text else ()):
        at = text.find(chunk, max(0, at + width - rule.overlap))
        width = len(chunk)
        kept = chunk.strip()
        if kept:
            out.append((index, at, at + len(kept), kept))
    return out


_CHUNK_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("split_index", T.IntegerType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("end_char", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("first_sentence", T.IntegerType()),
            T.StructField("after_sentence", T.IntegerType()),
        ]
    )
)


def recursive_array(text: Column, starts: Column, ends: Column, rule: SplitRule = SplitRule()) -> Column:
    """Chunks of a text with the range of sentences each one overlaps (sentences are ordered and disjoint)."""

    @F.pandas_udf(_CHUNK_TYPE)
    def split(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        rows = []
        for value, lo, hi in zip(texts, starts, ends):
            chunks = split_recursive(value or "", rule)
            begins = np.array([c[1] for c in chunks], dtype=np.int64)
            stops = np.array([c[2] for c in chunks], dtype=np.int64)
            first = np.searchsorted(np.asarray(hi), begins, side="right")
            after = np.searchsorted(np.asarray(lo), stops, side="left")
            rows.append(
                [
                    dict(split_index=c[0], start_char=c[1], end_char=c[2], text=c[3], first_sentence=int(f), after_sentence=int(a))
                    for c, f, a in zip(chunks, first, after)
                ]
            )
        return pd.Series(rows)

    return split(text, starts, ends)


def recursive_chunks(documents: DataFrame, text: str = "text", rule: SplitRule = SplitRule()) -> DataFrame:
    """Recursive chunks with the ids of the sentences they overlap and the section of the first one."""
    found = documents.select(
        "document_row_id",
        F.col(text).alias("source_text"),
        section_headers(F.col(text)).alias("headers"),
        sentence_array(F.col(text), with_sections=True).alias("sentences"),
    )
    split = found.select(
        "document_row_id",
        "headers",
        F.transform(
            "sentences", lambda s: F.when(s["at_line_start"] & (s["section_pos"] > 0), s["section_pos"]).otherwise(F.lit(0))
        ).alias("section_pos"),
        recursive_array(
            F.col("source_text"),
            F.transform("sentences", lambda s: s["start_char"]),
            F.transform("sentences", lambda s: s["end_char"]),
            rule,
        ).alias("chunks"),
    )
    rows = explode_rows(split, F.col("chunks"), "document_row_id", "headers", "section_pos", names=("chunk_pos", "c"))
    count = F.col("c.after_sentence") - F.col("c.first_sentence")
    header = F.get("section_pos", F.col("c.first_sentence"))
    document = F.col("document_row_id").cast("string")
    rows = rows.select(
        "document_row_id",
        "chunk_pos",
        F.concat_ws(":lr:", document, F.col("c.split_index").cast("string")).alias("chunk_id"),
        F.col("c.text").alias("text"),
        normalize_sentence(F.col("c.text")).alias("normalized_text"),
        F.lit("legal_recursive").alias("chunk_type"),
        F.when(
            count > 0,
            F.transform(
                F.sequence(F.col("c.first_sentence"), F.greatest(F.col("c.after_sentence") - 1, F.col("c.first_sentence"))),
                lambda i: F.concat_ws(":s:", document, i.cast("string")),
            ),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("sentence_ids"),
        F.col("c.start_char").alias("start_char"),
        F.col("c.end_char").alias("end_char"),
        F.lit(None).cast("int").alias("page_number"),
        F.when((count > 0) & (header > 0), F.get("headers", header - 1)).alias("section"),
    )
    return rows.select(
        *[c for c in rows.columns if c != "section"],
        F.col("section.number").alias("section_number"),
        F.col("section.title").alias("section_title"),
        F.filter(F.array("section.number", "section.title"), lambda part: part.isNotNull() & (part != "")).alias("clause_path"),
    )


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_width: int = 2048) -> DataFrame:
    """Pairs of same-key intervals [start_char, end_char) that overlap.

    Intervals are spread over fixed-width bins and joined on (key, bin), so the join stays an equi-join and
    a long document is split over many tasks. A pair is kept only in the bin where the later of the two
    starts lies, so no pair appears twice and no de-duplication is needed. Columns of ``right`` other than
    the key get the prefix ``other_``.
    """

    def binned(df: DataFrame, lo: str, hi: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(lo) / bin_width), F.floor((F.greatest(F.col(hi), F.col(lo) + 1) - 1) / bin_width))
        return df.withColumn("bin", F.explode(bins))

    other = right.select(key, *[F.col(c).alias(f"other_{c}") for c in right.columns if c != key])
    pairs = binned(left, "start_char", "end_char").join(binned(other, "other_start_char", "other_end_char"), [key, "bin"])
    return pairs.where(
        (F.col("other_start_char") < F.col("end_char"))
        & (F.col("other_end_char") > F.col("start_char"))
        & (F.floor(F.greatest("start_char", "other_start_char") / bin_width) == F.col("bin"))
    ).drop("bin")
