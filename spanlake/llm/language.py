"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words bounded by blanks) in order of
frequency. A document's own list is compared to each language's by out-of-place distance: how far each n-gram stands
from its place in the profile, and a fixed distance for those that the profile lacks. The nearest language wins, ties
to the smaller name.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.llm.batches import bound_batches, give_back, tidied
from spanlake.session import cut_lineage

UNDETERMINED = "und"
_GRAM_BITS = 13
_GRAM_ALL = np.uint64(3 * _GRAM_BITS)
_GRAM_MASK = (np.uint64(1) << _GRAM_ALL) - np.uint64(1)
_DOCS_AT_ONCE_CHARS = 1 << 18
_RUN = 1 << 20


@dataclass
class Profiles:
    """Rank tables. Letters have codes from 2 (1 is the blank, ``other`` all letters never seen); a gram packs up to three."""

    languages: list[str]
    size: int
    letters: np.ndarray
    grams: list[np.ndarray] = field(default_factory=list)
    ranks: list[np.ndarray] = field(default_factory=list)
    floors: dict[str, float] = field(default_factory=dict)  # from fit_profiles(calibrate=True)


_TABLES: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter (categories L*)."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _TABLES["letters"]


def _code_table(letters: np.ndarray) -> np.ndarray:
    """For each code point its letter code; 1 for all that is no letter."""
    table = np.ones(sys.maxunicode + 1, np.uint64)
    table[letter_table()] = len(letters) + 2
    table[letters] = np.arange(2, len(letters) + 2)
    return table


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of blank-bounded letter runs and their documents. Runs of blanks count as one."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    shift = np.uint64(_GRAM_BITS)
    letter = codes != 1
    two = (codes[:-1] << shift) | codes[1:]
    same2 = (doc[1:] == doc[:-1]) & (letter[1:] | letter[:-1])
    three = (two[:-1] << shift) | codes[2:]
    same3 = (doc[2:] == doc[:-2]) & letter[1:-1]
    return np.concatenate([codes[letter], two[same2], three[same3]]), np.concatenate([doc[letter], doc[:-1][same2], doc[:-2][same3]])


def _counted(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) keys in order, with their counts; a long text is counted in runs cut at blanks."""
    keys, counts = [], []
    start = 0
    while start < len(codes):
        stop = min(len(codes), start + _RUN)
        if stop < len(codes) and doc[stop] == doc[stop - 1]:
            blanks = np.flatnonzero(codes[start + 1 : stop] == 1)
            stop = start + 1 + int(blanks[-1]) if len(blanks) else stop
        end = stop + (stop < len(codes) and codes[stop] == 1)  # a blank at the cut bounds both runs
        grams, owner = _grams(codes[start:end], doc[start:end])
        k, n = np.unique((owner.astype(np.uint64) << _GRAM_ALL) | grams, return_counts=True)
        keys.append(k), counts.append(n)
        start = stop
    if len(keys) == 1:
        return keys[0], counts[0]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out, place = np.unique(np.concatenate(keys), return_inverse=True)
    return out, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def _top(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, document, rank from 0) of the ``size`` most frequent n-grams of each document; ties to the smaller code."""
    owner = (keys >> _GRAM_ALL).astype(np.int64)
    order = np.lexsort((-counts, owner))  # stable: equal counts stay in code order
    keys, owner = keys[order], owner[order]
    rank = np.arange(len(keys)) - np.searchsorted(owner, owner, "left")
    few = rank < size
    return keys[few] & _GRAM_MASK, owner[few], rank[few]


def _pieces(texts: list[str | None]):
    """Runs of consecutive texts of about a quarter million characters: (first row, code points, document of each)."""
    row = 0
    while row < len(texts):
        points, size, start = [], 0, row
        while row < len(texts) and (not points or size < _DOCS_AT_ONCE_CHARS):
            points.append(_code_points(texts[row] or ""))
            size += len(points[-1])
            row += 1
        yield start, np.concatenate(points), np.repeat(np.arange(len(points)), [len(p) for p in points])


def fit_profiles(docs: DataFrame, size: int = 300, max_rows: int = 2000, max_letters: int = 4000, calibrate: bool = False) -> Profiles:
    """Profiles of each language in ``docs`` (text, lang), from the rows with non-null lang and text.

    The sample is bounded: of each language the ``max_rows`` texts with the smallest text hash, counted whole in the
    tasks; only n-gram counts of whole languages, cut at the ``size`` most frequent, and letter counts reach the driver.
    With ``calibrate`` each language also gets a floor: half the median score of the sample's rows that are found to be in it, rightly.
    """
    bound_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "n"))
    chosen = known.select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct().withColumn("_p", place).where(F.col("_p") <= max_rows)
    chosen = cut_lineage(chosen.select("lang", "h"))
    sample = known.withColumn("h", F.xxhash64("text")).join(chosen, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.any_value("text").alias("text"))

    def letters_of(batches):
        for batch in batches:
            counts: dict[int, int] = {}
            for _, points, _ in _pieces(batch.column(0).to_pylist()):
                values, n = np.unique(points[letter_table()[points]], return_counts=True)
                for v, k in zip(values.tolist(), n.tolist(), strict=True):
                    counts[v] = counts.get(v, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["letter", "n"])

    sample = cut_lineage(sample)
    common = sample.select("text").mapInArrow(tidied(letters_of), "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(max_letters)
    letters = np.array(sorted(r.letter for r in common.collect()), np.int64)

    def grams_of(batches):
        codes = _code_table(letters)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for start, points, doc in _pieces(batch.column(1).to_pylist()):
                keys, counts = _counted(codes[points], doc)
                here = langs[start + (keys >> _GRAM_ALL).astype(np.int64)]
                for lang in set(here):
                    values, place = np.unique(keys[here == lang] & _GRAM_MASK, return_inverse=True)
                    n = np.bincount(place, weights=counts[here == lang]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(tidied(grams_of), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    table = best.select("lang", "gram", "rank").toPandas()
    profiles = Profiles(sorted(table["lang"].unique()), size, letters)
    for lang in profiles.languages:
        part = table[table["lang"] == lang].sort_values("gram")
        profiles.grams.append(part["gram"].to_numpy().astype(np.uint64))
        profiles.ranks.append(part["rank"].to_numpy().astype(np.int64) - 1)
    if calibrate and profiles.languages:
        right = identify_language(sample.select("lang", "text"), profiles).where("lang_pred = lang")
        profiles.floors = {r.lang: r.floor for r in right.groupBy("lang").agg((F.median("score") / 2).alias("floor")).collect()}
    return profiles


def _predict(texts: list[str | None], profiles: Profiles, codes: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not profiles.languages:
        return names, scores
    for start, points, doc in _pieces(texts):
        n = int(doc[-1]) + 1 if len(doc) else 0
        has_letter = np.bincount(doc[letter_table()[points]], minlength=n) > 0 if n else np.empty(0, bool)
        grams, owner, rank = _top(*_counted(codes[points], doc), profiles.size)
        distances = []
        for known, place in zip(profiles.grams, profiles.ranks, strict=True):
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            apart = np.where(known[at] == grams, np.abs(place[at] - rank), profiles.size)
            distances.append(np.bincount(owner, weights=apart, minlength=n))
        total = np.maximum(np.bincount(owner, minlength=n) * profiles.size, 1)
        distances = np.stack(distances)
        best = distances.argmin(axis=0)
        for k in np.flatnonzero(has_letter):
            names[start + k] = profiles.languages[best[k]]
            scores[start + k] = min(1.0, max(0.0, 1 - distances[best[k], k] / total[k]))
    return names, scores


def identify_language(docs: DataFrame, profiles: Profiles, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and a score between 0 and 1 (1: every n-gram at its place), from whole texts.

    Null, empty and letterless texts give ``und`` and 0, as does a set of profiles without languages. All other columns
    pass through untouched; columns named as the two new ones are replaced.
    """

    bound_batches(docs.sparkSession)
    rest = [F.col(c) for c in docs.columns if c not in into]

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes = _code_table(profiles.letters)
        for column in batches:
            names, scores = _predict(column.tolist(), profiles, codes)
            yield pd.DataFrame({"lang": names, "score": scores})
        give_back()

    found = docs.select(*rest, predicted(F.col(text).cast("string")).alias("_language"))
    return found.select(*rest, F.col("_language.lang").alias(into[0]), F.col("_language.score").alias(into[1]))
