"""Quality rules: gradient-boosted trees over statistics of whole texts, after two fixed base rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.batches import bound_batches, give_back, tidied
from spanlake.llm.boosting import FlatTrees, train
from spanlake.llm.words import SPACE, mix, slices, windows
from spanlake.session import cut_lineage

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_digits", "n_upper", "n_punct", "n_pipes", "n_short"]
#: Features of the trees, and the direction in which a larger value may move the verdict.
FEATURES = {
    "symbols_per_word": -1, "pipes_per_word": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": -1, "digit_share": -1,
    "punct_per_word": 0, "mean_word": 0, "short_share": 0, "words_per_line": 0, "log_words": 0,
}
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def _marks(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_IS_SYMBOL, _IS_DIGIT, _IS_UPPER = _marks(SYMBOLS), _marks(b"0123456789"), _marks(bytes(range(65, 91)))
_IS_PUNCT, _IS_PIPE = _marks(b".,;:!?\"'()-"), _marks(b"|")
_NOT_INNER = np.array([(b & 0xC0) != 0x80 for b in range(256)])  # first bytes of code points
_SOLID_FIRST = _NOT_INNER & ~SPACE


def _distinct_repeats(keys: np.ndarray) -> np.ndarray:
    ordered = np.sort(keys)
    return np.unique(ordered[1:][ordered[1:] == ordered[:-1]])


def text_counts(column) -> np.ndarray:
    """The counts of COUNTS for each text, rows x counts. Null is an empty text."""
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    for piece in slices(column):
        n = len(piece.offsets) - 1
        docs = np.arange(n)
        salt = mix(docs.astype(np.uint64) + np.uint64(99))
        starts, ends = piece.word_bounds()
        word_doc = piece.doc_of(starts)
        hashes = piece.hashes(starts, ends)
        # Words in windows that occur twice or more in their text.
        window = windows(hashes, WINDOW)
        inside = word_doc[: len(window)] == word_doc[len(starts) - len(window) :]
        keys = window ^ salt[word_doc[: len(window)]]
        again = np.zeros(len(starts) + 1, np.int64)
        twice = _distinct_repeats(keys[inside])
        if len(twice):
            place = np.searchsorted(twice, keys)
            hit = np.flatnonzero(inside & (twice[np.minimum(place, len(twice) - 1)] == keys))
            np.add.at(again, hit, 1)
            np.add.at(again, hit + WINDOW, -1)
        repeated = np.bincount(word_doc[np.cumsum(again)[:-1] > 0], minlength=n)
        # Lines with a word; equal ones have equal bytes.
        breaks = np.flatnonzero(piece.data == 10)
        heads = np.unique(np.concatenate([piece.offsets[:-1], breaks + 1]))
        heads = heads[heads < len(piece.data)]
        tails = np.minimum(np.concatenate([heads[1:], [len(piece.data)]]), len(piece.data)) if len(heads) else heads
        tails = tails - (piece.data[np.maximum(tails - 1, 0)] == 10) if len(heads) else heads
        some = np.searchsorted(starts, heads) < np.searchsorted(starts, tails)
        heads, tails = heads[some], tails[some]
        line_doc = piece.doc_of(heads)
        line_keys = piece.hashes(heads, tails) ^ salt[line_doc]
        _, first = np.unique(line_keys, return_index=True)
        lines = np.bincount(line_doc, minlength=n)
        data = piece.data
        lengths = np.add.reduceat(_SOLID_FIRST[data], starts, dtype=np.int64) if len(starts) else starts
        short = np.bincount(word_doc[lengths <= 3], minlength=n)
        columns = [
            np.bincount(word_doc, minlength=n), piece.per_doc(_SOLID_FIRST[data]), piece.per_doc(_IS_SYMBOL[data]),
            lines - np.bincount(line_doc[first], minlength=n), repeated, piece.per_doc(_NOT_INNER[data]), lines,
            piece.per_doc(_IS_DIGIT[data]), piece.per_doc(_IS_UPPER[data]), piece.per_doc(_IS_PUNCT[data]), piece.per_doc(_IS_PIPE[data]), short,
        ]
        out[piece.first_row : piece.first_row + n] = np.stack(columns, axis=1)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            c["n_symbols"] / words, c["n_pipes"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_upper"] / chars,
            c["n_digits"] / chars, c["n_punct"] / words, c["word_chars"] / words, c["n_short"] / words, words / lines, np.log1p(words),
        ],
        axis=1,
    )


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with one long column ``q_<count>`` for each of COUNTS, in one pass over whole texts."""
    bound_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    fields = docs.select(*rest).schema.simpleString()[len("struct<") : -1]
    names = [f"q_{c}" for c in COUNTS]

    def run(batches):
        for batch in batches:
            counts = text_counts(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], names=[*batch.schema.names[:-1], *names]
            )

    wanted = ", ".join(f"{n} long" for n in names)
    return docs.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(tidied(run), f"{fields}, {wanted}" if fields else wanted)


def _breaks_rules(n_words, n_repeat_words):
    """Fewer than 10 words, or more than a fifth of the words in windows that repeat; for columns and arrays alike."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def base_failed() -> Column:
    return _breaks_rules(F.col("q_n_words"), F.col("q_n_repeat_words"))


def _smallest_hashes(n: int, max_rows: int) -> Column:
    """Whether the hash of ``_id`` is among the smallest, about four times ``max_rows`` of ``n``: what further tasks need not send."""
    share = min(1.0, 4 * max_rows / max(n, 1))
    return F.lit(True) if share == 1.0 else F.xxhash64("_id") <= F.lit(int(share * 2**64) - 2**63)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id and text of the documents that ``fit_quality`` may learn from, so that only their texts are counted.

    Of the ids in both tables whose label is 0 or 1, the ``max_rows`` with the smallest hash: a bounded list, which is
    broadcast. Null ids have no label. An empty table on either side gives an empty sample.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    there = cut_lineage(known.join(ids, "_id", "left_semi"))
    chosen = cut_lineage(there.where(_smallest_hashes(there.count(), max_rows)).orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")


def fit_quality(counted: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> FlatTrees:
    """Train on labelled documents that pass the base rules.

    ``counted``: doc_id and the counts; ``labels``: doc_id, quality (1 good, 0 not, other values and null ignored). At
    most ``max_rows`` rows, those with the smallest hash of doc_id among the first 4 * ``max_rows`` labels by hash, are
    written and then read by the driver: that bound does not grow with the corpus. Without labels of both kinds the
    model is constant.
    """
    wanted = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y"))
    wanted = wanted.where(_smallest_hashes(wanted.count(), max_rows))
    sample = counted.where(~base_failed()).join(wanted, F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows)
    rows = cut_lineage(sample.select("_y", *[f"q_{c}" for c in COUNTS])).toPandas()
    signs = list(FEATURES.values())
    return train(features(rows.iloc[:, 1:].to_numpy()), rows["_y"].to_numpy(), signs)


def score_quality(counted: DataFrame, model: FlatTrees, threshold: float = 0.5) -> DataFrame:
    """Adds quality_score (double), base_failed and kept: kept if the base rules hold and the score reaches ``threshold``.

    A model trained without both labels gives every text the same score and rejects none.
    """
    broken = len(model.roots) == 0
    names = [f"q_{c}" for c in COUNTS]

    @F.pandas_udf("double")
    def scored(table: pd.DataFrame) -> pd.Series:
        return pd.Series(model.probability(features(table.to_numpy())) if not broken else np.ones(len(table)))

    with_score = counted.withColumn("quality_score", scored(F.struct(*names))).withColumn("base_failed", base_failed())
    return with_score.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= threshold))


def judge_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, quality_score, base_failed and kept for every row of ``docs`` (doc_id, text; more ignored).

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike; rows without doc_id are
    judged by their text too.
    """
    counted = cut_lineage(document_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    return score_quality(counted, fit_quality(counted, labels, max_rows), threshold)


def keeps_text(model: FlatTrees, threshold: float = 0.5):
    """The verdict of ``judge_quality`` as a column function of a text, for filters: one pass, only the verdict comes back.

    A null or empty text is not kept. With a model trained without both labels the base rules alone decide.
    """
    n_words, n_repeat_words = COUNTS.index("n_words"), COUNTS.index("n_repeat_words")

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        counts = text_counts(texts)
        good = ~_breaks_rules(counts[:, n_words], counts[:, n_repeat_words])
        if len(model.roots):
            good &= model.probability(features(counts)) >= threshold
        give_back()
        return pa.array(good)

    return lambda text: kept(F.col(text).cast("string"))
