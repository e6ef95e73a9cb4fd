"""How the test tables stand in for documents, questions, golden answers and predictions.

* documents: ``documents`` (document_row_id = doc_id); category = language, description = source;
* answerable questions: a ``benchmark`` item contained in a document, question and golden answer alike;
* unanswerable questions: user turns of conversation c asked about document c;
* question_index: 2 * item for the former, 2 * turn + 1 for the latter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import row_key
from spanlake.operators.chunk import sentence_chunks
from spanlake.operators.enrichment import base_query
from spanlake.operators.retrieve import index_parts
from spanlake.operators.term_index import PARTS, TermIndex
from spanlake.plans.stores import RECURSIVE_VERSION, stored_index, stored_recursive_chunks, stored_spans
from spanlake.session import cut_lineage, shared_folder

_TOKEN = r"[a-zA-Z0-9[\p{L}\p{N}]]+"  # letters and digits; most are told by one comparison


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, spread over all cores when the files give fewer splits than that (never at scale)."""
    rows = table(spark, folder, "documents").withColumnRenamed("doc_id", "document_row_id")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, "document_row_id") if rows.rdd.getNumPartitions() < cores else rows


def store(spark: SparkSession, folder: str) -> str:
    """Where the spans and chunks of a data folder are kept for later queries."""
    return f"{shared_folder(spark)}/spanlake/{hashlib.sha256(folder.encode()).hexdigest()[:16]}"


def _grams(tokens, keep):
    """Neighbouring token triples as hashes."""
    from spanlake.functions.text import let

    def build(known):
        count = F.greatest(F.size(known) - 2, F.lit(0))
        return F.transform(F.slice(known, 1, count), lambda t, i: F.xxhash64(t, F.get(known, i + 1), F.get(known, i + 2)))

    return keep(let(tokens, build))


def _character_runs(text, size: int):
    """All runs of ``size`` neighbouring characters, from one pass over the characters."""
    from spanlake.functions.text import let

    def build(letters):
        count = F.greatest(F.size(letters) - (size - 1), F.lit(0))
        return F.transform(F.slice(letters, 1, count), lambda c, i: F.concat(c, *[F.get(letters, i + k) for k in range(1, size)]))

    return let(F.split(text, ""), build)


def containment_join(haystacks: DataFrame, needles: DataFrame, hay_id: str, needle_id: str) -> DataFrame:
    """Exact (haystack, needle) pairs where the needle text is a substring, without pairing everything.

    Tokens inside a needle (all but the first and last) appear as whole tokens wherever the needle does, so
    the needle's first inner token triple must be among the triples of the haystack: an equi-join on a hash
    gives the candidates, the substring test decides. A needle of fewer than five tokens is joined by its first
    three characters (all, if fewer) with the runs of as many characters in the haystack. Empty needles have no pairs.
    """
    tokens = F.regexp_extract_all(F.col("text"), F.lit(_TOKEN), F.lit(0))
    anchors = needles.select(needle_id, F.col("text").alias("needle"), tokens.alias("t"))
    inner = F.xxhash64(F.get("t", F.lit(1)), F.get("t", F.lit(2)), F.get("t", F.lit(3)))
    anchors = anchors.select(
        needle_id,
        "needle",
        F.when(F.size("t") >= 5, inner).alias("gram"),
        F.least(F.length("needle"), F.lit(3)).alias("run"),
    )
    spread = explode_rows(haystacks, _grams(tokens, F.array_distinct), hay_id, names=("n", "gram")).drop("n")
    # A haystack holds each triple once and a needle has one triple, so no pair can repeat.
    candidates = spread.join(anchors.where("gram is not null"), "gram").select(hay_id, needle_id, "needle")
    short = anchors.where("gram is null and run > 0").withColumn("gram", F.left("needle", F.col("run")))
    for run in sorted(r.run for r in short.select("run").distinct().collect()):  # 1 to 3, those that occur
        starts = explode_rows(haystacks, F.array_distinct(_character_runs(F.col("text"), run)), hay_id, names=("n", "gram")).drop("n")
        candidates = candidates.unionByName(starts.join(short.where(F.col("run") == run), "gram").select(hay_id, needle_id, "needle"))
    return candidates.join(haystacks, hay_id).where(F.contains("text", "needle"))


def gold_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return containment_join(documents(spark, folder), table(spark, folder, "benchmark"), "document_row_id", "item_id")


def evaluation_rows(spark: SparkSession, folder: str) -> DataFrame:
    answer = F.array(F.struct(F.col("needle").alias("text")))
    answerable = gold_pairs(spark, folder).select(
        "document_row_id",
        (F.col("item_id") * 2).alias("question_index"),
        F.col("lang").alias("category"),
        F.col("source").alias("category_description"),
        F.col("needle").alias("question"),
        answer.alias("answers"),
        F.lit(False).alias("is_impossible"),
    )
    turns = table(spark, folder, "conversations").where(F.col("role") == "user")
    turns = turns.select(F.col("conv_id").alias("document_row_id"), "turn", F.col("text").alias("question"))
    about = documents(spark, folder).select("document_row_id", "lang", "source")
    unanswerable = turns.join(about, "document_row_id").select(
        "document_row_id",
        (F.col("turn") * 2 + 1).alias("question_index"),
        F.col("lang").alias("category"),
        F.col("source").alias("category_description"),
        "question",
        F.array().cast("array<struct<text:string>>").alias("answers"),
        F.lit(True).alias("is_impossible"),
    )
    return answerable.unionByName(unanswerable).withColumn("row_id", row_key("document_row_id", "question_index"))


def stored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows, stored once for queries that read them several times."""
    return cut_lineage(evaluation_rows(spark, folder))


def search_queries(rows: DataFrame) -> DataFrame:
    """Queries of the rows, stored once because every search reads them several times."""
    return cut_lineage(rows.select(F.col("row_id").alias("query_id"), "document_row_id", base_query().alias("query")))


def spans(spark: SparkSession, folder: str) -> DataFrame:
    return stored_spans(documents(spark, folder), store(spark, folder))


def recursive(spark: SparkSession, folder: str) -> DataFrame:
    return stored_recursive_chunks(documents(spark, folder), store(spark, folder))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence chunks; the texts carry no section lines, so five sentences stand for one section."""
    plain = sentence_chunks(spans(spark, folder))
    part = F.concat(F.lit("part "), F.floor(F.col("chunk_pos") / 5).cast("string"))
    return plain.withColumns({"section_title": part, "clause_path": F.array(part)})


def index(spark: SparkSession, folder: str, *methods: str) -> TermIndex:
    """What the methods read of the index of sentence chunks."""
    return stored_index(documents(spark, folder), chunks(spark, folder), store(spark, folder), parts=index_parts(*methods) or PARTS)


def recursive_index(spark: SparkSession, folder: str, *methods: str) -> TermIndex:
    return stored_index(documents(spark, folder), recursive(spark, folder), store(spark, folder), RECURSIVE_VERSION, parts=index_parts(*methods) or PARTS)


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each assistant turn as a prediction for the user turn before it.

    The predecessor is found by an equi-join on (conversation, turn - 1), not by a window over a conversation.
    """
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold_text"))
    answered = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("predicted_answer"))
    return answered.join(asked, ["conv_id", "turn"])


def results(spark: SparkSession, folder: str, shift: int = 0) -> DataFrame:
    """Result rows: the answer of turn t + 2 * shift against question t; a toxic label marks "no answer"."""
    from spanlake.operators.scoring import with_token_f1

    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1 + 2 * shift).alias("turn"), F.col("turn").alias("question_index"), F.col("text").alias("gold_text"))
    answered = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("predicted_answer"))
    labels = table(spark, folder, "labels")
    about = table(spark, folder, "documents").select("doc_id", "lang")
    rows = (
        asked.join(answered, ["conv_id", "turn"], "left")
        .join(labels, F.col("conv_id") == labels["doc_id"], "left")
        .drop("doc_id")
        .join(about, F.col("conv_id") == about["doc_id"], "left")
    )
    impossible = F.coalesce(F.col("toxic") == 1, F.lit(False))
    rows = rows.select(
        row_key("conv_id", "question_index").alias("row_id"),
        F.col("conv_id").alias("document_row_id"),
        "question_index",
        F.coalesce("lang", F.lit("")).alias("category"),
        F.when(impossible, F.array().cast("array<string>")).otherwise(F.array("gold_text")).alias("golds"),
        F.coalesce("predicted_answer", F.lit("")).alias("predicted_answer"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("predicted_marked_impossible"),
        impossible.alias("gold_marked_impossible"),
    )
    scored = with_token_f1(rows, "predicted_answer", F.col("golds"))
    return scored.withColumn("correct_at_0_5", F.col("token_f1") >= 0.5)
