"""Stored sentence spans, chunks and search indexes: reused when their manifest matches the documents.

Spans and chunks belong to one document each, so a store of them is brought up to date by document: rows lie in buckets
of documents, and only buckets with a new, changed or vanished document are written anew. An index depends on the whole
collection and is rebuilt.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.chunk import recursive_chunks
from spanlake.operators.incremental import content_manifest
from spanlake.operators.segment import sentence_key, sentence_spans
from spanlake.operators.term_index import PARTS, TermIndex, open_index, write_index
from spanlake.session import cut_lineage, write_table
from spanlake.sinks.tables import write_versioned
from spanlake.sources.results import read_table, read_valid_cache

SENTENCE_VERSION = "sentence-v4"
RECURSIVE_VERSION = "legal-recursive-v1"
INDEX_VERSION = "terms-v5"
# Buckets of a store at least, and documents of a bucket at most when it is first built.
BUCKETS = 64
BUCKET_DOCUMENTS = 100_000
# Buckets a task writes without sorting its rows.
OPEN_BUCKETS = 4
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def load_or_build(documents: DataFrame, path: str, version: str, build, rebuild: bool = False) -> tuple[DataFrame, bool]:
    """(rows, whether they came from the store). The manifest hashes every text, so changed input rebuilds."""
    manifest = content_manifest(documents, version)
    if not rebuild:
        stored = read_valid_cache(documents.sparkSession, path, manifest)
        if stored is not None:
            return stored, True
    built = build(documents)
    write_versioned(built, manifest, path)
    stored = read_valid_cache(documents.sparkSession, path, manifest)
    return (built if stored is None else stored), False


def _bucket(count: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("document_row_id").cast("string")), count).cast("int").alias("bucket")


@contextmanager
def _open_files(spark: SparkSession, count: int) -> Iterator[None]:
    """Writes inside keep so many partition files open in a task; only rows of further ones are sorted."""
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(max(int(before), count)))
    try:
        yield
    finally:
        spark.conf.set(_WRITERS, before)


def _rows_of(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame | None:
    """The rows of all buckets of a manifest (a path for each of them), None if there are none."""
    places = manifest.where("rows_name is not null").select("rows_name", "bucket").distinct().collect()
    return spark.read.parquet(*[f"{path}/{p.rows_name}/bucket={p.bucket}" for p in sorted(places)]) if places else None


def load_or_update(documents: DataFrame, path: str, version: str, build, rebuild: bool = False) -> tuple[DataFrame, int]:
    """(rows, number of buckets written). ``build`` must make the rows of each document from that document alone.

    The manifest holds version and text hash of every document, its bucket, and under which name the bucket's rows were
    written. Rows are written under a new name first, then the manifest, so readers and lost jobs never see rows and
    manifest that do not belong together; the names a new manifest no longer mentions stay for readers of the old one.
    """
    spark, expected, every = documents.sparkSession, content_manifest(documents, version), documents
    stored = None if rebuild else read_table(spark, f"{path}/manifest")
    if stored is None or not {"bucket", "buckets", "rows_name"} <= set(stored.columns):
        count = max(BUCKETS, documents.count() // BUCKET_DOCUMENTS)
        stored = expected.limit(0).select("*", F.lit(0).alias("bucket"), F.lit(count).alias("buckets"), F.lit(None).cast("string").alias("rows_name"))
        touched, kept = None, None
    else:
        first = stored.select("buckets").first()
        count = first.buckets if first else BUCKETS
        same = ["document_row_id", "version", "text_sha256"]
        changed = expected.join(stored.select(same), same, "left_anti").select("document_row_id")
        gone = stored.join(expected.select(same), same, "left_anti").select("document_row_id")
        touched = [r.bucket for r in changed.unionByName(gone).select(_bucket(F.lit(count))).distinct().collect()]  # one number per bucket
        if not touched:
            rows = _rows_of(spark, path, stored)
            return (build(documents) if rows is None else rows), 0
        old = _rows_of(spark, path, stored.where(F.col("bucket").isin(touched)))
        kept = None if old is None else old.join(stored.join(expected.select(same), same, "left_semi").select("document_row_id").distinct(), "document_row_id", "left_semi")
        documents = documents.join(changed.distinct(), "document_row_id", "left_semi")
    name = f"rows-{uuid.uuid4().hex}"
    own = _bucket(F.lit(count))
    # documents are dealt out by bucket before they are built, so their many rows are written where they are made,
    # neither shuffled nor sorted
    rows = build(documents.repartitionByRange(count, own)).withColumn("bucket", own)
    if kept is not None:
        rows = kept.select(rows.drop("bucket").columns).withColumn("bucket", own).unionByName(rows).repartition("bucket")
    with _open_files(spark, OPEN_BUCKETS):
        write_table(rows, f"{path}/{name}", by=("bucket",))
    written = [r.bucket for r in spark.read.schema(rows.schema).parquet(f"{path}/{name}").select("bucket").distinct().collect()]
    current = expected.select("*", own, F.lit(count).alias("buckets"))
    # buckets that were not touched keep the name they have
    before = stored.select("bucket", "rows_name").distinct()
    if touched is not None:
        before = before.where(~F.col("bucket").isin(touched))
    after = spark.createDataFrame([(b, name) for b in written], "bucket int, rows_name string").unionByName(before)
    write_table(cut_lineage(current.join(after, "bucket", "left")), f"{path}/manifest", "overwrite")
    found = _rows_of(spark, path, spark.read.parquet(f"{path}/manifest"))
    return (build(every) if found is None else found), len(touched) if touched is not None else len(written)


def _packed_spans(documents: DataFrame) -> DataFrame:
    """Sentence spans as they are stored: without ids, which tell no more than document and index, and with a normalised text only where it differs."""
    return sentence_spans(documents).drop("sentence_id").withColumn("normalized_text", F.when(F.col("normalized_text") != F.col("raw_text"), F.col("normalized_text")))


def _span_columns(rows: DataFrame) -> list[str]:
    names = [c for c in rows.columns if c != "bucket"]
    return [names[0], "sentence_id", *names[1:]]


def stored_spans(documents: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    rows = load_or_update(documents, f"{path}/{SENTENCE_VERSION}", SENTENCE_VERSION, _packed_spans, rebuild)[0]
    whole = {"sentence_id": sentence_key(), "normalized_text": F.coalesce("normalized_text", "raw_text")}
    return rows.select(*[whole[c].alias(c) if c in whole else c for c in _span_columns(rows)])


def stored_recursive_chunks(documents: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    return load_or_update(documents, f"{path}/{RECURSIVE_VERSION}", RECURSIVE_VERSION, recursive_chunks, rebuild)[0]


def stored_index(documents: DataFrame, chunks: DataFrame, path: str, kind: str = SENTENCE_VERSION, rebuild: bool = False, parts: tuple[str, ...] = PARTS) -> TermIndex:
    """The index of the documents' chunks, each part in a store of its own; tables are written first, then the row that names them."""
    spark, found = documents.sparkSession, {}
    for part in parts:
        version = f"{INDEX_VERSION}-{kind}-{part}"

        def build(_: DataFrame) -> DataFrame:
            name = f"tables-{uuid.uuid4().hex}"
            write_index(chunks, f"{path}/{version}/{name}", (part,))  # noqa: B023
            return spark.range(1).select(F.lit(name).alias("tables"))

        named = load_or_build(documents, f"{path}/{version}", version, build, rebuild)[0].first()
        found[part] = f"{path}/{version}/{named.tables}"
    return open_index(spark, found, parts)
