"""Records of JSON files of any layout, read in splits of bytes.

Spark cuts the files behind every ``}``, wherever a split begins. What such a piece does to a reader of JSON is a small
automaton: it may end a string or not, and it opens and closes some brackets, in two variants for the two states in
which it may begin. Effects of consecutive pieces compose, so running sums inside a split, and over the few splits of a
file, tell for every piece whether it begins in a string and how deep. A record begins where a piece at the depth of
records has a brace, and goes on until that depth is reached again. So a large ``{"data": [...]}`` is read by as many
tasks as it has splits, and files of different layouts may lie in one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.session import cut_lineage

_SPLIT = ("file_path", "file_block_start")


def _outside(piece: Column, begins_inside: bool) -> Column:
    """What stands outside strings in a piece without escapes."""
    parts = F.split(piece, '"')
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == int(begins_inside)), " ")


def _balance(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _before(df: DataFrame, value: Column, into: str) -> DataFrame:
    """The sum of ``value`` over all earlier pieces of the file: those of earlier splits and those before it in its own."""
    rows = df.withColumn("_value", value)
    earlier = lambda over: F.coalesce(F.sum("_value").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy(*_SPLIT).agg(F.sum("_value").alias("_value"))
    starts = totals.select(*_SPLIT, earlier(W.partitionBy("file_path").orderBy("file_block_start")).alias("_start"))
    inside = rows.withColumn("_inside", earlier(W.partitionBy(*_SPLIT).orderBy("_row")))
    return inside.join(starts, list(_SPLIT)).withColumn(into, F.col("_start") + F.col("_inside")).drop("_value", "_start", "_inside")


def _latest(df: DataFrame, **values: Column) -> DataFrame:
    """The last known value of each kind up to each piece of the file."""
    rows = df.withColumns({f"_new_{k}": v for k, v in values.items()})
    known = [F.max_by(f"_new_{k}", F.when(F.col(f"_new_{k}").isNotNull(), F.col("_row"))).alias(f"_old_{k}") for k in values]
    over = W.partitionBy("file_path").orderBy("file_block_start").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(*_SPLIT).agg(*known).select(*_SPLIT, *[F.last(f"_old_{k}", ignorenulls=True).over(over).alias(f"_start_{k}") for k in values])
    inside = W.partitionBy(*_SPLIT).orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = rows.withColumns({f"_own_{k}": F.last(f"_new_{k}", ignorenulls=True).over(inside) for k in values}).join(starts, list(_SPLIT))
    return own.withColumns({k: F.coalesce(f"_own_{k}", f"_start_{k}") for k in values}).drop(*[f"_{x}_{k}" for x in ("new", "own", "start") for k in values])


def read_record_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, record_no, text): the JSON text of every record, numbered in file order.

    A file is any sequence of JSON values: lists of records, ``{"data": [records]}`` or single records, each on one
    line or on many. A value ``{...}`` whose ``data`` stands behind another nested value is one record text as a
    whole. Files without a value give no rows; a file that ends inside a string or bracket is an error.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select("value", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size").withColumn("_row", F.monotonically_increasing_id())  # rises within a split
    plain = F.regexp_replace("value", r"\\(?s:.)", "")
    pieces = pieces.withColumn("_quotes", F.length(plain) - F.length(F.translate(plain, '"', "")))
    for inside in (0, 1):
        # the brace behind a piece closes something unless it stands in a string
        closes = F.when((F.col("_quotes") + inside) % 2 == 0, F.lit(1)).otherwise(F.lit(0))
        pieces = pieces.withColumn(f"_effect{inside}", _balance(_outside(plain, bool(inside))) - closes)
    pieces = _before(cut_lineage(pieces), F.col("_quotes"), "_quotes_before")
    begins_inside = F.col("_quotes_before") % 2 == 1
    pieces = cut_lineage(_before(pieces, F.when(begins_inside, F.col("_effect1")).otherwise(F.col("_effect0")), "depth"))
    _require_closed(pieces)

    outside = ~begins_inside
    # a value begins at depth 0, or behind the end of a list at depth 1
    behind_lists = F.regexp_replace("value", r"^[\s\ufeff]*(?:\[\s*\]\s*)*", "")
    behind_end = F.regexp_replace(F.regexp_replace("value", r"^\s*\]", ""), r"^\s*(?:\[\s*\]\s*)*", "")
    fresh = F.when(outside & (F.col("depth") == 0), behind_lists).when(outside & (F.col("depth") == 1) & F.col("value").rlike(r"^\s*\]"), behind_end)
    in_front = F.regexp_extract("_fresh", r'(?s)^(.*?)(?<!\\)"data"\s*:\s*\[', 1)
    wrapped = F.col("_fresh").rlike(r'(?s)^\{.*?(?<!\\)"data"\s*:\s*\[') & (_balance(_outside(F.regexp_replace(in_front, r"\\(?s:.)", ""), False)) == 1)
    in_data = F.regexp_replace("_fresh", r'(?s)^\{.*?(?<!\\)"data"\s*:\s*\[\s*', "")
    wrapper = F.when(in_data.startswith("]"), F.lit("behind data")).otherwise(F.lit("wrapped"))
    kind = F.when(F.col("_fresh").startswith("["), F.lit("list")).when(wrapped, wrapper).when(F.col("_fresh").startswith("{"), F.lit("single"))
    ends_data = outside & (F.col("depth") == 2) & F.col("value").rlike(r"^\s*\]")
    pieces = pieces.withColumn("_fresh", fresh).withColumn("_kind", kind)
    pieces = _latest(pieces, kind=F.col("_kind"), _ended=F.when(F.col("_kind").isNotNull(), F.lit(False)).when(ends_data, F.lit(True)))
    pieces = pieces.withColumn("kind", F.when((F.col("kind") == "wrapped") & F.col("_ended"), F.lit("behind data")).otherwise(F.col("kind")))

    head = (
        F.when(F.col("_fresh").isNotNull() & (F.col("kind") == "list"), F.regexp_replace("_fresh", r"^\[\s*", ""))
        .when(F.col("_fresh").isNotNull() & F.col("kind").isin("wrapped", "behind data"), in_data)
        .when(F.col("_fresh").isNotNull(), F.col("_fresh"))
        .when(outside & (((F.col("kind") == "list") & (F.col("depth") == 1)) | ((F.col("kind") == "wrapped") & (F.col("depth") == 2))), F.regexp_replace("value", r"^[\s,]*", ""))
    )
    pieces = pieces.withColumn("_head", head)
    starts = F.coalesce(F.col("_head").startswith("{"), F.lit(False))
    above = F.when(F.col("kind") == "list", 1).when(F.col("kind") == "wrapped", 2).when(F.col("kind") == "single", 0)
    goes_on = (F.col("depth") > above) & F.col("_head").isNull()
    pieces = pieces.withColumn("_starts", starts.cast("int")).where(starts | F.coalesce(goes_on, F.lit(False)))
    numbered = _before(pieces, F.col("_starts"), "_earlier")
    part = F.struct("file_block_start", "_row", F.when(F.col("_starts") == 1, F.col("_head")).otherwise(F.col("value")).alias("text"))
    records = numbered.groupBy("file_path", (F.col("_earlier") + F.col("_starts") - 1).alias("record_no")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return records.select("file_path", "record_no", F.concat(F.array_join(F.col("parts.text"), "}"), F.lit("}")).alias("text"))


def _require_closed(pieces: DataFrame) -> None:
    """Raise if a file ends inside a string or a bracket."""
    effect = F.when(F.col("_quotes_before") % 2 == 1, F.col("_effect1")).otherwise(F.col("_effect0"))
    last = F.max_by(F.struct((F.col("depth") + effect).alias("depth"), (F.col("_quotes_before") + F.col("_quotes")).alias("quotes")), F.struct("file_block_start", "_row"))
    ends = pieces.groupBy("file_path", "file_size").agg(last.alias("at"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    # Whether a brace stands behind the last piece shows in the size of the file (of which Spark leaves out a byte order
    # mark); a compressed file may end either way.
    spare = F.col("bytes") - F.col("file_size")
    brace = F.when(spare.isin(0, -3), F.lit(True)).when(spare.isin(1, -2), F.lit(False))
    closed = F.when(brace, F.col("at.depth") == 0).when(~brace, F.col("at.depth") == -1).otherwise(F.col("at.depth").isin(0, -1))
    bad = ends.where((F.col("at.quotes") % 2 == 1) | ~closed).limit(5).collect()
    if bad:
        raise ValueError("unfinished JSON in " + ", ".join(r.file_path for r in bad))
