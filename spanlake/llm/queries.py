"""One registered query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import alignment, bpe, chat, language, licences, mixing, mtree, near_dedup, pages, quality, ranked, sharding, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths, so they are laid out as source/thousand/twenty/doc_id.txt, every 20th as LICENSE.txt one level up."""
    docs = _table(spark, sf_dir, "documents")
    high, low = F.col("doc_id").cast("long") - F.pmod("doc_id", F.lit(1000)), F.col("doc_id").cast("long") - F.pmod("doc_id", F.lit(20))
    source = F.coalesce("source", F.lit("none"))
    path = F.when(F.pmod("doc_id", F.lit(20)) == 0, F.concat_ws("/", source, high, F.concat(F.lit("LICENSE-"), F.col("doc_id"), F.lit(".txt")))).otherwise(
        F.concat_ws("/", source, high, low, F.concat(F.col("doc_id"), F.lit(".txt")))
    )
    files = docs.where("doc_id is not null").select(path.alias("path"), "text")
    return licences.inherit_licences(files, licences.scan_licences(files))


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in columns], "base_failed", "quality_score", "kept")


@_query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn int, role string, text string")
    read = chat.read_back(chat.format_conversations(conversations.unionByName(planted)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), (F.size("rewrites") > 0).alias("rewrites_history"),
    )


@_query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.session import cut_lineage

    vectors = cut_lineage(mtree.integer_vectors(_table(spark, sf_dir, "embeddings")))
    return mtree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


@_query
def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(warc.mark_revisits(_table(spark, sf_dir, "pages")))
    return warc.read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents"), words=4, percent=80)


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    profiles = language.fit_profiles(docs.where(~held_out))
    return language.identify_language(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    both = bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest_ids("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(_table(spark, sf_dir, "documents"))
    return ranked.search_index(index, _table(spark, sf_dir, "benchmark"), 20)


@_query
def op12_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2("text", 256).alias("text_key"))
    placed = sharding.assign_shards(rows, F.col("text_key"), F.col("bytes") + 8, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


_WORDS = r"'[^\x20\x09-\x0D]+'"
ORACLES = {
    "op1_source_mix": f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares FROM weighed),
marked AS (SELECT *, 3 * source_size * shares <= remaining * weight AS is_full FROM levels),
level AS (SELECT arg_max(remaining, shares) AS remaining, max(shares) AS shares FROM marked WHERE NOT is_full),
plan AS (SELECT m.source, m.source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(level.remaining * weight AS DOUBLE) / level.shares END AS target FROM marked m, level),
rated AS (
  SELECT d.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS coin
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated""",
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
marked AS (
  SELECT *, length(text)
    + length(regexp_replace(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[TEXT\]|\[/ROLE\]|\\', '\0' || chr(1), 'g')) - length(text)
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, false AS rewrites_history FROM marked GROUP BY conv_id""",
    "op5_exact_topk": """
WITH clean AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT *, list_transform(range(32), lambda k: (CAST(('0x' || substr(hex || '0', (5 * k) // 4 + 1, 3)) AS BIGINT) >> (7 - (5 * k) % 4)) & 31) AS five
  FROM (SELECT page_id, payload_bytes, hex || '00' AS hex, first FROM d))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(five, lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(i + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM bits""",
    "op11_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL) JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20""",
    "op8_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = u""",
}
