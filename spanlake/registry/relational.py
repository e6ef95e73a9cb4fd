"""Relational core: joins, windows, set operations, flattening, incremental results."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.text import row_key
from spanlake.operators.failures import sentence_units, span_shape
from spanlake.operators.incremental import content_manifest, first_by_key, last_by_key, merge_results, pending
from spanlake.operators.sampling import disjoint_draws, position_within, sample_ids, share_split, with_position
from spanlake.operators.scoring import parse_bool, parse_gold_answers
from spanlake.registry import inputs, query
from spanlake.registry import sqltext as S
from spanlake.sources.corpus import column_counts, contracts_from_records, lookup_join, paragraphs_from_contracts, questions_from_paragraphs

_BIG = "bigint"


def _nested(spark, folder):
    """Conversations as nested records: one document per conversation, user turns as questions."""
    turns = inputs.table(spark, folder, "conversations")
    qa = F.struct(
        "turn",
        F.col("text").alias("question"),
        (F.col("role") != "user").alias("is_impossible"),
        F.array(F.struct(F.col("role").alias("text"))).alias("answers"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(qa)), lambda q: q.dropFields("turn"))  # one conversation
    records = turns.groupBy("conv_id").agg(ordered.alias("qas"))
    paragraph = F.struct(F.get("qas", F.lit(0))["question"].alias("context"), F.col("qas"))
    return records.select(
        F.col("conv_id").alias("record_pos"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"), F.array(paragraph).alias("paragraphs")
    )


@query(
    "flatten_contracts",
    """SELECT conv_id::INT AS document_row_id, 'conversation ' || conv_id AS title, 1 AS paragraphs_len, first(text ORDER BY turn) AS context, count(*) AS questions
       FROM conversations GROUP BY conv_id""",
)
def flatten_contracts(spark, folder):
    contracts = contracts_from_records(_nested(spark, folder))
    return contracts.select("document_row_id", "title", "paragraphs_len", "context", F.size("qas").cast(_BIG).alias("questions"))


@query(
    "flatten_questions",
    """SELECT conv_id::INT || ':' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS row_id, text AS question, role <> 'user' AS is_impossible,
              1 AS answers_len FROM conversations""",
)
def flatten_questions(spark, folder):
    questions = questions_from_paragraphs(paragraphs_from_contracts(contracts_from_records(_nested(spark, folder))))
    return questions.select(row_key("document_row_id", "question_index").alias("row_id"), "question", "is_impossible", "answers_len")


@query("left_dim_join", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def left_dim_join(spark, folder):
    t = lambda n: inputs.table(spark, folder, n)
    joined = lookup_join(t("supplier"), t("nation"), "s_nationkey", "n_nationkey")
    return lookup_join(joined, t("region"), "n_regionkey", "r_regionkey").select("s_suppkey", "s_name", "n_name", "r_name")


@query(
    "semi_join_selected",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND o_totalprice > 200000)",
)
def semi_join(spark, folder):
    orders = inputs.table(spark, folder, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000D")
    items = inputs.table(spark, folder, "lineitem")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("anti_join_pending", "SELECT c_custkey AS row_id, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark, folder):
    work = inputs.table(spark, folder, "customer").select(F.col("c_custkey").alias("row_id"), "c_name")
    done = inputs.table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("row_id"))
    return pending(work, done)


@query(
    "full_outer_compare",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
       SELECT coalesce(a.k, b.k) AS custkey, coalesce(a.n, 0) AS baseline, coalesce(b.n, 0) AS comparison, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b ON a.k = b.k""",
)
def full_outer(spark, folder):
    orders = inputs.table(spark, folder, "orders")
    filled = F.col("o_orderstatus") == "F"
    side = lambda rows, n: orders.where(rows).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias(n))
    both = side(filled, "baseline").join(side(~filled, "comparison"), "custkey", "full_outer").na.fill(0)
    return both.withColumn("delta", F.col("baseline") - F.col("comparison"))


@query(
    "cross_variants",
    """SELECT item_id, q || ' / ' || c AS variant_name FROM benchmark, (SELECT unnest(['raw_q', 'enriched_v1']) AS q),
       (SELECT unnest(['raw_ctx', 'rag_dense', 'rag_hybrid', 'rag_hier_bm25', 'rag_hier_dense']) AS c)""",
)
def cross_variants(spark, folder):
    from spanlake.plans.variants import variant_grid

    return variant_grid(inputs.table(spark, folder, "benchmark").select("item_id")).select("item_id", "variant_name")


@query(
    "last_write_wins",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def last_write_wins(spark, folder):
    events = inputs.table(spark, folder, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return last_by_key(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_per_key(spark, folder):
    events = inputs.table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return first_by_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("ordered_collect", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY conv_id")
def ordered_collect(spark, folder):
    turns = inputs.table(spark, folder, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "line")))  # one conversation
    grouped = turns.groupBy("conv_id").agg(ordered.alias("lines"))
    return grouped.select("conv_id", F.array_join(F.transform("lines", lambda t: t["line"]), "\n").alias("transcript"), F.size("lines").cast(_BIG).alias("turns"))


@query(
    "union_merge",
    """WITH u AS (SELECT event_id // 2 AS row_id, value, 0 AS src, event_id AS seq FROM events WHERE event_type = 'click'
                  UNION ALL SELECT event_id // 2, value, 1, event_id FROM events WHERE event_type <> 'click')
       SELECT row_id, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY src DESC, seq DESC) AS n FROM u) WHERE n = 1""",
)
def union_merge(spark, folder):
    """Click events as the older result table, all other events as the newer one, keyed by pairs of ids."""
    events = inputs.table(spark, folder, "events").select("event_type", F.floor(F.col("event_id") / 2).alias("row_id"), "value", F.col("event_id").alias("seq"))
    older = events.where("event_type = 'click'").drop("event_type")
    return merge_results(older, events.where("event_type <> 'click'").drop("event_type"))


@query("json_roundtrip", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '["' || event_type || '"]' AS cell, 1 AS parsed FROM events""")
def json_roundtrip(spark, folder):
    events = inputs.table(spark, folder, "events")
    cell = F.to_json(F.array("event_type"))
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), cell.alias("cell"), F.size(parse_gold_answers(cell)).alias("parsed"))


@query("bad_json", "SELECT event_id, 0 AS parsed FROM events")
def bad_json(spark, folder):
    """Cells that are not a JSON list count as no answers."""
    return inputs.table(spark, folder, "events").select("event_id", F.size(parse_gold_answers(F.concat("event_type", F.lit("[")))).alias("parsed"))


@query("manifest_hash", "SELECT doc_id AS document_row_id, 'v1' AS version, sha256(text) AS text_sha256 FROM documents")
def manifest_hash(spark, folder):
    return content_manifest(inputs.documents(spark, folder), "v1")


@query("column_counts", "SELECT count(*) AS rows, count(doc_id) AS doc_id, count(text) AS text, count(lang) AS lang, count(source) AS source, count(n_chars) AS n_chars FROM documents")
def counts(spark, folder):
    return column_counts(inputs.table(spark, folder, "documents"))


@query("value_counts", "SELECT lang, source, count(*) AS documents, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY ALL")
def value_counts(spark, folder):
    """Distinct texts by hash: equal texts meet by (group, hash) before they are counted."""
    rows = inputs.table(spark, folder, "documents").groupBy("lang", "source", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("lang", "source").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("distinct_texts"))


@query("document_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM (SELECT DISTINCT o_orderkey FROM orders)")
def document_positions(spark, folder):
    return with_position(inputs.table(spark, folder, "orders"), "o_orderkey")


def _permutation_sql(seed: int) -> str:
    """Places of all documents in the permutation that ``permuted`` defines."""
    add = lambda r, half: f"CAST(('0x' || substr(md5('{seed}:{r}:' || CAST({half} AS VARCHAR)), 1, 13)) AS BIGINT)"
    l1 = f"((x // b) + {add(0, '(x % b)')}) % a"
    steps = f"""SELECT id, a, b, n, ({l1}) AS l1, x % b AS r0 FROM {{0}}"""
    second = f"SELECT *, (r0 + {add(1, 'l1')}) % b AS r1 FROM ({steps})"
    third = f"SELECT *, (l1 + {add(2, 'r1')}) % a AS l2 FROM ({second})"
    fourth = f"SELECT id, a, b, n, l2 * b + (r1 + {add(3, 'l2')}) % b AS x FROM ({third})"
    size = "SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents))"
    return f"""size AS (SELECT n, a, (n + a - 1) // a AS b FROM ({size})),
      placed AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS x FROM (SELECT DISTINCT doc_id FROM documents)),
      walk AS ({fourth.format('(SELECT id, a, b, n, x FROM placed, size)')} UNION ALL {fourth.format('(SELECT * FROM walk WHERE x >= n)')}),
      drawn AS (SELECT id, x, n FROM walk WHERE x < n)"""


@query(
    "disjoint_draws",
    f"""WITH RECURSIVE {_permutation_sql(42)}, cut AS (SELECT *, n // 5 AS first, n // 10 AS second FROM drawn)
        SELECT id AS doc_id, CASE WHEN x < first THEN 0 ELSE 1 END AS draw, CASE WHEN x < first THEN x ELSE x - first END AS selection_pos FROM cut WHERE x < first + second""",
)
def draws(spark, folder):
    """A fifth and then a tenth of all documents, drawn without a common one."""
    ids = inputs.table(spark, folder, "documents").select("doc_id")
    n = ids.distinct().count()
    return disjoint_draws(ids, [n // 5, n // 10], 42, "doc_id")


@query("share_split", f"WITH RECURSIVE {_permutation_sql(7)} SELECT id AS doc_id, CASE WHEN x < floor(n * 0.6) THEN 'train' ELSE 'test' END AS split FROM drawn")
def sixty_forty(spark, folder):
    return share_split(inputs.table(spark, folder, "documents"), 0.6, 7, "doc_id")


@query("seeded_sample")
def seeded_sample(spark, folder):
    """The reference sample of 50 documents, drawn with seed 42 from all ids."""
    return sample_ids(inputs.documents(spark, folder).select("document_row_id"), 50, 42)


@query(
    "parse_bool",
    """SELECT event_id, lower(event_type) IN ('view', 'yes') AS flag FROM events""",
)
def parse_flag(spark, folder):
    text = F.when(F.lower("event_type") == "view", F.lit(" Yes! ")).otherwise(F.col("event_type"))
    return inputs.table(spark, folder, "events").select("event_id", parse_bool(text).alias("flag"))


@query(
    "span_shapes",
    f"""WITH u AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace({S.strip('text')}, '([.!?]){S.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS u FROM conversations)
        SELECT conv_id, turn, len(u) AS units, CASE WHEN len(u) = 0 THEN 'none' WHEN len(u) > 1 THEN 'multi_sentence' ELSE 'single_sentence' END AS shape FROM u""",
)
def span_shapes(spark, folder):
    turns = inputs.table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.size(sentence_units(F.col("text"))).cast(_BIG).alias("units"), span_shape(F.col("text")).alias("shape"))


@query(
    "turn_index_join",
    """WITH a AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM conversations)
       SELECT q.conv_id, q.i AS turn_index, length(q.text) AS question_chars, length(p.text) AS answer_chars
       FROM a q JOIN a p ON p.conv_id = q.conv_id AND p.i = q.i WHERE q.role = 'user' AND p.role = 'assistant'""",
)
def turn_index_join(spark, folder):
    """Position of each turn among the turns of its role, then a join on two keys."""
    turns = inputs.table(spark, folder, "conversations").select("conv_id", "role", "turn", F.length("text").alias("chars"))
    rows = position_within(turns, ["conv_id", "role"], "turn", "turn_index")
    side = lambda role, name: rows.where(F.col("role") == role).select("conv_id", "turn_index", F.col("chars").alias(name))
    return side("user", "question_chars").join(side("assistant", "answer_chars"), ["conv_id", "turn_index"])


@query(
    "slice_accuracy",
    """SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority END AS priority, CASE WHEN grouping(o_orderstatus) = 0 THEN o_orderstatus END AS status,
              count(*) AS rows, round(avg((o_totalprice > 150000)::INT), 6) AS accuracy
       FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""",
)
def slice_accuracy(spark, folder):
    orders = inputs.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 150000).cast("int").alias("hit"))
    return orders.cube("priority", "status").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query(
    "accuracy_pivot",
    """SELECT l_returnflag AS slice, round(avg((l_discount > 0.05)::INT) FILTER (WHERE l_linestatus = 'F'), 6) AS F, round(avg((l_discount > 0.05)::INT) FILTER (WHERE l_linestatus = 'O'), 6) AS O
       FROM lineitem GROUP BY 1""",
)
def accuracy_pivot(spark, folder):
    items = inputs.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("slice"), "l_linestatus", (F.col("l_discount") > 0.05).cast("int").alias("hit"))
    return items.groupBy("slice").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("hit"), 6))


@query(
    "numeric_match",
    """SELECT l_orderkey, l_linenumber, abs(l_extendedprice * (1 - l_discount) - l_extendedprice) < 0.001 AS close, lower(l_returnflag) = lower('r') AS same FROM lineitem""",
)
def numeric_match(spark, folder):
    from spanlake.functions.numeric import matches

    items = inputs.table(spark, folder, "lineitem")
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("string")
    return items.select(
        "l_orderkey", "l_linenumber", matches(net, F.col("l_extendedprice").cast("string")).alias("close"), matches(F.col("l_returnflag"), F.lit(" r ")).alias("same")
    )


@query(
    "calculator",
    """SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 6 WHEN 0 THEN l_quantity + l_linenumber WHEN 1 THEN l_quantity - l_linenumber
              WHEN 2 THEN l_quantity * l_linenumber WHEN 3 THEN l_quantity / l_linenumber WHEN 4 THEN pow(l_quantity, l_linenumber)
              ELSE (l_quantity > l_linenumber)::INT END, 4) AS result FROM lineitem""",
)
def calculator(spark, folder):
    from spanlake.functions.numeric import calculate

    names = F.array(*[F.lit(n) for n in ("add", "subtract", "multiply", "divide", "exp", "greater")])
    operation = F.get(names, F.col("l_linenumber") % 6)
    result = calculate(operation, F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    return inputs.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(result, 4).alias("result"))
