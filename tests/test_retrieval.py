import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.operators import fusion, ngram_counts, term_index, vectors
from spanlake.operators.fusion import fuse_ranked, hierarchical_search, section_index
from spanlake.operators.lexical import bm25_search, chunk_terms, document_frequencies, of_asked
from spanlake.operators.retrieve import index_parts, retrieve, sectioned_context
from spanlake.operators.segment import sentence_spans
from spanlake.operators.vectors import dense_search, ngram_terms, tfidf_search, tfidf_weights
from spanlake.operators.term_index import open_index, write_index
from spanlake.plans.stores import stored_index, stored_spans
from spanlake.session import write_table

TEXTS = {
    (1, 0): "Assignment requires consent.",
    (1, 1): "Notices must be in writing.",
    (1, 2): "Consent may not be withheld; consent is needed for assignment and transfer.",
    (1, 3): "",
    (1, 4): "The the the end.",
    (2, 0): "Assignment is forbidden in this document.",
    (2, 1): "Other words here.",
}
SECTIONS = {(1, 0): ["2", "Assignment"], (1, 1): ["9", "Notices"], (1, 2): ["2", "Assignment"], (1, 3): [], (1, 4): [], (2, 0): [], (2, 1): []}
QUERIES = [("a", 1, "assignment consent"), ("b", 1, "the the consent"), ("c", 2, "assignment zzz"), ("d", 1, "zzz"), ("e", 999, "assignment")]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(d, p, f"{d}:s:{p}", t, t, [f"{d}:s:{p}"], *(SECTIONS[d, p] or [None, None]), SECTIONS[d, p]) for (d, p), t in TEXTS.items()]
    return spark.createDataFrame(
        rows, "document_row_id int, chunk_pos int, chunk_id string, text string, normalized_text string, sentence_ids array<string>, "
        "section_number string, section_title string, clause_path array<string>",
    )


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, document_row_id int, query string")


def bm25(query, key):
    toks = {k: re.findall(r"[a-z0-9_]+", t.lower()) for k, t in TEXTS.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for v in toks.values() for t in set(v))
    tf, score = Counter(toks[key]), 0.0
    for t in re.findall(r"[a-z0-9_]+", query.lower()):
        if tf[t]:
            score += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * (len(toks[key]) or 1) / avg))
    return score


def grams(text):
    u = re.findall(r"\w\w+", text.lower())
    return u + [f"{a} {b}" for a, b in zip(u, u[1:])]


def tfidf(query, key):
    n = len(TEXTS)
    df = Counter(g for t in TEXTS.values() for g in set(grams(t)))
    vec = lambda text: {g: c * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in Counter(grams(text)).items() if df[g]}
    q, d = vec(query), vec(TEXTS[key])
    norm = math.sqrt(sum(v * v for v in q.values())) * math.sqrt(sum(v * v for v in d.values()))
    return sum(v * d.get(g, 0) for g, v in q.items()) / norm if norm else 0.0


def expected(score, k):
    out = {}
    for qid, doc, text in QUERIES:
        ranked = sorted(((score(text, key), key[1]) for key in TEXTS if key[0] == doc), key=lambda x: (-round(x[0], 9), x[1]))[:k]
        for rank, (value, pos) in enumerate(ranked, 1):
            out[qid, rank] = (pos, round(value, 9))
    return out


def actual(df):
    return {(r.query_id, r["rank"]): (r.chunk_pos, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 3, 10])
def test_bm25_and_tfidf_equal_the_formulas(chunks, queries, k):
    assert actual(bm25_search(chunks, queries, k)) == expected(bm25, k)
    assert actual(tfidf_search(chunks, queries, k)) == expected(tfidf, k)


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_frequent_and_rare_terms_take_different_lookups(chunks, queries, monkeypatch, share):
    monkeypatch.setattr(vectors, "HOT_SHARE", share)  # some terms, then no term, count as frequent
    assert actual(tfidf_search(chunks, queries, 3)) == expected(tfidf, 3)


def test_stored_index_gives_the_same_ranking(spark, chunks, queries, tmp_path):
    write_index(chunks, str(tmp_path / "index"))
    index = open_index(spark, str(tmp_path / "index"))
    assert actual(retrieve(chunks, queries, "bm25_sentence", 3, index=index)) == expected(bm25, 3)
    assert actual(retrieve(chunks, queries, "dense_sentence", 3, index=index)) == expected(tfidf, 3)
    for method in ("hybrid", "bm25_hierarchical", "dense_hierarchical"):
        assert actual(retrieve(chunks, queries, method, 4, index=index)) == actual(retrieve(chunks, queries, method, 4))
    plan = retrieve(chunks.drop("normalized_text"), queries, "dense_sentence", 3, index=index)
    assert plan.count() == len(expected(tfidf, 3))  # no text is read
    write_index(chunks.limit(0), str(tmp_path / "none"))
    assert retrieve(chunks.limit(0), queries, "bm25_sentence", 3, index=open_index(spark, str(tmp_path / "none"))).count() == 0


def test_stored_index_is_built_once_and_anew_for_changed_texts(spark, chunks, queries, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "document_row_id long, text string")
    path = str(tmp_path / "store")
    first = stored_index(docs, chunks, path)
    names = lambda index: index.places.inputFiles()
    assert names(stored_index(docs, chunks, path)) == names(first) != names(stored_index(docs.withColumn("text", F.lit("new")), chunks, path))


def test_fusion_ties_and_ranks(chunks, queries):
    dense, lexical = tfidf_search(chunks, queries, 5), bm25_search(chunks, queries, 5)
    fused = [r for r in fuse_ranked(dense, lexical, 3).orderBy("rank").collect() if r.query_id == "a"]
    assert [r["rank"] for r in fused] == [1, 2, 3] and fused[0].chunk_pos in (0, 2)
    # All scores are zero for query d, so both lists are in collection order and so is the fusion.
    assert [r.chunk_pos for r in fuse_ranked(dense, lexical, 3).where("query_id = 'd'").orderBy("rank").collect()] == [0, 1, 2]


def test_hierarchical_expands_sections(chunks, queries):
    ranked = hierarchical_search(chunks, queries, k=10, leaf_k=1, top_sections=1)
    assert {r.chunk_pos for r in ranked.where("query_id = 'a'").collect()} == {0, 2}
    assert ranked.where("query_id = 'e'").count() == 0
    dense = hierarchical_search(chunks, queries, "dense_hierarchical", k=1, leaf_k=50, top_sections=5)
    assert {(k[0], v[0]) for k, v in actual(dense).items()} == {(k[0], v[0]) for k, v in expected(tfidf, 1).items()}
    with pytest.raises(ValueError):
        hierarchical_search(chunks, queries, "other")
    with pytest.raises(ValueError):
        retrieve(chunks, queries, "other")


def test_section_index_and_context(spark, chunks, queries):
    spans = chunks.withColumns({"sentence_index": F.col("chunk_pos"), "sentence_id": F.col("chunk_id")})
    index = {tuple(r.section_key): r.sentence_ids for r in section_index(spans).where("document_row_id = 1").collect()}
    assert index == {("2", "Assignment"): ["1:s:0", "1:s:2"], ("9", "Notices"): ["1:s:1"], ("_unsectioned",): ["1:s:3", "1:s:4"]}
    ranked = hierarchical_search(chunks, queries.where("query_id = 'a'"), k=10, leaf_k=1, top_sections=1)
    context = sectioned_context(ranked, chunks).first().context
    assert context.count("[SECTION 2 - Assignment]") == 1 and TEXTS[1, 2] in context


def test_dense_vectors_equal_brute_force(spark):
    vectors = [(1, i, [float((i * 7 + j * 3) % 5 - 2) for j in range(4)]) for i in range(30)]
    query = [1.0, -2.0, 0.5, 0.0]
    chunks = spark.createDataFrame(vectors, "document_row_id int, chunk_pos int, vector array<float>")
    queries = spark.createDataFrame([("q", 1, query)], "query_id string, document_row_id int, query_vector array<double>")
    length = lambda v: math.sqrt(sum(x * x for x in v))
    cos = lambda v: sum(a * b for a, b in zip(v, query)) / (length(v) * length(query)) if length(v) else 0.0
    want = sorted(((-round(cos(v), 9), i) for _, i, v in vectors))[:5]
    assert [r.chunk_pos for r in dense_search(chunks, queries, 5).orderBy("rank").collect()] == [i for _, i in want]


def test_containment_of_needles_of_any_length(spark):
    from spanlake.registry.inputs import containment_join

    hay = {1: "The quick brown fox jumps over the lazy dog", 2: "concatenate", 3: "a.b", 4: "", 5: None, 6: "brown fox jumps over", 7: "aaaa é日本 x"}
    needles = {1: "cat", 2: "a", 3: ".", 4: "brown fox jumps over the", 5: "brown fox", 6: "zz", 7: "é日", 8: "", 9: "ck brown fox jumps ov", 10: "aaaaa", 11: None, 12: "x"}
    found = containment_join(spark.createDataFrame(list(hay.items()), "h long, text string"), spark.createDataFrame(list(needles.items()), "n long, text string"), "h", "n")
    assert sorted((r.h, r.n) for r in found.collect()) == sorted((h, n) for h, t in hay.items() for n, x in needles.items() if t and x and x in t)


def test_index_is_written_without_a_shuffle_of_postings_and_by_part(spark, chunks, queries, tmp_path):
    path, docs = str(tmp_path), chunks.select("document_row_id", F.col("normalized_text").alias("text"))
    words = stored_index(docs, chunks, path, parts=index_parts("bm25_sentence"))
    assert actual(retrieve(chunks, queries, "bm25_sentence", 3, index=words)) == expected(bm25, 3)
    assert words.ngram_counts is None and not list(tmp_path.glob("*ngrams"))
    assert index_parts("bm25_sentence", "dense_hierarchical") == index_parts("hybrid") == ("words", "ngrams")
    # one row per chunk, as they come, repeated chunks too
    twice = chunks.unionByName(chunks)
    write_index(twice, f"{path}/twice")
    both = open_index(spark, f"{path}/twice")
    assert both.n_chunks == both.word_counts.count() == both.ngram_counts.count() == both.places.count() == 2 * chunks.count()


@pytest.mark.parametrize("hot_share", [1e-9, 1e-4, 10.0])
def test_vector_lengths_do_not_depend_on_which_terms_are_frequent(spark, chunks, tmp_path, monkeypatch, hot_share):
    monkeypatch.setattr(term_index, "HOT_SHARE", hot_share)
    write_index(chunks, str(tmp_path), ("ngrams",))
    found = {(r.document_row_id, r.chunk_pos): r.norm for r in open_index(spark, str(tmp_path), ("ngrams",)).places.collect()}
    weights, _ = tfidf_weights(chunks, chunks.select("document_row_id"))
    wanted = weights.groupBy("document_row_id", "chunk_pos").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm")).collect()
    assert wanted and all(found[r.document_row_id, r.chunk_pos] == pytest.approx(r.norm) for r in wanted)


def test_vector_lengths_are_computed_of_asked_documents_only(spark, chunks, queries, tmp_path, monkeypatch):
    seen, whole = [], term_index._norms
    monkeypatch.setattr(term_index, "_norms", lambda counts, *rest: seen.append({r.document_row_id for r in counts.collect()}) or whole(counts, *rest))
    write_index(chunks, str(tmp_path), ("ngrams",))
    assert not seen and not (tmp_path / "ngrams" / "places").exists()
    index = open_index(spark, str(tmp_path), ("ngrams",))
    seen.clear()
    one = queries.where("document_row_id = 1")
    found = actual(retrieve(chunks, one, "dense_sentence", 3, index=index))
    assert seen == [{1}]
    assert found == actual(tfidf_search(chunks, one, 3)) and found


@pytest.mark.parametrize("method", ["bm25_sentence", "dense_sentence", "hybrid"])
def test_a_collection_counted_in_slices_is_searched_alike(spark, chunks, queries, tmp_path, monkeypatch, method):
    wanted = actual(retrieve(chunks, queries, method, 3))
    monkeypatch.setattr(ngram_counts, "SLICE_ENTRIES", 10)
    write_index(chunks, str(tmp_path))
    index = open_index(spark, str(tmp_path))
    assert index.n_slices > 1 and index.word_slices > 1
    grams = chunk_terms(chunks, ngram_terms)
    slices = index.ngram_terms.select("slice", ngram_counts.slice_of("term", index.n_slices).alias("own")).distinct().collect()
    assert len(slices) > 1 and all(r.slice == r.own for r in slices)
    counted = {(r.term, r.df) for r in index.ngram_terms.collect()}
    assert counted == {(r.term, r.df) for r in document_frequencies(grams).collect()} and len(counted) == index.ngram_terms.count()
    assert actual(retrieve(chunks, queries, method, 3, index=index)) == wanted


def test_terms_are_counted_once_in_a_chunk_and_portions_add_up():
    lists = [["b", "a", "b", "a"], [], None, ["a", None, "b"], ["ä", "b", "a"]]
    wanted = {"a": 3, "b": 3, "ä": 1, "b a": 2, "a b": 1, "ä b": 1}
    column = pa.array(lists, pa.list_(pa.string()))
    for slices in (1, 3):
        found = [(t, int(n)) for own in range(slices) for terms, counts in ngram_counts.count_chunks(column, slices, own) for t, n in zip(terms.to_pylist(), counts, strict=True)]
        assert sorted(found) == sorted(wanted.items())
    assert [len(t) for t, _ in ngram_counts.count_chunks(column[1:3])] == [0, 0]


def test_what_a_stored_table_shuffled_is_removed(spark, tmp_path):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {b.name() for b in (blocks.apply(i) for blocks in [manager.getAllBlocks()] for i in range(blocks.size())) if b.isShuffle()}
    before = files()
    rows = spark.range(2000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    write_table(rows, str(tmp_path / "t"))
    assert not files() - before
    assert spark.read.parquet(str(tmp_path / "t")).count() == rows.count() == 7


def test_stored_spans_are_those_of_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "SECTION 1. Terms\nA  plain sentence. Another one , with\u00a0space."), (2, None), (3, "")], "document_row_id int, text string")
    kept, wanted = stored_spans(docs, str(tmp_path)), sentence_spans(docs)
    assert kept.columns == wanted.columns and kept.count() > 1
    assert sorted(map(str, kept.collect())) == sorted(map(str, wanted.collect()))
    stored = spark.read.parquet(*map(str, tmp_path.glob("*/rows-*")))
    assert "sentence_id" not in stored.columns and 0 < stored.where("normalized_text is null").count() < stored.count()
    assert stored_spans(docs, str(tmp_path)).count() == kept.count()


@pytest.mark.parametrize("method, scorer", [("bm25_sentence", bm25_search), ("dense_sentence", tfidf_search)])
def test_terms_are_counted_of_asked_documents_only(spark, chunks, queries, tmp_path, monkeypatch, method, scorer):
    write_index(chunks, str(tmp_path), index_parts(method))
    index = open_index(spark, str(tmp_path), index_parts(method))
    seen, whole = [], term_index._counted
    monkeypatch.setattr(term_index, "_counted", lambda tokens, part: seen.append({r.document_row_id for r in tokens.collect()}) or whole(tokens, part))
    one = queries.where("document_row_id = 1")
    found = actual(retrieve(chunks, one, method, 3, index=index))
    assert seen == [{1}] and found == actual(scorer(chunks, one, 3)) and found


def test_only_sections_of_asked_documents_are_ranked(chunks, queries, monkeypatch):
    seen = []
    one = queries.where("document_row_id = 1")
    wanted = actual(hierarchical_search(chunks, queries, k=10, leaf_k=2, top_sections=2))
    monkeypatch.setattr(fusion, "of_asked", lambda rows, q: seen.append({r.document_row_id for r in of_asked(rows, q).collect()}) or of_asked(rows, q))
    found = actual(hierarchical_search(chunks, one, k=10, leaf_k=2, top_sections=2))
    assert seen == [{1}] and found and found == {key: rows for key, rows in wanted.items() if key in found}
