from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.functions.arrays import running_starts


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalize_and_tokens(spark):
    assert one(spark, T.normalize_sentence(F.lit("A sentence ,  with\n“text” – x ."))) == 'A sentence, with "text" - x.'
    assert one(spark, T.tokenize(F.lit("événement A_1"))) == ["v", "nement", "a_1"]
    assert one(spark, T.unicode_tokens(F.lit("été x ab"))) == ["été", "ab"]
    assert one(spark, T.with_bigrams(T.unicode_tokens(F.lit("aa bb cc")))) == ["aa", "bb", "cc", "aa bb", "bb cc"]
    assert one(spark, T.strip(F.lit("\n  x \x1f"))) == "x"


def test_answers_and_overlap(spark):
    assert one(spark, T.normalize_answer(F.lit("The  Cat, an' a dog!"))) == "cat dog"
    overlap = T.multiset_overlap(T.answer_tokens(F.lit("cat cat dog bird")), T.answer_tokens(F.lit("cat dog cat cat")))
    assert one(spark, overlap) == 3
    counts = {r["term"]: r["tf"] for r in one(spark, T.term_counts(T.tokenize(F.lit("b a b ab a b"))))}
    assert counts == {"a": 2, "ab": 1, "b": 3}


def test_names(spark):
    assert one(spark, T.slugify(F.lit("  Vendor/Chat  v4__x-- "))) == "vendor-chat-v4__x"
    assert one(spark, T.slugify(F.lit("!!"), "model")) == "model"
    assert one(spark, T.class_name(F.lit("Non-Compete / x"))) == "NonCompeteX"
    assert one(spark, T.identifier(F.lit("Non-Compete"))) == "NON_COMPETE"
    assert one(spark, T.title_case(F.lit("BAR-baz O'NEIL"))) == "Bar-Baz O'Neil"


def test_lines_and_offsets(spark):
    text = "a\r\nb\n\nc\rd e\n"
    assert one(spark, T.split_lines(F.lit(text))) == text.splitlines(keepends=True)
    assert one(spark, T.split_lines(F.lit(text), keep_ends=False)) == text.splitlines()
    lengths = [(i * 7) % 13 for i in range(1000)]
    starts = one(spark, running_starts(F.array(*[F.lit(n) for n in lengths])))
    assert starts == [sum(lengths[:i]) for i in range(1000)]
    assert one(spark, running_starts(F.array().cast("array<int>"))) == []


def test_trimming_and_collapsing_agree_with_python_on_every_white_space(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = [(s, f"{s}a{s} b{s}{s}c\n{s}", f"é{s}") for s in [*spaces, "\u200b", "\ufeff", "\u180e"]]
    shown = spark.createDataFrame(rows, "s string, t string, u string").select("*", T.strip("t").alias("b"), T.lstrip("t").alias("l"), T.rstrip("t").alias("r"), T.collapse("t").alias("c"), T.strip("u").alias("e"))
    for r in shown.collect():
        assert (r.b, r.l, r.r, r.e) == (r.t.strip(), r.t.lstrip(), r.t.rstrip(), r.u.strip())
        assert r.c == " ".join(r.t.split())


def test_term_counts_by_runs(spark):
    tokens = F.array(*[F.lit(t) for t in ["b", "a", "b", "", "aa", "a b", "b"]], F.lit(None).cast("string"))
    assert [tuple(e) for e in one(spark, T.term_counts(tokens))] == [("a", 1), ("a b", 1), ("aa", 1), ("b", 3)]
    assert one(spark, T.term_counts(F.array().cast("array<string>"))) == []


def test_running_starts_of_arrays_of_one_and_of_many_blocks(spark):
    for n in (0, 1, 256, 257, 600):
        lengths = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        assert one(spark, running_starts(lengths)) == [i * (i + 1) // 2 for i in range(n)]


def test_only_untidy_sentences_are_rewritten(spark):
    parts = ["a", "Word", " ", "  ", "\t", "\n", "\xa0", "\u2028", "\x85", ",", ".", "\u2019", "\u201c", "\u2013", "\xe9", "-"]
    values = [x + y + z for x in parts for y in parts for z in parts] + ["", " "]
    rows = spark.createDataFrame([(v,) for v in values], "text string")
    changed = T.normalize_sentence("text") != F.col("text")
    assert rows.where(F.col("text").rlike(T._UNTIDY) != changed).count() == 0
    plain = F.regexp_replace(T.collapse(F.translate("text", "\xa0\u2018\u2019\u201c\u201d\u2013\u2014", " ''\"\"--")), r" ([,.;:!?])", "$1")
    assert rows.where(T.normalize_sentence("text") != plain).count() == 0
