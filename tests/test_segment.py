from pyspark.sql import functions as F

from spanlake.operators import lines, segment
from spanlake.operators.chunk import SplitRule, overlap_join, recursive_chunks, split_recursive
from spanlake.operators.segment import sentence_spans

CASES = {
    7: "Acme Inc. may assign this Agreement with consent. Notices must be in writing.",
    8: "A sentence ,  with text.",
    9: "DEFINED TERMS\n\nThe parties agree.\n\n1. First item applies.\n\n(a) Second item applies.\n\n(1) Third item applies.\n\n(h) Fourth item.\n\n• Fifth item. Sixth item.",
    10: "The parties (a) may assign, (b) may sell, and (c) may act under Section 2(a). Another sentence follows.",
    11: "",
    12: None,
    13: "ARTICLE IV Terms\nBody starts here. MORE\nPLAIN HEADER\nAfter it. Then.\n3.1 Payment due\nPay now.",
    14: "odd ﷐ mark. Next﷑ one.",
    15: "A\r\n\r\nB follows. C",
}


def spans(spark, **options):
    rows = spark.createDataFrame(list(CASES.items()), "document_row_id int, text string")
    return sentence_spans(rows, **options).orderBy("document_row_id", "sentence_index").collect()


def test_offsets_reproduce_the_text(spark):
    rows = spans(spark)
    for r in rows:
        assert CASES[r.document_row_id][r.start_char : r.end_char] == r.raw_text
    found = lambda d: [r for r in rows if r.document_row_id == d]
    assert [r.sentence_id for r in found(7)] == ["7:s:0", "7:s:1"]
    assert found(8)[0].normalized_text == "A sentence, with text."
    assert [r.raw_text[:2] for r in found(9)] == ["DE", "Th", "1.", "(a", "(1", "(h", "• ", "Si"]
    assert len(found(10)) == 2
    assert not found(11) and not found(12)
    assert [r.raw_text for r in found(14)] == ["odd ﷐ mark.", "Next﷑ one."]
    assert [r.raw_text for r in found(15)] == ["A", "B follows.", "C"]


def test_sections_follow_line_starts(spark):
    rows = [r for r in spans(spark) if r.document_row_id == 13]
    assert [(r.raw_text, r.section_number, r.section_title) for r in rows] == [
        ("ARTICLE IV Terms", "ARTICLE IV", "Terms"),
        ("Body starts here.", "ARTICLE IV", "Terms"),
        ("MORE\nPLAIN HEADER\nAfter it.", None, None),
        ("Then.", None, None),
        ("3.1 Payment due\nPay now.", "3.1", "Payment due"),
    ]
    carried = [r for r in spans(spark, carry_forward=True) if r.document_row_id == 13]
    assert carried[2].clause_path == ["ARTICLE IV", "Terms"]
    assert (carried[3].section_number, carried[3].section_title) == (None, "Plain Header")


def test_recursive_chunks_cover_all_sentences(spark):
    text = "ARTICLE I TERMS\n" + " ".join(f"Sentence number {i} has some words." for i in range(60)) + "\n\n2. Next part\nShort end."
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "document_row_id int, text string")
    rule = SplitRule(size=200, overlap=40)
    chunks = recursive_chunks(rows, rule=rule).orderBy("chunk_pos").collect()
    ids = {r.sentence_id for r in sentence_spans(rows).collect()}
    assert {i for c in chunks for i in c.sentence_ids} == ids
    assert {c.document_row_id for c in chunks} == {1}
    for c in chunks:
        assert text[c.start_char : c.end_char] == c.text and len(c.text) <= 200
    assert chunks[0].clause_path == ["ARTICLE I", "TERMS"]
    assert [c[3] for c in split_recursive("abcdefghij", SplitRule(size=4, overlap=1))] == ["abcd", "defg", "ghij"]


def test_overlap_join_equals_brute_force(spark):
    left = [(d, i, i * 37 % 500, i * 37 % 500 + 1 + i % 90) for d in (1, 2) for i in range(40)]
    right = [(d, i, i * 53 % 500, i * 53 % 500 + 2 + i % 70) for d in (1, 3) for i in range(40)]
    schema = "document_row_id int, n int, start_char int, end_char int"
    pairs = overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "document_row_id", bin_width=32)
    got = sorted((r.document_row_id, r.n, r.other_n) for r in pairs.collect())
    want = sorted((a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and b[2] < a[3] and b[3] > a[2])
    assert got == want


def test_lines_of_body_text_skip_the_class_patterns_and_no_class_is_lost(spark):
    samples = ["EXHIBIT 1", "Annex B", "ARTICLE IV", "Article 3", "WHEREAS it", "RECITALS", "NOW THEREFORE we", "TERM AND RENT", "SECTION 2.1 x", "3. Term", "4.2", "(iv) x", "(a) x", "(B) x", "(12) x", "c) x", "Plain text.", "exhibit 1", "", "١.٢"]
    known = dict.fromkeys(samples)
    for name, _, pattern in reversed(lines.LINE_CLASSES):
        test = lines.is_all_caps(F.col("s")) if pattern is None else F.col("s").rlike("(?U)" + pattern)
        found = spark.createDataFrame([(s,) for s in samples if s], "s string").where(test).collect()
        known.update({r.s: name for r in found})
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", lines.line_class(F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in rows} == known and {name for name, _, _ in lines.LINE_CLASSES} <= set(known.values())
    plan = spark.createDataFrame([("x",)], "s string").select(lines.line_class(F.col("s")))._jdf.queryExecution().analyzed().toString()
    assert lines._OPENING in plan


def test_section_lines_are_found_in_the_whole_text(spark):
    ends = ["\n", "\r", "\r\n", "\x0b", "\x85", "\u2028", "\n\n", "\n \t\n"]
    texts = [f"{first}{a}2. Term{b}  SCOPE OF WORK {c}It ends here. Section 4 Law{a}article IV Fees{b}{last}"
             for a in ends for b in ends for c in ends[:3] for first in ("", "Intro text.", "\ufdd2 1. Begin") for last in ("", "ÉTÉ", "x")]
    rows = spark.createDataFrame(list(enumerate(texts)), "document_row_id long, text string")
    marks = F.size(F.split(segment._marked(F.col("text"), True), segment._HEADER)) - 1
    assert rows.where(marks != F.size(segment.section_headers(F.col("text")))).count() == 0
    assert rows.where(marks > 1).count() == len(texts)
    # lines are not taken one by one: the pattern of line ends stands for heading paragraphs only
    patterns = [str(segment._marked(F.col("text"), sections)).count("(?<=\\r)(?!\\n)") for sections in (False, True)]
    assert patterns[0] == patterns[1]
