"""Offset-exact sentence segmentation as one chain of column expressions.

A document is cut at three kinds of places: paragraph breaks, the ends of leading heading lines, and
sentence ends. Every sentence is the text between two cuts with the white space around it removed. The
cuts are written into a working copy as marker characters by regular expressions, the copy is split once,
and offsets are running sums of piece lengths. Nothing leaves the JVM and no row is shuffled: a document
is segmented where its row already is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import running_starts
from spanlake.functions.text import LINE_END, WS, let, lstrip, normalize_sentence, rstrip, strip, title_case, words

# Markers are Unicode non-characters, which interchange text never contains. Should a text hold one
# anyway, the working copy carries _STAND_IN in its place and the raw text is cut from the original.
_CUT, _PARAGRAPH, _LINE, _HEADER, _STAND_IN = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4"
_ANY_MARKER = f"[{_CUT}-{_HEADER}]"

# Abbreviations (lower case, final dot left out) that do not end a sentence.
ABBREVIATIONS = [
    "inc", "corp", "ltd", "llc", "co", "no", "sec", "art", "ex",
    "u.s", "u.s.a", "e.g", "i.e", "mr", "mrs", "ms", "dr",
]

# Closing characters kept with the sentence, and characters that may open the next one.
_CLOSERS = r"""["')\]}]"""
_OPENERS = r"""["'(\[\u2022\u2023\u25aa\u25ab\u25e6\u25cf\u25cb\p{IsUppercase}\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089]"""

_KNOWN = "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
_TOKEN_START = r"(?<![^\s\x1c-\x1f\x85\p{Z}])"
SENTENCE_END = (
    rf"[.?!](?<!{_TOKEN_START}(?:(?i:{_KNOWN})|\p{{Nd}}{{1,3}})\.)"
    rf"{_CLOSERS}*+(?={WS}+{_OPENERS}|{WS}*\z)"
)
_PARAGRAPH_BREAK = r"\n[ \t]*\n+"

# A numbered or ARTICLE section line.
SECTION_LINE = (
    r"(?iu)^(?:Section[\s\x1c-\x1f\x85\p{Z}]+)?"
    r"(\p{Nd}+(?:\.\p{Nd}+)*(?:\([a-zA-Z0-9]+\))?|ARTICLE[\s\x1c-\x1f\x85\p{Z}]+[IVXLC]+)"
    r"\.?[\s\x1c-\x1f\x85\p{Z}]+(.{1,120})$"
)

# The end of a line ("\r\n" counts once) with the cuts behind it; the mark of a line that may announce a section, which has
# the condition of ``may_announce_section`` and is not blank.
_LINE_START = rf"[[^ -~]&&[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]](?!(?<=\r)\n){_CUT}*+"
_CANDIDATE = rf"{_LINE}(?=[\s\x1c-\x1f\x85\p{{Z}}{_CUT}]*+(?:\p{{Nd}}|(?i:section|article)|[^a-z{_LINE}]++(?:{_LINE}|\z)))"


def is_heading(line: Column) -> Column:
    """Short line without end punctuation, mostly capitals or in title case."""

    def test(text: Column) -> Column:
        letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
        capitals = F.length(F.regexp_replace(text, r"[^\p{IsUppercase}]", ""))
        titled = (
            text.rlike(r"[\p{Lu}\p{Lt}]")
            & ~text.rlike(r"[\p{Lu}\p{Lt}\p{Ll}][\p{Lu}\p{Lt}]")
            & ~text.rlike(r"(?<![\p{Lu}\p{Lt}\p{Ll}])\p{Ll}")
        )
        return (
            (text != "")
            & (F.length(text) <= 120)
            & ~text.rlike(r"[.!?;:]$")
            & (F.size(words(text)) <= 14)
            & (letters > 0)
            & ((capitals >= letters * F.lit(0.65)) | titled)
        )

    return let(strip(line), test)


def is_all_caps(text: Column) -> Column:
    """Short stripped line with letters, none of them lower case, not ending in ``. ; ,``."""
    return (F.length(text) <= 80) & (F.upper(text) == text) & text.rlike(r"\p{L}") & ~text.rlike(r"[.;,]$")


def line_section(line: Column) -> Column:
    """(number, title) announced by a line, or null when it announces none."""

    def detect(text: Column) -> Column:
        numbered = F.struct(
            F.regexp_extract(text, SECTION_LINE, 1).alias("number"), strip(F.regexp_extract(text, SECTION_LINE, 2)).alias("title")
        )
        titled = F.struct(F.lit(None).cast("string").alias("number"), title_case(text).alias("title"))
        return F.when(text.rlike(SECTION_LINE), numbered).when((text != "") & is_all_caps(text), titled)

    return let(strip(line), detect)


def may_announce_section(line: Column) -> Column:
    """Cheap necessary condition of ``line_section``: starts with a number or keyword, or has no lower case."""
    # one anchor in front of both: a failed line is not searched for another begin
    return line.rlike(rf"^(?:[\s\x1c-\x1f\x85\p{{Z}}{_CUT}]*+(?:\p{{Nd}}|(?i:section|article))|[^a-z]*+$)")


def _without(text: Column, *markers: str) -> Column:
    for marker in markers:
        text = F.replace(text, F.lit(marker), F.lit(""))
    return text


def _cut_headings(paragraph: Column) -> Column:
    """Mark the end of each leading heading line; the last line of a paragraph never counts as one."""

    def mark_all(body: Column) -> Column:
        trailing = F.regexp_extract(body, rf"[\s\x1c-\x1f\x85\p{{Z}}{_CUT}]*+\z", 0)
        core = F.regexp_replace(body, rf"[\s\x1c-\x1f\x85\p{{Z}}{_CUT}]++\z", "")
        return F.concat(let(F.split(core, LINE_END), mark_lines), trailing)

    def mark_lines(lines: Column) -> Column:
        candidates = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))

        def rebuild(stop: Column) -> Column:
            headings = F.when(stop == 0, F.size(candidates)).otherwise(stop.cast("int") - 1)
            head = F.transform(F.slice(lines, 1, headings), lambda line: F.concat(line, F.lit(_CUT)))
            return F.concat(F.array_join(head, ""), F.array_join(F.slice(lines, headings + 1, F.greatest(F.size(lines), F.lit(1))), ""))

        flags = F.transform(candidates, lambda line: is_heading(_without(line, _CUT)))
        return let(F.array_position(flags, False), rebuild)

    # Most paragraphs do not begin with a heading; only those that do are taken apart.
    def mark(body: Column) -> Column:
        first = _without(F.regexp_extract(body, r"^[ -~[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]]*+", 0), _CUT)
        return F.when(is_heading(first), mark_all(body)).otherwise(body)

    lead = F.regexp_extract(paragraph, f"^{WS}*+", 0)
    return F.concat(lead, let(lstrip(paragraph), mark), F.lit(_CUT))


def _marked(text: Column, with_sections: bool) -> Column:
    safe = F.when(text.rlike(_ANY_MARKER), F.regexp_replace(text, _ANY_MARKER, _STAND_IN)).otherwise(text)
    cut = F.regexp_replace(safe, SENTENCE_END, "$0" + _CUT)
    paragraphs = F.split(F.regexp_replace(cut, _PARAGRAPH_BREAK, "$0" + _PARAGRAPH), _PARAGRAPH)
    joined = F.array_join(F.transform(paragraphs, _cut_headings), "")
    if not with_sections:
        return joined

    # Line starts, and lines that announce a section, get their own marks after any cut standing there. Both are found in
    # the whole text; only lines that may announce a section are looked at one by one.
    lined = F.substring(F.regexp_replace(F.concat(F.lit("\n"), joined), _LINE_START, "$0" + _LINE), 2, 1 << 30)

    def mark_header(piece: Column, i: Column) -> Column:
        line = _without(F.substring_index(piece, _LINE, 1), _CUT)
        return F.when((i > 0) & line_section(line).isNotNull(), F.concat(F.lit(_HEADER), piece)).otherwise(piece)

    return F.array_join(F.transform(F.split(F.regexp_replace(lined, _CANDIDATE, _LINE + _HEADER), _HEADER), mark_header), "")


def sentence_array(text: Column, with_sections: bool = False) -> Column:
    """Array of (start_char, end_char, raw_text[, at_line_start, section_pos]) in text order."""
    source = F.coalesce(text, F.lit(""))
    # The original text, carried along only if it holds a marker character of its own.
    original = F.when(source.rlike(_ANY_MARKER), source)
    lead_class = rf"^[\s\x1c-\x1f\x85\p{{Z}}{_LINE}{_HEADER}]*+"

    def measure(piece: Column) -> Column:
        """Lead (with marks), the rest without trailing white space and marks, lengths without marks."""

        def parts(lead: Column) -> Column:
            rest = F.when(lead == "", piece).otherwise(F.substring(piece, F.length(lead) + 1, 1 << 30))
            return let(_without(rest, _LINE, _HEADER) if with_sections else rest, lambda rest: sized(lead, rest))

        def sized(lead: Column, rest: Column) -> Column:
            bare = F.length(_without(lead, _LINE, _HEADER)) if with_sections else F.length(lead)
            # a printable last character tells that there is nothing to remove, without a look at the whole text
            ends_printable = F.ascii(F.substring(rest, -1, 1)).between(33, 126)
            fields = [
                bare.alias("lead"),
                F.when(ends_printable, rest).otherwise(rstrip(rest)).alias("raw"),
                (bare + F.length(rest)).alias("n"),
            ]
            if with_sections:
                fields += [
                    (F.length(lead) - F.length(_without(lead, _HEADER))).alias("headers_here"),
                    F.when(F.contains(piece, F.lit(_HEADER)), F.length(piece) - F.length(_without(piece, _HEADER))).otherwise(0).alias("headers"),
                    lead.rlike(f"{_LINE}{_HEADER}?$").alias("at_line_start"),
                ]
            return F.struct(*fields)

        return let(F.regexp_extract(piece, lead_class, 0), parts)

    def place(entry: Column, start: Column, before: Column, original: Column) -> Column:
        first, size = start + entry["lead"], F.length(entry["raw"])
        fields = [
            first.alias("start_char"),
            (first + size).alias("end_char"),
            F.coalesce(F.substring(original, first + 1, size), entry["raw"]).alias("raw_text"),
        ]
        if with_sections:
            fields += [entry["at_line_start"].alias("at_line_start"), (before + entry["headers_here"]).alias("section_pos")]
        return F.struct(*fields)

    def assemble(entries: Column, original: Column) -> Column:
        starts = running_starts(F.transform(entries, lambda e: e["n"]))
        numbered = F.zip_with(entries, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        if with_sections:
            before = running_starts(F.transform(entries, lambda e: e["headers"]))
            rows = F.zip_with(numbered, before, lambda x, b: place(x["e"], x["s"], b, original))
        else:
            rows = F.transform(numbered, lambda x: place(x["e"], x["s"], F.lit(0), original))
        return F.filter(rows, lambda r: r["end_char"] > r["start_char"])

    entries = F.transform(F.split(_marked(source, with_sections), _CUT), measure)
    return let(entries, lambda e: let(original, lambda o: assemble(e, o)))


def section_headers(text: Column) -> Column:
    """Sections announced by the lines of a text, in order."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), LINE_END), may_announce_section)
    return F.filter(F.transform(lines, line_section), lambda s: s.isNotNull())


def sentence_key() -> Column:
    """The id of a sentence: its document and its place there."""
    return F.concat_ws(":s:", F.col("document_row_id").cast("string"), F.col("sentence_index").cast("string"))


def sentence_spans(documents: DataFrame, text: str = "text", carry_forward: bool = False) -> DataFrame:
    """One row per sentence with its id, offsets, normalised text and section.

    A sentence gets the current section only if it starts exactly at a line start; with
    ``carry_forward`` every sentence gets the section current at its start.
    """
    found = documents.select("document_row_id", F.col(text).alias("source_text"), sentence_array(F.col(text), with_sections=True).alias("found"))
    # only sections some sentence lies in are read from the text again
    used = F.exists("found", lambda s: s["section_pos"] > 0)
    found = found.select("document_row_id", F.when(used, section_headers(F.col("source_text"))).alias("headers"), "found")
    rows = found.select("document_row_id", "headers", F.posexplode_outer("found").alias("sentence_index", "s"))
    rows = rows.where(F.col("s").isNotNull())
    known = F.lit(True) if carry_forward else F.col("s.at_line_start")
    section = F.when(known & (F.col("s.section_pos") > 0), F.get("headers", F.col("s.section_pos") - 1))
    rows = rows.select(
        "document_row_id",
        sentence_key().alias("sentence_id"),
        "sentence_index",
        F.col("s.raw_text").alias("raw_text"),
        normalize_sentence(F.col("s.raw_text")).alias("normalized_text"),
        F.col("s.start_char").alias("start_char"),
        F.col("s.end_char").alias("end_char"),
        F.lit(None).cast("int").alias("page_number"),
        section.alias("section"),
    )
    return rows.select(
        *[c for c in rows.columns if c != "section"],
        F.col("section.number").alias("section_number"),
        F.col("section.title").alias("section_title"),
        F.filter(F.array("section.number", "section.title"), lambda part: part.isNotNull() & (part != "")).alias("clause_path"),
    )


def split_texts(rows: DataFrame, text: str, keep: list[str], position: str = "piece_pos") -> DataFrame:
    """Sentences of any text column, e.g. golden answers; a text without sentences stays whole."""
    pieces = F.transform(sentence_array(F.col(text)), lambda s: s["raw_text"])
    whole = strip(F.coalesce(F.col(text), F.lit("")))
    pieces = let(pieces, lambda p: F.when((F.size(p) == 0) & (whole != ""), F.array(whole)).otherwise(p))
    return rows.select(*keep, F.posexplode_outer(pieces).alias(position, "piece")).where(F.col("piece").isNotNull())
