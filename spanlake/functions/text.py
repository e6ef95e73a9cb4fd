"""String expressions. Everything here is a Column expression evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip / str.split treat as whitespace (Java's \s is ASCII only).
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
# The same characters one by one; trimming them needs no pattern.
_WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# The ends of line that str.splitlines recognises; "\r\n" counts once.
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"

# White space as WS, told from printable ASCII by one comparison.
_WS_FAST = r"[[^!-~]&&[\s\x1c-\x1f\x85\p{Z}]]"

# Typographic characters and their ASCII stand-ins.
_PLAIN_FOR = {
    "\u00a0": " ",
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2013": "-",
    "\u2014": "-",
}

# What ``normalize_sentence`` changes: such a character, white space other than a blank, a blank before another one or before
# punctuation, at the begin or at the end. One search tells that most texts stay as they are.
_UNTIDY = rf"[[^!-~]&&[\s\x1c-\x1f\x85\p{{Z}}{''.join(_PLAIN_FOR)}]](?:(?<! )|[ ,.;:!?]|\z|(?<=\A ))"

# ASCII punctuation removed before answers are compared.
PUNCTUATION = r"[!-/:-@\[-`{-~]"

# Texts that mean "the document has no answer".
NO_ANSWER = "NO_ANSWER"
NO_ANSWER_MARKERS = ["", "no answer", "none", "not found", "n/a", "na", "not applicable", "no_answer", "noanswer"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body``; a lambda would otherwise re-evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove all leading and trailing whitespace, not only blanks."""
    return F.btrim(_col(c), F.lit(_WS_CHARS))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(_WS_CHARS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(_WS_CHARS))


def collapse(c: Column | str) -> Column:
    """Every run of white space as one blank; single blanks are left where they are."""
    return F.trim(F.regexp_replace(_col(c), rf"{_WS_FAST}(?:{_WS_FAST}++|(?<! ))", " "))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; blank text gives an empty array."""
    return F.filter(F.split(_col(c), f"{WS}+"), lambda w: w != "")


def split_lines(c: Column | str, keep_ends: bool = True) -> Column:
    """Lines with (or without) their terminators; a final terminator opens no extra line."""
    lines = F.filter(F.split(_col(c), LINE_END), lambda line: line != "")
    if keep_ends:
        return lines
    return F.transform(lines, lambda line: F.regexp_replace(line, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])$", ""))


def normalize_sentence(c: Column | str) -> Column:
    """Typographic characters to ASCII, whitespace collapsed, none left before punctuation."""

    def rewrite(plain: Column) -> Column:
        for typographic, ascii_form in _PLAIN_FOR.items():  # byte searches; translate would walk every character
            plain = F.replace(plain, F.lit(typographic), F.lit(ascii_form))
        return F.regexp_replace(collapse(plain), r" ([,.;:!?])", "$1")

    text = F.coalesce(_col(c), F.lit(""))
    return F.when(text.rlike(_UNTIDY), rewrite(text)).otherwise(text)


def tokenize(c: Column | str) -> Column:
    """ASCII word tokens of the normalised, lower-cased text (accented letters separate tokens).

    Normalisation only turns characters that separate tokens into other separators, so the tokens of the
    text itself are the same and the work is left out.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0))


def unicode_tokens(c: Column | str) -> Column:
    """Lower-cased Unicode word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[a-z0-9_[\p{L}\p{N}]]{2,}"), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by every pair of neighbours joined with a blank."""


    def extend(known: Column) -> Column:
        heads = F.slice(known, 1, F.greatest(F.size(known) - 1, F.lit(0)))
        return F.concat(known, F.transform(heads, lambda t, i: F.concat(t, F.lit(" "), F.get(known, i + 1))))

    return let(tokens, extend)


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) for the tokens of one row, in O(n log n) and without a shuffle.

    Each run of equal tokens among the sorted ones is a term; empty and null tokens count as none.
    """

    def count(ordered: Column) -> Column:
        first = F.transform(ordered, lambda t, i: F.when((t != "") & ~F.get(ordered, i - 1).eqNullSafe(t), i))
        return let(F.filter(first, lambda i: i.isNotNull()), lambda starts: F.transform(starts, lambda i, k: entry(ordered, starts, i, k)))

    def entry(ordered: Column, starts: Column, i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(ordered))
        return F.struct(F.get(ordered, i).alias("term"), (end - i).alias("tf"))

    return let(F.sort_array(tokens), count)


def occurrence_keys(tokens: Column) -> Column:
    """Tokens made distinct by numbering repeats, so that set operations count multiplicity."""
    return F.flatten(
        F.transform(
            term_counts(tokens),
            lambda e: F.transform(F.sequence(F.lit(1), e["tf"]), lambda i: F.concat(e["term"], F.lit("\n"), i.cast("string"))),
        )
    )


def multiset_overlap(left: Column, right: Column) -> Column:
    """Number of tokens two token arrays share, counting repeats."""
    return F.size(F.array_intersect(occurrence_keys(left), occurrence_keys(right)))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    bare = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(?:a|an|the)\b", " "))


def answer_tokens(c: Column | str) -> Column:
    return words(normalize_answer(c))


def normalize_category(c: Column | str) -> Column:
    return F.lower(collapse(F.coalesce(_col(c), F.lit(""))))


def extract_category(question: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_col(question), F.lit("")), r'related to "([^"]+)"', 1)


def drop_prefix(c: Column | str, prefix: str) -> Column:
    text = _col(c)
    return strip(F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text))


def normalize_marker(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip(F.coalesce(_col(c), F.lit("")))), r"[^a-z0-9_]+", " "))


def slugify(c: Column | str, empty: str = "value") -> Column:
    """Lower-case slug of letters, digits, dot, underscore and single hyphens."""
    slug = F.regexp_replace(F.lower(strip(c)), r"[^0-9a-z._-]+", "-")
    slug = F.regexp_replace(F.regexp_replace(slug, r"-+", "-"), r"^[-._]+|[-._]+$", "")
    return F.when(slug == "", F.lit(empty)).otherwise(slug)


def identifier(c: Column | str, empty: str = "CATEGORY") -> Column:
    """Upper-case identifier such as a prompt name."""
    name = F.upper(F.regexp_replace(F.regexp_replace(_col(c), r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", ""))
    return F.when(name == "", F.lit(empty)).otherwise(name)


def title_case(c: Column | str) -> Column:
    """Capitalise every run of letters, as str.title does (initcap only looks at blanks)."""
    parts = F.split(F.lower(_col(c)), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def class_name(c: Column | str, empty: str = "Category") -> Column:
    name = F.replace(title_case(F.regexp_replace(_col(c), r"[^0-9A-Za-z]+", " ")), F.lit(" "), F.lit(""))
    return F.when(name == "", F.lit(empty)).otherwise(name)


def joined_nonblank(*cols: Column | str) -> Column:
    """Stripped, non-blank values joined with a blank."""
    return F.concat_ws(" ", *[F.nullif(strip(c), F.lit("")) for c in cols])


def row_key(document: Column | str, question: Column | str) -> Column:
    return F.concat_ws(":", _col(document).cast("string"), _col(question).cast("string"))


def percent(value: Column, digits: int = 2) -> Column:
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.concat(F.format_number(value, digits), F.lit("%")))
