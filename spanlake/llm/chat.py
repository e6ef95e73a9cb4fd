"""Chat formatting with any template: the template is only ever asked to render lists of turns.

Successive prefixes of a conversation are rendered and consecutive outputs compared: what a prefix adds to the one
before is the new turn's span. Where a prefix changes what was there, the template rewrites history, which is reported
and cuts back the spans it touched. Where the text stands inside a span is found the same way, by rendering the turn with two probe
texts: what both share in front is its opening mark, what both share behind its closing mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]


class InstTemplate:
    """Marks turns in the style ``<s>[INST] question [/INST] answer </s>``; any role can be named.

    Control strings inside texts and role names get a backslash behind their first character, and backslashes are
    doubled, so that the marks of the output are the template's own and every text can be read back.
    """

    #: The control strings of the format.
    CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]")
    _inside = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
    _escaped = re.compile(r"\\(\\?)")

    def escape(self, text: str) -> str:
        return self._inside.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def render(self, turns: list[Turn]) -> str:
        return "".join(self.mark(role, self.escape(text)) for role, text in turns)

    def mark(self, role: str, text: str) -> str:
        if role == "user":
            return f"<s>[INST] {text} [/INST]"
        if role == "assistant":
            return f" {text} </s>"
        if role == "system":
            return f"<<SYS>> {text} <</SYS>>"
        return f"[ROLE] {self.escape(role)} [TEXT] {text} [/ROLE]"

    def role_of(self, opening: str) -> str:
        """The role that an opening mark names."""
        known = {"<s>[INST] ": "user", " ": "assistant", "<<SYS>> ": "system"}
        return known[opening] if opening in known else self.unescape(opening[len("[ROLE] ") : -len(" [TEXT] ")])


@dataclass
class Formatted:
    """The output, and per turn (start, content start, content end, end), or None where history was rewritten."""

    text: str
    spans: list[tuple[int, int, int, int] | None]
    rewrites: list[int]


def _common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


_PROBES = ("0", "1")


def format_turns(template, turns: list[Turn]) -> Formatted:
    """Render the prefixes of ``turns`` one after another and locate every turn in the last output."""
    before = template.render([])
    spans: list[tuple[int, int, int, int] | None] = []
    rewrites: list[int] = []
    for k, (role, _) in enumerate(turns):
        now = template.render(turns[: k + 1])
        start = _common_prefix(before, now)
        if start < len(before):
            rewrites.append(k)
            spans = [s if s and s[3] <= start else None for s in spans]
        a, b = (template.render([*turns[:k], (role, probe)])[start:] for probe in _PROBES)
        opening = _common_prefix(a, b)
        closing = _common_prefix(a[opening:][::-1], b[opening:][::-1])
        end = len(now)
        spans.append((start, start + opening, end - closing, end))
        before = now
    return Formatted(before, spans, rewrites)


def format_conversations(turns: DataFrame, template=None, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, rewrites.

    ``turns`` needs conv_id, turn, role and text; more columns are ignored. Turns are taken by turn number, then role
    and text, a null number first; null roles and texts are empty; rows without conv_id make up one conversation; rows
    repeated are turns repeated. ``spans`` holds per turn role, start, text_start, text_end, end (code points of
    ``formatted``) and ``loss``, true for the roles to learn from; of a turn whose place a later one rewrote the
    positions are null and ``loss`` is false. ``rewrites`` lists the positions of the turns that did so.

    A conversation is one value of the output, so its turns come together in one task; conversations are spread.
    """
    template = template or InstTemplate()
    schema = "formatted string, spans array<struct<role:string,start:int,text_start:int,text_end:int,end:int,loss:boolean>>, rewrites array<int>"

    @F.pandas_udf(schema)
    def formatted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            rows = []
            for conversation in column:
                pairs = [(t["role"], t["text"]) for t in conversation]
                done = format_turns(template, pairs)
                places = [
                    {"role": role, **dict(zip(("start", "text_start", "text_end", "end"), span or (None,) * 4, strict=True)), "loss": span is not None and role in learn_from}
                    for (role, _), span in zip(pairs, done.spans, strict=True)
                ]
                rows.append((done.text, places, done.rewrites))
            yield pd.DataFrame(rows, columns=["formatted", "spans", "rewrites"])

    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", formatted("turns").alias("f")).select("conv_id", "f.*")


def read_back(formatted: DataFrame, template=None) -> DataFrame:
    """``turns`` (role and text of each, taken from the marks) and ``loss_texts`` of formatted conversations.

    Both are read from ``formatted`` by its spans alone and unescaped; turns without a place are left out.
    """
    template = template or InstTemplate()

    @F.pandas_udf("turns array<struct<role:string,text:string>>, loss_texts array<string>")
    def read(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for whole, places in zip(text, spans, strict=True):
            found, loss = [], []
            for p in places:
                if p["start"] is None:
                    continue
                said = template.unescape(whole[p["text_start"] : p["text_end"]])
                found.append({"role": template.role_of(whole[p["start"] : p["text_start"]]), "text": said})
                if p["loss"]:
                    loss.append(said)
            rows.append((found, loss))
        return pd.DataFrame(rows, columns=["turns", "loss_texts"])

    return formatted.withColumn("_back", read("formatted", "spans")).select("*", "_back.*").drop("_back")
