"""Text functions: JVM-side column expressions, and Arrow UDFs where no built-in has the semantics."""

from __future__ import annotations

import binascii
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_group(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, null where there is none; an empty group stays empty."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1))


def header_field(content: Column, tag: str) -> Column:
    """The rest of the line after the first ``<tag>``. Lines end at a line feed only, so a carriage return stays."""
    return first_group(content, f"(?d)<{tag}>(.*)")


def before(c: Column, marker: str) -> Column:
    """All before the marker; where there is none, all but the last character."""
    at = F.instr(c, marker)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.substring(c, F.lit(1), F.length(c) - 1))


def strip_tags(html: Column) -> Column:
    """Text of a block of markup by removing what stands in angle brackets: cheap, JVM-side."""
    return F.regexp_replace(html, "<[^>]*>", "")


class _Text(HTMLParser):
    HIDDEN = ("script", "style", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in self.HIDDEN))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def parsed_text(html: str) -> str:
    """What a reader would see: no comments, declarations, scripts, styles or templates; character references resolved."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(StringType())
def html_text(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for block in blocks:
        yield block.map(lambda h: None if h is None else parsed_text(h))


@F.pandas_udf(ArrayType(StringType()))
def html_texts(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``parsed_text`` of each entry of an array, nulls kept."""
    for block in blocks:
        yield block.map(lambda hs: None if hs is None else [None if h is None else parsed_text(h) for h in hs])


@F.pandas_udf(StringType())
def decode_lossy(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UTF-8 with invalid bytes left out (no built-in does that: they raise, or put U+FFFD)."""
    for block in raw:
        yield block.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


_UU = re.compile(r"begin\s\d{3}[^\n]*\n(.*?)\n?end\b", re.S)


def uu_bytes(text: str) -> bytes | None:
    """The decoded body of the first encoding in a text; null where there is none or it is corrupt."""
    found = _UU.search(text)
    if not found:
        return None
    out = bytearray()
    try:
        for line in found.group(1).split("\n"):
            if line and line != "`":
                out += binascii.a2b_uu(line)
    except binascii.Error:
        return None
    return bytes(out)


@F.pandas_udf(BinaryType())
def uu_decode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for block in texts:
        yield block.map(lambda t: None if t is None else uu_bytes(t))


def pdf_texts(extract: Callable[[bytes], list[str]] | None) -> Callable[[Column], Column]:
    """A column function from arrays of encoded documents to arrays of their pages' text, null where extraction fails. ``extract``
    turns a file into the texts of its pages; without one every extraction fails."""

    def one(text: str | None) -> str | None:
        raw = uu_bytes(text) if text is not None else None
        if raw is None or extract is None:
            return None
        try:
            return "\n\n".join(page or "" for page in extract(raw)).strip()
        except Exception:  # whatever a pluggable extractor raises means that this file failed
            return None

    @F.pandas_udf(ArrayType(StringType()))
    def run(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for block in blocks:
            yield block.map(lambda ts: None if ts is None else [one(t) for t in ts])

    return run


def rendered(value: object) -> str:
    """A JSON value as Python prints it."""
    return str(value)


@F.pandas_udf(StringType())
def json_rendered(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text to the string of its value: lists with quotes and brackets, None, True; text that isn't JSON stays."""
    import json

    def one(text: str | None) -> str:
        try:
            return rendered(None if text is None else json.loads(text))
        except ValueError:
            return text

    for block in values:
        yield block.map(one)
