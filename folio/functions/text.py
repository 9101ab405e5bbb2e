"""Text shaping as column expressions, so that Catalyst sees and generates code for all of it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII blanks but the line end; a plain \v would be a class in Java's expressions.
_BLANKS = r"[ \t\f\x0B]"


def normalise(text: Column) -> Column:
    """Lines without blanks at their ends, and at most one blank line in a row."""
    text = F.regexp_replace(text, _BLANKS + r"*\r?\n", "\n")
    text = F.regexp_replace(text, _BLANKS + r"+$", "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def strip_scripts(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")


def effectively_empty(text: Column) -> Column:
    """Nothing but blanks and HTML comments."""
    return F.regexp_replace(strip_comments(text), r"\s", "") == ""


def is_effectively_empty(text: str | None) -> bool:
    """The same of a string; null is empty."""
    return not re.sub(r"(?s)<!--.*?-->", "", text or "").strip(" \t\n\r\f\v")


def unescape(text: Column) -> Column:
    """The five named entities of XML, the ampersand last."""
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def html_article(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def safe_cell(text: Column) -> Column:
    """A cell on one line, with backslashes and pipes escaped."""
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\r\n", "<br>"), ("\r", " "), ("\n", "<br>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def cut_data_uris(markdown: Column) -> Column:
    """Embedded images cut down to their type, empty ones too."""
    return F.regexp_replace(markdown, r"(data:[\w.+/-]*(?:;[\w.=+-]+)*);base64,[A-Za-z0-9+/=]*", "$1;base64...")


def preview(text: Column, n: int = 500) -> Column:
    return F.left(text, F.lit(n))


def page_count(text: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(text) / size).cast("int"))


def page(text: Column, offset: int, size: int) -> Column:
    """``size`` characters from ``offset`` on, with a note on how to go on; null if there is no such place."""
    total = F.char_length(text)
    body = F.substring(text, offset + 1, size)
    more = F.concat(F.lit(f"\n\n[{size} characters from {offset} of "), total.cast("string"), F.lit(f"; go on at {offset + size}]"))
    return F.when((total > 0) & (total <= offset), None).otherwise(F.when(total > offset + size, F.concat(body, more)).otherwise(body))


def merge_partial_numbers(text: Column) -> Column:
    """A line that is only ".1" joins the next line that isn't blank."""
    return F.regexp_replace(text, r"(?m)^[ \t]*(\.\d+)[ \t]*\n(?:[ \t]*\n)*[ \t]*(?=\S)(?!\.\d+[ \t]*$)", "$1 ")


def clock(seconds: Column) -> Column:
    """Hours, minutes and seconds of a number of seconds."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s % 60))).otherwise(F.concat_ws(":", m.cast("string"), two(s % 60)))
