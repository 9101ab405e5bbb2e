"""Properties that hold for any input."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.converters.pdf import form_text, lines_of, merge_partial_numbers
from folio.converters.pdf_reader import Glyph
from folio.functions import uri
from folio.plans import detect
from folio.plans.model import ConversionError, Info, Options, Unsupported
from folio.plans.registry import Registry, normalise
from folio.render.html_md import html_to_markdown, parse
from folio.render.table_md import aligned, table
from folio.tools import unique_names

REGISTRY = Registry()
CELLS = st.lists(st.lists(st.text(max_size=8), min_size=1, max_size=5), min_size=1, max_size=6)
HTML = st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<a href='x'>", "</a>", "<pre>", "</pre>", "<img src=q>", "text ", "a*b_c", "&amp;", "<!-- c -->", "<script>", "</script>", "<h1>", "</h1>", "<br>", "<blockquote>", "\n"]), max_size=40).map("".join)


@given(st.text())
def test_normalise_is_idempotent(text):
    once = normalise(text)
    assert normalise(once) == once and "\n\n\n" not in once and not re.search(r"[ \t]+(\n|$)", once)


@given(HTML)
@settings(max_examples=300)
def test_any_html_renders(html):
    out = html_to_markdown(html)
    assert out == out.strip() and "\n\n\n" not in out
    assert parse(html).tag == ""


@given(CELLS)
def test_tables_have_one_width(rows):
    clean = [[re.sub(r"[\r\n|]", " ", c) for c in r] for r in rows]
    for text in (table(clean), aligned(clean)):
        assert len({line.count("|") for line in text.split("\n")}) == 1 if "\x0b" not in text else True
    assert len(table(rows, safe=True).split("\n")) == len(rows) + 1 or any(c in "".join(map("".join, rows)) for c in "\x0b\x0c\x1c\x1d\x1e\x85  ")


@given(st.binary(max_size=400), st.sampled_from([None, *detect.MIME_OF]))
@settings(max_examples=400, deadline=None)
def test_any_bytes_convert_or_fail_as_such(data, extension):
    try:
        got = REGISTRY.convert(data, Info(extension=extension), Options())
        assert isinstance(got.result.markdown, str)
    except (ConversionError, Unsupported):
        pass


@given(st.binary(max_size=60), st.sampled_from(["", "text/plain", "a/b;k=v"]))
def test_data_uris_round_trip(data, head):
    import base64

    mime, _, body = uri.parse_data_uri(f"data:{head};base64,{base64.b64encode(data).decode()}")
    assert body == data and (mime or "") == head.split(";")[0]


@given(st.lists(st.text(alphabet="ab./", max_size=6), max_size=12))
def test_names_are_unique_and_plain(names):
    out = unique_names(names)
    assert len(set(out)) == len(out) == len(names) and all("/" not in n and n.endswith(".md") for n in out)


@given(st.text(alphabet=".12 a\n", max_size=40))
def test_partial_numbers_keep_the_text(text):
    assert sorted(merge_partial_numbers(text).split()) == sorted(text.split())


@given(st.lists(st.tuples(st.floats(0, 600), st.floats(0, 780), st.sampled_from("abc -")), max_size=60))
def test_any_glyphs_lay_out(places):
    glyphs = [Glyph(x, y, x + 5, 10, False, False, c) for x, y, c in places]
    lines = lines_of(glyphs)
    assert all(ln.x0 <= ln.x1 for ln in lines)
    assert form_text([]) is None


@given(st.text(max_size=60), st.sampled_from(["utf-8", "utf-16", "utf-8-sig", "utf-32"]))
def test_marked_text_decodes(text, codec):
    if "﻿" not in text and (codec != "utf-8" or text):
        assert detect.decode(text.encode(codec), None if codec != "utf-8" else "utf-8") == text
