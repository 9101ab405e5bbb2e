"""Every converter on small files: what has to be in the result, and what must not."""

from __future__ import annotations

import json

import pytest
from fixtures import PNG, docx, epub, mobi, msg, ods, pdf, pptx, wav, xls, xlsx, zipped

from folio.converters import pdf as pdf_
from folio.converters.media import clock
from folio.converters.pdf import Word, form_text, merge_partial_numbers
from folio.hooks import Hooks
from folio.plans.model import ConversionError, Info, Options, Unsupported
from folio.plans.registry import FailedConversion, Registry, normalise
from folio.render.html_md import html_to_markdown

REGISTRY = Registry()


def run(data: bytes, options: Options | None = None, **info: str):
    return REGISTRY.convert(data, Info(**info), options or Options())


FORM = b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET\n" % (x, y, w) for y, row in ((500, (b"Name", b"Age", b"City")), (485, (b"Ann", b"30", b"Paris")), (470, (b"Bob", b"41", b"Rome"))) for x, w in zip((72, 200, 330), row, strict=True))
PROSE = b"BT /F1 24 Tf 72 700 Td (Big Title) Tj ET BT /F1 10 Tf 72 660 Td 12 TL (This goes on for a whi-) Tj T* (le and ends.) Tj 0 -30 Td (\x95 item) Tj ET"
RSS = b'<?xml version="1.0"?><rss><channel><title>Feed</title><description>About</description><item><title>One</title><pubDate>Mon</pubDate><description>&lt;b&gt;bold&lt;/b&gt;</description></item></channel></rss>'
ATOM = b'<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><updated>2020</updated><summary>s</summary></entry></feed>'
MHTML = b"From: x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<html><body><h1>Caf=C3=A9</h1><p>a=\r\nb</p></body></html>\r\n--B--\r\n"
NOTEBOOK = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# Top\n", "text"]}, {"cell_type": "code", "source": ["x = 1\n", "y"]}, {"cell_type": "raw", "source": ["raw"]}], "nbformat": 4, "nbformat_minor": 5, "metadata": {}}).encode()
TUBE = b'<html><head><title>Vid</title><meta itemprop="interactionCount" content="12"><meta name="keywords" content="k"></head><body><script>var ytInitialData = {"a":[{"attributedDescriptionBodyText":{"content":"About; {it}"}}]};</script></body></html>'

VECTORS = [
    ("docx", docx(), {"extension": ".docx"}, ["# The Title", "A **bold** and *slanted* word.", "[a link](https://x.example/)", "## Part", "- one\n  - inner", "1. first\n2. second", "| k | v |", "a\\|b", "![](data:image/png;base64...)", "$$\\frac{a}{b}$$", "$x^{2}$", "Ann: why so"], ["iVBOR"]),
    ("xlsx", xlsx(), {"filename": "a.xlsx"}, ["## Data", "| x\\|y | when |", "| 1.5 | 2023-03-15 | True |"], []),
    ("ods", ods(), {}, ["## S", "| a | b | b |"], []),
    ("pptx", pptx(), {"extension": ".pptx"}, ["<!-- Slide number: 1 -->\n# Headline\nbelow", "| h |", "### Chart: Growth", "| Category | Sales |\n|---|---|\n| 2003 | 7.0 |", "![a cat](Picture4.jpg)", "### Notes:\nremember"], []),
    ("epub", epub(), {}, ["**Title:** A Book", "**Authors:** Ann, Bob", "# One", "* item", "**b**", "*i*", "> quote"], []),
    ("xls", xls(), {}, ["## Tab", "| Name | 2.5 |", "| Ann | 30 |"], []),
    ("msg", msg(), {}, ["# Email Message", "**From:** a@x.example", "**Subject:** Hello", "## Content\n\nThe body."], []),
    ("mobi", mobi(), {}, ["# Tale", "Once upon."], []),
    ("pdf", pdf(FORM), {}, ["| Name | Age | City  |\n| ---- | --- | ----- |\n| Ann  | 30  | Paris |"], []),
    ("pdf", pdf(PROSE), {}, ["# Big Title", "This goes on for a while and ends.", "- item"], []),
    ("rss", RSS, {"extension": ".xml"}, ["# Feed\nAbout", "## One\nPublished on: Mon\n**bold**"], ["<rss"]),
    ("rss", ATOM, {}, ["# F", "## E\nUpdated on: 2020\ns"], ["<feed"]),
    ("xml", b"<books><b id='1'><t>x|y</t></b><b id='2'><t>z</t></b></books>", {"extension": ".xml"}, ["# books", "| @id | t |", "| 1 | x\\|y |"], []),
    ("xml", b"<c><a k='v'>t</a><n><m/></n></c>", {"extension": ".xml"}, ["- **a** (k=v): t", "- **n**\n  - **m**"], []),
    ("csv", "名,年\n佐藤,30\n三木,".encode("cp932"), {"extension": ".csv", "charset": "cp932"}, ["| 名 | 年 |\n| --- | --- |\n| 佐藤 | 30 |\n| 三木 |  |"], []),
    ("csv", b"a,b\n1,2,3\n4\n", {"extension": ".csv"}, ["| 1 | 2 |\n| 4 |  |"], ["3"]),
    ("ipynb", NOTEBOOK, {"extension": ".json"}, ["# Top\ntext", "```python\nx = 1\ny\n```", "```\nraw\n```"], ["nbformat"]),
    ("mhtml", MHTML, {}, ["# Café", "ab"], ["=C3"]),
    ("rtf", rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hi \b there\b0\par caf\'e9 \u8364? x}", {}, ["Hi there\ncafé € x"], ["Arial"]),
    ("wikipedia", b'<html><head><title>X - W</title></head><body><span class="mw-page-title-main">X</span><div id="mw-content-text"><p>Text <a href="/wiki/Y" title="Y">y</a></p></div><div>chrome</div></body></html>', {"url": "https://en.wikipedia.org/wiki/X", "extension": ".html"}, ["# X\n\nText [y](/wiki/Y \"Y\")"], ["chrome"]),
    ("bing", b'<html><body><div class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly94LmV4YW1wbGUv">Hit</a></h2><p>Some <strong>bold</strong></p></div></body></html>', {"url": "https://www.bing.com/search?q=cats+dogs", "mimetype": "text/html"}, ["## A Bing search for 'cats dogs' found the following results:", "## [Hit](https://x.example/)", "Some **bold**"], ["ck/a"]),
    ("youtube", TUBE, {"url": "https://www.youtube.com/watch?v=abc", "mimetype": "text/html"}, ["# YouTube\n\n## Vid", "- **Views:** 12", "### Description\nAbout; {it}"], []),
    ("image", PNG, {}, ["ImageSize: 7x5", "Title: A picture"], []),
    ("audio", wav(), {}, ["NumChannels: 2", "SampleRate: 44100", "Duration: 0:01"], []),
    ("plain", b"just text", {"extension": ".txt"}, ["just text"], []),
    ("zip", zipped({"a.csv": "x,y\n1,2", "d/b.json": "{}", "c.bin": b"\0\1"}), {"filename": "z.zip"}, ["Content from the zip file `z.zip`", "## File: a.csv\n\n| x | y |", "## File: d/b.json"], ["c.bin"]),
]


@pytest.mark.parametrize(("name", "data", "info", "has", "lacks"), VECTORS, ids=[f"{v[0]}{i}" for i, v in enumerate(VECTORS)])
def test_vectors(name, data, info, has, lacks):
    got = run(data, **info)
    assert got.converter == name
    for x in has:
        assert x in got.result.markdown
    for x in lacks:
        assert x not in got.result.markdown


def test_titles():
    assert run(docx(), extension=".docx").result.title == "The Title"
    assert run(epub()).result.title == "A Book"
    assert run(NOTEBOOK, extension=".ipynb").result.title == "Top"
    assert run(b"<html><title> T </title><body>x</body></html>").result.title == "T"


def test_data_uris_are_kept_on_demand():
    keep = Options(keep_data_uris=True)
    assert "data:image/png;base64,iVBOR" in run(docx(), keep, extension=".docx").result.markdown
    assert "data:image/png;base64,iVBOR" in run(pptx(), keep, extension=".pptx").result.markdown
    assert html_to_markdown('<img src="data:image/png;base64,AAA" alt="a">') == "![a](data:image/png;base64...)"
    assert html_to_markdown('<img src="data:image/png;base64,AAA" alt="a">', True) == "![a](data:image/png;base64,AAA)"


@pytest.mark.parametrize(("html", "markdown"), [
    ("<h2>a <b>b</b></h2>", "## a **b**"), ("<p>a</p><p>b</p>", "a\n\nb"), ("a<br>b", "a  \nb"), ("<ol><li>x<li>y</ol>", "1. x\n2. y"), ("<ul><li>a<ul><li>b</li></ul></li></ul>", "* a\n  + b"),
    ('<a href="javascript:x()">t</a>', "t"), ('<a href="https://a.b/c d">t</a>', "[t](https://a.b/c%20d)"), ('<a href="https://a.b/">https://a.b/</a>', "<https://a.b/>"), ('<a href="/x"></a>', ""),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"), ("<pre>x  y\n z</pre>", "```\nx  y\n z\n```"), ("<code>a`b</code>", "``a`b``"), ("a_b*c", "a\\_b\\*c"), ("<script>x</script>y", "y"),
    ("<table><tr><th>a<th>b<tr><td>1|2<td>c</table>", "| a | b |\n| --- | --- |\n| 1\\|2 | c |"), ('<input type="checkbox" checked> t', "[x]  t"), ('<h1>x <img src="s" alt="pic"></h1>', "# x pic"), ('<img data-src="s" alt="a\nb">', "![a b](s)"),
    ("<p>&lt;b&gt; &amp; &eacute;", "<b> & é"), ("", ""),
])
def test_html(html, markdown):
    assert html_to_markdown(html) == markdown


def test_deep_html_keeps_its_text():
    got = run(b"<html><body>" + b"<div>" * 20_000 + b"deep" + b"</div>" * 20_000 + b"</body></html>")
    assert got.result.markdown == "deep"


def test_main_content():
    page = "<html><body><nav>menu</nav><article>" + "word " * 60 + "</article><footer>foot</footer></body></html>"
    assert "menu" in run(page.encode()).result.markdown
    got = run(page.encode(), Options(main_content=True)).result.markdown
    assert "menu" not in got and "word" in got


def test_meta_charset():
    assert "é" in run("<html><head><meta charset=windows-1252></head><body>café</body></html>".encode("cp1252")).result.markdown


@pytest.mark.parametrize("data", [b"%PDF-1.4 nothing here", b"PK\3\4 broken", bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 600, b"\x89PNG\r\n\x1a\n", b"{\\rtf1 {{{", b"\xff\xd8\xff\xe0\0", b"ID3\4\0\0\0\0\0\x7f", b"RIFF\0\0\0\0WAVEfmt ", b"<?xml version='1.0'?><a><b></a>", b"GIF89a"])
def test_broken_files_only_fail_as_such(data):
    try:
        run(data)
    except (ConversionError, Unsupported):
        pass


def test_entities_in_xml_are_refused():
    evil = b'<?xml version="1.0"?><!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'
    assert run(evil, extension=".xml").converter == "plain"
    deep = b"<a>" * 300 + b"</a>" * 300
    assert any(a.converter == "xml" and "nesting" in a.message for a in run(deep, extension=".xml").attempts)


def test_archives_are_bounded():
    inner = zipped({"t.txt": "core"})
    for _ in range(6):
        inner = zipped({"n.zip": inner, "t.txt": "layer"})
    got = run(inner, extension=".zip").result.markdown
    assert "layer" in got and "core" not in got


def test_one_bad_page_is_left_out():
    good = pdf(PROSE, PROSE)
    got = run(good.replace(b"/MediaBox [0 0 612 792] /Contents 7 0 R", b"/MediaBox [0 0 612 792] /Contents 70 R "))
    assert "Big Title" in got.result.markdown
    assert run(pdf(b"")).result.degraded


def test_running_heads_go():
    page = lambda n: b"BT /F1 8 Tf 72 770 Td (Report %d of 9) Tj ET BT /F1 10 Tf 72 600 Td (Words of page %s here.) Tj ET BT /F1 10 Tf 72 560 Td (More of it.) Tj ET BT /F1 10 Tf 72 500 Td (And more.) Tj ET BT /F1 10 Tf 72 400 Td (End %s.) Tj ET" % (n, b"abc"[n : n + 1], b"xyz"[n : n + 1])
    assert "Report" not in run(pdf(page(0), page(1), page(2))).result.markdown


@pytest.mark.parametrize(("text", "yes"), [(".1", True), (".10", True), ("1.", False), (".1.2", False), (".a", False), ("", False)])
def test_partial_numbers(text, yes):
    assert bool(pdf_.PARTIAL.match(text)) is yes
    assert merge_partial_numbers(f"{text}\n\nnext") == (f"{text} next" if yes else f"{text}\n\nnext")


def test_forms_need_columns():
    assert form_text([Word("a", 10, 20, 10), Word("b", 200, 220, 10)]) is None
    rows = [Word(t, x, x + 20, y) for y in (10, 30, 50) for t, x in (("a", 10), ("b", 150), ("c", 300))]
    assert form_text(rows).startswith("| a   | b   | c   |\n| --- | --- | --- |")


def test_normalise():
    assert normalise("a \t\r\n\n\n\nb  \n") == "a\n\nb\n"


def test_clock():
    assert (clock(5), clock(65), clock(3661)) == ("0:05", "1:05", "1:01:01")


def test_hooks():
    hooks = Hooks(caption=lambda d, m: "a cat", ocr=lambda d: "read", transcribe=lambda d, e: "")
    assert "# Description:\na cat" in run(PNG, Options(hooks=hooks)).result.markdown
    assert "[No speech detected]" in run(wav(), Options(hooks=hooks)).result.markdown
    assert "*[Image OCR]\nread\n[End OCR]*" in run(docx(), Options(hooks=hooks), extension=".docx").result.markdown
    assert "a cat a cat" in run(pptx(), Options(hooks=hooks), extension=".pptx").result.markdown


def test_order_and_failures():
    with pytest.raises(Unsupported):
        run(b"\0\1\2\3")
    with pytest.raises(FailedConversion) as e:
        run(b"PK\3\4 broken", extension=".docx")
    assert [a.converter for a in e.value.attempts][:1] == ["docx"]
    own = Registry()
    from folio.plans.model import Result
    from folio.plans.registry import Converter

    own.register(Converter("mine", lambda d, i, o: Result("mine"), (".txt",)))
    assert own.convert(b"x", Info(extension=".txt"), Options()).converter == "mine"


def test_analysis_service():
    service = Hooks(analyze=lambda d, m, a: f"<!-- page -->{a} {m}" if m == "application/pdf" else "")
    assert run(pdf(PROSE), Options(hooks=service)).result.markdown == "prebuilt-documentSearch application/pdf"
    got = run(wav(), Options(hooks=service))
    assert got.converter == "audio" and got.attempts[0].converter == "analysis"
    assert run(b"a,b", Options(hooks=service), extension=".csv").converter == "csv"
