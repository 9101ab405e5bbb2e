"""Budgets and their notes, memory, and what happens side by side or when a service fails."""

from __future__ import annotations

import gc
import http.client
import io
import threading
import time
import tracemalloc
import zipfile
import zlib

import pytest

from folio.converters import archive as ar
from folio.converters.pdf import pdf
from folio.engine import Folio
from folio.plans.model import Info, Options, asked
from folio.render.html_md import html_to_markdown
from folio.sources import fetch, readers


def zipped(entries) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def convert(data: bytes, name: str = "a.zip"):
    f = Folio()
    return f.registry.convert(data, Info(filename=name, extension="." + name.rpartition(".")[2]), f.options).result


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_archive_entries_of_one_name():
    got = convert(zipped([("a.txt", "first"), ("a.txt", "second")]))
    assert got.markdown.count("## File: a.txt") == 2 and "first" in got.markdown and "second" in got.markdown and not got.degraded


def test_archive_budgets_are_noted(monkeypatch):
    many = convert(zipped([(f"{k}.txt", "x") for k in range(5000)]))
    assert "> Archive has 5000 entries; only the first 4096 were processed." in many.markdown and many.degraded
    assert many.markdown.count("## File:") == 4096
    monkeypatch.setattr(ar, "MAX_ENTRY", 10)
    large = convert(zipped([("a.txt", "x" * 11), ("b.txt", "ok")]))
    assert "## File: a.txt\n\n> Skipped: entry exceeds the per-file size limit." in large.markdown and "## File: b.txt\n\nok" in large.markdown and large.degraded
    monkeypatch.setattr(ar, "MAX_TOTAL", 15)
    much = convert(zipped([("a.txt", "x" * 9), ("b.txt", "y" * 9), ("c.txt", "z")]))
    assert "decompression limit" in much.markdown and "c.txt" not in much.markdown and much.degraded
    assert convert(zipped([("a.bin", b"\0\1")])).degraded


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_archives_as_tables(spark):
    from folio.operators import archives

    whole = {"two": zipped([("a.txt", "first"), ("a.txt", "second")]), "many": zipped([(f"{k}.txt", "x") for k in range(4100)]), "none": zipped([("skip.bin", b"\0\1")])}
    docs = readers.rows(spark, [(k, v, Info(extension=".zip")) for k, v in whole.items()] + [("null", None, None), ("bad", b"PK", None)])
    got = {r["archive_id"]: r for r in archives.collected(archives.converted_entries(archives.entries(docs))).collect()}
    assert set(got) == set(whole)
    for k, data in whole.items():
        once = convert(data, f"{k}.zip")
        assert got[k]["markdown"] == once.markdown.replace(f"`{k}.zip`", f"`{k}`") and got[k]["degraded"] == once.degraded


def test_scopes_of_threads_leave_each_other_alone(spark):
    from folio.runtime import scratch, stash

    begun, ended, kept = threading.Event(), threading.Event(), []

    def other():
        with scratch() as keep:
            begun.wait(60)
            kept.append(keep(stash(spark.range(3), "other")))
            ended.wait(60)

    t = threading.Thread(target=other)
    t.start()
    with scratch():
        mine = stash(spark.range(5), "mine")
        begun.set()
        while not kept:
            time.sleep(0.05)
    ended.set()
    t.join()
    assert kept[0].count() == 3
    with pytest.raises(Exception, match="(?i)path|exist|found"):
        mine.count()


def paged(n: int) -> bytes:
    """A PDF of ``n`` pages with a table each."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for p in range(n):
        rows = b"".join(b"BT /F1 9 Tf %d %d Td (%s %d) Tj ET\n" % (x, 740 - 15 * i, word, 100 * p + i) for i in range(40) for x, word in ((72, b"key"), (200, b"name of"), (400, b"region")))
        body = zlib.compress(rows)
        kids.append(b"%d 0 R" % (len(objects) + 1))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (len(objects) + 2))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_memory_does_not_grow_with_pages():
    peaks = {}
    for n in (50, 200):
        data = paged(n)
        gc.collect()
        tracemalloc.start()
        got = pdf(data, Info(extension=".pdf"), Options())
        peaks[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.markdown.count("key ") == 40 * n
    assert peaks[200] < 30 << 20 and peaks[200] < 2 * peaks[50]


def test_long_tables_and_lists_take_linear_time():
    def taken(n: int) -> float:
        html = "<table>" + "<tr><td>a</td><td>b</td></tr>" * n + "</table><ol>" + "<li>x</li>" * n + "</ol>"
        began = time.process_time()
        text = html_to_markdown(html)
        assert text.count("| a | b |") == n and f"\n{n}. x" in text
        return time.process_time() - began

    small = min(taken(2000) for _ in range(2))
    assert taken(16000) < 24 * max(small, 0.02)


def test_addresses_inside():
    assert fetch.is_inner("64:ff9b::7f00:1") and fetch.is_inner("2002:7f00:1::") and fetch.is_inner("::ffff:10.0.0.1")
    assert not fetch.is_inner("64:ff9b::808:808") and not fetch.is_inner("8.8.8.8")


def test_a_broken_response_is_an_empty_row(monkeypatch):
    def broken(*args, **kw):
        raise http.client.IncompleteRead(b"half", 10)

    monkeypatch.setattr(fetch, "fetch", broken)
    assert readers._fetched("http://h/x", True) == ("http://h/x", None, None)


def test_a_fetch_has_one_deadline(monkeypatch):
    monkeypatch.setattr(fetch, "TIMEOUT", 0.3)
    import socketserver

    class Slow(socketserver.BaseRequestHandler):
        def handle(self):
            self.request.recv(4096)
            self.request.sendall(b"HTTP/1.1 200 OK\r\nContent-Length: 100\r\n\r\n")
            for _ in range(30):
                try:
                    self.request.sendall(b"x")
                except OSError:
                    return
                time.sleep(0.1)

    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Slow) as server:
        server.daemon_threads = True
        threading.Thread(target=server.serve_forever, daemon=True).start()
        began = time.monotonic()
        with pytest.raises(OSError):
            fetch.fetch(f"http://127.0.0.1:{server.server_address[1]}/", guard=False)
        assert time.monotonic() - began < 2
        server.shutdown()


def test_hooks_that_fail_say_nothing():
    class Hooks:
        def ocr(self, data):
            raise RuntimeError("down")

    assert asked(Hooks(), "ocr", b"") is None and asked(None, "ocr", b"") is None


def test_link_targets():
    assert html_to_markdown('<a href="http://h/a b?q=1#f" title="t">x</a>') == '[x](http://h/a%20b?q=1#f "t")'
    assert html_to_markdown('<a href="javascript:x()">x</a> <a href="HTTP://h/">y</a> <a>z</a>') == "x [y](http://h/) z"
    assert html_to_markdown('<a href="http://h/a_b">http://h/a_b</a>') == "<http://h/a_b>"
    assert html_to_markdown('<h1>a <img alt="b\nc" src="x"></h1><img data-src="y" alt="d" title="e">') == '# a b c\n\n![d](y "e")'


def test_captions_of_a_video_page():
    """The track made by hand in English is the one that the hook gets."""

    class Hooks:
        def captions(self, address):
            return f"said at {address}"

    tracks = '[{"languageCode": "de", "baseUrl": "u1"}, {"languageCode": "en", "kind": "asr", "baseUrl": "u2"}, {"languageCode": "en-GB", "baseUrl": "u3"}]'
    page = f'<html><head><title>T</title></head><body><script>var x = {{"captionTracks": {tracks}, "y": 1}};</script></body></html>'.encode()
    f = Folio()
    info = Info(mimetype="text/html", charset="utf-8", url="https://www.youtube.com/watch?v=a")
    assert "### Transcript" not in f.registry.convert(page, info, f.options).result.markdown
    assert f.registry.convert(page, info, Options(hooks=Hooks())).result.markdown.endswith("### Transcript\nsaid at u3\n")
