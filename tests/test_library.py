"""Detection, addresses, the front, the command line and the table operations."""

from __future__ import annotations

import io

import pytest
from fixtures import docx, pptx, xlsx, zipped

from folio.__main__ import main
from folio.engine import Folio
from folio.functions import uri
from folio.plans import detect, dispatch
from folio.plans.model import INFO_FIELDS, Info
from folio.sources import fetch, readers
from folio.tools import capabilities, convert_batch, convert_to_markdown, preview, supported_formats, unique_names


def test_info_updates():
    a = Info(mimetype="text/html", charset="utf-8")
    assert a.updated(Info(charset="ascii", url="u")) == Info("text/html", None, "ascii", None, None, "u")
    assert a.updated(charset=None).charset is None


@pytest.mark.parametrize(("given", "want"), [
    ("data:text/plain;charset=utf-8;base64,aGk=", ("text/plain", {"charset": "utf-8"}, b"hi")), ("data:,a%20b", (None, {}, b"a b")), ("data:text;k=v,x", ("text", {"k": "v"}, b"x")), ("data:;base64,aGk=", (None, {}, b"hi")),
])
def test_data_uris(given, want):
    assert uri.parse_data_uri(given) == want


def test_bad_data_uris():
    for bad in ("data:nocomma", "http://x", "data:;base64,a"):
        with pytest.raises(ValueError):
            uri.parse_data_uri(bad)


def test_file_uris():
    assert uri.file_uri_to_path("file:///a/b%20c?x#y") == (None, "/a/b c")
    assert uri.file_uri_to_path("file:/a") == (None, "/a")
    assert uri.file_uri_to_path("file://localhost/a") == ("localhost", "/a")
    with pytest.raises(ValueError):
        uri.file_uri_to_path("http://x")


@pytest.mark.parametrize(("target", "want"), [("b", "http://h/a/b"), ("/b", "http://h/b"), ("//o/b", "http://o/b"), ("../b", "http://h/b"), ("?q", "http://h/a/x?q"), ("https://o/", "https://o/"), ("mailto:x", None), ("", None)])
def test_joins(target, want):
    assert uri.join("http://h/a/x", target) == want


@pytest.mark.parametrize(("address", "inner"), [("127.0.0.1", True), ("10.1.2.3", True), ("169.254.1.1", True), ("100.64.0.1", True), ("0.1.2.3", True), ("::1", True), ("::ffff:10.0.0.1", True), ("fe80::1", True), ("fd00::1", True), ("8.8.8.8", False), ("2606:4700::1", False)])
def test_guard(address, inner):
    assert fetch.is_inner(address) is inner


def test_blocked_and_refresh():
    with pytest.raises(OSError):
        fetch.resolve("127.0.0.1", 80, True)
    assert fetch.refresh_target(b'<meta http-equiv="refresh" content="0; url=/next">', "http://h/a") == "http://h/next"
    assert fetch.refresh_target(b"<p>" * 20_000, "http://h/a") is None
    info = fetch.response_info("http://h/x.csv?y", {"Content-Type": "text/html; charset=latin-1", "Content-Disposition": 'a; filename="n.pdf"'})
    assert (info.mimetype, info.charset, info.filename, info.extension) == ("text/html", "latin-1", "n.pdf", ".pdf")


@pytest.mark.parametrize(("data", "info", "want"), [
    (docx(), Info(), ("docx", None)), (xlsx(), Info(), ("xlsx", None)), (pptx(), Info(), ("pptx", None)), (b"a,b", Info(extension=".csv"), ("csv", "ascii")), ("é".encode(), Info(filename="a.txt"), ("txt", "utf-8")),
    (b"{}", Info(), ("json", "ascii")), (b"<html></html>", Info(url="http://h/"), ("html", "ascii")), (b"%PDF-1.7", Info(), ("pdf", None)),
])
def test_guesses(data, info, want):
    got = detect.guesses(data, info)[0]
    assert got.extension == f".{want[0]}" and got.mimetype == detect.MIME_OF[got.extension] and got.charset == want[1]


def test_lying_names_give_two_guesses():
    assert [g.extension for g in detect.guesses(b"%PDF-1.7", Info(extension=".docx"))] == [".docx", ".pdf"]


def test_decode():
    assert detect.decode("日本語テキスト".encode("cp932")) == "日本語テキスト"
    assert detect.decode("é".encode("utf-16")) == "é"
    assert detect.decode(b"\xff\xfe\xfd") is not None
    assert detect.decode("é".encode("cp1252"), "cp1252") == "é"


def test_front(tmp_path):
    f = Folio()
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2")
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert f.convert(str(path)).markdown == f.convert(path).markdown == f.convert(path.as_uri()).text_content == table
    stream = io.BytesIO(b"xx1,2")
    stream.read(2)
    assert f.convert(stream, Info(extension=".csv")).markdown.startswith("| 1 | 2 |") and stream.tell() == 2
    assert f.convert("data:text/csv,a%0A1").markdown == "| a |\n| --- |\n| 1 |"
    for bad in (io.StringIO("x"), 5):
        with pytest.raises(TypeError):
            f.convert(bad)
    with pytest.raises(ValueError):
        f.convert_uri("ftp://x")
    with pytest.raises(ValueError):
        f.convert_uri("file://host/x")

    own = Folio(fetcher=lambda u: fetch.Fetched(b"a,b", Info(mimetype="text/csv", url=u)))
    assert own.convert("http://h/x").markdown.startswith("| a | b |")

    class Response:
        url, headers = "http://h/x", {"Content-Type": "text/csv"}

        def iter_content(self, chunk_size):
            yield from (b"a,", b"b")

    assert f.convert(Response()).markdown.startswith("| a | b |")


def test_command_line(tmp_path, capsysbinary):
    one, two = tmp_path / "a.csv", tmp_path / "a.json"
    one.write_text("a\n1")
    two.write_text("{}")
    assert main([str(one)]) == 0 and capsysbinary.readouterr().out == b"| a |\n| --- |\n| 1 |\n"
    assert main([str(one), str(two), "-O", str(tmp_path / "out")]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.json.md", "a.md"]
    assert main([str(tmp_path / "gone")]) == 1
    assert main([str(one), "-o", str(tmp_path / "o.md")]) == 0 and (tmp_path / "o.md").read_text().startswith("| a |")
    for bad in (["-m", "x", "f"], ["-c", "no-such", "f"], ["f", "g"]):
        with pytest.raises(SystemExit):
            main(bad)


def test_tools(tmp_path):
    f = tmp_path / "t.txt"
    f.write_text("x" * 100)
    assert convert_to_markdown(str(f), 90) == "x" * 10
    assert "go on with offset=40" in convert_to_markdown(str(f), 0, 40)
    with pytest.raises(ValueError):
        convert_to_markdown(str(f), 100)
    assert "Characters: 100" in preview(str(f))
    assert unique_names(["a/x.pdf", "b/x.doc", "x.doc", "http://h/y.html?q"]) == ["x.md", "x.doc.md", "x.doc-1.md", "y.md"]
    assert [s for *_, s in convert_batch([str(f), "/gone"], str(tmp_path / "o"))][0] == "ok"
    with pytest.raises(ValueError):
        convert_batch([], "../x")
    assert "pdf: .pdf" in supported_formats()
    assert capabilities() == {"formats": 23, "caption": False, "ocr": False, "ocr_pdf": False, "transcribe": False, "transcript": False, "analyze": False}


# -- tables -------------------------------------------------------------------------------------


def test_tables_equal_direct_calls(spark):
    items = [("d", docx(), Info(extension=".docx")), ("c", b"a,b\n1,2", Info(filename="x.csv")), ("n", None, None), ("p", b"\0\1\2", None), ("b", b"PK\3\4", Info(extension=".docx")), ("z", zipped({"a.txt": "in"}), Info(filename="z.zip"))]
    got = {r["doc_id"]: r for r in dispatch.convert_documents(readers.rows(spark, items)).collect()}
    f = Folio()
    for i, data, info in items:
        if i in "dcz":
            assert got[i]["markdown"] == f.registry.convert(data, info, f.options).result.markdown and got[i]["status"] == "ok"
    assert {i: got[i]["status"] for i in "npb"} == {"n": "invalid_input", "p": "unsupported", "b": "failed"}
    assert got["b"]["attempts"][0]["converter"] == "docx"
    many = dispatch.convert_documents(readers.rows(spark, items).repartition(3)).collect()
    assert sorted((r["doc_id"], r["markdown"] or "") for r in many) == sorted((i, r["markdown"] or "") for i, r in got.items())


def test_one_python_pass(spark):
    done = dispatch.convert_documents(readers.rows(spark, [("a", b"x", Info(extension=".txt"))])).where("status = 'ok'").select("markdown", "title")
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_files_and_stream(spark, tmp_path):
    from folio.operators import sinks
    from folio.streaming.ingest import convert_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("a\n1")
    (src / "b.html").write_text("<p>hi</p>")
    found = readers.files(spark, str(src))
    assert "content" not in found.select("doc_id")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    done = dispatch.convert_documents(found)
    written = {r["output"]: r["error"] for r in sinks.write_files(done, str(tmp_path / "md")).collect()}
    assert written == {"a.md": None, "b.md": None} and (tmp_path / "md" / "b.md").read_text() == "hi\n"
    sinks.write_table(done, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    q = convert_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r["markdown"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["hi", "| a |\n| --- |\n| 1 |"]


def test_fallback(spark):
    from folio.plans.model import Result
    from folio.plans.registry import Converter, Registry

    first, second = Registry(False), Registry(False)
    first.register(Converter("one", lambda d, i, o: Result("" if d == b"x" else "kept"), (".txt",)))
    second.register(Converter("two", lambda d, i, o: Result("again"), (".txt",)))
    docs = readers.rows(spark, [("a", b"x", Info(extension=".txt")), ("b", b"y", Info(extension=".txt"))])
    got = {r["doc_id"]: r["markdown"] for r in dispatch.with_fallback(docs, first, second).collect()}
    assert got == {"a": "again", "b": "kept"}
    rows = [(None, b"x", Info(extension=".txt")), ("a", b"x", Info(extension=".txt")), ("a", b"y", Info(extension=".txt")), ("a", None, None)]
    got = dispatch.with_fallback(readers.rows(spark, rows), first, second).collect()
    assert sorted((str(r["doc_id"]), str(r["markdown"]), r["status"]) for r in got) == [("None", "again", "ok"), ("a", "None", "invalid_input"), ("a", "again", "ok"), ("a", "kept", "ok")]


def test_addresses(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("text")
    got = readers.addresses(spark, ["data:text/plain,x", f.as_uri(), "data:bad"]).collect()
    assert sorted((bytes(r["content"]) if r["content"] is not None else b"") for r in got) == [b"", b"text", b"x"]
    odd = ["ftp://x", "no scheme", None, "DATA:,b", "file://host/x", (tmp_path / "gone").as_uri(), "data:,c"]
    got = [(r["doc_id"], r["content"] and bytes(r["content"])) for r in readers.addresses(spark, odd).collect()]
    assert sorted(got, key=str) == sorted([(u, {"DATA:,b": b"b", "data:,c": b"c"}.get(u)) for u in odd], key=str)


def test_names_stay_in_the_folder(spark):
    from folio.operators.shaping import output_names

    rows = [(1, "../../etc/x.txt"), (2, "x.pdf"), (3, ".."), (4, None), (5, "a?b=/c"), (6, "x.pdf")]
    got = {r["k"]: r["output"] for r in output_names(spark.createDataFrame(rows, "k int, name string"), "k", "name").collect()}
    assert got == {1: "x.txt.md", 2: "x.pdf.md", 3: "output.md", 4: "output-1.md", 5: "a.md", 6: "x.pdf-1.md"}


def test_no_two_rows_get_one_name(spark, monkeypatch):
    from folio.operators import shaping

    monkeypatch.setattr(shaping, "PIECE", 3)
    names = ["x", "x", "x-1.pdf", "y-2", "y", "y", "x-1.txt", "x-1"] + ["index.html"] * 20 + ["index-7.html", None, None]
    docs = spark.createDataFrame([(k if k % 5 else None, n, "mine") for k, n in enumerate(names)], "doc_id int, name string, output string")
    got = shaping.output_names(docs, "doc_id", "name")
    assert got.columns == ["doc_id", "name", "output"]
    made = [r["output"] for r in got.collect()]
    assert len(made) == len(names) == len(set(made)) and "x-2.md" in made and "index.html-19.md" in made
    assert shaping.output_names(docs.limit(0), "doc_id", "name").count() == 0


def test_info_schema():
    assert tuple(Info.__dataclass_fields__) == INFO_FIELDS
