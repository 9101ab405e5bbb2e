"""Queries on rows and sizes that the small tables don't have."""

from __future__ import annotations

import duckdb
import pandas as pd

from folio.plans.queries import QUERIES, SQL


def against_sql(spark, path, query: str, name: str, rows: pd.DataFrame) -> tuple[list, list]:
    """What a query and its SQL make of one table of these rows."""
    rows.to_parquet(path / f"{name}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    got, want = QUERIES[query](spark, str(path)), con.sql(SQL[query])
    key = lambda r: str(r)
    return sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key), sorted(want.fetchall(), key=key)


def test_cut_data_uris_of_odd_texts(spark, tmp_path):
    texts = ["", "plain", None, "see data:image/png;base64,AAAA here", "x" * 100_000, "data:image/png;base64,"]
    got, want = against_sql(spark, tmp_path, "cut_data_uris", "documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert got == want


def parts(n: int, brands: int = 1) -> pd.DataFrame:
    return pd.DataFrame({"p_partkey": range(n), "p_name": [f"part {k % 97}" for k in range(n)], "p_brand": [f"Brand#{k % brands}" for k in range(n)], "p_type": "LARGE", "p_size": [1 + k % 50 for k in range(n)]})


def test_convert_part_archives_of_many_files(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "convert_part_archives", "part", parts(5000))
    assert got == want


def test_expand_part_archives_of_many_files(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "expand_part_archives", "part", parts(5000))
    assert got == want


def test_mail_is_made_and_converted_in_one_pass(spark, tmp_path):
    parts(3).to_parquet(tmp_path / "part.parquet")
    plan = QUERIES["convert_mail"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_encodings_of_fonts_are_read_once():
    from folio.converters import pdf_reader as reader

    file = type("File", (), {"get": staticmethod(lambda x: x)})()
    assert reader.Font(file, {"Encoding": "WinAnsiEncoding"}).map == reader._plain("cp1252") and reader._plain("cp1252") is reader._plain("cp1252")
    assert [v for v, _ in reader.parse(b" /A#42 % note\n <4 1> [1 (x)] true >> ) 2 0 R")] == ["AB", b"A", [1, b"x"], True, reader.Ref(2)]


def test_padding_of_old_workbooks_is_passed_over():
    from folio.converters.ole import _records

    assert [(i, kind) for i, kind, _ in _records(b"\x0a\0\0\0" + b"\0" * 4000 + b"\x85\0\1\0x\0\0")] == [(0, 10), (4, 0), (4004, 0x85)]


def test_normalise_by_pieces(monkeypatch):
    import tracemalloc

    from folio.plans import registry

    text = "a \r\n\n\n\n b\t\n" * 50 + " \n\n\n"
    whole = registry.normalise(text)
    for n in (1, 2, 3, 7, len(text)):
        monkeypatch.setattr(registry, "PIECE", n)
        assert registry.normalise(text) == whole
    assert registry.normalise("") == "" and registry.normalise("x") == "x"
    monkeypatch.undo()
    text = "a b\n" * 2_000_000
    tracemalloc.start()
    registry.normalise(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text)


def test_page_archives_are_whole_and_made_in_one_pass(spark, tmp_path):
    pd.DataFrame({"page_id": [16 * k for k in range(4200)], "url": "u", "html": "<p>x</p>"}).to_parquet(tmp_path / "pages.parquet")
    found = QUERIES["expand_archives"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("InPandas") == 1
    (row,) = found.collect()
    assert row["markdown"].count("## File: ") == 4200 and row["markdown"].index("p0.html") < row["markdown"].index("p16.html")
