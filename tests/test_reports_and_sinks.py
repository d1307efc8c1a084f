import json
import re
import zipfile
from glob import glob
from xml.etree import ElementTree

import pytest

from contactloom import schemas
from contactloom.operators.history import mark_known, merged_history
from contactloom.operators.report import (
    combine_results,
    contact_summary,
    number_rows,
    run_counts,
    top_businesses,
)
from contactloom.sinks import save, update_history, write_csv, write_excel, write_json
from contactloom.sources import history_from_json, history_source

ROWS = [
    ("q", 2, 'Comma, "quote"\nline', "http://b.org", None, ["a@b.org", "c@d.org"], False),
    ("q", 1, "Ünïcode 店", "http://a.org", "+1 (2)", ["x@y.org"], False),
    ("r", 1, "Skipped & <b>", "http://a.org", None, [], True),
    ("r", 7, "None", None, "", None, False),
]


@pytest.fixture
def contacts(spark):
    return spark.createDataFrame(ROWS, schemas.CONTACTS)


def sheet_rows(path):
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
        sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
    return [
        ["".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t")) or cell.findtext("m:v", None, ns) for cell in row]
        for row in sheet.iter(f"{{{ns['m']}}}row")
    ]


def test_json(contacts, tmp_path):
    write_json(contacts, str(tmp_path / "j"))
    lines = [json.loads(line) for f in sorted(glob(f"{tmp_path}/j/*.json")) for line in open(f, encoding="utf-8")]
    assert len(lines) == 4
    by_key = {(r["query"], r["seq"]): r for r in lines}
    assert by_key[("q", 2)]["email_addresses"] == ["a@b.org", "c@d.org"]
    assert by_key[("q", 2)]["phone_number"] is None and by_key[("q", 1)]["name"] == "Ünïcode 店"
    raw = "".join(open(f, encoding="utf-8").read() for f in glob(f"{tmp_path}/j/*.json"))
    assert "店" in raw


def test_csv(spark, contacts, tmp_path):
    write_csv(contacts, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    got = {(r["query"], r["seq"]): r.asDict() for r in back.collect()}
    assert got[("q", "2")]["name"] == 'Comma, "quote"\nline'
    assert got[("q", "2")]["email_addresses"] == "a@b.org, c@d.org"
    assert got[("r", "1")]["skipped"] == "true"


def test_csv_marker(spark, contacts, tmp_path):
    write_csv(contacts.limit(0), str(tmp_path / "c"), empty_marker=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["No data found"]


def test_excel(contacts, tmp_path):
    write_excel(contacts, str(tmp_path / "x"), "2024-01-01_00-00-00")
    books = glob(f"{tmp_path}/x/*.xlsx")
    assert all(re.search(r"/[0-9a-f]{8}_2024-01-01_00-00-00_\w+\.xlsx$", b) for b in books)
    rows = [row for book in books for row in sheet_rows(book)[1:]]
    assert sheet_rows(books[0])[0] == ["query", "seq", "name", "website", "phone_number", "email_addresses", "skipped"]
    got = {(r[0], r[1]): r for r in rows}
    assert len(rows) == 4
    assert got[("q", "2")][2] == 'Comma, "quote"\nline' and got[("q", "2")][5] == "a@b.org, c@d.org"
    assert got[("r", "1")][2] == "Skipped & <b>" and got[("r", "1")][6] == "1"
    assert got[("q", "1")][2] == "Ünïcode 店"


def test_excel_splits_at_the_sheet_limit(contacts, tmp_path, spark):
    from contactloom.sinks.excel import ExcelDataSource
    from contactloom.sinks.files import _ordered

    spark.dataSource.register(ExcelDataSource)
    rows = _ordered(contacts.filter("query = 'q'"), "t").drop("email_addresses").coalesce(1)
    writer = rows.write.format("contact_excel").mode("append")
    writer.option("path", str(tmp_path / "x")).option("sheetRows", "2").save()
    assert sorted(len(sheet_rows(b)) for b in glob(f"{tmp_path}/x/*.xlsx")) == [2, 2]


def test_save(spark, contacts, tmp_path):
    paths = save(contacts, str(tmp_path), ("json", "csv", "excel"), stamp="t")
    assert set(paths) == {"json", "csv", "excel"}
    assert spark.read.json(paths["json"]).count() == 4
    assert len(glob(f"{paths['csv']}/query_hash=*/run_ts=t/*.csv")) >= 2
    with pytest.raises(ValueError):
        save(contacts, str(tmp_path), ("parquet",))


def test_saving_again_replaces_the_run(spark, contacts, tmp_path):
    def rows_of(paths):
        books = [row for b in glob(f"{paths['excel']}/*.xlsx") for row in sheet_rows(b)[1:]]
        lines = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths["csv"])
        return spark.read.json(paths["json"]).count(), lines.count(), len(books)

    save(contacts, str(tmp_path), stamp="t")
    assert rows_of(save(contacts, str(tmp_path), stamp="t")) == (4, 4, 4)
    assert rows_of(save(contacts, str(tmp_path), stamp="u")) == (8, 8, 8)
    assert rows_of(save(contacts.filter("query = 'q'"), str(tmp_path), stamp="u")) == (8, 8, 8)
    for _ in range(2):
        write_json(contacts, str(tmp_path / "plain"))
    assert spark.read.json(str(tmp_path / "plain")).count() == 4


def test_unreadable_history_is_an_error(spark, tmp_path):
    (tmp_path / "history").mkdir()
    assert history_source(spark, str(tmp_path / "history")).count() == 0
    (tmp_path / "history" / "part.parquet").write_text("no table")
    with pytest.raises(Exception):
        history_source(spark, str(tmp_path / "history")).count()


def test_reports(spark, contacts):
    rows = [("q", n, f"b{n}") for n in (5, 17, 3, 250, 99)] + [("r", 1, "c")]
    df = spark.createDataFrame(rows, "query string, seq bigint, name string")
    numbers = {(r["query"], r["seq"]): r["number"] for r in number_rows(df, block=1).collect()}
    assert numbers == {("q", 3): 1, ("q", 5): 2, ("q", 17): 3, ("q", 99): 4, ("q", 250): 5, ("r", 1): 1}
    assert {r["seq"] for r in top_businesses(df, 2).filter("query = 'q'").collect()} == {3, 5}
    assert top_businesses(df, 0).count() == top_businesses(df, None).count() == 6
    counts = {(r["query"], r["number"]): r["email_count"] for r in contact_summary(contacts).collect()}
    assert counts == {("q", 1): 1, ("q", 2): 2, ("r", 1): 0, ("r", 2): 0}
    totals = {r["query"]: r.asDict() for r in run_counts(contacts).collect()}
    assert totals["q"] == {"query": "q", "businesses": 2, "websites": 2, "with_emails": 2, "emails": 3}
    whole = combine_results(contacts.drop("skipped"), contacts.filter("skipped"))
    assert whole.count() == 5 and whole.filter("skipped").count() == 1


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    assert history_source(spark, path).count() == 0
    sites = spark.createDataFrame([("http://a.org",), ("http://a.org",), (None,), ("",), ("http://b.org",)], "website string")
    update_history(sites, path)
    update_history(sites, path)
    assert sorted(r[0] for r in history_source(spark, path).collect()) == ["http://a.org", "http://b.org"]
    seen = spark.createDataFrame(
        [("q", 1, "http://a.org"), ("q", 2, "http://a.org/"), ("q", 3, None), ("q", 4, "")],
        "query string, seq bigint, website string",
    )
    marked = {r["seq"]: r["skipped"] for r in mark_known(seen, history_source(spark, path)).collect()}
    assert marked == {1: True, 2: False, 3: False, 4: False}
    bare = spark.createDataFrame([("q", 1, "a.org")], "query string, seq bigint, website string")
    https = spark.createDataFrame([("https://a.org",)], "website string")
    assert not mark_known(bare, https).first()["skipped"]
    assert mark_known(bare, https, normalize=True).first()["skipped"]
    assert merged_history(sites, https).count() == 3
    (tmp_path / "h.json").write_text('["http://x.org", "http://y.org", "http://x.org"]')
    assert history_from_json(spark, str(tmp_path / "h.json")).count() == 2
