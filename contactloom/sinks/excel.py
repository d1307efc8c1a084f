"""Excel sink: a Spark data source whose tasks write workbooks row by row."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# --- fixed values: sheet limit and package parts of a minimal workbook --------------------------
SHEET_ROWS = 1_048_576
_PARTS = {
    "[Content_Types].xml": (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" '
        'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType='
        '"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType='
        '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
    ),
    "_rels/.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type='
        '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
        'Target="xl/workbook.xml"/></Relationships>'
    ),
    "xl/workbook.xml": (
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    ),
    "xl/_rels/workbook.xml.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type='
        '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
        'Target="worksheets/sheet1.xml"/></Relationships>'
    ),
}
_NAMES = ("query_hash", "run_ts")
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Workbook:
    """One sheet with inline strings, streamed into a local file and copied when closed."""

    def __init__(self, columns: list[str]):
        handle, self.local = tempfile.mkstemp(suffix=".xlsx")
        os.close(handle)
        self.zip = zipfile.ZipFile(self.local, "w", zipfile.ZIP_DEFLATED)
        for name, body in _PARTS.items():
            self.zip.writestr(name, _XML + body)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write((_XML + _SHEET).encode())
        self.rows = 0
        self.add(columns)

    def add(self, values) -> None:
        self.rows += 1
        cells = "".join(_cell(value) for value in values)
        self.sheet.write(f'<row r="{self.rows}">{cells}</row>'.encode())

    def finish(self, target: str) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()
        store, path = _located(target)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with open(self.local, "rb") as source, store.open_output_stream(path) as sink:
            while block := source.read(1 << 20):
                sink.write(block)
        os.unlink(self.local)


def _located(target: str):
    """File system and path of a local path or a URI."""
    from pyarrow import fs

    uri = target if "://" in target else "file://" + os.path.abspath(target.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value}</v></c>"
    legal = "".join(ch for ch in str(value) if ch in "\t\n\r" or ch >= " ")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(legal)}</t></is></c>'


class ExcelDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contact_excel"

    def schema(self):
        raise NotImplementedError("this source is for writing only")

    def writer(self, schema, overwrite):
        return ExcelWriter(self.options, schema, overwrite)


class ExcelWriter(DataSourceWriter):
    """Rows arrive ordered by query; a new workbook starts with each query and at the sheet limit.

    Helper columns ``query_hash`` and ``run_ts`` name the file and are not written as cells. Tasks
    write to a pending folder; only files of successful tasks are moved out of it, so a lost or
    repeated task leaves nothing behind. Afterwards older workbooks of the same queries and stamp go,
    or all older ones if the folder is to be overwritten.
    """

    def __init__(self, options, schema, overwrite: bool = False):
        self.overwrite = overwrite
        self.folder = options["path"].rstrip("/")
        self.pending = f"{self.folder}/_pending_{uuid.uuid4().hex}"
        self.limit = int(options.get("sheetRows", SHEET_ROWS))
        self.columns = [f.name for f in schema.fields if f.name not in _NAMES]

    def write(self, rows: Iterator) -> Written:
        files: list[str] = []
        book, current = None, None

        def close():
            name = f"{'_'.join(current)}_{uuid.uuid4().hex[:12]}.xlsx"
            book.finish(f"{self.pending}/{name}")
            files.append(name)

        for row in rows:
            names = tuple(row[name] for name in _NAMES)
            if book is not None and (names != current or book.rows >= self.limit):
                close()
                book = None
            if book is None:
                book, current = _Workbook(self.columns), names
            book.add(row[name] for name in self.columns)
        if book is not None:
            close()
        return Written(files)

    def commit(self, messages):
        store, pending = _located(self.pending)
        _, folder = _located(self.folder)
        fresh = {name for message in messages if message for name in message.files}
        for name in fresh:
            store.move(f"{pending}/{name}", f"{folder}/{name}")
        self._remove_older(store, folder, fresh)
        self._clear()

    def _remove_older(self, store, folder: str, fresh: set[str]) -> None:
        from pyarrow import fs

        replaced = {name.rsplit("_", 1)[0] for name in fresh}
        for found in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            name = found.base_name
            same_output = self.overwrite or name.rsplit("_", 1)[0] in replaced
            if name.endswith(".xlsx") and name not in fresh and same_output:
                store.delete_file(found.path)

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, pending = _located(self.pending)
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)
