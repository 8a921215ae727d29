"""Documents of every format as rows: a function over bytes, a DataFrame function and a data source."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from leafmill.sources.biff import read_xls
from leafmill.sources.compound import Compound
from leafmill.sources.hwp import files_of, read_hwp
from leafmill.sources.hwpx import read_hwpx
from leafmill.sources.legacy import read_doc, read_ppt
from leafmill.sources.package import Package, PackageError, detect
from leafmill.sources.pdf import read_pdf
from leafmill.sources.slides import read_pptx
from leafmill.sources.spread import read_xlsx
from leafmill.sources.web import read_html
from leafmill.sources.element import Element
from leafmill.sources.word import read_docx

ELEMENTS = "path string, format string, element int, section int, name string, kind string, level int, text string, rows array<array<string>>, spans array<struct<r:int,c:int,row_span:int,col_span:int>>, runs array<struct<text:string,marks:string,size:double>>, part string, error string"
_ARROW = pa.schema([
    ("path", pa.string()), ("format", pa.string()), ("element", pa.int32()), ("section", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()),
    ("rows", pa.list_(pa.list_(pa.string()))), ("spans", pa.list_(pa.struct([("r", pa.int32()), ("c", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32())]))),
    ("runs", pa.list_(pa.struct([("text", pa.string()), ("marks", pa.string()), ("size", pa.float64())]))), ("part", pa.string()), ("error", pa.string()),
])


def elements(path: str, content: bytes, guards: dict[str, int] | None = None) -> tuple[str, list[Element]]:
    """The format and the elements of a file. guards: other max_part and max_ratio than package.py has, for large files that are trusted."""
    kind = detect(path, content)
    if kind in ("docx", "xlsx", "pptx", "hwpx"):
        return kind, list({"docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx, "hwpx": read_hwpx}[kind](Package(content, **(guards or {}))))
    if kind in ("doc", "xls", "ppt", "hwp", "cfb"):
        file = Compound(content)
        if kind == "cfb":
            kind = next((k for s, k in (("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt"), ("FileHeader", "hwp")) if s in file.streams), "cfb")
        if kind != "cfb":
            return kind, list({"doc": read_doc, "xls": read_xls, "ppt": read_ppt, "hwp": read_hwp}[kind](file))
    if kind == "pdf":
        return kind, list(read_pdf(content))
    if kind in ("html", "htm"):
        return "html", read_html(content.decode("utf-8", "replace"))[0]
    raise PackageError("the format isn't known")


def rows_of(path: str, content: bytes | None, fail: bool = False, guards: dict[str, int] | None = None) -> Iterator[tuple]:
    """Rows of ELEMENTS. A file that can't be read has one row with its error, or raises if `fail`."""
    try:
        if content is None:
            raise PackageError("no content")
        kind, found = elements(path or "", content, guards)
        for k, e in enumerate(found):
            yield path, kind, k, e.section, e.name, e.kind, e.level, e.text if e.rows is None else None, e.rows, e.spans, e.runs, e.part or None, None
    except Exception as e:
        if fail:
            raise
        yield path, detect(path or "", content or b""), *[None] * 10, f"{type(e).__name__}: {e}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    for k in (9, 10):  # lists of structs, from their flat fields
        lists = [x or () for x in columns[k]]
        kind = _ARROW.field(k).type
        fields = list(zip(*(s for x in lists for s in x))) or [()] * kind.value_type.num_fields
        flat = pa.StructArray.from_arrays([pa.array(f, kind.value_type.field(j).type) for j, f in enumerate(fields)], fields=list(kind.value_type))
        upto = list(accumulate(map(len, lists), initial=0))
        columns[k] = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat, mask=pa.array([x is None for x in columns[k]], pa.bool_()))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _ARROW.field(k).type) for k, c in enumerate(columns)], schema=_ARROW)


#: What a batch of elements holds, by _weight().
_MOST = 2000


def _weight(row: tuple) -> int:
    """1 for a short element, more for a long text, many runs or a large table."""
    return 1 + len(row[7] or "") // 256 + len(row[10] or ()) // 8 + sum(map(len, row[8] or ())) // 8


def in_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ELEMENTS in batches of bounded size."""
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += _weight(row)
        if held >= _MOST:
            yield _batch(kept)
            kept, held = [], 0
    yield _batch(kept)


def batches_of(files: Iterable[tuple[str, bytes | None]], fail: bool = False, guards: dict[str, int] | None = None) -> Iterator[pa.RecordBatch]:
    """The elements of files (path, content) in batches of bounded size; a file is asked for when those before are read."""
    return in_batches(row for p, c in files for row in rows_of(p, c, fail, guards))


def parse_files(files: DataFrame, path: str = "path", content: str = "content", fail: bool = False, guards: dict[str, int] | None = None) -> DataFrame:
    """The elements of files (path, content), such as spark.read.format("binaryFile") gives them. Contents
    are never shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from batches_of(((p.as_py(), c.as_py()) for p, c in zip(b.column(0), b.column(1))), fail, guards)

    return files.select(path, content).mapInArrow(run, ELEMENTS)


_ITEM = "struct<element:int,section:int,name:string,kind:string,level:int,text:string,rows:array<array<string>>,spans:array<struct<r:int,c:int,row_span:int,col_span:int>>,runs:array<struct<text:string,marks:string,size:double>>,part:string>"
GATHERED = f"path string, format string, items array<{_ITEM}>, error string"


def gather_files(files: DataFrame, path: str = "path", content: str = "content", fail: bool = False, guards: dict[str, int] | None = None) -> DataFrame:
    """(path, format, items, error): a row for each file with its elements in order, from the task that reads it. Nothing is
    shuffled; what render makes of it stays in that task."""
    names = [f.name for f in _ARROW if f.name not in ("path", "format", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0), b.column(1)):
                made = _batch(list(rows_of(p.as_py(), c.as_py(), fail, guards)))
                good = made.filter(pa.compute.is_valid(made.column("element")))
                items = pa.StructArray.from_arrays([good.column(n) for n in names], names=names)
                error = made.column("error")[-1] if made.num_rows else pa.scalar(None, pa.string())
                kind = made.column("format")[0].as_py() if made.num_rows else elements(p.as_py() or "", c.as_py(), guards)[0]
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()], pa.string()), pa.array([kind], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items), pa.array([error.as_py()], pa.string())], names=["path", "format", "items", "error"])

    return files.select(path, content).mapInArrow(run, GATHERED)


def gathered_files(spark: SparkSession, folder: str, pattern: str = "*", fail: bool = False, guards: dict[str, int] | None = None) -> DataFrame:
    """gather_files() of all files below a folder."""
    return gather_files(_binary(spark, folder, pattern), fail=fail, guards=guards)


ASSETS = "path string, part string, filename string, content_type string, length bigint"
_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "wmf": "image/x-wmf", "emf": "image/x-emf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "bin": "application/vnd.openxmlformats-officedocument.oleObject"}


def assets_of(content: bytes | None) -> list[tuple[str, str, str, int]]:
    """(part, filename, content type, bytes) of the pictures and embedded files of a package; none of what is no package."""
    try:
        if (content or b"")[:4] == b"\xd0\xcf\x11\xe0":
            stored = list(files_of(Compound(content)))
            return [(n, n.rpartition("/")[2], _TYPES.get(n.lower().rpartition(".")[2], "application/octet-stream"), len(x)) for n, x in stored]
        parts = Package(content or b"").parts
    except PackageError:
        return []
    inside = [n for n in sorted(parts) if any(f"/{f}/" in f"/{n}" for f in ("media", "embeddings", "BinData")) and not n.endswith("/")]
    return [(n, n.rpartition("/")[2], _TYPES.get(n.lower().rpartition(".")[2], "application/octet-stream"), parts[n].file_size) for n in inside]


def parse_assets(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The pictures and embedded files of files (path, content), without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p.as_py(), *x) for p, c in zip(b.column(0), b.column(1)) for x in assets_of(c.as_py())]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 4 else pa.int64()) for k, c in enumerate(columns)], names=["path", "part", "filename", "content_type", "length"])

    return files.select(path, content).mapInArrow(run, ASSETS)


def _binary(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def read_files(spark: SparkSession, folder: str, pattern: str = "*", fail: bool = False, guards: dict[str, int] | None = None) -> DataFrame:
    """The elements of all files below a folder, on any file system that Spark reads."""
    return parse_files(_binary(spark, folder, pattern), fail=fail, guards=guards)


class OfficeSource(DataSource):
    """spark.read.format("office").load(folder) on a local or mounted file system; option mode is
    PERMISSIVE (default, errors are rows) or FAILFAST; maxPartBytes and maxRatio are the guards. One task reads about 32 MB of files."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return ELEMENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _OfficeReader(self.options)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)


class _OfficeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.fail = options.get("path", "."), options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.most = int(options.get("maxPartitionBytes", 32 << 20))
        self.guards = {k: int(options[o]) for k, o in (("max_part", "maxPartBytes"), ("max_ratio", "maxRatio")) if o in options}

    def partitions(self) -> list[InputPartition]:
        root = os.path.realpath(self.folder)
        found = [root] if os.path.isfile(root) else [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if not f.startswith((".", "_"))]
        inside = sorted(p for p in found if p == root or os.path.realpath(p).startswith(root + os.sep))  # no link leads out of the folder
        out, size = [[]], 0
        for p in inside:
            if size > self.most:
                out, size = [*out, []], 0
            out[-1].append(p)
            size += os.path.getsize(p) + (4 << 10)
        return [_Files(p) for p in out if p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            with open(path, "rb") as f:
                for row in rows_of(path, f.read(), self.fail, self.guards):
                    yield (*row[:9], *(None if x is None else [tuple(s) for s in x] for x in row[9:11]), *row[11:])


def register(spark: SparkSession) -> None:
    """Makes the format "office" known to the session."""
    spark.dataSource.register(OfficeSource)


