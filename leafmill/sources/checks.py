"""Whether packages are whole, and whether there is anything in them to read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.sources.package import Package, PackageError
from leafmill.sources.web import read_html
from leafmill.sources.word import html_of

_MEDIA = {"docx": "word/media/", "pptx": "ppt/media/", "xlsx": "xl/media/"}
#: Parts in which text, values or drawings mean something.
_PARTS = {
    "docx": r"word/(?!theme/)(?!.*(?:settings|styles|numbering|fontTable|webSettings)\.xml$).*\.xml", "pptx": r"ppt/(?:slides|notesSlides|slideMasters|slideLayouts|charts|comments|commentAuthors).*\.xml",
    "xlsx": r"xl/(?:workbook\.xml|sharedStrings\.xml|worksheets/.*\.xml|comments.*\.xml|drawings/.*\.xml|charts/.*\.xml)",
}
_TEXT = re.compile(rb"<(?:\w+:)?(?:t|instrText)(?:\s[^>]*)?>(.*?)</(?:\w+:)?(?:t|instrText)>", re.S)
_VALUE = re.compile(rb"<(?:\w+:)?v(?:\s[^>]*)?>(.*?)</(?:\w+:)?v>", re.S)
_SHEET = re.compile(rb'<(?:\w+:)?sheet\b[^>]*\bname="([^"]+)"')
_DRAWN = {"docx": (b"<w:drawing", b"<v:imagedata"), "pptx": (b"<a:blip", b"<c:chart"), "xlsx": (b"<a:blip", b"<c:chart")}


def bad_member(content: bytes) -> str | None:
    """The first damaged member of a zip package, or what is wrong with the package; None if all is well."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.testzip()
    except Exception as e:  # whatever a hostile file makes the library raise
        return f"{type(e).__name__}: {e}"


def _visible(found: list[bytes]) -> bool:
    return any(re.sub(rb"<[^>]+>", b"", x).strip() for x in found)


def has_signal(kind: str, content: bytes, guards: dict[str, int] | None = None) -> bool:
    """Whether a package holds pictures, text, values, named sheets, drawings or imported pages. True for what can't be told.
    guards: see reader.elements()."""
    if kind not in _PARTS:
        return True
    try:
        package = Package(content, **(guards or {}))
        if any(n.startswith(_MEDIA[kind]) for n in package.parts):
            return True
        if kind == "docx" and any(t == "aFChunk" and not x and n in package and read_html(html_of(n, package.read(n)))[0] for n, t, x in package.relations("word/document.xml").values()):
            return True
        for name in package.parts:
            if not re.fullmatch(_PARTS[kind], name) and name != "docProps/core.xml":
                continue
            raw = package.read(name)
            if _visible(_TEXT.findall(raw)) or any(d in raw for d in _DRAWN[kind]) or kind == "xlsx" and _visible(_VALUE.findall(raw)):
                return True
            if name == "xl/workbook.xml" and any(not re.fullmatch(rb"(?:sheet|hoja)\d+", n.strip().lower()) for n in _SHEET.findall(raw)):
                return True
    except PackageError:
        return True
    return False


def package_checks(files: DataFrame, guards: dict[str, int] | None = None) -> DataFrame:
    """path, valid, problem and semantic_empty of packages (path, content); null content is a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            problems = [bad_member(c) if c is not None else "no content" for c in b.column(1).to_pylist()]
            empty = [not has_signal((p or "").lower().rpartition(".")[2], c or b"", guards) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p is None for p in problems]), pa.array(problems, pa.string()), pa.array(empty)], names=["path", "valid", "problem", "semantic_empty"])

    return files.select("path", "content").mapInArrow(run, "path string, valid boolean, problem string, semantic_empty boolean")
