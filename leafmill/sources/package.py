"""Zip packages of office documents: guarded parts, safe XML, relationships, format detection."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

#: Guards against hostile files, not limits of the engine: a part may have so many bytes, and so many times its compressed
#: size. Readers take others as options; parts that are read row by row (sheets) have only the second.
MAX_PART_BYTES = 100 << 20
MAX_RATIO = 100

_DOCTYPE = re.compile(rb"<!DOCTYPE[^\[>]*(\[.*?\]\s*)?>", re.S)
_ENTITY = re.compile(rb"&(?!(?:amp|lt|gt|quot|apos);|#)[^;\s<>&]{1,64};")


class PackageError(ValueError):
    """A package that can't or mustn't be read."""


def local(tag: object) -> str:
    """A tag's or attribute's name without its namespace."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def attribute(node: ElementTree.Element, name: str, default: str = "") -> str:
    """An attribute by its local name; with a namespace or without."""
    if name in node.attrib:
        return node.attrib[name]
    return next((v for k, v in node.attrib.items() if local(k) == name), default)


def children(node: ElementTree.Element | None, *names: str) -> list[ElementTree.Element]:
    return [x for x in (node if node is not None else ()) if local(x.tag) in names]


def child(node: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    """The first descendant along a path of local names."""
    for name in path:
        node = next(iter(children(node, name)), None)
    return node


def every(node: ElementTree.Element | None, *names: str) -> list[ElementTree.Element]:
    return [x for x in (node.iter() if node is not None else ()) if local(x.tag) in names]


_DOCTYPES = tuple("<!DOCTYPE".encode(k) for k in ("ascii", "utf-16-le", "utf-16-be"))


class _Tree:
    """The open elements of a part that is read in pieces; finished ones leave their parents."""

    def __init__(self) -> None:
        self.open: list[ElementTree.Element] = []

    def start(self, x: ElementTree.Element) -> None:
        self.open.append(x)

    def end(self) -> bool:
        x = self.open.pop()
        if self.open and local(self.open[-1].tag) in ("sheetData", "sst"):
            self.open[-1].remove(x)
        return True


class _Partial(ElementTree.TreeBuilder):
    """A tree that can be had before its end."""

    root: ElementTree.Element | None = None

    def start(self, tag: str, attributes: dict[str, str]) -> ElementTree.Element:
        x = super().start(tag, attributes)
        self.root = x if self.root is None else self.root
        return x

    def doctype(self, *_: object) -> None:
        raise PackageError("a document type stands where it can't be taken out")


def parse_xml(raw: bytes, name: str = "") -> ElementTree.Element:
    """The root of an XML text without document type and named entities."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raw = re.sub(r"^\s*<\?xml[^>]*\?>", "", raw.decode("utf-16", "replace")).encode()
    elif b"\0" in raw[:8]:
        raise PackageError(f"part {name} is in an encoding that isn't read")
    if b"<!DOCTYPE" in raw:
        raw = _ENTITY.sub(b"", _DOCTYPE.sub(b"", raw))
    try:
        if b"<!DOCTYPE" in raw:  # in a comment, or in a form that the pattern doesn't know
            parser = ElementTree.XMLParser(target=_Partial())
            parser.feed(raw)
            return parser.close()
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        tree = _Partial()
        try:
            ElementTree.XMLParser(target=tree).feed(raw)
        except ElementTree.ParseError:
            pass
        if tree.root is None:
            raise PackageError(f"part {name} is no XML: {e}") from e
        return tree.root


class Package:
    """A package in memory. Names with `..`, absolute ones and doubled ones are refused or ignored."""

    def __init__(self, content: bytes, max_part: int = MAX_PART_BYTES, max_ratio: int = MAX_RATIO) -> None:
        self.max_part, self.max_ratio = max_part, max_ratio
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise PackageError(f"no zip package: {e}") from e
        self.parts: dict[str, zipfile.ZipInfo] = {}
        for info in self.zip.infolist():
            name = info.filename.replace("\\", "/")
            if name.startswith("/") or ".." in name.split("/") or re.match(r"[A-Za-z]:", name):
                raise PackageError(f"part name leaves the package: {name}")
            self.parts.setdefault(name, info)

    def __contains__(self, name: str) -> bool:
        return name in self.parts

    def _checked(self, name: str, most: int) -> zipfile.ZipInfo:
        info = self.parts.get(name)
        if info is None:
            raise PackageError(f"no part {name}")
        if info.file_size > most or info.file_size > self.max_ratio * max(info.compress_size, 1) and info.file_size > 1 << 16:
            raise PackageError(f"part {name} is too large: {info.file_size} bytes of {info.compress_size}")
        return info

    def read(self, name: str) -> bytes:
        info = self._checked(name, self.max_part)
        try:
            with self.zip.open(info) as part:
                data = part.read(self.max_part + 1)
        except (zipfile.BadZipFile, RuntimeError, OSError, EOFError, zlib.error) as e:
            raise PackageError(f"part {name} is damaged: {e}") from e
        if len(data) > self.max_part:
            raise PackageError(f"part {name} is larger than it says")
        return data

    def xml(self, name: str) -> ElementTree.Element:
        """A part's root. Document types are taken out wherever they stand, so no entity is ever expanded. Of a part
        that isn't well formed the beginning counts, as far as it is."""
        return parse_xml(self.read(name), name)

    def rows(self, name: str, tags: str | tuple[str, ...]) -> Iterator[ElementTree.Element]:
        """The elements of some names in a part, one by one and in order, each emptied when the next is asked for: a part of any
        size takes the memory of one."""
        info = self._checked(name, 1 << 62)
        target, tags = _Tree(), (tags,) if isinstance(tags, str) else tags
        parser, head = ElementTree.XMLPullParser(["start", "end"]), b""
        try:
            with self.zip.open(info) as part:
                while data := part.read(1 << 16):
                    if head is not None and any(d in (head := head[-32:] + data) for d in _DOCTYPES):
                        raise PackageError(f"part {name}, which is read row by row, has a document type")
                    parser.feed(data)
                    for event, x in parser.read_events():
                        head = None  # behind the root's begin there can't be one
                        if event == "start":
                            target.start(x)
                        elif target.end() and local(x.tag) in tags:
                            yield x
                            x.clear()
        except (zipfile.BadZipFile, RuntimeError, OSError, EOFError, zlib.error, ElementTree.ParseError) as e:
            raise PackageError(f"part {name} is damaged: {e}") from e

    def maybe(self, name: str) -> ElementTree.Element | None:
        return self.xml(name) if name in self.parts else None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """By id: the target (resolved against the part unless external), the type's last word, external."""
        folder, name = posixpath.split(part)
        root = self.maybe(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for r in children(root, "Relationship"):
            target, external = attribute(r, "Target"), attribute(r, "TargetMode") == "External"
            if not external:
                target = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[attribute(r, "Id")] = (target, attribute(r, "Type").rpartition("/")[2], external)
        return out


def detect(name: str, content: bytes) -> str:
    """The format of a file: by its content where that tells, else by its name's ending; '' if unknown."""
    if content[:2] == b"PK":
        try:
            parts = Package(content).parts
        except PackageError:
            return "zip"
        for part, kind in (("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx"), ("Contents/content.hpf", "hwpx")):
            if part in parts:
                return kind
        return "hwpx" if any(p.startswith("Contents/section") for p in parts) else "zip"
    if b"%PDF-" in content[:1024]:
        return "pdf"
    ending = name.lower().rpartition(".")[2] if "." in name else ""
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return ending if ending in ("doc", "xls", "ppt", "hwp") else "cfb"
    return ending if ending in ("html", "htm", "txt", "md") else ""
