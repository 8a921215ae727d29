"""Files of the Hangul word processor, version 5 (hwp): a compound file of tagged records."""

from __future__ import annotations

import re
import struct
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

from leafmill.sources.compound import Compound, inflate
from leafmill.sources.package import PackageError
from leafmill.sources.element import Element, Run

_BIN_DATA, _FACE_NAME, _CHAR_SHAPE, _PARA_SHAPE, _STYLE, _PROPERTIES = 18, 19, 21, 25, 26, 16
_PARA, _TEXT, _SHAPES, _CTRL, _LIST, _TABLE, _PICTURE, _EQUATION = 66, 67, 68, 71, 72, 77, 85, 88
#: Controls by the first four bytes of their record.
_CONTROLS = {b" lbt": "table", b"deqe": "equation", b" osg": "image", b"cip$": "image", b"daeh": "header", b"toof": "footer", b"  nf": "footnote", b"  ne": "endnote"}
_WIDE = set(range(32)) - {0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31}
_PLAIN = {10: "\n", 9: "\t", 24: "-", 30: " ", 31: " "}
_ALIGNMENTS = ("justify", "left", "right", "center", "distribute", "divide")


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, body) of each record; the last may be cut."""
    at = 0
    while at + 4 <= len(data):
        x = struct.unpack_from("<I", data, at)[0]
        size, at = x >> 20, at + 4
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            size, at = struct.unpack_from("<I", data, at)[0], at + 4
        yield x & 0x3FF, x >> 10 & 0x3FF, data[at : at + size]
        at += size


def _counted(data: bytes, at: int) -> tuple[str, int]:
    """A string after its length in characters, and where it ends; what doesn't fit is empty."""
    n = int.from_bytes(data[at : at + 2], "little")
    end = at + 2 + 2 * n
    return (data[at + 2 : end].decode("utf-16-le", "replace").rstrip("\0"), end) if end <= len(data) else ("", at + 2)


def text_parts(data: bytes) -> list[tuple[int, int, str | None]]:
    """Stretches of a paragraph's text by their first and last 16-bit unit: None for plain ones, else what a control
    character stands for. Extended control characters take eight units."""
    units = array("H", data[: len(data) & ~1])
    if sys.byteorder == "big":
        units.byteswap()
    out, at = [], 0
    for k in [k for k, u in enumerate(units) if u < 32]:
        if k < at:  # inside an extended one
            continue
        if k > at:
            out.append((at, k, None))
        c = units[k]
        at = k + (8 if c in _WIDE else 1)
        if c in _PLAIN:
            out.append((k, at, _PLAIN[c]))
    if at < len(units):
        out.append((at, len(units), None))
    return out


def part_text(data: bytes, parts: list[tuple[int, int, str | None]], begin: int = 0, end: int = 1 << 32) -> str:
    """The text of the stretches from one unit to another."""
    found = []
    for a, b, text in parts:
        if a < end and b > begin:
            found.append(data[2 * max(a, begin) : 2 * min(b, end)].decode("utf-16-le", "replace") if text is None else text if begin <= a else "")
    return "".join(found)


def hwp_text(data: bytes) -> str:
    """A paragraph's text."""
    return part_text(data, text_parts(data))


@dataclass
class Shape:
    """A character shape: size in points and marks (see Run)."""

    size: float = 0.0
    marks: str = ""

    @classmethod
    def of(cls, body: bytes) -> Shape:
        if len(body) < 50:
            return cls()
        size, bits = struct.unpack_from("<iI", body, 42)
        on = {"b": bits & 2, "i": bits & 1, "u": bits >> 2 & 3, "s": bits >> 18 & 7, "^": bits >> 15 & 1, "_": bits >> 16 & 1}
        return cls(size / 100, "".join(k for k, v in on.items() if v))


@dataclass
class Info:
    """What the DocInfo stream says: sections, fonts, shapes of characters and paragraphs, styles and stored files."""

    sections: int = 0
    fonts: list[str] = field(default_factory=list)
    shapes: list[Shape] = field(default_factory=list)
    #: Alignment, left and right margin, indent.
    paragraphs: list[tuple[str, int, int, int]] = field(default_factory=list)
    #: Name, kind, next style, paragraph and character shape.
    styles: list[tuple[str, int, int, int, int]] = field(default_factory=list)
    #: Path of a linked file, or (number, ending) of a stored one.
    files: list[str | tuple[int, str]] = field(default_factory=list)

    @classmethod
    def of(cls, data: bytes) -> Info:
        out = cls()
        for tag, _, body in records(data):
            if tag == _PROPERTIES:
                out.sections = int.from_bytes(body[:2], "little")
            elif tag == _FACE_NAME:
                out.fonts.append(_counted(body, 1)[0])
            elif tag == _CHAR_SHAPE:
                out.shapes.append(Shape.of(body))
            elif tag == _PARA_SHAPE:
                whole = body[:16].ljust(16, b"\0")
                bits, left, right, indent = struct.unpack("<Iiii", whole)
                out.paragraphs.append((_ALIGNMENTS[min(bits & 7, 5)], left, right, indent))
            elif tag == _STYLE:
                name, at = _counted(body, 0)
                at += 2 + 2 * int.from_bytes(body[at : at + 2], "little")  # the name in English
                kind, after, _, para, char = struct.unpack("<BBhHH", body[at : at + 8].ljust(8, b"\xff"))
                out.styles.append((name, kind & 7, after, para, char))
            elif tag == _BIN_DATA:
                kind = int.from_bytes(body[:2], "little") & 15
                if kind == 1:
                    out.files.append((int.from_bytes(body[2:4], "little"), _counted(body, 4)[0]))
                else:
                    path, at = _counted(body, 2)
                    out.files.append(path or _counted(body, at)[0])
        return out

    def heading(self, style: int, runs: list[Run]) -> int:
        """The level by the style's name, else by the first run's size."""
        name = self.styles[style][0].lower() if 0 <= style < len(self.styles) else ""
        if any(k in name for k in ("개요", "outline", "heading")):
            return next((k for k in range(1, 7) if str(k) in name), 1)
        if "제목" in name or "title" in name:
            return 1
        return heading_by_size(runs)


def heading_by_size(runs: list[Run]) -> int:
    """3 from 13 points, 2 from 16, 1 from 20; the first run counts."""
    size = runs[0][2] if runs else 0
    return 1 if size >= 20 else 2 if size >= 16 else 3 if size >= 13 else 0


@dataclass
class _Node:
    tag: int
    body: bytes
    children: list[_Node] = field(default_factory=list)

    def of(self, tag: int) -> list[_Node]:
        return [x for x in self.children if x.tag == tag]

    def below(self, tag: int) -> _Node | None:
        todo = list(self.children)
        while todo:
            x = todo.pop(0)
            if x.tag == tag:
                return x
            todo += x.children
        return None


def tree(found: Iterator[tuple[int, int, bytes]]) -> list[_Node]:
    """The records by their levels. Those behind a list's head on its own level are in that list, up to the next
    head on that level or a record above."""
    root = _Node(-1, b"")
    stack: list[tuple[int, _Node]] = [(-1, root)]
    lists: list[int] = []
    for tag, level, body in found:
        while lists and (level < lists[-1] or level == lists[-1] and tag == _LIST):
            lists.pop()
        deep = level + len(lists)
        while stack[-1][0] >= deep:
            stack.pop()
        node = _Node(tag, body)
        stack[-1][1].children.append(node)
        stack.append((deep, node))
        if tag == _LIST:
            lists.append(level)
    return root.children


def shape_starts(body: bytes) -> list[tuple[int, int]]:
    """(place, shape) of the stretches of a paragraph: pairs of 32-bit numbers, in some files of 32 and 16 bits."""
    wide = [struct.unpack_from("<II", body, k) for k in range(0, len(body) - 7, 8)]
    ordered = lambda x: all(a[0] < b[0] for a, b in zip(x, x[1:])) and (not x or x[0][0] == 0)
    if len(body) % 8 == 0 and ordered(wide):
        return wide
    return [struct.unpack_from("<IH", body, k) for k in range(0, len(body) - 5, 6)]


class _Section:
    def __init__(self, info: Info, number: int, part: str) -> None:
        self.info, self.number, self.part = info, number, part

    def element(self, kind: str, **more: object) -> Element:
        return Element(kind, section=self.number, part=self.part, **more)

    def paragraph(self, node: _Node) -> Iterator[Element]:
        text = node.of(_TEXT)
        if text:
            body = text[-1].body
            parts = text_parts(body)
            whole = part_text(body, parts)
            if whole.strip():
                runs = self.runs(body, parts, node.of(_SHAPES))
                level = self.info.heading(node.body[10] if len(node.body) > 10 else -1, runs)
                yield self.element("heading" if level else "paragraph", text=whole.strip(), level=level, runs=runs)
        for ctrl in node.of(_CTRL):
            yield from self.control(ctrl)

    def runs(self, body: bytes, parts: list[tuple[int, int, str | None]], shapes: list[_Node]) -> list[Run]:
        starts = shape_starts(shapes[-1].body) if shapes else []
        out = []
        for n, (begin, shape) in enumerate(starts or [(0, -1)]):
            text = part_text(body, parts, begin, starts[n + 1][0] if n + 1 < len(starts) else 1 << 32)
            own = self.info.shapes[shape] if 0 <= shape < len(self.info.shapes) else Shape()
            if text:
                out.append((text, own.marks, own.size))
        return out

    def control(self, ctrl: _Node) -> Iterator[Element]:
        kind = _CONTROLS.get(ctrl.body[:4])
        if kind == "table":
            yield self.table(ctrl)
        elif kind == "equation":
            found = ctrl.below(_EQUATION)
            if found is not None:
                script, end = _counted(found.body, 4)
                yield self.element("equation", text=script)
        elif kind == "image":
            found = ctrl.below(_PICTURE)
            if found is not None:
                number = int.from_bytes(found.body[71:73], "little") if len(found.body) > 72 else -1
                name, part = self.stored(number)
                picture = self.element("image", text="", name=name)
                picture.part = part
                yield picture
        elif kind:
            inside = [e.text for lst in ctrl.of(_LIST) for p in lst.of(_PARA) for e in self.paragraph(p) if e.kind in ("paragraph", "heading")]
            yield self.element("note" if kind.endswith("note") else kind, text="\n".join(inside), name=kind)

    def stored(self, number: int) -> tuple[str, str]:
        """Name and stream of the picture that has a number in the list of files."""
        entry = self.info.files[number] if 0 <= number < len(self.info.files) else None
        if isinstance(entry, tuple):
            name = f"BIN{entry[0]:04X}" + (f".{entry[1].lower()}" if entry[1] else "")
            return name, f"BinData/{name}"
        return (entry.replace("\\", "/").rpartition("/")[2], entry) if entry else (f"image_{number}.bin", "")

    def table(self, ctrl: _Node) -> Element:
        head = next(iter(ctrl.of(_TABLE)), None)
        high, wide = struct.unpack_from("<HH", head.body, 4) if head is not None and len(head.body) >= 8 else (0, 0)
        cells = []
        for node in ctrl.of(_LIST):
            c, r, cs, rs = struct.unpack_from("<HHHH", node.body, 8) if len(node.body) >= 16 else (0, 0, 1, 1)
            text = []
            for p in node.of(_PARA):
                for e in self.paragraph(p):
                    text += [x for row in e.rows for x in row if x] if e.rows is not None else [e.text] if e.kind in ("paragraph", "heading") else []
            cells.append((r, c, max(rs, 1), max(cs, 1), "\n".join(text)))
        inside = [x for x in cells if x[0] < high and x[1] < wide]
        if len(inside) < len(cells) / 2 or not (high and wide):  # without places the cells come in order
            wide = wide or max(1, len(cells))
            inside = [(k // wide, k % wide, 1, 1, x[4]) for k, x in enumerate(cells)]
        by: dict[int, dict[int, str]] = {}
        for r, c, _, _, text in inside:
            by.setdefault(r, {})[c] = text
        rows = [[by[r].get(c, "") for c in range(wide)] if r in by else [""] * min(wide, 1) for r in range(max([high - 1, *by], default=-1) + 1)]
        return self.element("table", rows=rows, spans=[x[:4] for x in inside if x[2] > 1 or x[3] > 1])


def opened(file: Compound) -> int:
    """The flags of a file that can be read: bit 0 packed, bit 2 for distribution."""
    head = file.read("FileHeader")
    if not head.startswith(b"HWP Document File"):
        raise PackageError("no HWP signature")
    version, flags = struct.unpack_from("<II", head, 32) if len(head) >= 40 else (0x05000000, 0)
    if version >> 24 != 5:
        raise PackageError(f"version {version >> 24} isn't known")
    if flags & 2 or flags & 16:
        raise PackageError("the file is encrypted")
    return flags


def info_of(file: Compound) -> Info:
    flags = opened(file)
    if "DocInfo" not in file.streams:
        return Info()
    data = file.read("DocInfo")
    return Info.of(inflate(data) if flags & 1 else data)


def read_hwp(file: Compound) -> Iterator[Element]:
    """Paragraphs, headings, tables, equations, pictures, headers, footers and notes of all sections."""
    flags, info = opened(file), info_of(file)
    body = "ViewText" if flags & 4 else "BodyText"
    numbers = sorted(int(m[1]) for n in file.streams if (m := re.fullmatch(rf"{body}/Section([0-9]+)", n)))
    for section in numbers:
        name = f"{body}/Section{section}"
        data = file.read(name)
        own = _Section(info, section, name)
        for node in tree(records(inflate(data) if flags & 1 else data)):
            if node.tag == _PARA:
                yield from own.paragraph(node)


def files_of(file: Compound) -> Iterator[tuple[str, bytes]]:
    """(stream, content) of the stored files; one that isn't packed, though the file says so, comes as it is."""
    flags = opened(file)
    for name in sorted(n for n in file.streams if n.startswith("BinData/")):
        data = file.read(name)
        if flags & 1:
            try:
                data = inflate(data)
            except PackageError:
                pass
        yield name, data
