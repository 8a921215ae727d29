"""Workbooks of the BIFF8 format (xls): cells, formulas, names, links, notes, headers and footers."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from leafmill.sources.compound import Compound
from leafmill.sources.spread import render
from leafmill.sources.element import Element

_ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}
#: Days from the first day of 1900's calendar to that of 1904's.
_DAYS_1904 = 1462


def _error(code: int) -> str:
    return _ERRORS.get(code, f"#ERR{code}")


def _rk(x: int) -> float:
    value = float(struct.unpack("<i", struct.pack("<I", x & 0xFFFFFFFC))[0] >> 2) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return value / 100 if x & 1 else value


def _chars(data: bytes, at: int, count: int, wide: int) -> str:
    return data[at : at + count * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "cp1252", "replace")


def _string(data: bytes, at: int, wide_count: bool = True) -> str:
    """A BIFF8 string; rich and phonetic parts are passed over, a cut one is as long as it is."""
    count = int.from_bytes(data[at : at + (2 if wide_count else 1)], "little")
    at += 2 if wide_count else 1
    flags = data[at] if at < len(data) else 0
    return _chars(data, at + 1 + (2 if flags & 8 else 0) + (4 if flags & 4 else 0), count, flags)


class _Segments:
    """The shared strings over their continued records: each continues a string with flags of its own."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            got = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if self.at >= len(self.parts[self.k]) and n:
                self.k, self.at = self.k + 1, 0
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        rich = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        ext = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = ""
        while count and self.k < len(self.parts):
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                if self.k >= len(self.parts):
                    break
                flags, self.at = self.parts[self.k][0], 1
            width = 2 if flags & 1 else 1
            n = min(count, (len(self.parts[self.k]) - self.at) // width)
            if not n:
                break
            out += self.parts[self.k][self.at : self.at + n * width].decode("utf-16-le" if width == 2 else "latin-1", "replace")
            self.at, count = self.at + n * width, count - n
        self.take(4 * rich + ext)
        return out


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, kind, body) of each record. Where one says that it goes on behind the end of the stream, reading goes
    on at the next place that can be a record's head."""
    at = 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        end = at + 4 + size
        if end > len(data):
            end = next((k for k in range(at + 5, len(data) - 3) if data[k : k + 2] != b"\0\0" and k + 4 + int.from_bytes(data[k + 2 : k + 4], "little") <= len(data)), len(data))
        yield at, kind, data[at + 4 : end]
        at = end


# formulas -----------------------------------------------------------------------------------------

_BINARY = dict(zip(range(0x03, 0x0F), "+ - * / ^ & < <= = >= > <>".split()))
#: Functions by number: name and, for those of a fixed count, arguments.
_FUNCTIONS = dict(zip((0, 1, *range(4, 10), 27, *range(34, 40)), "COUNT IF SUM AVERAGE MIN MAX ROW COLUMN ROUND TRUE FALSE AND OR NOT MOD".split()))
_ARGUMENTS = {34: 0, 35: 0} | dict.fromkeys((27, 39), 2)
_PREFIX, _SUFFIX = {0x12: "+", 0x13: "-"}, {0x14: "%"}
#: Bytes that follow each token of a fixed size.
_SIZES = {0x24: 4, 0x25: 8, 0x2C: 4, 0x2D: 8, 0x3A: 6, 0x3B: 10, 0x23: 4, 0x22: 3, 0x21: 2, 0x1E: 2, 0x1F: 8, 0x1D: 1, 0x1C: 1, 0x19: 2}


def letters(column: int) -> str:
    """A column's letters by its number from 0."""
    out = ""
    column += 1
    while column:
        column, k = divmod(column - 1, 26)
        out = chr(65 + k) + out
    return out


def _sheet(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else "'" + name.replace("'", "''") + "'"


class Formulas:
    """Formulas as text from their tokens in reverse Polish order; what can't be told ends the text there."""

    def __init__(self, sheets: list[str], links: list[tuple[int, int]], names: list[str]) -> None:
        self.sheets, self.links, self.names = sheets, links, names

    def text(self, tokens: bytes, rows: int = 0, columns: int = 0, cell: tuple[int, int] = (0, 0)) -> str:
        """The formula of a cell that lies so many rows and columns from the one the tokens were written for; cell
        is its own place, from which references that are stored as offsets count."""
        self.cell = cell
        stack: list[str] = []
        at = 0
        while at < len(tokens):
            kind, at = tokens[at], at + 1
            if kind >= 0x40:  # the classes of a token (value, array) change nothing in the text
                kind = (kind & 0x1F) | 0x20
            size = tokens[at] * (2 if tokens[at + 1] & 1 else 1) + 2 if kind == 0x17 and at + 1 < len(tokens) else _SIZES.get(kind, 0)
            body, at = tokens[at : at + size], at + size
            if len(body) < size or not self._step(kind, body, stack, rows, columns):
                break
        return stack[-1] if stack else ""

    def _step(self, kind: int, body: bytes, stack: list[str], rows: int, columns: int) -> bool:
        if kind in _BINARY and len(stack) > 1:
            right = stack.pop()
            stack[-1] += _BINARY[kind] + right
        elif kind in _PREFIX and stack:
            stack[-1] = _PREFIX[kind] + stack[-1]
        elif kind in _SUFFIX and stack:
            stack[-1] += _SUFFIX[kind]
        elif kind == 0x15 and stack:
            stack[-1] = f"({stack[-1]})"
        elif kind in (0x24, 0x25, 0x3A, 0x3B):
            number = struct.unpack(f"<{len(body) // 2}H", body)
            prefix, number = (self._prefix(number[0]), number[1:]) if kind >= 0x3A else ("", number)
            half = len(number) // 2
            stack.append(prefix + ":".join(self._place(number[k], number[half + k], rows, columns) for k in range(half)))
        elif kind in (0x2C, 0x2D):
            number = struct.unpack(f"<{len(body) // 2}H", body)
            half = len(number) // 2
            stack.append(":".join(self._offset(number[k], number[half + k]) for k in range(half)))
        elif kind == 0x23:
            k = int.from_bytes(body[:2], "little")
            stack.append(self.names[k - 1] if 0 < k <= len(self.names) else f"Name{k}")
        elif kind in (0x21, 0x22):
            k = int.from_bytes(body[-2:], "little")
            count = min(body[0], len(stack)) if kind == 0x22 else _ARGUMENTS.get(k, 1) if k in _FUNCTIONS else len(stack) or 1
            if kind == 0x22 and not count or len(stack) < count:
                return False
            given = [stack.pop() for _ in range(count)][::-1]
            stack.append(f"{_FUNCTIONS.get(k, f'F{k}')}({','.join(given)})")
        elif kind == 0x1E:
            stack.append(str(struct.unpack("<h", body)[0]))
        elif kind == 0x1F:
            stack.append(render(struct.unpack("<d", body)[0], ""))
        elif kind == 0x17:
            stack.append('"' + _chars(body, 2, body[0], body[1]).replace('"', '""') + '"')
        elif kind == 0x1D:
            stack.append("TRUE" if body[0] else "FALSE")
        elif kind == 0x1C:
            stack.append(_error(body[0]))
        else:
            return kind == 0x19  # attributes say how to calculate
        return True

    def _prefix(self, link: int) -> str:
        first, last = self.links[link] if link < len(self.links) else (len(self.sheets), 0)
        if first >= len(self.sheets):
            return ""
        until = ":" + _sheet(self.sheets[last]) if last != first and last < len(self.sheets) else ""
        return _sheet(self.sheets[first]) + until + "!"

    def _offset(self, row: int, column: int) -> str:
        """A reference whose relative parts are offsets, which wrap at the sheet's edges."""
        own = (column & 0x8000, column & 0x4000)
        return self._place((self.cell[0] + row) & 0xFFFF if own[0] else row, column & 0xC000 | ((self.cell[1] + column) & 0xFF if own[1] else column & 0xFF), 0, 0)

    def _place(self, row: int, column: int, rows: int, columns: int) -> str:
        own = (column & 0x8000, column & 0x4000)
        row, column = row + (rows if own[0] else 0), (column & 0xFF) + (columns if own[1] else 0)
        if row < 0 or column < 0:
            return "#REF!"
        return ("" if own[1] else "$") + letters(column) + ("" if own[0] else "$") + str(row + 1)


# parts of a sheet ---------------------------------------------------------------------------------

_CODES = {"L": " ", "C": " ", "R": " ", "P": "#", "N": "#", "D": "date", "T": "time", "F": "file", "A": "sheet"}


def header_text(code: str) -> str:
    """A header's or footer's text from its codes: places and fonts go, page numbers and the like have a word."""
    found = re.sub(r'&(?:(&)|"[^"]*"|[0-9]{1,3}|([A-Z]))', lambda m: "&" if m[1] else _CODES.get(m[2] or "", " "), code)
    return re.sub(r"\s+", " ", found).strip()


_REST = r"""[^\s"'<>]+"""
_ADDRESS = re.compile("|".join(k + _REST for k in (r"(?:ftp|https?)://", "file://", "mailto:", r"www\.", r"[A-Z]:[\\/]", rf"\\\\{_REST}\\\\")), re.IGNORECASE)


def link_target(body: bytes) -> str:
    """The longest address in a link's record, whichever of the two encodings it is in."""
    found = [m[0].split("\0")[0].strip() for text in (body.decode("utf-16-le", "ignore"), body.decode("cp1252", "replace")) for m in _ADDRESS.finditer(text)]
    return max(found, key=len, default="")


class _Globals:
    def __init__(self, every: list[tuple[int, int, bytes]]) -> None:
        self.sheets: list[tuple[int, int, str]] = []
        self.strings, self.codes, self.formats, self.links, self.names, self.tokens = [], {}, [], [], [], []
        self.days = 0
        for k, (_, kind, body) in enumerate(every):
            if kind == 0x85 and len(body) > 8:
                self.sheets.append((struct.unpack_from("<I", body)[0], body[4] & 3, _string(body, 6, False)))
            elif kind == 0x41E and len(body) > 4:
                self.codes[struct.unpack_from("<H", body)[0]] = _string(body, 2)
            elif kind == 0xE0 and len(body) > 3:
                self.formats.append(struct.unpack_from("<H", body, 2)[0])
            elif kind == 0x17 and len(body) > 1:
                self.links = [struct.unpack_from("<HH", body, 4 + 6 * k) for k in range(min(int.from_bytes(body[:2], "little"), (len(body) - 2) // 6))]
            elif kind == 0x18 and len(body) > 14:
                size = body[3] * (2 if body[14] & 1 else 1)
                name, end = _chars(body, 15, body[3], body[14]), 15 + size + int.from_bytes(body[4:6], "little")
                if name and end + sum(body[10:14]) <= len(body):
                    self.names.append(name)
                    self.tokens.append(body[15 + size : end])
            elif kind == 0x22 and len(body) > 1:
                self.days = _DAYS_1904 if body[0] else 0
            elif kind == 0xFC and len(body) > 7:
                parts = [body[8:]]
                for _, more, own in every[k + 1 :]:
                    if more != 0x3C:
                        break
                    parts.append(own)
                segments = _Segments(parts)
                self.strings = [segments.string() for _ in range(struct.unpack_from("<I", body, 4)[0]) if segments.k < len(parts)]
        self.sheets = sorted({s[0]: s for s in reversed(self.sheets)}.values()) or [(0, 0, "Sheet1")]

    def shown(self, value: float, xf: int) -> str:
        code = self.codes.get(self.formats[xf], "") if xf < len(self.formats) else ""
        dated = self.days and re.search(r"(?i)yy|d/m|m/d", code)
        return render(value + self.days if dated else value, code)


class _Cells:
    """The cells of one sheet. A formula stands behind its value, then a link, then a note's author."""

    def __init__(self, book: _Globals, formulas: Formulas) -> None:
        self.book, self.formulas = book, formulas
        self.value: dict[tuple[int, int], str] = {}
        self.formula: dict[tuple[int, int], str] = {}
        self.link: dict[tuple[int, int], str] = {}
        self.note: dict[tuple[int, int], str] = {}
        self.links: list[tuple[int, int, int, int, str]] = []
        self.spans: list[tuple[int, int, int, int]] = []
        self.edges = {"header": "", "footer": ""}
        self.waiting: tuple[int, int] | None = None  # the formula whose text comes in the next record
        self.anchor: tuple[int, int] | None = None
        self.shared: dict[tuple[int, int], bytes] = {}
        self.sharing: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def take(self, kind: int, body: bytes) -> None:
        waiting, anchor, self.waiting, self.anchor = self.waiting, self.anchor, None, None
        if kind == 0x207 and waiting:
            self.value[waiting] = _string(body, 0)
        elif kind == 0x4BC and anchor:
            size = int.from_bytes(body[8:10], "little")
            self.shared[anchor] = body[10 : 10 + size] or body[11 : 11 + int.from_bytes(body[9:11], "little")]
            self.waiting = waiting
            self._share(anchor)
        elif kind in (0x14, 0x15) and len(body) > 2:
            self.edges["header" if kind == 0x14 else "footer"] = header_text(_string(body, 0))
        elif kind == 0xE5 and len(body) > 1:
            for k in range(min(int.from_bytes(body[:2], "little"), (len(body) - 2) // 8)):
                r0, r1, c0, c1 = struct.unpack_from("<HHHH", body, 2 + 8 * k)
                self.spans.append((r0, c0, r1 - r0 + 1, c1 - c0 + 1))
                self.value.setdefault((r0, c0), "")
        elif kind == 0x1B8 and len(body) > 7:
            r0, r1, c0, c1 = struct.unpack_from("<HHHH", body)
            if url := link_target(body[8:]):
                self.links.append((r0, c0, r1, c1, url))
        elif kind == 0x1C and len(body) > 10:
            if author := _chars(body, 11, int.from_bytes(body[8:10], "little"), body[10]).strip():
                self.note[struct.unpack_from("<HH", body)] = author
        elif kind in (0xFD, 0x203, 0x27E, 0x204, 0xD6, 0x205, 0x06, 0xBD, 0x02) and len(body) > 7:
            self._cell(kind, body)

    def _cell(self, kind: int, body: bytes) -> None:
        r, c, xf = struct.unpack_from("<HHH", body)
        if kind == 0xBD:
            for k in range((len(body) - 6) // 6):
                xf, rk = struct.unpack_from("<HI", body, 4 + 6 * k)
                self.value[r, c + k] = self.book.shown(_rk(rk), xf)
        elif kind in (0x204, 0xD6):
            self.value[r, c] = _string(body, 6)
        elif kind == 0x205:
            self.value[r, c] = _error(body[6]) if body[7] else ("TRUE" if body[6] else "FALSE")
        elif kind == 0x02:
            self.value[r, c] = self.book.shown(float(int.from_bytes(body[6:8], "little")), xf)
        elif kind == 0xFD and len(body) > 9:
            k = struct.unpack_from("<I", body, 6)[0]
            self.value[r, c] = self.book.strings[k] if k < len(self.book.strings) else ""
        elif kind == 0x27E and len(body) > 9:
            self.value[r, c] = self.book.shown(_rk(struct.unpack_from("<I", body, 6)[0]), xf)
        elif kind == 0x203 and len(body) > 13:
            self.value[r, c] = self.book.shown(struct.unpack_from("<d", body, 6)[0], xf)
        elif kind == 0x06 and len(body) > 13:
            self._formula((r, c), xf, body)

    def _formula(self, at: tuple[int, int], xf: int, body: bytes) -> None:
        if body[12:14] == b"\xff\xff":
            self.value[at] = {1: "TRUE" if body[8] else "FALSE", 2: _error(body[8])}.get(body[6], "")
            self.waiting = at if body[6] == 0 else None
        else:
            self.value[at] = self.book.shown(struct.unpack_from("<d", body, 6)[0], xf)
        tokens = body[22 : 22 + int.from_bytes(body[20:22], "little")]
        if len(tokens) > 4 and tokens[0] == 0x01:  # it has the formula of a shared one's first cell
            self.anchor = struct.unpack_from("<HH", tokens, 1)
            self.sharing.setdefault(self.anchor, []).append(at)
            if self.anchor in self.shared:
                self._share(self.anchor)
        elif tokens:
            self.formula[at] = self.formulas.text(tokens)

    def _share(self, anchor: tuple[int, int]) -> None:
        for at in self.sharing.pop(anchor, []):
            self.formula[at] = self.formulas.text(self.shared[anchor], at[0] - anchor[0], at[1] - anchor[1], at)

    def rows(self) -> list[list[str]]:
        """Each row as far as its last cell, so that a lone cell far out makes no grid."""
        text = dict(self.value)
        for at, formula in self.formula.items():
            if formula:
                text[at] = f"{text.get(at, '')} (={formula})".strip()
        for r0, c0, r1, c1, url in self.links:
            # a later link overrides; a range of more than the cells that there are holds but those and its corner
            inside = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)] if (r1 - r0 + 1) * (c1 - c0 + 1) <= max(1024, len(text)) else [k for k in text if r0 <= k[0] <= r1 and c0 <= k[1] <= c1] + [(r0, c0)]
            self.link.update(dict.fromkeys(inside, url))
        for at, url in self.link.items():
            text[at] = f"{text[at]} <{url}>" if text.get(at) else url
        for at, author in self.note.items():
            text[at] = f"{text.get(at, '')} [comment: {author}]".strip()
        by: dict[int, dict[int, str]] = {}
        for (r, c), x in text.items():
            by.setdefault(r, {})[c] = x
        return [[by[r].get(c, "") for c in range(max(by[r]) + 1)] if r in by else [] for r in range(max(by, default=-1) + 1)]


def read_xls(file: Compound) -> Iterator[Element]:
    """The defined names, and for each sheet its header, footer and table: hidden ones have level 1."""
    stream = "Workbook" if "Workbook" in file.streams else "Book"
    data = file.read(stream)
    every = list(records(data))
    book = _Globals(every)
    formulas = Formulas([s[2] for s in book.sheets], book.links, book.names)
    for name, tokens in zip(book.names, book.tokens):
        if target := formulas.text(tokens):
            yield Element("paragraph", f"Defined name: {name.removeprefix('_xlnm.')} = {target}", part=stream)
    for number, (offset, hidden, name) in enumerate(book.sheets):
        cells, begun = _Cells(book, formulas), False
        for where, kind, body in every:
            if where < offset:
                continue
            if kind == 0x0A and begun:
                break
            begun = True
            cells.take(kind, body)
        part = f"{stream}#{name}"
        for edge, text in cells.edges.items():
            if text:
                yield Element(edge, text, section=number, name=name, part=part)
        yield Element("table", rows=cells.rows(), section=number, name=name, level=int(hidden > 0), spans=cells.spans, part=part)
