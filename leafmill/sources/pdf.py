"""Text and pictures of PDF files, page by page: objects, compressed object streams, fonts' character maps and the text
operators of content streams. Scanned pages have no text; encrypted files are refused."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from leafmill.sources.element import Element
from leafmill.sources.package import PackageError

#: Bytes that a stream may inflate to: a guard against hostile files.
MAX_STREAM = 200 << 20
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_SPACE = b"\0\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%" + _SPACE
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}


class Name(str):
    """A name such as /Font, without the slash."""


class Ref(int):
    """A reference to an object by its number."""


class Operator(str):
    """A word that is no value."""


class Stream:
    def __init__(self, head: dict, raw: bytes) -> None:
        self.head, self.raw = head, raw


class _Reader:
    """Values from bytes; words that are no values come as operators."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        data = self.data
        while self.at < len(data):
            if data[self.at] in _SPACE:
                self.at += 1
            elif data[self.at] == 37:  # a comment
                ends = [k for k in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if k >= 0]
                self.at = min(ends, default=len(data))
            else:
                return

    def value(self, depth: int = 0) -> object:
        """The next value; None at the end or where nesting is beyond reason."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data) or depth > 64:
            self.at = len(data)
            return None
        two, c = data[at : at + 2], data[at : at + 1]
        if two == b"<<":
            return self._dictionary(depth)
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self._string()
        if c == b"[":
            self.at, out = at + 1, []
            while True:
                self.skip()
                if self.at >= len(data) or data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if c == b"/":
            end = self._word(at + 1)
            self.at = end
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data[at + 1 : end]).decode("latin-1"))
        end = max(self._word(at), at + 1)
        self.at, word = end, data[at:end]
        if re.fullmatch(rb"[+-]?\d+", word):
            m = re.compile(rb"\s+(\d{1,5})\s+R(?![A-Za-z0-9])").match(data, end)
            if m:
                self.at = m.end()
                return Ref(word)
            return int(word)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False}.get(word, Operator(word.decode("latin-1")))

    def _word(self, at: int) -> int:
        data = self.data
        while at < len(data) and data[at] not in _DELIMITERS:
            at += 1
        return at

    def _dictionary(self, depth: int) -> dict:
        self.at += 2
        out: dict[str, object] = {}
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                continue
            self.skip()
            if self.data[self.at : self.at + 2] != b">>":
                out[key] = self.value(depth + 1)

    def _string(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at : at + 1]
            at += 1
            if c == b"\\":
                m = re.compile(rb"[0-7]{1,3}").match(data, at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif data[at : at + 1] in (b"\r", b"\n"):
                    at += 2 if data[at : at + 2] == b"\r\n" else 1
                else:
                    out += _ESCAPES.get(data[at : at + 1], data[at : at + 1])
                    at += 1
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        self.at = at
        return bytes(out)


class Pdf:
    """A file's objects. They are found where they stand, so a damaged table of places doesn't matter; later ones override."""

    def __init__(self, content: bytes) -> None:
        if b"%PDF-" not in content[:1024]:
            raise PackageError("no PDF file")
        self.data, self.objects = content, {}
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(content)}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise PackageError("the file is encrypted")
        for number in list(self.places):
            found = self.get(Ref(number))
            if isinstance(found, Stream) and found.head.get("Type") == "ObjStm":
                self._unpack(found)

    def get(self, x: object) -> object:
        """What a reference leads to; any other value itself."""
        seen = set()
        while isinstance(x, Ref) and x not in seen:
            seen.add(x)
            if x not in self.objects:
                self.objects[x] = self._read(self.places[x]) if x in self.places else None
            x = self.objects[x]
        return None if isinstance(x, Ref) else x

    def _read(self, at: int) -> object:
        reader = _Reader(self.data, at)
        head = reader.value()
        reader.skip()
        if not isinstance(head, dict) or self.data[reader.at : reader.at + 6] != b"stream":
            return head
        begin = reader.at + 6 + (2 if self.data[reader.at + 6 : reader.at + 8] == b"\r\n" else 1)
        size = self.get(head.get("Length"))
        end = begin + size if isinstance(size, int) and size >= 0 else -1
        if end < 0 or not re.match(rb"\s*endstream", self.data[end : end + 20]):
            end = self.data.find(b"endstream", begin)
        return Stream(head, self.data[begin : end if end >= 0 else len(self.data)])

    def _unpack(self, stream: Stream) -> None:
        data, count, first = self.decoded(stream), self.get(stream.head.get("N")), self.get(stream.head.get("First"))
        if not isinstance(count, int) or not isinstance(first, int):
            return
        numbers = [int(x) for x in re.findall(rb"\d+", data[:first])][: 2 * count]
        for number, at in zip(numbers[::2], numbers[1::2]):
            if number not in self.places:
                self.objects[number] = _Reader(data, first + at).value()

    def decoded(self, stream: Stream) -> bytes:
        """A stream's content; of filters Flate and ASCII hex are known, others give nothing."""
        filters, data = self.get(stream.head.get("Filter")), stream.raw
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if name in ("FlateDecode", "Fl"):
                worker = zlib.decompressobj()
                try:
                    data = worker.decompress(data, MAX_STREAM)
                except zlib.error:
                    return b""
                if worker.unconsumed_tail:
                    raise PackageError("a stream inflates beyond reason")
            elif name in ("ASCIIHexDecode", "AHx"):
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0]).decode().ljust(2, "0"))
            else:
                return b""
        return data

    def dictionary(self, x: object) -> dict:
        found = self.get(x)
        return found.head if isinstance(found, Stream) else found if isinstance(found, dict) else {}

    def pages(self) -> list[dict]:
        """The pages in the order of the tree, each with what it inherits; without a tree in the order of their numbers."""
        roots = [self.dictionary(Ref(n)) for n in sorted({*self.places, *self.objects})]
        catalog = next((d for d in reversed(roots) if d.get("Type") == "Catalog"), {})
        out, stack, seen = [], [(catalog.get("Pages"), {})], set()
        while stack:
            ref, above = stack.pop()
            if ref is None or isinstance(ref, Ref) and ref in seen:
                continue
            seen.add(ref if isinstance(ref, Ref) else None)
            node = above | self.dictionary(ref)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, {n: node[n] for n in ("Resources",) if n in node}) for k in reversed(kids)]
            elif node:
                out.append(node)
        return out or [d for d in roots if d.get("Type") == "Page"]


def _unit(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace")


class Font:
    """How a font's codes read: by its map to characters, else as Western text."""

    def __init__(self, pdf: Pdf, font: dict) -> None:
        self.wide = pdf.get(font.get("Subtype")) == "Type0"
        self.ranges: list[tuple[int, int, str | list[str]]] = []
        self.one: dict[int, str] = {}
        found = pdf.get(font.get("ToUnicode"))
        if isinstance(found, Stream):
            self._map(pdf.decoded(found))
        encoding = pdf.dictionary(font.get("Encoding"))
        code = 0
        for x in pdf.get(encoding.get("Differences")) or []:
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                m = re.fullmatch(r"uni([0-9A-Fa-f]{4})", x)
                if m or len(x) == 1:
                    self.one.setdefault(code, chr(int(m[1], 16)) if m else str(x))
                code += 1

    def _map(self, data: bytes) -> None:
        reader, stack = _Reader(data), []
        while (x := reader.value()) is not None:
            if not isinstance(x, Operator):
                stack.append(x)
                continue
            if x == "endbfchar":
                pairs = [y for y in stack if isinstance(y, bytes)]
                self.one |= {int.from_bytes(a, "big"): _unit(b) for a, b in zip(pairs[::2], pairs[1::2])}
            elif x == "endbfrange":
                rows = [y for y in stack if isinstance(y, (bytes, list))]
                for a, b, to in zip(rows[::3], rows[1::3], rows[2::3]):
                    self.ranges.append((int.from_bytes(a, "big"), int.from_bytes(b, "big"), [_unit(t) for t in to if isinstance(t, bytes)] if isinstance(to, list) else _unit(to)))
            stack = []

    def text(self, raw: bytes) -> str:
        codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        out = []
        for code in codes:
            found = self.one.get(code)
            if found is None:
                for a, b, to in self.ranges:
                    if a <= code <= b:
                        at = code - a
                        found = (to[at] if at < len(to) else "") if isinstance(to, list) else to[:-1] + chr(ord(to[-1]) + at) if to and ord(to[-1]) + at < 0x110000 else ""
                        break
                self.one[code] = found = found if found is not None else ("�" if self.wide else bytes([code]).decode("cp1252", "replace"))
            out.append(found)
        return "".join(out)


class _Page:
    """Strings of text at their places: (x, y, size, text)."""

    def __init__(self, pdf: Pdf) -> None:
        self.pdf, self.found, self.pictures = pdf, [], []

    def draw(self, content: bytes, resources: dict, base: tuple[float, ...] = (1, 0, 0, 1, 0, 0), depth: int = 0) -> None:
        pdf, reader, stack = self.pdf, _Reader(content), []
        fonts = {k: v for k, v in pdf.dictionary(resources.get("Font")).items()}
        made: dict[str, Font] = {}
        font, size, leading, matrix, line, saved = None, 1.0, 0.0, (1, 0, 0, 1, 0, 0), (1, 0, 0, 1, 0, 0), []

        def number(k: int) -> float:
            return float(stack[k]) if len(stack) >= abs(k) and isinstance(stack[k], (int, float)) else 0.0

        def moved(x: float, y: float) -> tuple[float, ...]:
            a, b, c, d, e, f = line
            return (a, b, c, d, e + a * x + c * y, f + b * x + d * y)

        def show(parts: list[object]) -> None:
            text, gap = "", 0.0
            for p in parts:
                if isinstance(p, bytes):
                    own = font.text(p) if font else p.decode("cp1252", "replace")
                    text += (" " if gap < -180 and text and not text.endswith(" ") else "") + own
                    gap = 0.0
                elif isinstance(p, (int, float)):
                    gap += p
            if text:
                a, b, c, d, e, f = base
                x, y = matrix[4], matrix[5]
                self.found.append((a * x + c * y + e, b * x + d * y + f, abs(size * matrix[3] * d) or size, text))

        while (x := reader.value()) is not None or reader.at < len(content):
            if not isinstance(x, Operator):
                stack.append(x)
                continue
            if x == "Tf" and len(stack) > 1:
                name = str(stack[-2])
                if name in fonts and name not in made:
                    made[name] = Font(pdf, pdf.dictionary(fonts[name]))
                font, size = made.get(name), number(-1)
            elif x == "BT":
                matrix = line = (1, 0, 0, 1, 0, 0)
            elif x in ("Td", "TD"):
                leading = -number(-1) if x == "TD" else leading
                matrix = line = moved(number(-2), number(-1))
            elif x == "Tm" and len(stack) > 5:
                matrix = line = tuple(number(k) for k in range(-6, 0))
            elif x == "TL":
                leading = number(-1)
            elif x in ("T*", "'", '"'):
                matrix = line = moved(0, -leading)
                if x != "T*" and stack:
                    show(stack[-1:])
            elif x == "Tj" and stack:
                show(stack[-1:])
            elif x == "TJ" and stack and isinstance(stack[-1], list):
                show(stack[-1])
            elif x == "q":
                saved.append(base)
            elif x == "Q" and saved:
                base = saved.pop()
            elif x == "cm" and len(stack) > 5:
                a, b, c, d, e, f = (number(k) for k in range(-6, 0))
                A, B, C, D, E, G = base
                base = (a * A + b * C, a * B + b * D, c * A + d * C, c * B + d * D, e * A + f * C + E, e * B + f * D + G)
            elif x == "Do" and stack:
                form = pdf.get(pdf.dictionary(resources.get("XObject")).get(str(stack[-1])))
                if isinstance(form, Stream) and form.head.get("Subtype") == "Image":
                    self.pictures.append(str(stack[-1]))
                elif isinstance(form, Stream) and depth < 12:
                    own = pdf.dictionary(form.head.get("Resources")) or resources
                    self.draw(pdf.decoded(form), own, base, depth + 1)
            elif x == "BI":  # a picture in the stream
                end = re.compile(rb"\sEI(?=\s|$)").search(content, reader.at)
                reader.at = end.end() if end else len(content)
                self.pictures.append("inline")
            stack = []

    def lines(self) -> list[str]:
        """The text from top to bottom: strings of about one height are a line, from left to right."""
        out: list[tuple[float, float, list[tuple[float, str]]]] = []
        for x, y, size, text in sorted(self.found, key=lambda t: -t[1]):
            if out and abs(out[-1][0] - y) <= 0.4 * max(size, out[-1][1]):
                out[-1][2].append((x, text))
            else:
                out.append((y, size, [(x, text)]))
        return [" ".join(t.strip(" ") for _, t in sorted(parts, key=lambda p: p[0]) if t.strip(" ")) for _, _, parts in out]


def read_pdf(content: bytes) -> Iterator[Element]:
    """The lines of each page as paragraphs, and its pictures."""
    pdf = Pdf(content)
    for number, node in enumerate(pdf.pages()):
        page, contents = _Page(pdf), pdf.get(node.get("Contents"))
        parts = [pdf.get(x) for x in contents] if isinstance(contents, list) else [contents]
        page.draw(b"\n".join(pdf.decoded(x) for x in parts if isinstance(x, Stream)), pdf.dictionary(node.get("Resources")))
        for line in page.lines():
            if line.strip():
                yield Element("paragraph", line, section=number, part=f"page {number + 1}")
        for name in page.pictures:
            yield Element("image", "", section=number, name=name, part=f"page {number + 1}")
