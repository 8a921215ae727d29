"""Small office files, written from rows: sinks, and what the readers are tried on."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict[str, str | bytes]) -> bytes:
    """A zip package of parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>')
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def relations(*items: tuple[str, str, str] | tuple[str, str, str, str]) -> str:
    """A relationships part of (id, type, target[, mode])."""
    rows = "".join(f'<Relationship Id="{i[0]}" Type="{_REL}/{i[1]}" Target={quoteattr(i[2])}{f" TargetMode={quoteattr(i[3])}" if len(i) > 3 else ""}/>' for i in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def word_paragraph(text: str, style: str = "", inner: str = "") -> str:
    p = f'<w:pPr>{f"<w:pStyle w:val={quoteattr(style)}/>" if style else ""}{inner}</w:pPr>'
    return f'<w:p>{p}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def word_table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{word_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(blocks: list[tuple[str, object]], parts: dict[str, str] | None = None) -> bytes:
    """A docx of (kind, text or rows): heading, paragraph, table, or xml."""
    make = {"heading": lambda x: word_paragraph(x, "Heading1"), "paragraph": word_paragraph, "table": word_table, "xml": str}
    body = "".join(make[k](x) for k, x in blocks)
    styles = f'<w:styles {_W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Sub"><w:name w:val="my own"/><w:basedOn w:val="Heading1"/></w:style></w:styles>'
    return package({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles} | (parts or {}))


def xlsx(sheets: list[tuple[str, list[list[object]]]], formats: list[str] = (), extra: dict[str, str] | None = None, tails: list[str] = ()) -> bytes:
    """An xlsx of (name, rows). Texts are shared strings, numbers plain; (number, k) is shown in formats[k]."""
    strings: dict[str, int] = {}
    parts, links, names = {}, [], ""
    for k, (name, rows) in enumerate(sheets, 1):
        body = ""
        for r, row in enumerate(rows, 1):
            cells = ""
            for c, v in enumerate(row):
                ref = f"{_letters(c + 1)}{r}"
                style = 0
                if isinstance(v, tuple):
                    v, style = v[0], v[1] + 1
                if v is None or v == "":
                    continue
                if isinstance(v, bool):
                    cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, (int, float)):
                    cells += f'<c r="{ref}" s="{style}"><v>{v!r}</v></c>'
                else:
                    cells += f'<c r="{ref}" t="s"><v>{strings.setdefault(str(v), len(strings))}</v></c>'
            body += f'<row r="{r}">{cells}</row>'
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {_S}><sheetData>{body}</sheetData>{tails[k - 1] if k <= len(tails) else ''}</worksheet>"
        links.append((f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml"))
        names += f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>'
    parts["xl/workbook.xml"] = f"<workbook {_S}><sheets>{names}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = relations(*links)
    parts["xl/sharedStrings.xml"] = f"<sst {_S}>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>"
    codes = "".join(f'<numFmt numFmtId="{164 + k}" formatCode={quoteattr(f)}/>' for k, f in enumerate(formats))
    xfs = '<xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{164 + k}"/>' for k in range(len(formats)))
    parts["xl/styles.xml"] = f"<styleSheet {_S}><numFmts>{codes}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>"
    return package(parts | (extra or {}))


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def slide_shape(lines: list[str], x: int = 0, y: int = 0, title: bool = False) -> str:
    text = "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in lines)
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="s"/><p:nvPr>{"<p:ph type=%s/>" % quoteattr("title") if title else ""}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody>{text}</p:txBody></p:sp>'


def pptx(slides: list[str], extra: dict[str, str] | None = None) -> bytes:
    """A pptx of slides, each the XML of its shapes."""
    parts, links, ids = {}, [], ""
    for k, shapes in enumerate(slides, 1):
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {_P}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        links.append((f"rId{k}", "slide", f"slides/slide{k}.xml"))
        ids += f'<p:sldId id="{255 + k}" r:id="rId{k}"/>'
    parts["ppt/presentation.xml"] = f"<p:presentation {_P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = relations(*links)
    return package(parts | (extra or {}))


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams (folders joined by /), each padded to the size that keeps it out of the mini stream."""
    entries: list[list] = [["Root Entry", 5, -1, -1, -1, b""]]
    places = {"": 0}
    for path, data in streams.items():
        folder = ""
        for name in path.split("/")[:-1]:
            full = f"{folder}/{name}".strip("/")
            if full not in places:
                places[full] = _hang(entries, places[folder], [name, 1, -1, -1, -1, b""])
            folder = full
        _hang(entries, places[folder], [path.split("/")[-1], 2, -1, -1, -1, data.ljust(4096, b"\0")])
    sectors, fat = [], []

    def put(data: bytes) -> int:
        begin, count = len(sectors), -(-len(data) // 512)
        for k in range(count):
            sectors.append(data[512 * k : 512 * k + 512].ljust(512, b"\0"))
            fat.append(begin + k + 1 if k + 1 < count else 0xFFFFFFFE)
        return begin

    starts = [put(e[5]) if e[1] == 2 else 0xFFFFFFFE if e[1] == 5 else 0 for e in entries]
    raw = b""
    for e, start in zip(entries, starts):
        name = e[0].encode("utf-16-le")
        raw += name.ljust(64, b"\0") + struct.pack("<HBB", len(name) + 2, e[1], 1) + struct.pack("<iii", e[2], e[3], e[4]) + bytes(36) + struct.pack("<IQ", start, len(e[5]))
    raw = raw.ljust(-(-len(raw) // 512) * 512, b"\0")
    directory = put(raw)
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("too large for the header's list of tables")
    first = len(sectors)
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * 512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    difat = struct.pack("<109I", *[*range(first, first + n_fat), *[0xFFFFFFFF] * (109 - n_fat)])
    return head + difat + b"".join(sectors) + table


def _hang(entries: list[list], folder: int, entry: list) -> int:
    entries.append(entry)
    k, at = len(entries) - 1, entries[folder][4]
    if at < 0:
        entries[folder][4] = k
    else:
        while entries[at][3] >= 0:
            at = entries[at][3]
        entries[at][3] = k
    return k


def _biff(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _biff_string(text: str, wide: bool = True) -> bytes:
    return struct.pack("<HB" if wide else "<BB", len(text.encode("utf-16-le")) // 2, 1) + text.encode("utf-16-le")


def tokens(*parts: object) -> bytes:
    """A formula's tokens in reverse Polish order: (row, column) a relative reference, (r0, c0, r1, c1) a range, a number, text
    in quotes by a str, a bool, and bytes as they are."""
    out = b""
    for x in parts:
        if isinstance(x, bytes):
            out += x
        elif isinstance(x, bool):
            out += bytes([0x1D, x])
        elif isinstance(x, int):
            out += struct.pack("<Bh", 0x1E, x)
        elif isinstance(x, float):
            out += struct.pack("<Bd", 0x1F, x)
        elif isinstance(x, str):
            out += bytes([0x17, len(x), 0]) + x.encode("cp1252")
        elif len(x) == 2:
            out += struct.pack("<BHH", 0x24, x[0], x[1] | 0xC000)
        else:
            out += struct.pack("<BHHHH", 0x25, x[0], x[2], x[1] | 0xC000, x[3] | 0xC000)
    return out


def xls_formula(r: int, c: int, formula: bytes, value: float = 0.0) -> bytes:
    return _biff(0x06, struct.pack("<HHHdHIH", r, c, 0, value, 0, 0, len(formula)) + formula)


def xls_link(r0: int, c0: int, r1: int, c1: int, url: str) -> bytes:
    return _biff(0x1B8, struct.pack("<HHHH", r0, r1, c0, c1) + bytes(24) + url.encode("utf-16-le") + b"\0\0")


def xls_note(r: int, c: int, author: str) -> bytes:
    return _biff(0x1C, struct.pack("<HHHHHB", r, c, 0, 1, len(author), 1) + author.encode("utf-16-le"))


def xls_merge(*ranges: tuple[int, int, int, int]) -> bytes:
    """Ranges of first and last row, first and last column."""
    return _biff(0xE5, struct.pack("<H", len(ranges)) + b"".join(struct.pack("<HHHH", *x) for x in ranges))


def xls_edge(text: str, footer: bool = False) -> bytes:
    return _biff(0x15 if footer else 0x14, _biff_string(text))


def xls_name(name: str, formula: bytes) -> bytes:
    return _biff(0x18, struct.pack("<HBBHHH", 0, 0, len(name), len(formula), 0, 0) + bytes(4) + b"\0" + name.encode("cp1252") + formula)


def xls_sheet_links(*pairs: tuple[int, int]) -> bytes:
    return _biff(0x17, struct.pack("<H", len(pairs)) + b"".join(struct.pack("<HHH", 0, *x) for x in pairs))


def xls(sheets: list[tuple[str, list[list[object]]]], formats: list[str] = (), tails: list[bytes] = (), globals_: bytes = b"", days_1904: bool = False) -> bytes:
    """A BIFF8 workbook of (name, rows), as xlsx(); tails are records at the end of each sheet, globals_ those of the book."""
    strings: dict[str, int] = {}
    bodies = []
    for number, (_, rows) in enumerate(sheets):
        out = [_biff(0x809, struct.pack("<HH", 0x600, 0x10) + bytes(12))]
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                style = 0
                if isinstance(v, tuple):
                    v, style = v[0], v[1] + 1
                if v is None or v == "":
                    continue
                place = struct.pack("<HHH", r, c, style)
                if isinstance(v, bool):
                    out.append(_biff(0x205, place + bytes([v, 0])))
                elif isinstance(v, (int, float)):
                    out.append(_biff(0x203, place + struct.pack("<d", v)))
                else:
                    out.append(_biff(0xFD, place + struct.pack("<I", strings.setdefault(str(v), len(strings)))))
        bodies.append(b"".join([*out, tails[number] if number < len(tails) else b"", _biff(0x0A, b"")]))
    parts, now = [], struct.pack("<II", len(strings), len(strings))
    for s in strings:
        one = _biff_string(s)
        if len(now) + len(one) > 8000:
            parts, now = [*parts, now], b""
        now += one
    shared = b"".join(_biff(0xFC if k == 0 else 0x3C, p) for k, p in enumerate([*parts, now]))
    head = _biff(0x809, struct.pack("<HH", 0x600, 5) + bytes(12)) + b"".join(_biff(0x41E, struct.pack("<H", 164 + k) + _biff_string(f)) for k, f in enumerate(formats))
    head += globals_ + (_biff(0x22, b"\1\0") if days_1904 else b"")
    head += b"".join(_biff(0xE0, struct.pack("<HH", 0, f) + bytes(16)) for f in (0, *range(164, 164 + len(formats))))
    bounds = lambda at: b"".join(_biff(0x85, struct.pack("<IBB", a, 0, 0) + _biff_string(n, False)) for a, (n, _) in zip(at, sheets))
    begin = len(head) + len(bounds([0] * len(sheets))) + len(shared) + 4
    places = [begin + sum(map(len, bodies[:k])) for k in range(len(bodies))]
    return compound({"Workbook": head + bounds(places) + shared + _biff(0x0A, b"") + b"".join(bodies)})


def doc(text: str) -> bytes:
    """A doc file whose text is one piece of UTF-16."""
    raw = text.replace("\n", "\r").encode("utf-16-le")
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(raw) // 2) + struct.pack("<HIH", 0, 0x400, 0)
    main = bytearray(0x400)
    struct.pack_into("<HH", main, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", main, 10, 0x0200)
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(main) + raw, "1Table": clx})


def ppt(slides: list[tuple[str, list[str]]]) -> bytes:
    """A ppt file of (title, lines)."""
    atom = lambda kind, body, options=0: struct.pack("<HHI", options, kind, len(body)) + body
    out = []
    for title, lines in slides:
        inner = atom(3999, struct.pack("<I", 0)) + atom(4000, title.encode("utf-16-le")) + atom(3999, struct.pack("<I", 1)) + atom(4000, "\r".join(lines).encode("utf-16-le"))
        out.append(atom(1006, inner, 15))
    return compound({"PowerPoint Document": b"".join(out)})


def _hwp_record(tag: int, level: int, body: bytes) -> bytes:
    size = min(len(body), 0xFFF)
    return struct.pack("<I", tag | level << 10 | size << 20) + (struct.pack("<I", len(body)) if size == 0xFFF else b"") + body


def _wide(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    return struct.pack("<H", len(raw) // 2) + raw


def hwp_paragraph(runs: str | list[tuple[str, int]], level: int = 0, style: int = 0, controls: bytes = b"") -> bytes:
    """A paragraph's records: text, or (text, shape) of each run; controls come below it."""
    runs = [(runs, 0)] if isinstance(runs, str) else runs
    text, at, places = "", 0, b""
    for part, shape in runs:
        places += struct.pack("<II", at, shape)
        text, at = text + part, at + len(part.encode("utf-16-le")) // 2
    own = _hwp_record(66, level, struct.pack("<IIHBB", at + 1, 0, 0, style, 0) + bytes(10))
    return own + _hwp_record(67, level + 1, (text + "\r").encode("utf-16-le")) + _hwp_record(68, level + 1, places) + controls


def hwp_table(rows: list[list[str]], spans: dict[tuple[int, int], tuple[int, int]] | None = None, level: int = 1) -> bytes:
    """A table's records; cells that a span of another covers are left out."""
    spans = spans or {}
    covered = {(r + y, c + x) for (r, c), (high, wide) in spans.items() for y in range(high) for x in range(wide) if x or y}
    out = [_hwp_record(71, level, b" lbt" + bytes(40)), _hwp_record(77, level + 1, struct.pack("<IHH", 0, len(rows), max(map(len, rows))) + bytes(10))]
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            if (r, c) not in covered:
                high, wide = spans.get((r, c), (1, 1))
                out.append(_hwp_record(72, level + 1, struct.pack("<IIHHHH", 1, 0, c, r, wide, high) + bytes(18)) + hwp_paragraph(text, level + 1))
    return b"".join(out)


def hwp_control(kind: bytes, level: int = 1, paragraphs: list[str] = (), record: bytes = b"") -> bytes:
    """A control's records with paragraphs in a list, or a record of its own: b"daeh" a header, b"  nf" a footnote, b"deqe" an equation."""
    inside = _hwp_record(72, level + 1, struct.pack("<II", len(paragraphs), 0)) + b"".join(hwp_paragraph(p, level + 1) for p in paragraphs) if paragraphs else b""
    return _hwp_record(71, level, kind + bytes(8)) + inside + record


def hwp_equation(script: str, level: int = 1) -> bytes:
    return hwp_control(b"deqe", level, record=_hwp_record(88, level + 1, struct.pack("<I", 0) + _wide(script)))


def hwp_picture(number: int, level: int = 1) -> bytes:
    return hwp_control(b" osg", level, record=_hwp_record(76, level + 1, bytes(8)) + _hwp_record(85, level + 2, bytes(71) + struct.pack("<H", number)))


def hwp_info(shapes: list[tuple[float, int]], styles: list[str] = (), files: list[tuple[int, str]] = ()) -> bytes:
    """A DocInfo stream: shapes of (points, flags), styles' names, stored files of (number, ending)."""
    out = _hwp_record(16, 0, struct.pack("<H", 1) + bytes(24)) + b"".join(_hwp_record(18, 0, struct.pack("<HH", 1, n) + _wide(e)) for n, e in files)
    out += _hwp_record(19, 0, b"\0" + _wide("Batang")) + b"".join(_hwp_record(21, 0, bytes(42) + struct.pack("<iI", int(p * 100), f) + bytes(20)) for p, f in shapes)
    out += _hwp_record(25, 0, struct.pack("<Iiii", 3, 100, 200, 50) + bytes(20))
    return out + b"".join(_hwp_record(26, 0, _wide(n) + _wide("en") + struct.pack("<BBhHH", 0, k, 1042, 0, 0)) for k, n in enumerate(styles))


def hwp(sections: list[list[str] | bytes], packed: bool = True, info: bytes | None = None, files: dict[str, bytes] | None = None) -> bytes:
    """A version 5 hwp file of sections, each paragraphs or records."""
    def pack(data: bytes) -> bytes:
        if not packed:
            return data
        worker = zlib.compressobj(wbits=-15)
        return worker.compress(data) + worker.flush()

    streams = {"FileHeader": (b"HWP Document File".ljust(32, b"\0") + bytes([0, 0, 0, 5]) + struct.pack("<I", int(packed))).ljust(256, b"\0")}
    if info is not None:
        streams["DocInfo"] = pack(info)
    for k, part in enumerate(sections):
        streams[f"BodyText/Section{k}"] = pack(part if isinstance(part, bytes) else b"".join(hwp_paragraph(p) for p in part))
    return compound(streams | {f"BinData/{n}": pack(x) for n, x in (files or {}).items()})


_H = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph" xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hh="http://www.hancom.co.kr/hwpml/2011/head"'


def hwpx_run(text: str, shape: int | None = None) -> str:
    return f"<hp:run{f' charPrIDRef={quoteattr(str(shape))}' if shape is not None else ''}><hp:t>{escape(text)}</hp:t></hp:run>"


def hwpx_table(rows: list[list[str]], spans: dict[tuple[int, int], tuple[int, int]] | None = None) -> str:
    spans = spans or {}
    covered = {(r + y, c + x) for (r, c), (high, wide) in spans.items() for y in range(high) for x in range(wide) if x or y}
    body = ""
    for r, row in enumerate(rows):
        cells = ""
        for c, text in enumerate(row):
            if (r, c) not in covered:
                high, wide = spans.get((r, c), (1, 1))
                cells += f'<hp:tc><hp:subList><hp:p>{hwpx_run(text)}</hp:p></hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="{wide}" rowSpan="{high}"/></hp:tc>'
        body += f"<hp:tr>{cells}</hp:tr>"
    return f"<hp:tbl>{body}</hp:tbl>"


def hwpx(sections: list[list[str]], head: str = "", order: list[int] | None = None, files: dict[str, bytes] | None = None) -> bytes:
    """A hwpx package of sections of paragraphs; one that begins with <hp: is markup. head: shapes of characters; order: of the sections."""
    parts: dict[str, str | bytes] = {}
    items = "".join(f'<item id="s{k}" href="Contents/section{k}.xml"/>' for k in range(len(sections)))
    parts["Contents/content.hpf"] = f"<package><manifest>{items}</manifest><spine>" + "".join(f'<itemref idref="s{k}"/>' for k in order or ()) + "</spine></package>"
    parts["Contents/header.xml"] = f"<hh:head {_H}>{head}</hh:head>"
    for k, paragraphs in enumerate(sections):
        parts[f"Contents/section{k}.xml"] = f"<hs:sec {_H}>" + "".join(p if p.startswith("<hp:") else f"<hp:p>{hwpx_run(p)}</hp:p>" for p in paragraphs) + "</hs:sec>"
    return package(parts | {f"BinData/{n}": x for n, x in (files or {}).items()})


def pdf(pages: list[list[str]], packed: bool = True) -> bytes:
    """A PDF of pages of lines, in a font of 16-bit codes that its map names."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /ToUnicode 4 0 R >>"]

    def stream(data: bytes) -> bytes:
        raw = zlib.compress(data) if packed else data
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if packed else b"", raw)

    objects.append(stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"))
    kids = []
    for lines in pages:
        body = b"BT /F1 10 Tf 50 800 Td 12 TL " + b" ".join(b"<%s> Tj T*" % x.encode("utf-16-be").hex().encode() for x in lines) + b" ET"
        kids.append(b"%d 0 R" % (len(objects) + 1))
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (len(objects) + 2), stream(body)]
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(kids), b" ".join(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, x) for k, x in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"
