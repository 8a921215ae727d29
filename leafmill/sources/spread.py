"""Spreadsheet packages (xlsx): one table element a sheet, cells rendered as they are shown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from xml.etree.ElementTree import Element as Node

from leafmill.sources.charts import drawings_of
from leafmill.sources.element import Element
from leafmill.sources.package import Package, PackageError, attribute, child, children, every, local

_BUILTIN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "yyyy-mm-dd", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm", 19: "h:mm:ss", 20: "h:mm", 21: "h:mm:ss", 22: "yyyy-mm-dd h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 48: "##0.0E+0"}
_REF = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]+)")
_LITERAL = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|\[\$([^\]-]*)[^\]]*\]|\[(?!h|m|s)[^\]]*\]')


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def place(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as B7."""
    m = _REF.match(ref)
    if not m:
        raise PackageError(f"no cell reference: {ref}")
    return int(m[2]) - 1, column_number(m[1]) - 1


def span(ref: str) -> tuple[int, int, int, int]:
    """First and last row and column of a range such as A1:C3."""
    a, _, b = ref.partition(":")
    return (*place(a), *place(b or a))


def _plain(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _clock(seconds: int, hours: int, with_seconds: bool, pad: bool) -> str:
    text = f"{hours:02d}" if pad else str(hours)
    return f"{text}:{seconds // 60 % 60:02d}" + (f":{seconds % 60:02d}" if with_seconds else "")


def render(value: float, code: str) -> str:
    """A number in a format code: durations, times, dates, fractions, scientific, percent, decimals with
    separators, literal affixes, a section for negatives and zero filling."""
    if not code or code.lower() in ("general", "@"):
        return _plain(value)
    value += 0.0  # a negative zero has no sign
    sections = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', code)
    negative = value < 0 and len(sections) > 1
    section = sections[1] if negative else sections[2] if value == 0 and len(sections) > 2 and sections[2] else sections[0]
    bare = _LITERAL.sub("", section)
    low = bare.lower()
    if re.search(r"\[(h+|m+|s+)\]", low):
        s = round(abs(value) * 86400)
        return ("-" if value < 0 else "") + _clock(s, s // 3600, "s" in low.replace("[", "", 1), False)
    is_date, is_time = bool(re.search(r"[yd]", low)), "h" in low or "ss" in low
    if is_time and not is_date or "mm:ss" in low:
        s = round(value % 1 * 86400) % 86400
        return _clock(s, s // 3600, "s" in low, True)
    if is_date or re.search(r"mmm", low):
        try:
            day = date(1899, 12, 30) + timedelta(days=int(value))
        except OverflowError:
            return _plain(value)
        s = round(value % 1 * 86400) % 86400
        return day.isoformat() + (" " + _clock(s, s // 3600, "s" in low, True) if is_time else "")
    prefix, suffix = _affixes(section)
    x = abs(value) if negative or value < 0 else value
    sign = "-" if value < 0 and not negative else ""
    if "?/" in bare or re.search(r"\?\s*/\s*\d", bare):
        most = 10 ** len(re.search(r"/\s*([?\d]+)", bare)[1]) - 1
        f = Fraction(x).limit_denominator(max(1, most))
        whole, rest = divmod(f.numerator, f.denominator)
        text = f"{rest}/{f.denominator}" if rest and (not whole or "#" not in bare and "0" not in bare.split("?")[0]) else f"{whole} {rest}/{f.denominator}" if rest else str(whole)
        return prefix + sign + text + suffix
    m = re.search(r"([0#]+)(?:\.([0#]+))?[eE]([+-])(0+)", bare)
    if m:
        mantissa, power = f"{x:.{len(m[2] or '')}e}".split("e")
        return prefix + sign + f"{mantissa}E{'-' if int(power) < 0 else '+' if m[3] == '+' else ''}{abs(int(power)):0{len(m[4])}d}" + suffix
    m = re.search(r"[0#?,]*[0#?](?:\.([0#?]+))?", bare)
    if not m:
        return prefix + (sign + _plain(x) if "@" in bare else "") + suffix
    if "%" in bare:
        x *= 100
    places = m[1] or ""
    groups = "," in m[0].split(".")[0]
    if re.fullmatch(r"[0\-\s/().]+", bare) and not places and bare.count("0") > 1 and re.search(r"0[\-\s/()]+0", bare):
        digits = str(round(x)).rjust(bare.count("0"), "0")
        extra, out = len(digits) - bare.count("0"), []
        k = 0
        for c in bare:
            if c == "0":
                out.append(digits[: extra + 1] if k == 0 else digits[extra + k])
                k += 1
            else:
                out.append(c)
        return sign + "".join(out)
    units = Decimal(repr(x)).quantize(Decimal(1).scaleb(-len(places)), ROUND_HALF_UP)
    text = f"{units:,f}" if groups else f"{units:f}"
    optional = len(places) - len(places.rstrip("#"))
    if optional and "." in text:
        cut = text[len(text) - optional :].rstrip("0")
        text = (text[: len(text) - optional] + cut).rstrip(".")
    least = m[0].split(".")[0].count("0")
    whole, dot, rest = text.partition(".")
    if least > len(whole.replace(",", "")):
        whole = whole.rjust(least, "0")
    return prefix + sign + whole + dot + rest + ("%" if "%" in bare and "%" not in suffix else "") + suffix


def _affixes(section: str) -> tuple[str, str]:
    """The literal text before and after the digits of a section."""
    digits = [m.span() for m in re.finditer(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.|([0#?][0#?,./]*(?:[eE][+-]0+)?)', section) if m[1]]
    if not digits:
        return _literal(section), ""
    return _literal(section[: digits[0][0]]), _literal(section[digits[-1][1] :])


def _literal(text: str) -> str:
    text = re.sub(r"_.|\*.", "", text)
    text = re.sub(r"\[\$([^\]-]*)[^\]]*\]", r"\1", text)
    text = re.sub(r"\[[^\]]*\]", "", text)
    return re.sub(r'"([^"]*)"|\\(.)', lambda m: m[1] if m[1] is not None else m[2], text).replace("#", "").replace("?", "").replace("0", "")


def shift(formula: str, rows: int, columns: int) -> str:
    """A formula moved by rows and columns: references without $ move along; texts in quotes stay."""

    def moved(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        c, r = column_number(m[3]), int(m[5])
        c, r = (c if m[2] else c + columns), (r if m[4] else r + rows)
        if c < 1 or r < 1:
            return "#REF!"
        letters = ""
        while c:
            c, k = divmod(c - 1, 26)
            letters = chr(65 + k) + letters
        return f"{m[2]}{letters}{m[4]}{r}"

    return re.sub(r"(\"[^\"]*\"|'[^']*'!?)|(?<![A-Za-z0-9_.$])(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(.])", moved, formula)


def _text(node: object) -> str:
    return "".join(t.text or "" for t in every(node, "t"))


_EDGES = {"oddHeader": "header", "evenHeader": "header", "firstHeader": "header", "oddFooter": "footer", "evenFooter": "footer", "firstFooter": "footer"}


def header_text(code: str) -> str:
    """The left, middle and right parts of a header or footer, without its codes for fonts, colours and fields."""
    parts, at = {"L": "", "C": "", "R": ""}, "C"
    for m in re.finditer(r'&(?:(&)|([LCR])|"[^"]*"?|K[0-9A-Fa-f+-]{0,6}|.|$)|([^&]+)', code, re.S):
        if m[2]:
            at = m[2]
        else:
            parts[at] += m[3] or m[1] or ("&" if m[0] == "&" else "")
    return " | ".join(x.strip() for x in parts.values() if x.strip())


def ragged(cells: dict[tuple[int, int], str]) -> list[list[str]]:
    """Each row as far as the last column of all, and rows without cells empty, as long as that is a grid; cells that lie so far
    apart that it would be mostly blank are rows that end with their last cell."""
    if not cells:
        return []
    high, wide = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
    by: dict[int, dict[int, str]] = {}
    for (r, c), text in cells.items():
        by.setdefault(r, {})[c] = text
    dense = high * wide <= max(10_000, 64 * len(cells))
    return [[by.get(r, {}).get(c, "") for c in range(wide if dense else max(by[r], default=-1) + 1 if r in by else 0)] for r in range(high)]


def read_xlsx(package: Package) -> Iterator[Element]:
    """The defined names, and for each sheet in the workbook's order its headers and footers, a table, named, and its
    drawings; hidden sheets too (level 1). A formula stands behind its value, a link and a comment behind a cell's text;
    merged cells have spans. Sheets are read row by row, whatever their size."""
    book = "xl/workbook.xml"
    links, root = package.relations(book), package.xml(book)
    strings = ["".join(t.text or "" for t in every(si, "t")) for si in package.rows("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in package else []
    styles = package.maybe("xl/styles.xml")
    codes = {int(attribute(n, "numFmtId")): attribute(n, "formatCode") for n in children(child(styles, "numFmts"), "numFmt")}
    formats = [codes.get(int(attribute(x, "numFmtId", "0")), _BUILTIN.get(int(attribute(x, "numFmtId", "0")), "")) for x in children(child(styles, "cellXfs"), "xf")]
    for name in children(child(root, "definedNames"), "definedName"):
        if attribute(name, "name") and (name.text or "").strip():
            yield Element("paragraph", f"Defined name: {attribute(name, 'name').removeprefix('_xlnm.')} = {name.text.strip()}", part=book)
    for k, sheet in enumerate(children(child(root, "sheets"), "sheet")):
        target, label = links.get(attribute(sheet, "id"), ("", "", True))[0], attribute(sheet, "name")
        if target not in package:
            continue
        cells, spans, edges = _sheet(package, target, strings, formats)
        for kind in ("header", "footer"):
            for text in (header_text(x.text or "") for x in edges if _EDGES.get(local(x.tag)) == kind):
                if text:
                    yield Element(kind, text, section=k, name=label, part=target)
        yield Element("table", rows=ragged(cells), section=k, name=label, level=int(attribute(sheet, "state", "visible") != "visible"), spans=spans, part=target)
        yield from drawings_of(package, target, k)


def _sheet(package: Package, target: str, strings: list[str], formats: list[str]) -> tuple[dict[tuple[int, int], str], list[tuple[int, int, int, int]], list[Node]]:
    rels = package.relations(target)
    cells: dict[tuple[int, int], str] = {}
    shared: dict[str, tuple[int, int, str]] = {}
    row_no, rest = -1, {"hyperlinks": [], "mergeCells": [], "headerFooter": []}
    for row in package.rows(target, ("row", *rest)):
        if local(row.tag) in rest:
            rest[local(row.tag)] += list(row)
            continue
        row_no = int(attribute(row, "r")) - 1 if attribute(row, "r") else row_no + 1
        col_no = -1
        for c in children(row, "c"):
            r, col_no = place(attribute(c, "r")) if attribute(c, "r") else (row_no, col_no + 1)
            kind, v, f = attribute(c, "t", "n"), child(c, "v"), child(c, "f")
            raw = v.text or "" if v is not None else ""
            if kind == "s":
                text = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
            elif kind == "inlineStr":
                text = _text(child(c, "is"))
            elif kind == "b":
                text = "TRUE" if raw == "1" else "FALSE"
            elif kind in ("e", "str") or not raw:
                text = raw
            else:
                style = int(attribute(c, "s", "0"))
                try:
                    text = render(float(raw), formats[style] if style < len(formats) else "")
                except (ValueError, OverflowError):
                    text = raw
            if f is not None:
                formula, group = f.text or "", attribute(f, "si")
                if attribute(f, "t") == "shared" and group:
                    if formula:
                        shared[group] = (r, col_no, formula)
                    elif group in shared:
                        r0, c0, master = shared[group]
                        formula = shift(master, r - r0, col_no - c0)
                if formula:
                    text = f"{text} (={formula})".strip()
            if text:
                cells[r, col_no] = text
    linked: dict[tuple[int, int], str] = {}
    for h in rest["hyperlinks"]:  # a later range overrides
        url = rels.get(attribute(h, "id"), ("", "", False))[0] or ("#" + attribute(h, "location") if attribute(h, "location") else "")
        r0, c0, r1, c1 = span(attribute(h, "ref"))
        inside = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r, c) in cells] if (r1 - r0 + 1) * (c1 - c0 + 1) <= len(cells) else [k for k in cells if r0 <= k[0] <= r1 and c0 <= k[1] <= c1]
        if not inside:
            inside, cells[r0, c0] = [(r0, c0)], attribute(h, "display")
        if url:
            linked.update(dict.fromkeys(inside, url))
    for at, url in linked.items():
        cells[at] = f"{cells[at]} <{url}>".strip()
    for part, kind, _ in rels.values():
        if kind == "comments" and part in package:
            notes = package.xml(part)
            authors = [a.text or "" for a in children(child(notes, "authors"), "author")]
            for n in children(child(notes, "commentList"), "comment"):
                who = int(attribute(n, "authorId", "0"))
                at = place(attribute(n, "ref"))
                cells[at] = f"{cells.get(at, '')} [comment: {authors[who] + ': ' if who < len(authors) and authors[who] else ''}{_text(n)}]".strip()
    spans = []
    for m in rest["mergeCells"]:
        r0, c0, r1, c1 = span(attribute(m, "ref"))
        spans.append((r0, c0, r1 - r0 + 1, c1 - c0 + 1))
        cells.setdefault((r0, c0), "")
    return cells, spans, rest["headerFooter"]
