"""Word-processor packages (docx) as elements."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from email import policy
from email.parser import BytesParser
from xml.etree.ElementTree import Element as Node

from leafmill.sources.element import Element, Run
from leafmill.sources.package import Package, attribute, child, children, every, local
from leafmill.sources.web import read_html


_MARKS = {"b": "b", "i": "i", "u": "u", "strike": "s"}
_RAISED = {"superscript": "^", "subscript": "_"}
#: Elements that only hold others: inserted and moved text stays, both where it was moved from and to.
_WRAPPERS = ("ins", "moveTo", "moveFrom", "smartTag", "sdt", "sdtContent", "fldSimple")


def value(node: Node | None, name: str, default: str = "") -> str:
    """The val of a child."""
    x = child(node, name)
    return attribute(x, "val", default) if x is not None else default


def _on(properties: Node | None, name: str) -> bool:
    x = child(properties, name)
    return x is not None and attribute(x, "val", "1") not in ("0", "false", "none")


def marks_of(properties: Node | None) -> str:
    """The marks that run properties set."""
    return "".join(m for k, m in _MARKS.items() if _on(properties, k)) + _RAISED.get(value(properties, "vertAlign"), "")


def marked(run: Run) -> str:
    """A run in Markdown; blank ones stay bare."""
    text, marks, _ = run
    if not text.strip():
        return text
    stars = "***" if "b" in marks and "i" in marks else "**" if "b" in marks else "*" if "i" in marks else ""
    text = stars + text + stars
    for mark, before, after in (("u", "<u>", "</u>"), ("s", "~~", "~~"), ("^", "<sup>", "</sup>"), ("_", "<sub>", "</sub>")):
        if mark in marks:
            text = before + text + after
    return text


def html_of(name: str, data: bytes) -> str:
    """The page in an imported part: of a mail archive its first page, in the first encoding that fits."""
    if name.lower().endswith((".mht", ".mhtml")):
        message = BytesParser(policy=policy.default).parsebytes(data)
        part = next((m for m in message.walk() if m.get_content_type() == "text/html"), None)
        if part is not None:
            return part.get_content()
    for encoding in ("utf-8", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


class Word:
    """Reads one package. Deleted text goes, inserted and moved text stays."""

    def __init__(self, package: Package) -> None:
        self.package, self.counters = package, defaultdict(lambda: defaultdict(int))
        self.own = self.links = package.relations("word/document.xml")
        self.part, self.styles = "word/document.xml", {attribute(s, "styleId"): s for s in children(package.maybe("word/styles.xml"), "style")}
        self.headings = self._headings()
        self.lists = self._lists()
        self.comments = {attribute(c, "id"): c for c in children(package.maybe("word/comments.xml"), "comment")}

    def target(self, rel: str) -> str:
        """What a relation of the part that is read, or else of the document, points to."""
        return (self.links.get(rel) or self.own.get(rel) or ("", "", False))[0]

    def _headings(self) -> dict[str, int]:
        own, based = {}, {}
        for s in children(self.package.maybe("word/styles.xml"), "style"):
            sid, name = attribute(s, "styleId"), attribute(child(s, "name"), "val").lower() if child(s, "name") is not None else ""
            based[sid] = attribute(child(s, "basedOn"), "val") if child(s, "basedOn") is not None else ""
            digits = "".join(c for c in name if c.isdigit())
            if name == "title":
                own[sid] = 1
            elif name.startswith("heading"):
                own[sid] = min(6, max(1, int(digits or 1)))
        out = {}
        for sid in based:
            at, seen = sid, set()
            while at and at not in own and at not in seen:
                seen.add(at)
                at = based.get(at, "")
            out[sid] = own.get(at, 0)
        return out

    def _lists(self) -> dict[tuple[str, str], tuple[str, str, int]]:
        root = self.package.maybe("word/numbering.xml")
        kinds: dict[str, dict[str, tuple[str, str, int]]] = {}
        for a in children(root, "abstractNum"):
            levels = {}
            for lvl in children(a, "lvl"):
                value = lambda n, d, lvl=lvl: attribute(child(lvl, n), "val", d) if child(lvl, n) is not None else d
                levels[attribute(lvl, "ilvl")] = (value("numFmt", "decimal"), value("lvlText", "%1."), int(value("start", "1")))
            kinds[attribute(a, "abstractNumId")] = levels
        out = {}
        for n in children(root, "num"):
            for level, what in kinds.get(attribute(child(n, "abstractNumId"), "val") if child(n, "abstractNumId") is not None else "", {}).items():
                out[attribute(n, "numId"), level] = what
        return out

    def marker(self, num: str, level: str) -> str:
        """The next marker of a list; deeper levels start again."""
        kind, pattern, start = self.lists.get((num, level), ("bullet", "", 1))
        if kind == "bullet":
            return "  " * int(level) + "- "
        counts = self.counters[num]
        counts[level] = counts[level] + 1 if level in counts else start
        for deeper in [k for k in counts if int(k) > int(level)]:
            del counts[deeper]
        text = pattern
        for k in range(int(level) + 1):
            own = self.lists.get((num, str(k)), ("decimal", "", 1))
            text = text.replace(f"%{k + 1}", _numeral(counts.get(str(k), own[2]), own[0]))
        return "  " * int(level) + text + " "

    def runs(self, node: Node, annotated: set[str] | None = None) -> list[Run]:
        """A paragraph's runs with links, references, bookmarks and comments."""
        out: list[Run] = []
        annotated = set() if annotated is None else annotated

        def behind(text: str) -> None:
            last = out.pop() if out else ("", "", 0.0)
            out.append((f"{last[0]} {text}".strip() if not last[0] else f"{last[0]} {text}", last[1], last[2]))

        for x in node:
            kind = local(x.tag)
            if kind == "r":
                ids = {attribute(c, "id") for c in children(x, "commentReference")}
                if ids and ids <= annotated:
                    continue
                out += self.run(x)
            elif kind == "hyperlink":
                inside = self.runs(x, annotated)
                target = self.target(attribute(x, "id")) or ("#" + attribute(x, "anchor") if attribute(x, "anchor") else "")
                out += inside
                if target and inside:
                    behind(f"<{target}>")
            elif kind == "bookmarkStart":
                name = attribute(x, "name")
                if name and not name.startswith("_"):
                    out.append((f"[bookmark: {name}] ", "", 0.0))
            elif kind == "commentRangeEnd":
                note = self.comments.get(attribute(x, "id"))
                first = next((t for p in every(note, "p") if (t := "".join(r[0] for r in self.runs(p)).strip())), "") if note is not None else ""
                if first:
                    annotated.add(attribute(x, "id"))
                    behind(f"[comment {attribute(x, 'id')}: {first}]")
            elif kind in _WRAPPERS:
                out += self.runs(x, annotated)
            elif kind == "AlternateContent":
                out += self.runs(self.chosen(x), annotated)
        return out

    def chosen(self, node: Node) -> Node:
        """The better of alternate contents."""
        first = child(node, "Choice")
        other = first if first is not None else child(node, "Fallback")
        return other if other is not None else node

    def run(self, r: Node) -> list[Run]:
        text = ""
        for x in r:
            kind = local(x.tag)
            if kind == "t":
                text += x.text or ""
            elif kind == "tab":
                text += "\t"
            elif kind in ("br", "cr"):
                text += "\n"
            elif kind == "fldChar":
                text += self.checkbox(x)
            elif kind in ("footnoteReference", "endnoteReference"):
                text += f"[^{attribute(x, 'id')}]"
            elif kind == "commentReference":
                text += f"[comment {attribute(x, 'id')}]"
            elif kind in ("drawing", "pict", "object", "AlternateContent"):
                text += self.drawn(self.chosen(x) if kind == "AlternateContent" else x)
        p = child(r, "rPr")
        style = child(self.styles.get(value(p, "rStyle")), "rPr")
        marks = "".join(dict.fromkeys(marks_of(style) + marks_of(p)))
        size = value(p, "sz")
        return [(text, marks, int(size) / 2 if size.isdigit() else 0.0)] if text else []

    def checkbox(self, field: Node) -> str:
        """[x] or [ ] for a form's checkbox."""
        box = child(field, "ffData", "checkBox")
        if box is None:
            return ""
        x = child(box, "checked")
        on = attribute(x, "val", "1") if x is not None else value(box, "default", "0")
        return "[x]" if on.lower() in ("1", "true", "on", "yes") else "[ ]"

    def drawn(self, node: Node) -> str:
        """The text of text boxes, the picture and the description in a drawing."""
        text = ""
        floats = any(True for _ in every(node, "anchor"))
        for box in every(node, "txbxContent"):
            inside = "\n".join(t for p in children(box, "p") if (t := "".join(r[0] for r in self.runs(p)).strip()))
            text += inside + ("\n" if inside and floats else "")
        said = " ".join(t for d in every(node, "docPr") for t in (attribute(d, "title"), attribute(d, "descr")) if t)
        for picture in [*every(node, "blip"), *every(node, "imagedata")]:
            part = self.target(attribute(picture, "embed") or attribute(picture, "id"))
            if part:
                return f"{text}![{said}]({part.rpartition('/')[2]})"
        return text + (f"![{said}]()" if said else "")

    def body(self, node: Node) -> Iterator[Element]:
        for x in node:
            kind = local(x.tag)
            if kind == "p":
                runs = self.runs(x)
                text = "".join(marked(r) for r in runs)
                p = child(x, "pPr")
                style, num = value(p, "pStyle"), child(p, "numPr")
                if not text.strip():
                    continue
                if self.headings.get(style):
                    yield Element("heading", text, self.headings[style], runs=runs, part=self.part)
                elif num is not None and child(num, "numId") is not None:
                    yield Element("paragraph", self.marker(value(num, "numId"), value(num, "ilvl", "0")) + text, runs=runs, part=self.part)
                else:
                    yield Element("paragraph", text, runs=runs, part=self.part)
            elif kind == "tbl":
                yield self.table(x)
            elif kind in _WRAPPERS:
                yield from self.body(x)
            elif kind == "AlternateContent":
                yield from self.body(self.chosen(x))
            elif kind == "altChunk":
                part = self.target(attribute(x, "id"))
                if part in self.package and part.lower().endswith((".html", ".htm", ".mht", ".mhtml")):
                    for e in read_html(html_of(part, self.package.read(part)))[0]:
                        e.part = part
                        yield e

    def table(self, node: Node) -> Element:
        rows: list[list[str]] = []
        spans: list[tuple[int, int, int, int]] = []
        open_at: dict[int, int] = {}
        for tr in children(node, "tr"):
            row: list[str] = []
            before = child(tr, "trPr", "gridBefore")
            row += [""] * (int(attribute(before, "val", "0")) if before is not None else 0)
            for tc in children(tr, "tc"):
                p = child(tc, "tcPr")
                wide = int(attribute(child(p, "gridSpan"), "val", "1")) if child(p, "gridSpan") is not None else 1
                merge = child(p, "vMerge")
                at = len(row)
                if merge is not None and attribute(merge, "val", "continue") == "continue" and at in open_at:
                    k = open_at[at]
                    spans[k] = (spans[k][0], spans[k][1], spans[k][2] + 1, spans[k][3])
                    row += [""] * wide
                    continue
                open_at.pop(at, None)
                if merge is not None or wide > 1:
                    spans.append((len(rows), at, 1, wide))
                    if merge is not None:
                        open_at[at] = len(spans) - 1
                inner = [e for e in self.body(tc)]
                row += ["\n".join(e.text if e.rows is None else "; ".join(" ".join(r) for r in e.rows) for e in inner)] + [""] * (wide - 1)
            rows.append(row)
        return Element("table", rows=rows, spans=[s for s in spans if s[2] * s[3] > 1], part=self.part)

    def elements(self) -> Iterator[Element]:
        root = self.package.xml("word/document.xml")
        core = self.package.maybe("docProps/core.xml")
        for name, make in (("title", lambda t: Element("heading", t, 1)), ("creator", lambda t: Element("paragraph", f"Author: {t}"))):
            x = child(core, name)
            if x is not None and (x.text or "").strip():
                yield make(x.text.strip())
        parts = list(dict.fromkeys((t, kind) for t, kind, external in self.links.values() if kind in ("header", "footer") and not external))
        main = list(self.body(child(root, "body") if child(root, "body") is not None else root))
        edges: dict[str, list[Element]] = {"header": [], "footer": []}
        for target, kind in parts:
            if target in self.package:
                edges[kind] += [Element(kind, e.text, rows=e.rows, part=target, runs=e.runs) for e in self.of(target)]
        yield from edges["header"]
        yield from main
        yield from edges["footer"]
        replies = self.replies()
        for part, kind, node in (("word/footnotes.xml", "note", "footnote"), ("word/endnotes.xml", "note", "endnote"), ("word/comments.xml", "comment", "comment")):
            for x in children(self.package.maybe(part), node):
                own = attribute(x, "id")
                if own.lstrip("-").isdigit() and int(own) > (0 if kind == "note" else -1):
                    inside = list(self.of(part, x))
                    text = "\n".join([e.text for e in inside if e.text] + replies.get(own, []) * (kind == "comment"))
                    if text:
                        yield Element(kind, f"{attribute(x, 'author')}: {text}" if attribute(x, "author") else text, name=own, part=part, runs=[r for e in inside for r in e.runs])

    def of(self, part: str, node: Node | None = None) -> Iterator[Element]:
        """The elements of another part, whose own relations come before the document's."""
        before = self.links, self.part
        self.links, self.part = self.package.relations(part), part
        yield from self.body(self.package.xml(part) if node is None else node)
        self.links, self.part = before

    def replies(self) -> dict[str, list[str]]:
        """The answers to each comment: those whose last paragraph is said to be below one of its own."""
        of = {attribute(p, "paraId"): k for k, c in self.comments.items() for p in every(c, "p") if attribute(p, "paraId")}
        out: dict[str, list[str]] = {}
        for x in children(self.package.maybe("word/commentsExtended.xml"), "commentEx"):
            own, above = of.get(attribute(x, "paraId")), of.get(attribute(x, "paraIdParent"))
            if own and above and own != above:
                text = "\n".join(e.text for e in self.of("word/comments.xml", self.comments[own])).strip()
                who = attribute(self.comments[own], "author")
                if text:
                    out.setdefault(above, []).append((f"Reply from {who}: " if who else "Reply: ") + text)
        return out


def _numeral(n: int, kind: str) -> str:
    if kind in ("lowerLetter", "upperLetter"):
        out = ""
        while n > 0:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out.upper() if kind == "upperLetter" else out
    if kind in ("lowerRoman", "upperRoman"):
        out = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            out += sign * (n // value)
            n %= value
        return out.upper() if kind == "upperRoman" else out
    return f"{n:02d}" if kind == "decimalZero" else str(n)


def read_docx(package: Package) -> Iterator[Element]:
    """The elements of a docx package in reading order."""
    return Word(package).elements()
