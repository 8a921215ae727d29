"""Packages of the Hangul word processor (hwpx)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree.ElementTree import Element as Node

from leafmill.sources.hwp import heading_by_size
from leafmill.sources.package import Package, attribute, child, children, every, local
from leafmill.sources.element import Element, Run

_KINDS = {"header": "header", "footer": "footer", "footNote": "footnote", "endNote": "endnote"}


def section_names(package: Package) -> list[str]:
    """The sections' parts: in the order of the package's spine, then those it doesn't name by number."""
    found = [n for n in package.parts if re.fullmatch(r"(?:Contents/)?section\d+\.xml", n)]
    by_number = sorted(found, key=lambda n: int("".join(c for c in n.rpartition("/")[2] if c.isdigit())))
    spine: list[str] = []
    root = package.maybe("Contents/content.hpf")
    if root is not None:
        items = {attribute(x, "id"): attribute(x, "href") for x in every(root, "item")}
        for ref in every(root, "itemref"):
            href = items.get(attribute(ref, "idref"), "")
            spine += [n for n in (href, f"Contents/{href}") if n in found and n not in spine][:1]
    return spine + [n for n in by_number if n not in spine]


def _mark(x: Node) -> str:
    kind = local(x.tag)
    if kind == "underline":
        return "u" if attribute(x, "type", "NONE") != "NONE" else ""
    if kind == "strikeout":
        return "s" if attribute(x, "shape", "NONE") != "NONE" else ""
    return {"bold": "b", "italic": "i", "supscript": "^", "subscript": "_"}.get(kind, "")


class _Reader:
    def __init__(self, package: Package) -> None:
        self.package = package
        self.files = [n for n in package.parts if n.startswith("BinData/")]
        head = package.maybe("Contents/header.xml")
        head = head if head is not None else package.maybe("header.xml")
        #: Marks and size of each shape of characters; runs name them by place.
        self.shapes: list[tuple[str, float]] = []
        for x in every(head, "charPr"):
            if attribute(x, "id"):
                height = attribute(x, "height")
                self.shapes.append(("".join(_mark(y) for y in x), int(height) / 100 if height.lstrip("-").isdigit() else 10.0))

    def shape(self, run: Node) -> tuple[str, float]:
        ref = attribute(run, "charPrIDRef")
        return self.shapes[int(ref)] if ref.isdigit() and int(ref) < len(self.shapes) else ("", 10.0)

    def paragraph(self, p: Node, section: int, part: str) -> Iterator[Element]:
        """Text and what stands in it, in order: an object ends the paragraph before it."""
        runs: list[Run] = []

        def flush() -> Iterator[Element]:
            text = "".join(r[0] for r in runs)
            if text.strip():
                level = heading_by_size(runs)
                yield Element("heading" if level else "paragraph", text, level, section=section, part=part, runs=list(runs))
            runs.clear()

        for x in p:
            parts = list(x) if local(x.tag) == "run" else [x] if local(x.tag) == "ctrl" else []
            marks, size = self.shape(x)
            for y in parts:
                kind = local(y.tag)
                text = {"t": "".join(y.itertext()), "tab": "\t", "lineBreak": "\n"}.get(kind)
                if text:
                    runs.append((text, marks, size))
                elif text is None and (made := self.object(y, section, part)) is not None:
                    yield from flush()
                    yield made
        yield from flush()

    def object(self, node: Node, section: int, part: str) -> Element | None:
        """The first table, equation, picture, header, footer or note in an element."""
        for x in node.iter():
            kind = local(x.tag)
            if kind == "tbl":
                return self.table(x, section, part)
            if kind == "equation":
                script = next((s.text for s in every(x, "script") if s.text), None) or attribute(x, "script") or (x.text or "").strip()
                return Element("equation", script, section=section, part=part)
            if kind == "pic":
                return self.picture(x, section)
            if kind in _KINDS:
                inside = [e.text for sub in children(x, "subList") for p in children(sub, "p") for e in self.paragraph(p, section, part) if e.kind in ("paragraph", "heading")]
                return Element("note" if kind.endswith("Note") else kind, "\n".join(inside), section=section, name=_KINDS[kind], part=part)
        return None

    def picture(self, node: Node, section: int) -> Element:
        ref = next((r for x in every(node, "img") if (r := attribute(x, "binaryItemIDRef") or attribute(x, "binaryItemId") or attribute(x, "binaryItemIdRef"))), "")
        stored = next((n for n in self.files if ref and ref in n.removeprefix("BinData/")), "")
        return Element("image", "", section=section, name=stored.rpartition("/")[2] or ref, part=stored)

    def table(self, node: Node, section: int, part: str) -> Element:
        placed: dict[int, dict[int, str]] = {}
        spans, taken = [], set()
        for r, tr in enumerate(children(node, "tr")):
            placed[r], c = {}, 0
            for tc in children(tr, "tc"):
                size = child(tc, "cellSpan")
                given = [(attribute(size, k) if size is not None else "") or attribute(tc, k) for k in ("colSpan", "rowSpan")]
                wide, high = (int(x) if x.isdigit() and int(x) else 1 for x in given)
                at = child(tc, "cellAddr")
                if at is not None and attribute(at, "colAddr").isdigit():
                    c = int(attribute(at, "colAddr"))
                while (r, c) in taken:
                    c += 1
                text = []
                for p in [q for sub in children(tc, "subList") for q in children(sub, "p")] + children(tc, "p"):
                    for e in self.paragraph(p, section, part):
                        text += [x for row in e.rows for x in row if x] if e.rows is not None else [e.text] if e.text else [f"![]({e.name})"] if e.kind == "image" else []
                placed[r][c] = "\n".join(text)
                if wide > 1 or high > 1:
                    spans.append((r, c, high, wide))
                    taken |= {(r + y, c + x) for y in range(min(high, 4096)) for x in range(min(wide, 4096)) if x or y}
                c += 1
        wide = max([c for row in placed.values() for c in row] + [c for _, c in taken], default=-1) + 1
        return Element("table", rows=[[row.get(c, "") for c in range(wide)] for row in placed.values()], section=section, spans=spans, part=part)


def read_hwpx(package: Package) -> Iterator[Element]:
    """The elements of all sections, in order."""
    reader = _Reader(package)
    for k, name in enumerate(section_names(package)):
        for p in children(package.xml(name), "p"):
            yield from reader.paragraph(p, k, name)
