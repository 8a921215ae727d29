"""Presentation packages (pptx): shapes in reading order, titles as headings, notes and comments."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from xml.etree.ElementTree import Element as Node

from leafmill.sources.charts import charts_of
from leafmill.sources.element import Element
from leafmill.sources.package import Package, attribute, child, children, every, local

Place = tuple[Fraction, Fraction, Fraction, Fraction]  # x and y scale, x and y offset


def _offset(node: Node) -> tuple[int, int]:
    x = next((f for p in ("spPr", "grpSpPr", "xfrm") if (s := child(node, p)) is not None and (f := s if p == "xfrm" else child(s, "xfrm")) is not None), None)
    off = child(x, "off")
    return (int(attribute(off, "x", "0")), int(attribute(off, "y", "0"))) if off is not None else (0, 0)


def _inside(group: Node, outer: Place) -> Place:
    """How a group's inner coordinates lie on the slide."""
    x = child(group, "grpSpPr", "xfrm")
    get = lambda n, a, b: (Fraction(int(attribute(child(x, n), a, "0"))), Fraction(int(attribute(child(x, n), b, "0")))) if child(x, n) is not None else (Fraction(0), Fraction(0))
    off, ext, inner_off, inner_ext = get("off", "x", "y"), get("ext", "cx", "cy"), get("chOff", "x", "y"), get("chExt", "cx", "cy")
    sx = ext[0] / inner_ext[0] if inner_ext[0] and ext[0] else Fraction(1)
    sy = ext[1] / inner_ext[1] if inner_ext[1] and ext[1] else Fraction(1)
    return (outer[0] * sx, outer[1] * sy, outer[2] + outer[0] * (off[0] - inner_off[0] * sx), outer[3] + outer[1] * (off[1] - inner_off[1] * sy))


def _shapes(tree: Node | None, place: Place = (Fraction(1), Fraction(1), Fraction(0), Fraction(0))) -> Iterator[tuple[Fraction, Fraction, Node]]:
    for node in tree if tree is not None else ():
        kind = local(node.tag)
        if kind == "grpSp":
            yield from _shapes(node, _inside(node, place))
        elif kind in ("sp", "pic", "graphicFrame", "cxnSp"):
            x, y = _offset(node)
            yield place[3] + place[1] * y, place[2] + place[0] * x, node


def _paragraph(p: Node, links: dict[str, tuple[str, str, bool]]) -> str:
    out = ""
    for x in p:
        if local(x.tag) in ("r", "fld"):
            t = child(x, "t")
            h = child(x, "rPr", "hlinkClick")
            url = links.get(attribute(h, "id"), ("", "", False))[0] if h is not None else ""
            out += (t.text or "" if t is not None else "") + (f" <{url}>" if url else "")
        elif local(x.tag) == "br":
            out += "\n"
    return out


def _markers(paragraphs: list[Node]) -> Iterator[tuple[Node, str]]:
    counts: dict[tuple[str, str], int] = {}
    for p in paragraphs:
        props = child(p, "pPr")
        auto, bullet, level = child(props, "buAutoNum"), child(props, "buChar"), int(attribute(props, "lvl", "0")) if props is not None else 0
        if auto is not None:
            key = (str(level), attribute(auto, "type"))
            counts[key] = int(attribute(auto, "startAt")) if attribute(auto, "startAt") else counts.get(key, 0) + 1
            yield p, "  " * level + f"{counts[key]}. "
        else:
            yield p, "  " * level + "- " if bullet is not None else ""


def _drawn(package: Package, part: str, section: int, masters: bool) -> Iterator[Element]:
    """The shapes of a slide by place; of a layout (masters) those that aren't places for a slide's own text."""
    links = package.relations(part)
    order = sorted(enumerate(_shapes(child(package.xml(part), "cSld", "spTree"))), key=lambda s: (s[1][0], s[1][1], s[0]))
    for _, (_, _, node) in order:
        ph = next(iter(every(node, "ph")), None)
        if masters and ph is not None:
            continue
        title = ph is not None and attribute(ph, "type") in ("title", "ctrTitle")
        for table in every(node, "tbl"):
            yield Element("table", rows=[["\n".join(_paragraph(p, links) for p in every(tc, "p")) for tc in children(tr, "tc")] for tr in children(table, "tr")], section=section, part=part)
        for ids in every(node, "relIds"):  # a diagram's texts lie in a part of their own
            data = links.get(attribute(ids, "dm"), ("", "", True))[0]
            for point in every(package.maybe(data), "pt"):
                text = "\n".join(t for p in every(point, "p") if (t := "".join(x.text or "" for x in every(p, "t")).strip()))
                if text:
                    yield Element("paragraph", text, section=section, part=data)
        if local(node.tag) in ("sp", "cxnSp"):
            for p, marker in _markers(children(child(node, "txBody"), "p")):
                text = _paragraph(p, links)
                if text.strip():
                    yield Element("heading" if title else "paragraph", marker + text, int(title), section=section, part=part)
        elif local(node.tag) == "pic":
            alt = next((attribute(x, "descr") for x in every(node, "cNvPr") if attribute(x, "descr")), "")
            blip = next(iter(every(node, "blip")), None)
            file = links.get(attribute(blip, "embed"), ("",))[0].rpartition("/")[2] if blip is not None else ""
            if alt or file:
                yield Element("paragraph", f"![{alt}]({file})", section=section, part=part)


def _slide(package: Package, part: str, section: int, authors: dict[str, str]) -> Iterator[Element]:
    links = package.relations(part)
    for target, kind, _ in links.values():
        if kind == "slideLayout" and target in package:
            yield from _drawn(package, target, section, True)
    yield from _drawn(package, part, section, False)
    yield from charts_of(package, part, section)
    for target, kind, _ in links.values():
        if kind == "notesSlide" and target in package:
            for _, _, node in _shapes(child(package.xml(target), "cSld", "spTree")):
                ph = next(iter(every(node, "ph")), None)
                if ph is None or attribute(ph, "type", "body") == "body":
                    for p in children(child(node, "txBody"), "p"):
                        text = _paragraph(p, {})
                        if text.strip():
                            yield Element("note", text, section=section, part=target)
        elif kind == "comments" and target in package:
            for cm in every(package.xml(target), "cm"):
                said = child(cm, "text")
                text = "".join([(said.text or "").strip() if said is not None else "", *(t.text or "" for t in every(cm, "t"))])
                who = authors.get(attribute(cm, "authorId"), "")
                if text.strip():
                    yield Element("comment", f"{who}: {text}" if who else text, section=section, part=target)


def read_pptx(package: Package) -> Iterator[Element]:
    """The elements of all slides in the presentation's order: of a slide its layout's own shapes, its shapes by place, charts, notes
    and comments with their authors."""
    links = package.relations("ppt/presentation.xml")
    authors = {attribute(a, "id"): attribute(a, "name") for a in every(package.maybe("ppt/commentAuthors.xml"), "cmAuthor")}
    for k, s in enumerate(children(child(package.xml("ppt/presentation.xml"), "sldIdLst"), "sldId")):
        ids = [v for n, v in s.attrib.items() if n.endswith("}id")]
        target = links.get(ids[0] if ids else "", ("", "", True))[0]
        if target in package:
            yield from _slide(package, target, k, authors)
