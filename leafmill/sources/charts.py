"""Charts of office packages as tables: categories down, series across."""

from __future__ import annotations

from collections.abc import Iterator

from leafmill.sources.element import Element
from leafmill.sources.package import Package, attribute, child, children, every


def _points(node: object) -> dict[int, str]:
    """Cached points by index."""
    return {int(attribute(p, "idx", "0")): (child(p, "v").text or "").strip() for p in every(node, "pt") if child(p, "v") is not None}


def chart(package: Package, part: str, section: int = 0) -> Element | None:
    """A chart part as a table element named by its title; None without series. A category that only some
    series have is a row too; one without a name has its number."""
    root = package.xml(part)
    title = "".join(t.text or "" for t in every(child(root, "chart", "title"), "t"))
    series = []
    for k, s in enumerate(every(root, "ser")):
        name = "".join(_points(child(s, "tx")).values()) or "".join(v.text or "" for v in every(child(s, "tx"), "v")) or f"Series {k + 1}"
        labels = _points(child(s, "cat") if child(s, "cat") is not None else child(s, "xVal"))
        values = _points(child(s, "val") if child(s, "val") is not None else child(s, "yVal"))
        series.append((name, labels, values))
    if not series:
        return None
    places = sorted({i for _, a, b in series for i in (*a, *b)})
    label = lambda i: next((a[i] for _, a, _ in series if a.get(i)), str(i + 1))
    rows = [["", *(n for n, _, _ in series)], *([label(i), *(b.get(i, "") for _, _, b in series)] for i in places)]
    return Element("table", rows=rows, section=section, name=title, part=part)


def charts_of(package: Package, part: str, section: int = 0) -> Iterator[Element]:
    """The charts that a part refers to, itself or through its drawings."""
    for target, kind, external in package.relations(part).values():
        if external or target not in package:
            continue
        if kind == "drawing":
            yield from charts_of(package, target, section)
        elif kind == "chart":
            found = chart(package, target, section)
            if found is not None:
                yield found


def _picture(package: Package, node: object, links: dict[str, tuple[str, str, bool]]) -> str:
    """The first picture in a shape as a Markdown reference with its description or name."""
    blip = next(iter(every(node, "blip")), None)
    target = links.get(attribute(blip, "embed"), ("",))[0] if blip is not None else ""
    own = next(iter(every(node, "cNvPr")), None)
    label = next((t for k in ("descr", "title", "name") if own is not None and (t := attribute(own, k))), "image")
    return f"![{label}]({target})" if target else ""


def drawings_of(package: Package, part: str, section: int = 0) -> Iterator[Element]:
    """What is drawn on a sheet: texts, pictures and charts by the row and column that they begin at; then pictures of the
    older kind of drawing."""
    relations = package.relations(part).values()
    for target in [t for t, kind, external in relations if kind == "drawing" and not external and t in package]:
        root, links = package.xml(target), package.relations(target)
        placed: list[tuple[int, int, int, Element]] = []
        shown: set[str] = set()
        for anchor in [*children(root, "twoCellAnchor"), *children(root, "oneCellAnchor")]:
            at = [int(x.text) if (x := child(anchor, "from", k)) is not None and (x.text or "").strip().isdigit() else 0 for k in ("row", "col")]
            found = []
            for body in every(anchor, "txBody"):
                lines = ["".join(t.text or "" for t in every(p, "t")).strip() for p in children(body, "p")]
                if any(lines):
                    found.append(Element("paragraph", "\n".join(x for x in lines if x), section=section, part=target))
            if picture := _picture(package, anchor, links):
                found.append(Element("image", picture, section=section, name=picture.rpartition("/")[2].rstrip(")"), part=target))
            for c in every(anchor, "chart"):
                own = links.get(attribute(c, "id"), ("", "", True))[0]
                made = chart(package, own, section) if own in package else None
                shown.add(own)
                if made is not None:
                    found.append(made)
            placed += [(*at, len(placed) + k, e) for k, e in enumerate(found)]
        yield from (x[3] for x in sorted(placed, key=lambda x: x[:3]))
        for own in [t for t, kind, _ in links.values() if kind == "chart" and t in package and t not in shown]:  # without a place
            made = chart(package, own, section)
            if made is not None:
                yield made
    for target in [t for t, kind, external in relations if kind == "vmlDrawing" and not external and t in package]:
        links = package.relations(target)
        for image in every(package.xml(target), "imagedata"):
            file = links.get(attribute(image, "relid"), ("",))[0]
            if file:
                yield Element("image", f"![{attribute(image, 'title') or 'image'}]({file})", section=section, name=file.rpartition("/")[2], part=target)
