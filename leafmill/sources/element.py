"""What readers of every format yield."""

from __future__ import annotations

from dataclasses import dataclass, field

#: A stretch of text in one form: text, marks (b i u s ^ _ for bold, italic, underlined, struck, raised, lowered) and
#: size in points (0 where it isn't said).
Run = tuple[str, str, float]


@dataclass
class Element:
    """One element of a document: kind is heading, paragraph, table, header, footer, note, comment or sheet data."""

    kind: str
    text: str = ""
    level: int = 0
    rows: list[list[str]] | None = None
    section: int = 0
    name: str = ""
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)
    #: Where it comes from: a part of a package, a stream of a compound file.
    part: str = ""
    runs: list[Run] = field(default_factory=list)
