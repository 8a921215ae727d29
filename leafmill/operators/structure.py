"""Structure recovery: headings, tables, key-value lists and paragraphs from the lines of plain text.

Classing and grouping lines is a fold over a document's lines, which are in one row: an Arrow UDF does
it in one pass. With windows over exploded lines every line of the corpus would be shuffled; with
array functions the optimizer repeats the split in each of them. What is made of the blocks is built
from array functions in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import HEADING_LABEL, ISO_DATE, KEY_VALUE, SEPARATOR_CELL, UNDERLINE, blank, col

_RULE, _SEPARATOR, _PAIR, _DATE, _LABEL = (re.compile(p, re.ASCII) for p in (UNDERLINE, SEPARATOR_CELL, KEY_VALUE, ISO_DATE, HEADING_LABEL))
_OUTER, _PARTS, _ENDS = re.compile(r"^\||\|$"), re.compile(r"[\t|]"), re.compile("\r\n?")
_BLOCK = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])
_BLOCKS = "array<struct<kind:string,first:int,text:string,rows:array<array<string>>>>"


def cells(line: str) -> list[str]:
    """The trimmed parts of a line between tabs or pipes, without the outer pipes."""
    return [x.strip(" ") for x in _PARTS.split(_OUTER.sub("", line.strip(" ")))]


def classes(lines: list[str]) -> list[str]:
    """blank, rule (a line that underlines a heading), heading, table, pair or text, for each line."""
    rules = [line[:1] in " \t=-" and bool(_RULE.match(line)) for line in lines]
    out = []
    for i, line in enumerate(lines):
        if not line.strip(" "):
            out.append("blank")
        elif rules[i] and i and lines[i - 1].strip(" ") and not rules[i - 1]:
            out.append("rule")
        elif not rules[i] and i + 1 < len(lines) and rules[i + 1]:
            out.append("heading")
        elif ("|" in line or "\t" in line) and len(cells(line)) > 1:
            out.append("table")
        elif (m := _PAIR.match(line)) and not _DATE.match(m[1]) and not _LABEL.match(m[1]) and not m[2].startswith("//"):
            out.append("pair")
        else:
            out.append("text")
    return out


def parse(text: str) -> list[dict[str, object]]:
    """The blocks of a text in order: kind, first line, its text, and rows for tables and pairs. Two or
    more key-value lines in a row are pairs; one alone is text."""
    lines = _ENDS.sub("\n", text).split("\n")
    kinds = classes(lines)
    out: list[dict[str, object]] = []
    i = 0
    while i < len(lines):
        end = i + 1
        kind = kinds[i]
        if kind in ("table", "pair"):
            while end < len(lines) and kinds[end] == kind:
                end += 1
        if kind == "table":
            rows = [r for r in map(cells, lines[i:end]) if not all(_SEPARATOR.match(x) for x in r)]
            out.append({"kind": kind, "first": i, "text": None, "rows": rows})
        elif kind == "pair" and end - i > 1:
            rows = [[m[1].strip(" "), m[2].strip(" ")] for m in map(_PAIR.match, lines[i:end])]
            out.append({"kind": kind, "first": i, "text": None, "rows": rows})
        elif kind not in ("blank", "rule"):
            out.append({"kind": "text" if kind == "pair" else kind, "first": i, "text": lines[i].strip(" "), "rows": None})
        i = end
    return out


#: Characters of text whose lines or blocks are objects at once.
SLICE = 1 << 19


def _by_slice(texts: pa.Array, make: Callable[[str], list], kind: pa.DataType) -> pa.Array:
    """make() of each text, of a null as of an empty one. As objects, blocks are many times their text: those of a slice become an
    array before the next is begun."""
    parts, made, held = [], [], 0
    for t in texts:
        text = t.as_py() or ""
        made.append(make(text))
        held += len(text)
        if held >= SLICE:
            parts.append(pa.array(made, pa.list_(kind)))
            made, held = [], 0
    return pa.concat_arrays([*parts, pa.array(made, pa.list_(kind))])


def classed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `classes`, the class of each line; none for a null text."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return _by_slice(texts, lambda t: classes(_ENDS.sub("\n", t).split("\n")), pa.string())

    return df.withColumn("classes", found(col(text)))


def blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `blocks`, as parse() has them; a null text has none."""

    @F.arrow_udf(_BLOCKS)
    def found(texts: pa.Array) -> pa.Array:
        return _by_slice(texts, parse, _BLOCK)

    return df.withColumn("blocks", found(col(text)))


def kinds(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `kinds`, the kind of each of its blocks, without what they hold."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return _by_slice(texts, lambda t: [b["kind"] for b in parse(t)], pa.string())

    return df.withColumn("kinds", found(col(text)))


#: Cells of a table up to which its rows are padded to the widest; a larger one is mostly blank, and rows end as they do.
PADDED_CELLS = 4_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pipe_table(rows: Column) -> Column:
    """Rows as a Markdown table, padded to the widest; pipes in cells are escaped; null without rows."""
    def line(parts: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))

    def row(r: Column, width: Column) -> Column:
        own = F.transform(r, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")))
        return line(F.concat(own, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.when(F.size(r) == 0, 1).otherwise(0)))))

    def whole(width: Column) -> Column:
        head = line(F.array_repeat(F.lit("---"), F.greatest(F.array_max(F.transform(F.slice(rows, 1, 1), F.size)), width)))
        return F.array_join(F.flatten(F.transform(rows, lambda r, k: F.when(k == 0, F.array(row(r, width), head)).otherwise(F.array(row(r, width))))), "\n")

    widest = F.array_max(F.transform(rows, F.size))
    return F.when(F.size(rows) > 0, let(F.when(widest.cast("bigint") * F.size(rows) <= PADDED_CELLS, widest).otherwise(0), whole))


def markdown(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `markdown`: blocks joined by blank lines."""
    one = lambda b: F.when(b["kind"] == "heading", F.concat(F.lit("# "), b["text"])).when(b["kind"] == "text", b["text"]).otherwise(pipe_table(b["rows"]))
    return blocks(df, text).withColumn("markdown", F.array_join(F.filter(F.transform("blocks", one), lambda x: ~blank(F.coalesce(x, F.lit("")))), "\n\n"))


def plain(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `plain`: paragraphs and headings as they are, tables as tab-separated rows."""
    one = lambda b: F.coalesce(b["text"], F.array_join(F.transform(b["rows"], lambda r: F.array_join(r, "\t")), "\n"))
    return blocks(df, text).withColumn("plain", F.array_join(F.transform("blocks", one), "\n"))


def json_tree(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with `json`: metadata and elements in order; tables have rows, others text."""
    kind = lambda b: F.when(b["kind"].isin("table", "pair"), "table").when(b["kind"] == "heading", "heading").otherwise("paragraph")
    count = lambda t: F.size(F.filter("blocks", lambda b: kind(b) == t)).alias(f"{t}s")
    elements = F.transform("blocks", lambda b: F.struct(kind(b).alias("type"), b["text"].alias("text"), b["rows"].alias("rows")))
    return blocks(df, text).withColumn("json", F.to_json(F.struct(F.col(key).alias("id"), F.struct(count("paragraph"), count("heading"), count("table")).alias("metadata"), elements.alias("elements"))))
