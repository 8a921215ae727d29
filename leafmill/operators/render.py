"""Elements of read documents as Markdown, plain text and JSON, one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import latex
from leafmill.operators.structure import let, pipe_table

_NAMELESS = r"(?i)^\s*(sheet|hoja)\s*[0-9]*\s*$"


def _ordered(elements: DataFrame) -> DataFrame:
    """(path, format, items, error): a document's elements in order, in one row. gathered_files() gives such rows as they
    are read; only elements that are rows by themselves must come together by path, which shuffles them."""
    if "items" in elements.columns:
        return elements
    item = F.struct("element", "section", "name", "kind", "level", "text", "rows", "spans", "runs", "part")
    return elements.groupBy("path").agg(F.first("format", ignorenulls=True).alias("format"), F.sort_array(F.collect_list(F.when(F.col("element").isNotNull(), item))).alias("items"), F.first("error", ignorenulls=True).alias("error"))


def _heads(items: str = "items") -> Column:
    """Whether a new section begins at item i, and what it is headed with."""
    x = F.col(items)
    several = F.size(F.array_distinct(F.transform(x, lambda e: e["section"]))) > 1

    def head(several: Column) -> Column:
        def of(e: Column, i: Column) -> Column:
            goes_on = (i > 0) & (F.get(x, i - 1)["section"] == e["section"])
            sheet = F.col("format").isin("xlsx", "xls") & (e["name"] != "") & ~e["name"].rlike(_NAMELESS)
            slide = F.col("format").isin("pptx", "ppt") & several
            return F.when(goes_on, None).when(sheet, F.concat(F.lit("## "), e["name"])).when(slide, F.concat(F.lit("## Slide "), (e["section"] + 1).cast("string")))

        return F.transform(x, of)

    return let(several, head)


def _markdown(e: Column) -> Column:
    return (
        F.when(e["rows"].isNotNull(), pipe_table(F.transform(e["rows"], lambda r: F.transform(r, lambda c: F.regexp_replace(c, "\r?\n", " ")))))
        .when(e["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.least(e["level"], F.lit(6)), F.lit(1))), F.lit(" "), e["text"]))
        .when(e["kind"] == "equation", F.concat(F.lit("$$ "), latex(e["text"]), F.lit(" $$")))
        .when(e["kind"] == "image", F.when(e["text"] != "", e["text"]).otherwise(F.concat(F.lit("![image]("), e["name"], F.lit(")"))))
        .when(e["kind"].isin("header", "footer"), F.concat(F.lit("<!-- "), e["kind"], F.lit(": "), e["text"], F.lit(" -->")))
        .when(e["kind"] == "note", F.concat(F.lit("[^"), e["name"], F.lit("]: "), e["text"])).when(e["kind"] == "comment", F.concat(F.lit("[comment: "), e["text"], F.lit("]"))).otherwise(e["text"])
    )


def to_markdown(elements: DataFrame) -> DataFrame:
    """(path, format, markdown, error) of every document; named sheets and several slides have headings."""
    blocks = F.flatten(F.zip_with(_heads(), "items", lambda h, e: F.array(h, _markdown(e))))
    return _ordered(elements).select("path", "format", F.array_join(F.filter(blocks, lambda b: F.trim(F.coalesce(b, F.lit(""))) != ""), "\n\n").alias("markdown"), "error")


def to_plain_text(elements: DataFrame) -> DataFrame:
    """(path, format, plain, error): tables as tab-separated rows."""
    one = lambda e: F.coalesce(F.array_join(F.transform(e["rows"], lambda r: F.array_join(r, "\t")), "\n"), e["text"])
    return _ordered(elements).select("path", "format", F.array_join(F.transform("items", one), "\n").alias("plain"), "error")


def to_json(elements: DataFrame) -> DataFrame:
    """(path, format, json, error): metadata, elements with their runs, spans and parts, and the pictures and files that they name."""
    count = lambda *k: F.size(F.filter("items", lambda e: e["kind"].isin(*k)))
    meta = F.struct(F.col("format").alias("source_format"), count("paragraph").alias("paragraphs"), count("heading").alias("headings"), count("table").alias("tables"), F.col("error"))
    shown = F.filter("items", lambda e: e["kind"] == "image")
    assets = F.transform(shown, lambda e: F.struct(e["name"].alias("filename"), e["part"].alias("source_path"), e["section"].alias("section")))
    return _ordered(elements).select("path", "format", F.to_json(F.struct(meta.alias("metadata"), F.col("items").alias("elements"), assets.alias("assets"))).alias("json"), "error")


def batch_summary(rendered: DataFrame) -> DataFrame:
    """total, success, failed and success_rate (percent) of rendered documents."""
    failed = F.count_if(F.col("error").isNotNull())
    return rendered.agg(F.count("*").alias("total"), (F.count("*") - failed).alias("success"), failed.alias("failed"), F.round((F.count("*") - failed) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("success_rate"))


def find_all(elements: DataFrame, kind: str) -> DataFrame:
    """The elements of a kind, in order within a document; a kind that there isn't gives none. Headings count as paragraphs."""
    kinds = ("paragraph", "heading") if kind == "paragraph" else (kind,)
    if "items" not in elements.columns:
        return elements.where(F.col("kind").isin(*kinds))
    return elements.select("path", "format", F.explode(F.filter("items", lambda e: e["kind"].isin(*kinds))).alias("e")).select("path", "format", "e.*")


def _empty_cells(e: Column) -> Column:
    """Blank cells of a table, without those that a merged range covers."""
    def covered(r: Column, c: Column) -> Column:
        return F.exists(e["spans"], lambda s: r.between(s["r"], s["r"] + s["row_span"] - 1) & c.between(s["c"], s["c"] + s["col_span"] - 1) & ~((s["r"] == r) & (s["c"] == c)))

    rows = F.transform(e["rows"], lambda row, r: F.size(F.filter(row, lambda x, c: (F.trim(x) == "") & ~F.coalesce(covered(r, c), F.lit(False)))))
    return F.aggregate(F.coalesce(rows, F.array().cast("array<int>")), F.lit(0), lambda a, b: a + b)


def check_quality(elements: DataFrame) -> DataFrame:
    """(path, format, counts, issues, score) of read documents: blank paragraphs, blank cells, equations that could not be read,
    pictures without a file and errors are issues; the score is 100 less their share, and 0 without paragraphs."""
    of = lambda *k: F.filter("items", lambda e: e["kind"].isin(*k))
    counts = {
        "paragraphs": F.size(of("paragraph", "heading")), "tables": F.size(of("table")), "equations": F.size(of("equation")), "images": F.size(of("image")),
        "empty_paragraphs": F.size(F.filter(of("paragraph", "heading"), lambda e: F.trim(F.coalesce(e["text"], F.lit(""))) == "")), "empty_cells": F.aggregate(F.transform(of("table"), _empty_cells), F.lit(0), lambda a, b: a + b),
        "failed_equations": F.size(F.filter(of("equation"), lambda e: (e["text"] == "") | e["text"].rlike("파싱 실패|데이터 부족"))), "missing_images": F.size(F.filter(of("image"), lambda e: F.coalesce(e["part"], F.lit("")) == "")),
        "errors": F.when(F.col("error").isNull(), 0).otherwise(1),
    }
    out = _ordered(elements).select("path", "format", *[c.cast("bigint").alias(k) for k, c in counts.items()])
    issues = sum((F.col(k) for k in ("empty_cells", "failed_equations", "missing_images", "errors")), F.col("empty_paragraphs"))
    total = F.col("paragraphs") + F.col("tables") + F.col("equations") + F.col("images")
    score = F.when(F.col("paragraphs") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - issues / total) * 100)))
    return out.select("*", issues.alias("issues"), score.alias("score"))
