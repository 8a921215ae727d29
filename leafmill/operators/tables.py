"""Operators on sheets and lists: series, used ranges, merged and linked ranges, numbering, inheritance."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.sheets import column_letters, roman


def pivot_series(rows: DataFrame, series: list[str]) -> DataFrame:
    """(category, series, value) as a row for each category with a column for each series."""
    return rows.groupBy("category").pivot("series", series).agg(F.sum("value"))


def used_range(cells: DataFrame) -> DataFrame:
    """The first and last row and column, and the number of cells, of each sheet."""
    return cells.groupBy("sheet").agg(F.min("r").alias("first_row"), F.max("r").alias("last_row"), F.min("c").alias("first_col"), F.max("c").alias("last_col"), F.count("*").alias("cells"))


def _by_row(ranges: DataFrame, by: tuple[str, ...], order: str | None = None) -> DataFrame:
    """For each row of each sheet the ranges that lie in it, so that a range join is an equi-join on rows."""
    part = F.struct(*([F.col(order).alias("n")] if order else []), *[c for c in ranges.columns if c not in (*by, order)])
    rows = ranges.where("r1 >= r0 and c1 >= c0").select(*by, F.explode(F.sequence("r0", "r1")).alias("r"), part.alias("range"))
    return rows.groupBy(*by, "r").agg(F.sort_array(F.collect_list("range")).alias("ranges"))


def _holding(c: str = "c") -> Column:
    return F.filter("ranges", lambda x: F.col(c).between(x["c0"], x["c1"]))


def merge_spans(cells: DataFrame, ranges: DataFrame, by: tuple[str, ...] = ("doc", "sheet")) -> DataFrame:
    """cells (by, r, c, ...) with row_span and col_span: a merged range's first cell has its size, the others 0, all else 1.
    ranges (by, r0, c0, r1, c1) may be several in a row; of two that hold a cell the first by place counts."""
    hit = cells.join(_by_row(ranges, by), [*by, "r"], "left").withColumn("range", F.get(_holding(), 0))
    anchor = (F.col("r") == F.col("range.r0")) & (F.col("c") == F.col("range.c0"))
    span = lambda n: F.when(F.col("range").isNull(), 1).when(anchor, n).otherwise(0).cast("bigint")
    return hit.select(*cells.columns, span(F.col("range.r1") - F.col("range.r0") + 1).alias("row_span"), span(F.col("range.c1") - F.col("range.c0") + 1).alias("col_span"))


def link_ranges(cells: DataFrame, ranges: DataFrame, by: tuple[str, ...] = ("doc", "sheet"), order: str = "ord") -> DataFrame:
    """cells (by, r, c, text, ...), with the target behind the text of those in a linked range (by, order, r0, c0, r1, c1,
    target); a later range overrides, and cells outside stay as they are."""
    hit = cells.join(_by_row(ranges, by, order), [*by, "r"], "left")
    target = F.element_at(_holding(), -1)["target"]
    text = F.when(F.coalesce(F.size(_holding()), F.lit(0)) > 0, F.trim(F.concat(F.coalesce("text", F.lit("")), F.lit(" <"), target, F.lit(">")))).otherwise(F.col("text"))
    return hit.select(*[text.alias("text") if c == "text" else c for c in cells.columns])


#: Format, pattern and first number of each level of a list.
LEVELS = [("decimal", "".join(f"%{j + 1}." for j in range(k + 1)), 1) for k in range(9)]


def _numeral(n: Column, kind: str) -> Column:
    made = {"lowerLetter": F.lower(column_letters(n)), "upperLetter": column_letters(n), "lowerRoman": F.lower(roman(n)), "upperRoman": roman(n), "decimalZero": F.lpad(n.cast("string"), 2, "0")}
    return F.coalesce(made[kind], n.cast("string")) if kind in made else n.cast("string")


#: Items that a task sorts, about 100 bytes each.
TASK_ITEMS = 1 << 20


def number_items(items: DataFrame, levels: list[tuple[str, str, int]] = LEVELS, by: tuple[str, ...] = ("list",)) -> DataFrame:
    """(by, pos, level) with `marker`, such as 2.1.3.: counters start again below a shallower item, and one that has none
    yet shows its first number. Levels are as many as `levels` has. Items at one place count together. There is one shuffle,
    by list and into tasks of about TASK_ITEMS (a list is in one), and one sort, which can go to disk: a counter is how many
    of its level there are so far, less those before the last shallower item."""
    window, level, keys = Window.partitionBy(*by).orderBy(F.col("pos").asc_nulls_last()), F.col("level"), range(len(levels))
    upto, here = window.rangeBetween(Window.unboundedPreceding, Window.currentRow), window.rangeBetween(Window.currentRow, Window.currentRow)
    own = [(level == k).cast("int") for k in keys]
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, items.count() // TASK_ITEMS + 1)
    out = items.select(*by, "pos", "level").repartition(tasks, *by)
    out = out.select("*", *[F.sum(own[k]).over(upto).alias(f"_s{k}") for k in keys], *[F.sum(own[k]).over(here).alias(f"_c{k}") for k in keys[1:]])
    last = lambda k: F.max(F.when(level.between(0, k - 1), F.col(f"_s{k}") - F.coalesce(f"_c{k}", F.lit(0)))).over(upto)
    names = [f"_n{k}" for k in keys]
    out = out.select(*by, "pos", "level", *[(F.col(f"_s{k}") - F.coalesce(last(k), F.lit(0)) if k else F.col("_s0")).alias(n) for k, n in enumerate(names)])
    shown = [_numeral(F.greatest(F.col(n), F.lit(1)) + (start - 1), kind) for n, (kind, _, start) in zip(names, levels)]
    marker = F.lit(None).cast("string")
    for k in reversed(range(len(levels))):
        text = F.lit(levels[k][1])
        for j in range(k + 1):
            text = F.replace(text, F.lit(f"%{j + 1}"), shown[j])
        marker = F.when(F.col("level") == k, text).otherwise(marker)
    return out.select(*by, "pos", "level", marker.alias("marker"))


def first_reference(refs: DataFrame) -> DataFrame:
    """(doc, pos, note): each note's number in the order of first references; ties by note."""
    first = refs.groupBy("doc", "note").agg(F.min("pos").alias("first_pos"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("doc").orderBy("first_pos", "note")).cast("bigint"))


def inherited(styles: DataFrame, by: str = "doc") -> DataFrame:
    """(by, style, level, depth): each style's own level or that of the nearest it is based on, and how far up; styles
    without any are left out, as are those whose chain runs in a circle. A document's styles are a group."""

    def resolve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        of = {r["style"]: (r["based_on"], r["level"]) for r in rows}
        out = []
        for style in of:
            at, depth, seen = style, 0, set()
            while at in of and at not in seen and of[at][1] is None:
                seen.add(at)
                at, depth = of[at][0], depth + 1
            if at in of and of[at][1] is not None:
                out.append((style, of[at][1], depth))
        columns = list(zip(*out)) if out else [(), (), ()]
        kinds = [table.schema.field("style").type, table.schema.field("level").type, pa.int64()]
        return pa.table([pa.array([key[0].as_py()] * len(out), key[0].type), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[by, "style", "level", "depth"])

    kind = {f.name: f.dataType.simpleString() for f in styles.schema}
    return styles.groupBy(by).applyInArrow(resolve, f"{by} {kind[by]}, style {kind['style']}, level {kind['level']}, depth bigint")
