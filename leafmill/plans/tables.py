"""Queries over sheets, references, numbering and number formats, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import sheets as X
from leafmill.operators import tables as O


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chart_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Series by return flag over months."""
    rows = _table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("category"), F.lower("l_returnflag").alias("series"), F.col("l_quantity").alias("value"))
    return O.pivot_series(rows, ["a", "n", "r"])


def used_ranges(spark: SparkSession, sf: str) -> DataFrame:
    cells = _table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sheet"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").cast("bigint").alias("c"))
    return O.used_range(cells)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of orders as cells: two documents of two sheets, a row for each order."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    rows = _table(spark, sf, "lineitem").select((k % 2).alias("doc"), F.concat(F.lit("s"), (k % 3 % 2).cast("string")).alias("sheet"), F.floor(k / 6).alias("r"), line.alias("c"), F.col("l_partkey").cast("string").alias("text"))
    return rows.groupBy("doc", "sheet", "r", "c").agg(F.min("text").alias("text"))


def _places(k: Column) -> list[Column]:
    return [(k % 2).alias("doc"), F.concat(F.lit("s"), (k % 3 % 2).cast("string")).alias("sheet")]


def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranges in each row: columns 1 and 2, and from 4 to 6 over two rows for every fourth."""
    k = F.col("o_orderkey")
    rows = _table(spark, sf, "orders").select(*_places(k), F.floor(k / 6).alias("r0")).distinct()
    two = F.array(F.struct(F.lit(1).alias("c0"), F.lit(2).alias("c1"), F.lit(0).alias("more")), F.when(F.col("r0") % 4 == 0, F.struct(F.lit(4).alias("c0"), F.lit(6).alias("c1"), F.lit(1).alias("more"))))
    ranges = rows.select("*", F.explode(two).alias("x")).where("x is not null")
    return O.merge_spans(_cells(spark, sf), ranges.select("doc", "sheet", "r0", F.col("x.c0").cast("bigint").alias("c0"), (F.col("r0") + F.col("x.more")).alias("r1"), F.col("x.c1").cast("bigint").alias("c1")))


def linked_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer links a block of five rows and two columns, and then one of two rows in the middle of it."""
    k = F.col("c_custkey")
    block = F.explode(F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for n, a, b, w in ((0, 0, 4, 2), (1, 1, 2, 3))]))
    ranges = _table(spark, sf, "customer").select(*_places(k), k, "c_name", block.alias("x"))
    target = F.concat("c_name", F.lit("/"), F.col("x.ord"))
    return O.link_ranges(_cells(spark, sf), ranges.select("doc", "sheet", (k * 2 + F.col("x.ord")).alias("ord"), (k * 2 + F.col("x.a")).alias("r0"), (k * 2 + F.col("x.b")).alias("r1"), F.lit(1).cast("bigint").alias("c0"), F.col("x.w").cast("bigint").alias("c1"), target.alias("target")))


def cell_references(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey") % 18278 + 1
    ref = X.reference(F.col("p_size"), n)
    return _table(spark, sf, "part").select("p_partkey", ref.alias("ref"), X.column_of(ref).alias("col_no"), X.row_of(ref).alias("row_no"))


def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    v, s = F.col("l_extendedprice") - 50000, F.col("l_quantity") + F.col("l_discount")
    return _table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", X.fixed(v, 2).alias("decimal"), X.fixed(v, 0, True).alias("thousands"), F.concat(X.fixed(F.col("l_discount") * 100, 1), F.lit("%")).alias("percent"),
        X.currency(v).alias("currency"), X.serial_date(F.col("l_partkey") + 40000).alias("date"), X.clock(s).alias("time"), X.duration(s).alias("duration"),
    )


def roman_markers(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select("p_partkey", X.roman(F.col("p_partkey") % 4200).alias("roman"), F.lower(X.column_letters(F.col("p_partkey") % 800 + 1)).alias("letter"))


def list_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order are list items; quantity gives one of five levels, each with a format of its own."""
    items = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity").cast("int") % 5).alias("level"))
    return O.number_items(items, _FORMATS)


def first_references(spark: SparkSession, sf: str) -> DataFrame:
    """Notes are numbered by where each is first referred to: suppliers along an order's lines."""
    refs = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("note"))
    return O.first_reference(refs)


def style_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as styles, each based on the one at half its number; regions give the levels."""
    styles = _table(spark, sf, "nation").select(F.lit(1).alias("doc"), F.col("n_nationkey").alias("style"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("based_on"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey")).alias("level"))
    return O.inherited(styles)


def sheet_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Events as record offsets: each ends where the user's next begins."""
    rows = _table(spark, sf, "events").select("user_id", "event_id")
    return rows.withColumn("end_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))


_FORMATS = [("decimal", "%1.", 1), ("lowerLetter", "%1.%2)", 1), ("lowerRoman", "(%3)", 3), ("decimalZero", "%1-%4", 1), ("upperRoman", "%5 of %2", 1)]

QUERIES = {f.__name__: f for f in (chart_pivot, used_ranges, merged_cells, linked_cells, cell_references, number_formats, roman_markers, list_numbering, first_references, style_chain, sheet_ends)}


def _fixed(v: str, places: int, commas: bool = False) -> str:
    u = f"CAST(round(abs({v}) * {10**places}) AS BIGINT)"
    whole = f"({u} // {10**places})"
    text = rf"regexp_replace(reverse(regexp_replace(reverse({whole}::VARCHAR), '([0-9]{{3}})', '\1,', 'g')), '^,', '')" if commas else f"{whole}::VARCHAR"
    if places:
        text += f" || '.' || lpad(({u} % {10**places})::VARCHAR, {places}, '0')"
    return f"CASE WHEN {v} < 0 AND {u} > 0 THEN '-' ELSE '' END || {text}"


_V, _S = "(l_extendedprice - 50000)", "(l_quantity + l_discount)"
_T = f"CAST(round(({_S} - floor({_S})) * 86400) AS BIGINT) % 86400"
_D = f"CAST(round(abs({_S}) * 86400) AS BIGINT)"
_HMS = lambda t, h: f"({h}) || ':' || lpad(((({t}) // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((({t}) % 60)::VARCHAR, 2, '0')"
_LET = lambda n: f"CASE WHEN {n} <= 26 THEN chr(CAST({n} + 64 AS INT)) WHEN {n} <= 702 THEN chr(CAST(({n} - 27) // 26 + 65 AS INT)) || chr(CAST(({n} - 27) % 26 + 65 AS INT)) ELSE chr(CAST(({n} - 703) // 676 + 65 AS INT)) || chr(CAST((({n} - 703) // 26) % 26 + 65 AS INT)) || chr(CAST(({n} - 703) % 26 + 65 AS INT)) END"
_CELL = "c AS (SELECT l_orderkey % 2 AS doc, 's' || l_orderkey % 3 % 2 AS sheet, l_orderkey // 6 AS r, l_linenumber::BIGINT AS c, min(l_partkey::VARCHAR) AS text FROM lineitem GROUP BY ALL)"
_MERGED = """k AS (SELECT DISTINCT o_orderkey % 2 AS doc, 's' || o_orderkey % 3 % 2 AS sheet, o_orderkey // 6 AS r0 FROM orders),
    m AS (SELECT doc, sheet, r0, 1 AS c0, r0 AS r1, 2 AS c1 FROM k UNION ALL SELECT doc, sheet, r0, 4, r0 + 1, 6 FROM k WHERE r0 % 4 = 0)"""
_NUM = {"decimal": "{0}::VARCHAR", "lowerLetter": "chr(CAST(96 + {0} AS INT))", "lowerRoman": "['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii'][CAST({0} AS INT)]", "decimalZero": "lpad({0}::VARCHAR, 2, '0')", "upperRoman": "upper(['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii'][CAST({0} AS INT)])"}


def _numbering() -> str:
    steps, names = ["i AS (SELECT l_orderkey AS list, l_linenumber AS pos, CAST(l_quantity AS INT) % 5 AS level FROM lineitem)"], []
    for k in range(5):
        steps.append(f"a{k} AS (SELECT *, sum((level = {k})::INT) OVER (PARTITION BY {', '.join(['list', *names])} ORDER BY pos) AS n{k} FROM {'i' if not k else f'a{k - 1}'})")
        names.append(f"n{k}")
    shown = [_NUM[kind].format(f"(greatest(n{k}, 1) + {start - 1})") for k, (kind, _, start) in enumerate(_FORMATS)]
    cases = []
    for k, (_, pattern, _) in enumerate(_FORMATS):
        text = f"'{pattern}'"
        for j in range(k + 1):
            text = f"replace({text}, '%{j + 1}', {shown[j]})"
        cases.append(f"WHEN level = {k} THEN {text}")
    return f"WITH {', '.join(steps)} SELECT list, pos, level, CASE {' '.join(cases)} END AS marker FROM a4"


ORACLE_SQL = {
    "chart_pivot": "SELECT strftime(l_shipdate, '%Y-%m') AS category, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1",
    "used_ranges": "SELECT l_returnflag AS sheet, min(l_orderkey) AS first_row, max(l_orderkey) AS last_row, min(l_linenumber)::BIGINT AS first_col, max(l_linenumber)::BIGINT AS last_col, count(*) AS cells FROM lineitem GROUP BY 1",
    "merged_cells": f"WITH {_CELL}, {_MERGED}, h AS (SELECT c.*, m.r0, m.c0, m.r1, m.c1 FROM c LEFT JOIN m ON m.doc = c.doc AND m.sheet = c.sheet AND c.r BETWEEN m.r0 AND m.r1 AND c.c BETWEEN m.c0 AND m.c1) SELECT doc, sheet, r, c, text, CASE WHEN r0 IS NULL THEN 1 WHEN r = r0 AND c = c0 THEN r1 - r0 + 1 ELSE 0 END::BIGINT AS row_span, CASE WHEN r0 IS NULL THEN 1 WHEN r = r0 AND c = c0 THEN c1 - c0 + 1 ELSE 0 END::BIGINT AS col_span FROM h",
    "linked_cells": f"""WITH {_CELL}, k AS (SELECT c_custkey % 2 AS doc, 's' || c_custkey % 3 % 2 AS sheet, c_custkey * 2 + ord AS ord, c_custkey * 2 + a AS r0, c_custkey * 2 + b AS r1, w AS c1, c_name || '/' || ord AS target FROM customer, (VALUES (0, 0, 4, 2), (1, 1, 2, 3)) AS v(ord, a, b, w)),
        h AS (SELECT c.doc, c.sheet, r, c, any_value(text) AS text, arg_max(target, ord) AS target FROM c LEFT JOIN k ON k.doc = c.doc AND k.sheet = c.sheet AND r BETWEEN r0 AND r1 AND c BETWEEN 1 AND c1 GROUP BY c.doc, c.sheet, r, c) SELECT doc, sheet, r, c, CASE WHEN target IS NULL THEN text ELSE text || ' <' || target || '>' END AS text FROM h""",
    "cell_references": f"WITH p AS (SELECT p_partkey, p_size, p_partkey % 18278 + 1 AS n FROM part) SELECT p_partkey, {_LET('n')} || p_size AS ref, n AS col_no, p_size::BIGINT AS row_no FROM p",
    "number_formats": f"SELECT l_orderkey, l_linenumber, {_fixed(_V, 2)} AS decimal, {_fixed(_V, 0, True)} AS thousands, {_fixed('(l_discount * 100)', 1)} || '%' AS percent, CASE WHEN {_V} < 0 THEN '(' ELSE '' END || '$' || {_fixed(f'abs({_V})', 2, True)} || CASE WHEN {_V} < 0 THEN ')' ELSE '' END AS currency, strftime(DATE '1899-12-30' + CAST(l_partkey + 40000 AS INT), '%Y-%m-%d') AS date, {_HMS(_T, f'lpad((({_T}) // 3600)::VARCHAR, 2, chr(48))')} AS time, {_HMS(_D, f'(({_D}) // 3600)::VARCHAR')} AS duration FROM lineitem",
    "roman_markers": f"""WITH p AS (SELECT p_partkey, p_partkey % 4200 AS n, p_partkey % 800 + 1 AS m FROM part) SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 3999 THEN ['', 'M', 'MM', 'MMM'][n // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1]
        || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] END AS roman, lower({_LET('m')}) AS letter FROM p""",
    "list_numbering": _numbering(),
    "first_references": "WITH f AS (SELECT l_orderkey AS doc, l_suppkey AS note, min(l_linenumber) AS first_pos FROM lineitem GROUP BY ALL) SELECT doc, note, first_pos, row_number() OVER (PARTITION BY doc ORDER BY first_pos, note) AS number FROM f",
    "style_chain": """WITH RECURSIVE s AS (SELECT n_nationkey AS style, CASE WHEN n_nationkey > 0 THEN CAST(n_nationkey // 2 AS INT) END AS based_on, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey END AS level FROM nation),
        w AS (SELECT style, based_on, level, 0 AS depth FROM s UNION ALL SELECT w.style, s.based_on, s.level, w.depth + 1 FROM w JOIN s ON s.style = w.based_on WHERE w.level IS NULL) SELECT 1 AS doc, style, level, depth::BIGINT AS depth FROM w WHERE level IS NOT NULL""",
    "sheet_ends": "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS end_id FROM events",
}
