"""Queries over the structure of plain text, and their SQL, which groups exploded lines with windows instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import structure as S


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(*(columns or ("doc_id", "text")))


def doc_markdown_render(spark: SparkSession, sf: str) -> DataFrame:
    return S.markdown(_docs(spark, sf)).select("doc_id", "markdown")


def doc_plain_render(spark: SparkSession, sf: str) -> DataFrame:
    return S.plain(_docs(spark, sf)).select("doc_id", "plain")


def doc_line_classes(spark: SparkSession, sf: str) -> DataFrame:
    return S.classed(_docs(spark, sf)).select("doc_id", F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def doc_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = S.blocks(_docs(spark, sf)).select("doc_id", F.explode(F.filter("blocks", lambda b: b["kind"].isin("table", "pair"))).alias("b"))
    rows = found.select("doc_id", "b.first", "b.kind", "b.rows")
    return rows.select("doc_id", F.col("first").cast("bigint").alias("first_line"), "kind", F.size("rows").cast("bigint").alias("n_rows"), F.array_max(F.transform("rows", F.size)).cast("bigint").alias("n_cols"))


def doc_key_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.posexplode(T.lines("text")).alias("line_no", "line")).where(T.is_key_value(F.col("line")) & ~T.is_table_line(F.col("line")))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.trim(T.key_of(F.col("line"))).alias("key"), T.value_of(F.col("line")).alias("value"))


def list_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a list are made of words: each gets one of the marker forms by its number."""
    forms = ["• ", "(7) ", "3) ", "12. ", "a) ", "iv. ", "① ", "☑ ", "□ ", "[x] ", ""]
    rows = _docs(spark, sf).select("doc_id", F.posexplode(T.lines("text")).alias("n", "line"))
    marked = rows.select("doc_id", "n", F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("n") % len(forms) + 1).cast("int")), F.trim("line")).alias("line"))
    return marked.select("doc_id", F.col("n").cast("bigint").alias("line_no"), F.coalesce(T.normal_marker("line"), "line").alias("line"))


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.normalized("text").alias("normal"))


def doc_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", *T.profile("text"))


def find_elements(spark: SparkSession, sf: str) -> DataFrame:
    kinds = S.kinds(_docs(spark, sf)).select("doc_id", F.explode("kinds").alias("kind"))
    return kinds.groupBy("doc_id").agg(*[F.count_if(F.col("kind").isin(*k)).alias(n) for n, k in {"paragraphs": ["text"], "headings": ["heading"], "tables": ["table", "pair"]}.items()])


def equation_latex(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.read.parquet(f"{sf}/part.parquet")
    script = F.concat(F.lit("{alpha + "), F.col("p_size"), F.lit("} over {beta} times sqrt {"), F.col("p_partkey"), F.lit("} leq sum x"))
    return r.select("p_partkey", T.latex(script).alias("latex"))


QUERIES = {f.__name__: f for f in (doc_markdown_render, doc_plain_render, doc_line_classes, doc_tables, doc_key_values, list_markers, text_normalize, doc_profile, find_elements, equation_latex)}

_KV = r"^\s*([^:：=＝|\t]{1,80}?)\s*[:：=＝]\s*(\S.*)$"
_CELLS = r"list_transform(string_split_regex(regexp_replace(trim(line), '^\||\|$', '', 'g'), '[\t|]'), lambda x: trim(x))"
_LINES = rf"""
    l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l1 AS (SELECT doc_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS n FROM l0),
    l2 AS (SELECT *, coalesce(lag(line) OVER w, '') AS before, coalesce(lead(line) OVER w, '') AS after, {_CELLS} AS cells, regexp_matches(line, '^\s*(={{3,}}|-{{3,}})\s*$') AS is_rule,
        regexp_extract(line, '{_KV}', 1) AS k, trim(regexp_extract(line, '{_KV}', 2)) AS v FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    l3 AS (SELECT *, regexp_matches(line, '{_KV}') AND NOT regexp_matches(k, '^\s*\d{{4}}-\d{{2}}-\d{{2}}') AND NOT regexp_matches(k, '(?i)^\s*(title|heading\s*[0-9]*)\s*$') AND NOT starts_with(v, '//') AS is_pair FROM l2),
    l4 AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN is_rule AND trim(before) <> '' AND NOT regexp_matches(before, '^\s*(={{3,}}|-{{3,}})\s*$') THEN 'rule'
        WHEN NOT is_rule AND regexp_matches(after, '^\s*(={{3,}}|-{{3,}})\s*$') THEN 'heading' WHEN len(cells) > 1 THEN 'table' WHEN is_pair THEN 'pair' ELSE 'text' END AS class FROM l3),
    l5 AS (SELECT *, CASE WHEN class IN ('table', 'pair') AND lag(class) OVER (PARTITION BY doc_id ORDER BY n) = class THEN 0 ELSE 1 END AS new FROM l4),
    l6 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l5),
    l7 AS (SELECT *, CASE WHEN class = 'pair' AND count(*) OVER (PARTITION BY doc_id, island) < 2 THEN 'text' ELSE class END AS kind,
        len(cells) > 1 AND len(list_filter(cells, lambda x: NOT regexp_matches(x, '^\s*:?-{{3,}}:?\s*$'))) = 0 AS is_sep FROM l6),
    l8 AS (SELECT *, CASE WHEN kind = 'table' THEN cells WHEN kind = 'pair' THEN [trim(k), v] END AS row, kind IN ('table', 'pair') AND NOT (kind = 'table' AND is_sep) AS has_row FROM l7 WHERE class NOT IN ('blank', 'rule'))"""

_RENDER = rf"""
    WITH {_LINES},
    r1 AS (SELECT *, max(CASE WHEN has_row THEN len(row) END) OVER (PARTITION BY doc_id, island) AS width, row_number() OVER (PARTITION BY doc_id, island, has_row ORDER BY n) AS nth FROM l8),
    r2 AS (SELECT doc_id, island, n, kind, has_row, nth, width, CASE WHEN has_row THEN '| ' || array_to_string(list_transform(range(1, width + 1), lambda i: replace(coalesce(row[i], ''), '|', '\|')), ' | ') || ' |'
        || CASE WHEN nth = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(1, width + 1), lambda i: '---'), ' | ') || ' |' ELSE '' END
        WHEN kind = 'heading' THEN '# ' || trim(line) WHEN kind = 'text' THEN trim(line) END AS md FROM r1),
    r3 AS (SELECT doc_id, island, string_agg(md, chr(10) ORDER BY n) AS md FROM r2 GROUP BY ALL)
    SELECT d.doc_id, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY island), '') AS markdown FROM documents d LEFT JOIN r3 USING (doc_id) GROUP BY d.doc_id"""

_PLAIN = rf"""
    WITH {_LINES},
    p AS (SELECT doc_id, n, island, CASE WHEN kind IN ('table', 'pair') THEN CASE WHEN has_row THEN array_to_string(row, chr(9)) END ELSE trim(line) END AS line FROM l8),
    q AS (SELECT doc_id, island, coalesce(string_agg(line, chr(10) ORDER BY n), '') AS line FROM p GROUP BY ALL)
    SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY island), '') AS plain FROM documents d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id"""

_FORMS = "['• ', '(7) ', '3) ', '12. ', 'a) ', 'iv. ', '① ', '☑ ', '□ ', '[x] ', '']"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _chain(start: str, steps: list[tuple[str, str]]) -> str:
    for p, r in steps:
        start = f"regexp_replace({start}, '{_sql(p)}', '{_sql(r).replace('$', chr(92))}', 'g')"
    return start


_MARKED = "CASE " + " ".join(f"WHEN regexp_matches(line, '{_sql(p)}') THEN regexp_replace(line, '{_sql(p)}', '{r.replace('$', chr(92))}', 'g')" for p, r in T.LIST_MARKERS) + " ELSE line END"
_COUNTS = ", ".join(f"CAST(len(regexp_extract_all(text, '{_sql(p)}')) AS BIGINT) AS {k}" for k, p in T.PROFILE.items())

ORACLE_SQL = {
    "doc_markdown_render": _RENDER,
    "doc_plain_render": _PLAIN,
    "doc_line_classes": f"WITH {_LINES} SELECT class, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l4 GROUP BY class",
    "doc_tables": f"WITH {_LINES} SELECT doc_id, first_line, kind, n_rows, n_cols FROM (SELECT doc_id, island, kind, min(n) AS first_line, CAST(count_if(has_row) AS BIGINT) AS n_rows, max(CASE WHEN has_row THEN len(row) END) AS n_cols FROM l8 WHERE kind IN ('table', 'pair') GROUP BY ALL)",
    "doc_key_values": f"WITH {_LINES} SELECT doc_id, n AS line_no, trim(k) AS key, v AS value FROM l3 WHERE is_pair AND len(cells) <= 1",
    "list_markers": rf"WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l1 AS (SELECT doc_id, unnest(ls) AS raw, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no FROM l0), l2 AS (SELECT doc_id, line_no, {_FORMS}[line_no % 11 + 1] || trim(raw) AS line FROM l1) SELECT doc_id, line_no, {_MARKED} AS line FROM l2",
    "text_normalize": f"SELECT doc_id, trim({_chain('text', T.NORMAL_STEPS)}) AS normal FROM documents",
    "doc_profile": rf"SELECT doc_id, {_COUNTS}, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS BIGINT) AS unique_tokens FROM documents",
    "find_elements": f"WITH {_LINES}, e AS (SELECT DISTINCT doc_id, island, kind FROM l8) SELECT doc_id, CAST(count_if(kind = 'text') AS BIGINT) AS paragraphs, CAST(count_if(kind = 'heading') AS BIGINT) AS headings, CAST(count_if(kind IN ('table', 'pair')) AS BIGINT) AS tables FROM e GROUP BY doc_id",
    "equation_latex": r"SELECT p_partkey, '\frac{\alpha + ' || p_size || '}{\beta} \times \sqrt{' || p_partkey || '} \leq \sum x' AS latex FROM part",
}
