"""Queries over benchmarks of converters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import fixtures as X
from leafmill.operators import scoring as S


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as the output of a converter (its source) for a file."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    k = F.col("doc_id")
    head = F.concat(F.lit("# "), "source", F.lit("\n## Sheet 1\n| id | "), "lang", F.lit(" |\n| --- | --- |\n| "), k, F.lit(" | "), "n_chars", F.lit(" |\n| nan |  |\n![](Shape3.png) ![fig](a/b.png) <https://x.org/"), k, F.lit("> [comment 1: x] [bookmark: y] (=A"), k % 7, F.lit(")\n"))
    text = F.concat(*[F.when(k % 2 == n, F.repeat(F.lit(x), (k % 5).cast("int"))).otherwise("") for n, x in enumerate(("## More\n", "| a | b |\n"))], "text")
    output = F.when(k % 50 == 0, "").otherwise(F.concat(head, text))
    return d.select(F.col("source").alias("converter"), F.concat(F.lit("in/f"), (k % 40).cast("string")).alias("file"), F.col("lang").alias("format"), "doc_id", "n_chars", output.alias("output"))


def _expectations() -> list[Column]:
    k = F.col("doc_id")
    text = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    return [
        F.when(k % 3 > 0, text(F.col("format"), F.concat(F.lit("absent"), k))).alias("expected_text"), F.when(k % 4 > 0, text(F.concat(F.lit("# "), "converter"), "| id |", "no (such)")).alias("expected_markdown"),
        F.when(k % 3 > 0, F.array(F.array(text("id", F.col("format")), text(k.cast("string"), "a.b"), text(" ", "12 3")))).alias("expected_tables"),
        F.when(k % 3 > 0, F.array(text(k.cast("string"), F.concat(F.lit(" "), "n_chars")), text("x"))).alias("expected_table_rows"), F.when(k % 3 > 0, text("media/a.png")).alias("expected_assets"),
        F.when(k % 100 == 0, True).alias("expected_empty"), F.when(k % 2 > 0, text("media/a.png", "media/b.png")).alias("asset_paths"),
    ]


def output_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", *S.profile_output("output"))


def output_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = S.score_output(_docs(spark, sf).select("*", *_expectations()))
    return found.select("doc_id", *[c for c in found.columns if c.endswith(("_total", "_found"))], F.round("accuracy", 9).alias("accuracy"))


def output_headings(spark: SparkSession, sf: str) -> DataFrame:
    found = _docs(spark, sf).select("doc_id", F.posexplode(S.meaningful_headings("output")).alias("n", "heading"))
    return found.select("doc_id", F.col("n").cast("bigint").alias("n"), "heading")


def _payload() -> Column:
    k = F.col("doc_id")
    return F.concat(
        F.lit('{"assets": ['), F.when(k % 2 == 0, '{"source_path": "word/media/a.png"}').otherwise('{"source_path": ""}'), F.lit('], "sections": [{"provenance": '), F.when(k % 3 == 0, '{"page": 1}').otherwise("null"),
        F.lit(', "elements": ['), F.repeat(F.lit('{"type": "paragraph", "runs": [{"bold": true, "provenance": {"page": 1}}, {"text": "x"}]}, '), (k % 4).cast("int")),
        F.lit('{"type": "footnote", "elements": [{"type": "paragraph", "runs": [{"italic": true}]}]}, {"type": "table", "rows": ['), F.repeat(F.lit('[{"provenance": {"cell": "A1"}, "paragraphs": [{"type": "paragraph", "runs": [{"underline": true}]}, {}]}, {}], '), (k % 5).cast("int")), F.lit("[]]}]}]}"),
    )


def json_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", _payload().alias("payload"))
    return S.structured_profile(docs).drop("payload").withColumn("json_asset_paths", F.array_join("json_asset_paths", ","))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of each output with its scores and measures; measured once and then tripled."""
    k = F.col("doc_id")
    scored = S.score_output(_docs(spark, sf).select("*", *_expectations()))
    made = {"json_asset_count": k % 3, "json_section_provenance_count": k % 2, "json_table_count": k % 4, "json_table_cell_count": k % 11, "json_cell_provenance_count": k % 7, "json_cell_paragraph_count": k % 13, "json_run_provenance_count": k % 17, "json_rich_run_count": k % 5}
    one = scored.select("converter", "file", "format", "doc_id", "accuracy", "expected_empty_total", "expected_empty_found", (F.length("output") > 0).alias("nonempty"), (k % 25 == 0).alias("input_semantic_empty"), F.when(k % 31 == 0, "broken").alias("error"), *S.profile_output("output"), *[v.alias(n) for n, v in made.items()])
    runs = one.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(3))))
    path = F.when(F.col("run") > F.col("doc_id") % 3, F.concat_ws("/", "converter", "file", F.col("doc_id").cast("string"), "run")).otherwise("")
    return runs.withColumn("seconds", (F.col("chars") * (F.col("run") + 1) + 1) / 1e6).withColumn("output_path", path)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scored_by_format(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.summarize_runs(_results(spark, sf), "converter", "format"))


def bench_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.deltas(S.summarize_runs(_results(spark, sf), "converter", "format"), "src0", "format"))


def bench_file_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.deltas(S.summarize_runs(_results(spark, sf), "converter", "file", "format"), "src0", "file", "format"))


def bench_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return S.gaps(S.deltas(S.summarize_runs(_results(spark, sf), "converter", "format"), "src0", "format")).withColumn("reasons", F.array_join("reasons", ", "))


def bench_index(spark: SparkSession, sf: str) -> DataFrame:
    return S.index_table(S.deltas(S.summarize_runs(_results(spark, sf), "converter", "format"), "src0", "format"))


def _upper(path: str, content: bytes) -> str:
    return content.decode().upper()


def _picky(path: str, content: bytes) -> str:
    if len(content) % 7 == 0:
        raise ValueError("no")
    return content.decode()[::-1]


def bench_runs(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content")).where("content is not null")
    ran = S.run_benchmark(files, {"upper": _upper, "picky": _picky}, runs=2)
    return ran.select("converter", "file", "run", F.length("output").cast("bigint").alias("chars"), "error", S.capture_path("out").alias("path"))


def fixture_list(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    ext = F.element_at(F.array(*map(F.lit, ("docx", "PPTX", "xlsx", "txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    listing = d.select(F.concat(F.lit("f"), "doc_id", F.lit("."), ext).alias("name"), F.when(F.col("doc_id") % 9 == 0, "dir").otherwise("file").alias("type"), F.when(F.col("doc_id") % 10 > 0, F.concat(F.lit("https://x.org/"), "doc_id")).alias("download_url"))
    return X.fixture_index(listing, ["docx", "pptx", "xlsx"], "listing", "public")


def fixture_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.counts_by_format(fixture_list(spark, sf))


def fixture_sources(spark: SparkSession, sf: str) -> DataFrame:
    return X.sources_table(fixture_list(spark, sf).withColumn("file", F.concat("name", F.lit("|x"))))


def manifest_used(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda t, k: spark.read.parquet(f"{sf}/{t}.parquet").select(F.concat(F.lit("f"), (F.col(k) % 2).cast("string")).alias("format"), F.col(k).alias("fixture_id"))
    return X.used_with(of("labels", "doc_id"), of("benchmark", "item_id"))


def expected_fetched(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").select(F.col("doc_id").alias("file"))
    return X.expected_of(of("labels"), of("documents").withColumn("expected", F.col("file") * 2))


def probe_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return X.probe_outcomes(d.select(F.col("lang").alias("format"), (F.col("doc_id") % 11 > 0).alias("valid"), (F.col("n_chars") > 200).alias("nonempty"), (F.col("doc_id") % 2 == 0).alias("input_semantic_empty")))


QUERIES = {f.__name__: f for f in (output_profile, output_scores, output_headings, json_profile, scored_by_format, bench_deltas, bench_file_deltas, bench_gaps, bench_index, bench_runs, fixture_list, fixture_counts, fixture_sources, manifest_used, expected_fetched, probe_outcomes)}

_NL = "chr(10)"
_OUT = f"""
    docs AS MATERIALIZED (SELECT source AS converter, 'in/f' || doc_id % 40 AS file, lang AS format, doc_id, n_chars, CASE WHEN doc_id % 50 = 0 THEN '' ELSE '# ' || source || {_NL} || '## Sheet 1' || {_NL} || '| id | ' || lang || ' |' || {_NL} || '| --- | --- |' || {_NL} || '| ' || doc_id || ' | ' || n_chars || ' |' || {_NL} || '| nan |  |' || {_NL} || '![](Shape3.png) ![fig](a/b.png) <https://x.org/' || doc_id || '> [comment 1: x] [bookmark: y] (=A' || doc_id % 7 || ')' || {_NL}
        || CASE WHEN doc_id % 2 = 0 THEN repeat('## More' || {_NL}, doc_id % 5) ELSE '' END || CASE WHEN doc_id % 2 = 1 THEN repeat('| a | b |' || {_NL}, doc_id % 5) ELSE '' END || text END AS output FROM documents),
    ls AS (SELECT *, string_split(output, {_NL}) AS ls FROM docs),
    hs AS (SELECT *, list_filter(list_transform(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: starts_with(x, '#')), lambda x: trim(regexp_replace(x, '^#+', ''))), lambda x: NOT regexp_full_match(trim(regexp_replace(lower(x), ':+$', '')), '|sheet|chart|notes|(sheet|hoja)\\s*\\d+')) AS heads,
        list_filter(list_transform(list_filter(list_transform(ls, lambda x: trim(x)), lambda x: starts_with(x, '|') AND ends_with(x, '|')), lambda x: list_transform(string_split(regexp_replace(x, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: NOT regexp_full_match(c, ':?-{{3,}}:?'))) > 0) AS parsed FROM ls),
    prof AS MATERIALIZED (SELECT *, length(output)::BIGINT AS chars, (len(ls) - CASE WHEN output = '' OR ends_with(output, {_NL}) THEN 1 ELSE 0 END)::BIGINT AS line_count, len(regexp_extract_all(output, '\\S+'))::BIGINT AS word_count,
        len(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(output, 'https?://\\S+', ' ', 'g'), 'mailto:\\S+', ' ', 'g'), '!\\[.*?\\]\\([^)]+\\)', ' ', 'g'), '\\[[^\\]]+\\]', ' ', 'g'), '(?i)\\bUnnamed:\\s*\\d+\\b', ' ', 'g'), '(?i)\\b(NaN|NaT)\\b', ' ', 'g')), '[a-z0-9가-힣]+'), lambda t: NOT regexp_full_match(t, '\\d+'))))::BIGINT AS unique_text_token_count,
        len(heads)::BIGINT AS heading_count, len(list_filter(parsed, lambda r: len(list_filter(r, lambda c: NOT regexp_full_match(c, '(?i)|nan|nat|unnamed:\\s*\\d+'))) > 0))::BIGINT AS markdown_table_row_count, len(regexp_extract_all(output, '<(#|mailto:|https?://)[^>]+>'))::BIGINT AS link_count,
        len(list_filter(regexp_extract_all(output, '!\\[.*?\\]\\([^)]+\\)'), lambda x: NOT regexp_matches(x, '(?i)^!\\[\\s*\\]\\((.*/)?\\s*Shape\\d+\\.(bmp|emf|gif|jpe?g|png|wmf)\\s*\\)$')))::BIGINT AS image_reference_count,
        len(regexp_extract_all(output, '\\[comment'))::BIGINT AS comment_marker_count, len(regexp_extract_all(output, '\\[bookmark:'))::BIGINT AS bookmark_marker_count, len(regexp_extract_all(output, '\\(='))::BIGINT AS formula_marker_count FROM hs)"""
_PROFILE = "chars, line_count, word_count, unique_text_token_count, heading_count, markdown_table_row_count, link_count, image_reference_count, comment_marker_count, bookmark_marker_count, formula_marker_count"
_CELL = r"(CASE WHEN regexp_matches(output, '(^|\||\s)' || {0} || '($|\||\s)') THEN 1 ELSE 0 END)"
_SCORES = f"""{_OUT},
    parts AS MATERIALIZED (SELECT *, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END AS t, CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END AS m, CASE WHEN doc_id % 100 = 0 THEN 1 ELSE 0 END AS e FROM prof),
    scored AS MATERIALIZED (SELECT *, (2 * t)::BIGINT AS expected_text_total, (t * (contains(output, format)::INT + contains(output, 'absent' || doc_id)::INT))::BIGINT AS expected_text_found, (3 * m)::BIGINT AS expected_markdown_total, (m * (contains(output, '# ' || converter)::INT + contains(output, '| id |')::INT + contains(output, 'no (such)')::INT))::BIGINT AS expected_markdown_found,
        (5 * t)::BIGINT AS expected_table_cells_total, (t * ({_CELL.format("'id'")} + {_CELL.format("format")} + {_CELL.format("doc_id")} + {_CELL.format("'a[.]b'")} + {_CELL.format("'12 3'")}))::BIGINT AS expected_table_cells_found, (2 * t)::BIGINT AS expected_table_rows_total,
        (t * (list_contains(parsed, [doc_id::VARCHAR, n_chars::VARCHAR])::INT + list_contains(parsed, ['x'])::INT))::BIGINT AS expected_table_rows_found, t::BIGINT AS expected_assets_total, CASE WHEN doc_id % 2 > 0 THEN t ELSE 0 END::BIGINT AS expected_assets_found, e::BIGINT AS expected_empty_total, CASE WHEN trim(output) = '' THEN e ELSE 0 END::BIGINT AS expected_empty_found FROM parts),
    accurate AS MATERIALIZED (SELECT *, (expected_text_found + expected_markdown_found + expected_table_cells_found + expected_table_rows_found + expected_assets_found + expected_empty_found)::DOUBLE / nullif(expected_text_total + expected_markdown_total + expected_table_cells_total + expected_table_rows_total + expected_assets_total + expected_empty_total, 0) AS accuracy FROM scored)"""
_JSON = {"json_asset_count": 3, "json_section_provenance_count": 2, "json_table_count": 4, "json_table_cell_count": 11, "json_cell_provenance_count": 7, "json_cell_paragraph_count": 13, "json_run_provenance_count": 17, "json_rich_run_count": 5}
_MEDIANS = [f"median_{k}" for k in (*S.MARKDOWN, *S.STRUCTURE)]
_RESULTS = f"""{_SCORES},
    results AS (SELECT *, {", ".join(f"doc_id % {n} AS {k}" for k, n in _JSON.items())}, (chars * (run + 1) + 1) / 1e6 AS seconds, CASE WHEN run > doc_id % 3 THEN converter || '/' || file || '/' || doc_id || '/' || run ELSE '' END AS output_path,
        CASE WHEN doc_id % 31 = 0 THEN false WHEN expected_empty_total > 0 THEN expected_empty_found = expected_empty_total WHEN doc_id % 25 = 0 THEN true ELSE length(output) > 0 END AS ok FROM accurate, unnest([1, 2, 3]) AS r(run))"""
_STATS = "min(seconds) AS best_seconds, median(seconds) AS median_seconds, avg(accuracy) AS mean_accuracy, avg(ok::INT) AS success_rate, " + ", ".join(f"median({c})::DOUBLE AS median_{k}" for k, c in [*S.MARKDOWN.items(), *((k, k) for k in S.STRUCTURE)]) + ", coalesce(min({'run': run, 'file': file, 'output_path': output_path}) FILTER (output_path <> '')['output_path'], '') AS representative_output_path"
_STATS = _STATS.replace("coalesce(min({'run': run, 'file': file, 'output_path': output_path}) FILTER (output_path <> '')['output_path'], '')", "coalesce((min({'run': run, 'file': file, 'output_path': output_path}) FILTER (output_path <> '')).output_path, '')")


def _delta_sql(by: str, key: str, more: str = "") -> str:
    cols = ", ".join(f"round(b.{m} - s.{m}, 9) AS {m}_delta" for m in _MEDIANS)
    return f"""{_RESULTS}, s AS (SELECT converter, {by}, {_STATS} FROM results GROUP BY ALL),
        compared AS (SELECT {", ".join("s." + c.strip() for c in by.split(","))}, s.converter AS competitor, b.converter IS NOT NULL AS baseline_available, true AS competitor_available, round(b.median_seconds, 9) AS baseline_median_seconds, round(s.median_seconds, 9) AS competitor_median_seconds, round(s.median_seconds / nullif(b.median_seconds, 0), 9) AS speedup,
            round(b.mean_accuracy, 9) AS baseline_mean_accuracy, round(s.mean_accuracy, 9) AS competitor_mean_accuracy, round(b.mean_accuracy - s.mean_accuracy, 9) AS accuracy_delta, round(b.success_rate, 9) AS baseline_success_rate, round(s.success_rate, 9) AS competitor_success_rate, round(b.success_rate - s.success_rate, 9) AS success_rate_delta, {cols}{more}
            FROM s LEFT JOIN (SELECT * FROM s WHERE converter = 'src0') b USING ({key}) WHERE s.converter <> 'src0')"""


_TRAILS = [("table_rows", True), ("headings", True), *((k, False) for k in ("links", "image_references", "comments", "bookmarks", "formula_markers"))]
_REASON = ["CASE WHEN accuracy_delta <= -0.25 THEN 'accuracy_trails_by=' || printf('%.3f', abs(accuracy_delta)) END", "CASE WHEN success_rate_delta < 0 THEN 'success_rate_trails_by=' || printf('%.3f', abs(success_rate_delta)) END"]
_REASON += [f"CASE WHEN median_{k}_delta <= -1{' AND coalesce(median_unique_text_tokens_delta <= -1, true)' if w else ''} THEN '{k}_trails_by=' || printf('%.3f', abs(median_{k}_delta)) END" for k, w in _TRAILS]
_SUMMARY = ", ".join(f"round({c}, 9) AS {c}" for c in ("best_seconds", "median_seconds", "mean_accuracy", "success_rate", *_MEDIANS))

ORACLE_SQL = {
    "output_profile": f"WITH {_OUT} SELECT doc_id, {_PROFILE} FROM prof",
    "output_scores": f"WITH {_SCORES} SELECT doc_id, {', '.join(f'expected_{k}_{x}' for k in ('text', 'markdown', 'table_cells', 'table_rows', 'assets', 'empty') for x in ('total', 'found'))}, round(accuracy, 9) AS accuracy FROM accurate",
    "output_headings": f"WITH {_OUT} SELECT doc_id, (generate_subscripts(heads, 1) - 1)::BIGINT AS n, unnest(heads) AS heading FROM prof",
    "json_profile": "SELECT doc_id, 1::BIGINT AS json_asset_count, CASE WHEN doc_id % 2 = 0 THEN 'word/media/a.png' ELSE '' END AS json_asset_paths, (doc_id % 3 = 0)::BIGINT AS json_section_provenance_count, 1::BIGINT AS json_table_count, (doc_id % 5 * 2)::BIGINT AS json_table_cell_count, (doc_id % 5)::BIGINT AS json_cell_provenance_count, (doc_id % 5 * 2)::BIGINT AS json_cell_paragraph_count, (doc_id % 4)::BIGINT AS json_run_provenance_count, (doc_id % 4 + 1 + doc_id % 5)::BIGINT AS json_rich_run_count FROM documents",
    "scored_by_format": f"WITH {_RESULTS}, s AS (SELECT converter, format, count(*) AS runs, count(DISTINCT file) AS files, {_STATS} FROM results GROUP BY converter, format) SELECT converter, format, runs, files, {_SUMMARY}, representative_output_path FROM s",
    "bench_deltas": f"WITH {_delta_sql('format', 'format')} SELECT * FROM compared",
    "bench_file_deltas": f"WITH {_delta_sql('file, format', 'file', ', coalesce(b.representative_output_path, chr(0)) AS baseline_output_path, s.representative_output_path AS competitor_output_path').replace('chr(0)', chr(39) * 2)} SELECT * FROM compared",
    "bench_gaps": f"WITH {_delta_sql('format', 'format')}, g AS (SELECT format, competitor, list_filter([{', '.join(_REASON)}], lambda x: x IS NOT NULL) AS reasons, CASE WHEN accuracy_delta <= -0.25 THEN abs(accuracy_delta) ELSE 0 END + CASE WHEN success_rate_delta < 0 THEN abs(success_rate_delta) ELSE 0 END AS big FROM compared) SELECT format, competitor, round(big + 0.05::DOUBLE * len(list_filter(reasons, lambda x: NOT starts_with(x, 'accuracy') AND NOT starts_with(x, 'success'))), 3) AS worst_gap_score, array_to_string(reasons, ', ') AS reasons FROM g WHERE len(reasons) > 0",
    "bench_index": f"WITH {_delta_sql('format', 'format')} SELECT competitor, format, '| ' || competitor || ' | ' || format || ' | ' || coalesce(printf('%.2fx', speedup), '') || ' | ' || coalesce(printf('%+.3f', accuracy_delta), '') || ' | ' || coalesce(printf('%+.3f', success_rate_delta), '') || ' | ' || coalesce(printf('%+.3f', median_json_asset_count_delta), '') || ' | ' || coalesce(printf('%+.3f', median_json_run_provenance_count_delta), '') || ' |' AS line FROM compared",
    "bench_runs": "WITH r AS (SELECT c AS converter, doc_id::VARCHAR AS file, run::INT AS run, text, c = 'picky' AND strlen(text) % 7 = 0 AS bad FROM documents, unnest(['upper', 'picky']) AS t(c), unnest([1, 2]) AS u(run) WHERE text IS NOT NULL) SELECT converter, file, run, CASE WHEN NOT bad THEN length(CASE WHEN converter = 'upper' THEN replace(text, 'ß', 'ss') ELSE text END) END::BIGINT AS chars, CASE WHEN bad THEN 'ValueError: no' END AS error, 'out/' || converter || '/' || file || '.run' || run || '.md' AS path FROM r",
}
_LIST = "list AS (SELECT name, lower(ext) AS format, 'https://x.org/' || doc_id AS url, 'listing' AS source, 'public' AS license FROM (SELECT doc_id, ['docx', 'PPTX', 'xlsx', 'txt'][doc_id % 4 + 1] AS ext, 'f' || doc_id || '.' || ext AS name FROM documents) WHERE doc_id % 9 > 0 AND doc_id % 10 > 0 AND ext <> 'txt')"
ORACLE_SQL |= {
    "fixture_list": f"WITH {_LIST} SELECT * FROM list",
    "fixture_counts": f"WITH {_LIST} SELECT format, count(*) AS n FROM list GROUP BY format",
    "fixture_sources": rf"WITH {_LIST} SELECT name || '|x' AS file, '| ' || name || '\|x | ' || source || ' | ' || license || ' | ' || url || ' |' AS line FROM list",
    "manifest_used": "SELECT 'f' || doc_id % 2 AS format, doc_id AS fixture_id FROM labels UNION SELECT 'f' || item_id % 2, item_id FROM benchmark",
    "expected_fetched": "SELECT doc_id AS file, doc_id * 2 AS expected FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "probe_outcomes": "SELECT lang AS format, count_if(doc_id % 11 > 0 AND n_chars <= 200 AND doc_id % 2 <> 0)::BIGINT AS unexpected_empty, count_if(doc_id % 11 > 0 AND n_chars <= 200 AND doc_id % 2 = 0)::BIGINT AS semantic_empty, count_if(doc_id % 11 = 0)::BIGINT AS invalid FROM documents GROUP BY lang",
}
