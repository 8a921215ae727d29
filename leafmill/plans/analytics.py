"""Queries over quality, similarity and benchmark runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import bigrams, jaccard
from leafmill.operators import analytics as A
from leafmill.plans.structure import _LINES


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return A.quality(_table(spark, sf, "documents").select("doc_id", "text"))


def verdict_buckets(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality_score(spark, sf).select("doc_id", A.verdict(F.col("score")).alias("verdict"))
    return scored.join(_table(spark, sf, "labels"), "doc_id", "left").groupBy("verdict", "quality").agg(F.count("*").alias("n"))


def length_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    mean = docs.groupBy("source").agg(F.avg("n_chars").alias("mean"))
    scored = docs.join(A.small(mean), "source").withColumn("percent", F.col("n_chars") * 100.0 / F.col("mean"))
    return scored.select("doc_id", F.round("percent", 6).alias("percent"), F.round(A.length_score(F.col("percent")), 6).alias("score"))


def keyword_top20(spark: SparkSession, sf: str) -> DataFrame:
    return A.keywords(_table(spark, sf, "documents").select("doc_id", "text"))


def word_coverage_top(spark: SparkSession, sf: str) -> DataFrame:
    return A.word_coverage(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark"))


def bigram_jaccard_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation against the turn before it."""
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "text")
    sets = turns.select("conv_id", "turn", bigrams("text").alias("own"))
    before = sets.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("own").alias("last"))
    return sets.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard(F.col("own"), F.col("last")), 9).alias("jaccard"))


def sentence_first(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_sentences(_table(spark, sf, "documents").select("doc_id", "text"))


def page_edges(spark: SparkSession, sf: str) -> DataFrame:
    return A.repeated_edges(_table(spark, sf, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("page"), "text"), share=0.01)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of each document; its source is the converter, its language the format."""
    docs = _table(spark, sf, "documents").select(F.col("source").alias("converter"), F.col("doc_id").alias("file"), F.col("lang").alias("format"), "n_chars", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"))
    return docs.select("converter", "file", "format", "run", (F.col("n_chars") * (F.col("run") + 1) / 1e6).alias("seconds"), (F.col("n_chars") % 100 / 100.0).alias("accuracy"), (F.col("n_chars") > 100).alias("nonempty"), F.col("n_chars").alias("chars"))


def bench_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return A.summarize(_runs(spark, sf), "converter", "file", "format")


def bench_by_format(spark: SparkSession, sf: str) -> DataFrame:
    return A.summarize(_runs(spark, sf), "converter", "format")


def bench_compare(spark: SparkSession, sf: str) -> DataFrame:
    return A.compare(bench_by_format(spark, sf), "src0", "format")


def bench_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return A.candidates(bench_compare(spark, sf))


def unseen_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("format"), F.col("n_chars").alias("size"))
    return A.unseen(docs, _table(spark, sf, "labels").select(F.col("doc_id").alias("id")), 5)


QUERIES = {f.__name__: f for f in (quality_score, verdict_buckets, length_scores, keyword_top20, word_coverage_top, bigram_jaccard_neighbours, sentence_first, page_edges, bench_by_file, bench_by_format, bench_compare, bench_candidates, unseen_topk)}

_QUALITY = rf"""
    {_LINES},
    q0 AS (SELECT doc_id, island, kind, count_if(has_row) AS rows, any_value(line) AS line FROM l8 GROUP BY ALL),
    q1 AS (SELECT doc_id, count(*) AS blocks, CAST(count_if(CASE WHEN kind IN ('table', 'pair') THEN rows < 2 ELSE NOT regexp_matches(line, '\p{{L}}') OR contains(line, chr(65533)) END) AS BIGINT) AS issues FROM q0 GROUP BY doc_id),
    quality AS (SELECT d.doc_id, coalesce(blocks, 0) AS blocks, coalesce(issues, 0) AS issues, CASE WHEN blocks IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0, least(100.0, (1 - issues / blocks) * 100))::DOUBLE END AS score FROM documents d LEFT JOIN q1 USING (doc_id))"""
_RUNS = "runs AS (SELECT source AS converter, doc_id AS file, lang AS format, n_chars * (run + 1) / 1e6 AS seconds, n_chars % 100 / 100.0 AS accuracy, n_chars > 100 AS nonempty, n_chars AS chars FROM documents, unnest([1, 2, 3]) AS t(run))"
_SUMMARY = "count(*) AS runs, count(DISTINCT file) AS files, min(seconds) AS best_seconds, median(seconds) AS median_seconds, round(avg(accuracy), 9) AS accuracy, round(avg(nonempty::INT), 9) AS success_rate, median(chars) AS median_chars FROM runs"
_COMPARE = f"""{_RUNS}, s AS (SELECT converter, format, {_SUMMARY} GROUP BY ALL),
    compared AS (SELECT s.converter, s.format, s.median_seconds / nullif(b.median_seconds, 0) AS speedup, round(b.accuracy - s.accuracy, 9) AS accuracy_delta, round(b.success_rate - s.success_rate, 9) AS success_rate_delta, round(b.median_chars - s.median_chars, 9) AS median_chars_delta
        FROM s LEFT JOIN (SELECT * FROM s WHERE converter = 'src0') b USING (format) WHERE s.converter <> 'src0')"""

ORACLE_SQL = {
    "quality_score": f"WITH {_QUALITY} SELECT * FROM quality",
    "verdict_buckets": f"WITH {_QUALITY} SELECT CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'poor' ELSE 'bad' END AS verdict, l.quality, count(*) AS n FROM quality q LEFT JOIN labels l USING (doc_id) GROUP BY ALL",
    "length_scores": "WITH p AS (SELECT doc_id, n_chars * 100.0::DOUBLE / avg(n_chars) OVER (PARTITION BY source) AS percent FROM documents) SELECT doc_id, round(percent, 6) AS percent, round(greatest(0.0, CASE WHEN percent > 200 THEN 100 - 0.5::DOUBLE * (percent - 200) WHEN percent < 75 THEN 100 - 1.5::DOUBLE * (75 - percent) ELSE 100.0 END), 6)::DOUBLE AS score FROM p",
    "keyword_top20": r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS token FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY token ORDER BY n DESC, token LIMIT 20",
    "word_coverage_top": r"""WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS token FROM documents), i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '\p{L}{2,}')) AS a FROM benchmark), t AS (SELECT item_id, len(a) AS size, unnest(a) AS token FROM i),
        m AS (SELECT doc_id, item_id, count(*) AS shared, count(*) * 100.0::DOUBLE / any_value(size) AS coverage FROM d JOIN t USING (token) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, shared, coverage FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, item_id) = 1""",
    "bigram_jaccard_neighbours": """WITH s AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(text)), lambda i: substring(text, i, 2))) AS own FROM conversations)
        SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(a.own || b.own)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.own, b.own)) / len(list_distinct(a.own || b.own)) END, 9) AS jaccard FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
    "sentence_first": r"""WITH l AS (SELECT doc_id, string_split_regex(text, '[.\n]') AS ls FROM documents), s AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS pos, trim(unnest(ls)) AS sentence FROM l), k AS (SELECT *, substring(replace(sentence, ' ', ''), 1, 30) AS key FROM s WHERE length(sentence) > 10)
        SELECT doc_id, pos, sentence, n FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS r FROM k) WHERE r = 1""",
    "page_edges": """WITH e AS (SELECT source, doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 2) AS ls FROM documents), u AS (SELECT source, doc_id, unnest(list_distinct([trim(ls[1]), trim(ls[-1])])) AS line FROM e WHERE len(ls) > 0), t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source HAVING count(*) >= 3)
        SELECT source AS "group", line, count(*) AS n, any_value(pages) AS pages FROM u JOIN t USING (source) GROUP BY source, line HAVING count(*) >= 3 AND count(*) >= 0.01 * any_value(pages)""",
    "bench_by_file": f"WITH {_RUNS} SELECT converter, file, format, {_SUMMARY} GROUP BY ALL",
    "bench_by_format": f"WITH {_RUNS} SELECT converter, format, {_SUMMARY} GROUP BY ALL",
    "bench_compare": f"WITH {_COMPARE} SELECT * FROM compared",
    "bench_candidates": f"""WITH {_COMPARE}, f AS (SELECT *, coalesce(speedup < 1, false) AS a, coalesce(accuracy_delta < -0.02, false) AS b, coalesce(success_rate_delta < 0, false) AS c, coalesce(median_chars_delta < -100, false) AS d FROM compared),
        g AS (SELECT * EXCLUDE (a, b, c, d), array_to_string(list_filter([CASE WHEN a THEN 'slower' END, CASE WHEN b THEN 'less_accurate' END, CASE WHEN c THEN 'fails_more' END, CASE WHEN d THEN 'less_text' END], lambda x: x IS NOT NULL), ',') AS reasons, (a::INT * 3 + b::INT * 5 + c::INT * 8 + d::INT * 2)::DOUBLE AS score FROM f)
        SELECT *, row_number() OVER (ORDER BY score DESC, format, converter) AS rank FROM g WHERE score > 0""",
    "unseen_topk": "SELECT * FROM (SELECT doc_id AS id, lang AS format, n_chars AS size, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE rank <= 5",
}
