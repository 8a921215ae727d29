"""Quality, similarity and benchmark analytics over documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from leafmill.functions.text import lines
from leafmill.operators.structure import blocks

#: Rows and bytes of a small side up to which it is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows and bytes (of its rows as JSON); at most BROADCAST_ROWS are looked at."""
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, blocks, issues (paragraphs without a letter, tables of one row, broken characters) and score."""
    issue = lambda b: (b["kind"].isin("table", "pair") & (F.size(b["rows"]) < 2)) | (b["kind"].isin("text", "heading") & ~b["text"].rlike(r"\p{L}")) | F.coalesce(b["text"], F.lit("")).contains("�")
    found = blocks(docs).select("doc_id", F.size("blocks").cast("bigint").alias("blocks"), F.size(F.filter("blocks", issue)).cast("bigint").alias("issues"))
    return found.withColumn("score", F.when(F.col("blocks") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("issues") / F.col("blocks")) * 100))))


def verdict(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("bad")


def length_score(percent: Column) -> Column:
    """100 between 75 and 200 percent of the expected length, less outside."""
    return F.greatest(F.lit(0.0), F.when(percent > 200, 100 - 0.5 * (percent - 200)).when(percent < 75, 100 - 1.5 * (75 - percent)).otherwise(100.0))


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def keywords(docs: DataFrame, most: int = 20, pattern: str = r"[^\W\d_]{3,}") -> DataFrame:
    """The most frequent tokens of lower-case text: token, n, docs; ties by token; a pattern of Python's. Each batch of
    documents is counted by itself, so that only counts are shuffled, one for each token of a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(pattern)
        for batch in batches:
            every: Counter[str] = Counter()
            once: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                found = token.findall(text.lower()) if text else []
                every.update(found)
                once.update(set(found))
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([once[t] for t in every], pa.int64())], names=["token", "n", "docs"])

    found = docs.select("text").mapInArrow(count, "token string, n bigint, docs bigint")
    return found.groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).orderBy(F.desc("n"), "token").limit(most)


#: Items whose tokens a worker holds at once; more are taken in blocks, each against all documents.
BLOCK_ITEMS = 20_000


def word_coverage(docs: DataFrame, items: DataFrame, pattern: str = r"\p{L}{2,}", block: int = BLOCK_ITEMS) -> DataFrame:
    """For each document the item whose distinct tokens it covers best: doc_id, item_id, shared, coverage
    (percent); ties by the least item, documents that share no token are left out.

    A worker counts a document's tokens against the items of a block, which have a token's items at hand; nothing is
    shuffled by token. Only beyond one block the best of each block come together by document."""
    mine = docs.select("doc_id", F.array_distinct(tokens(F.col("text"), pattern)).alias("own"))
    every = items.select("item_id", F.array_distinct(tokens(F.col("text"), pattern)).alias("own")).where("item_id is not null").orderBy("item_id")
    kind, key = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema, best = f"doc_id {kind}, item_id {key}, shared bigint, coverage double", None

    def blocks() -> Iterator[list[Row]]:
        rows: list[Row] = []
        for row in every.toLocalIterator():
            rows.append(row)
            if len(rows) == block:
                yield rows
                rows = []
        if rows:
            yield rows

    made = 0
    for rows in blocks():
        made += 1
        places: dict[str, list[int]] = {}
        for k, row in enumerate(rows):
            for t in row["own"] or ():
                places.setdefault(t, []).append(k)
        shared = docs.sparkSession.sparkContext.broadcast(({t: np.array(x) for t, x in places.items()}, np.array([len(r["own"] or ()) for r in rows]), [r["item_id"] for r in rows]))

        def cover(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            where, size, ids = shared.value
            for batch in batches:
                out = []
                for doc, own in zip(batch.column(0), batch.column(1).to_pylist()):
                    hits = [x for t in own or () if (x := where.get(t)) is not None]
                    if hits:
                        n = np.bincount(np.concatenate(hits), minlength=len(size))
                        share = n * 100.0 / np.maximum(size, 1)
                        k = int(share.argmax())
                        out.append((doc.as_py(), ids[k], int(n[k]), float(share[k])))
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, None if out else pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "shared", "coverage"])

        found = mine.mapInArrow(cover, schema)
        best = found if best is None else best.unionAll(found)
    if best is None:
        return docs.sparkSession.createDataFrame([], schema)
    if made == 1:
        return best
    top = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("coverage"), "item_id"))
    return best.withColumn("_r", top).where("_r = 1").drop("_r")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, sentence: the parts between full stops and line ends, trimmed."""
    return docs.select("doc_id", F.posexplode(F.split(F.col("text"), r"[.\n]")).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.trim("sentence").alias("sentence"))


def first_sentences(docs: DataFrame, least: int = 10, key_chars: int = 30) -> DataFrame:
    """Sentences of more than `least` characters, the first of each key of its first characters without spaces."""
    found = sentences(docs).where(F.length("sentence") > least).withColumn("key", F.substring(F.regexp_replace("sentence", " ", ""), 1, key_chars))
    return found.groupBy("key").agg(F.min(F.struct("doc_id", "pos", "sentence")).alias("s"), F.count("*").alias("n")).select("s.*", "n")


def repeated_edges(pages: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """First and last lines of pages (group, page, text) that so large a share of a group's pages have, at least `least`."""
    edge = pages.select("group", "page", F.filter(lines(F.col("text")), lambda x: F.length(F.trim(x)) > 2).alias("ls")).where(F.size("ls") > 0)
    edge = edge.select("group", "page", F.explode(F.array_distinct(F.array(F.trim(F.element_at("ls", 1)), F.trim(F.element_at("ls", -1))))).alias("line"))
    total = pages.groupBy("group").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    return edge.groupBy("group", "line").agg(F.count("*").alias("n")).join(total, "group").where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))).select("group", "line", "n", "pages")


def summarize(runs: DataFrame, *by: str) -> DataFrame:
    """runs, best and median seconds, mean accuracy, success rate and files of each group."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_distinct("file").alias("files"), F.min("seconds").alias("best_seconds"), F.median("seconds").alias("median_seconds"),
        F.round(F.avg("accuracy"), 9).alias("accuracy"), F.round(F.avg(F.col("nonempty").cast("int")), 9).alias("success_rate"), F.median("chars").alias("median_chars"),
    )


def compare(summary: DataFrame, baseline: str, *by: str) -> DataFrame:
    """Each converter's summary against the baseline's: speedup (null by zero) and deltas. The baseline's row comes to
    the others of its group by a window, so the summary is computed once."""
    taken = F.struct("median_seconds", "accuracy", "success_rate", "median_chars")
    base = F.max(F.when(F.col("converter") == baseline, taken)).over(Window.partitionBy(*by))
    joined = summary.withColumn("base", base).where(F.col("converter") != baseline)
    return joined.select("converter", *by, F.try_divide("median_seconds", "base.median_seconds").alias("speedup"), *[F.round(F.col(f"base.{c}") - F.col(c), 9).alias(f"{c}_delta") for c in ("accuracy", "success_rate", "median_chars")])


def candidates(compared: DataFrame) -> DataFrame:
    """Where the baseline falls behind, with reasons and a score, worst first by rank."""
    rules = {"slower": (F.col("speedup") < 1, 3.0), "less_accurate": (F.col("accuracy_delta") < -0.02, 5.0), "fails_more": (F.col("success_rate_delta") < 0, 8.0), "less_text": (F.col("median_chars_delta") < -100, 2.0)}
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, (c, _) in rules.items()]), lambda x: x.isNotNull())
    score = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0) for c, w in rules.values()), F.lit(0.0))
    out = compared.withColumn("reasons", F.array_join(reasons, ",")).withColumn("score", score).where("score > 0")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "format", "converter")).cast("bigint"))


def unseen(fixtures: DataFrame, used: DataFrame, most: int) -> DataFrame:
    """The first fixtures of each format whose id isn't used, largest first."""
    left = fixtures.join(used, "id", "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("format").orderBy(F.desc("size"), "id")).cast("bigint")).where(F.col("rank") <= most)
