"""Collections of test files: listings, what was used before, what is expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixture_index(listing: DataFrame, formats: list[str], source: str, licence: str) -> DataFrame:
    """name, format, url, source and license of the files of the formats in a folder's listing (name, type, download_url)."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    found = listing.where((F.col("type") == "file") & F.col("download_url").isNotNull()).withColumn("format", ext).where(F.col("format").isin(formats))
    return found.select("name", "format", F.col("download_url").alias("url"), F.lit(source).alias("source"), F.lit(licence).alias("license"))


def counts_by_format(index: DataFrame) -> DataFrame:
    return index.groupBy("format").agg(F.count("*").alias("n"))


def used_with(used: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest (format, fixture_id) of what was used before or now."""
    return used.select("format", "fixture_id").unionAll(new.select("format", "fixture_id")).distinct()


def expected_of(records: DataFrame, expectations: DataFrame) -> DataFrame:
    """The expectations of the files that were fetched."""
    return expectations.join(records.select("file").distinct(), "file", "left_semi")


def sources_table(records: DataFrame) -> DataFrame:
    """file, and its line of the provenance table in Markdown; pipes in names are escaped."""
    safe = [F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(r"\|")) for c in ("file", "source", "license", "url")]
    return records.select("file", F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |")).alias("line"))


def probe_outcomes(runs: DataFrame) -> DataFrame:
    """For each format: files that gave nothing though their input says something, files whose input is empty of meaning,
    and files that aren't valid packages."""
    return runs.groupBy("format").agg(
        F.count_if(F.col("valid") & ~F.col("nonempty") & ~F.col("input_semantic_empty")).alias("unexpected_empty"),
        F.count_if(F.col("valid") & ~F.col("nonempty") & F.col("input_semantic_empty")).alias("semantic_empty"), F.count_if(~F.col("valid")).alias("invalid"),
    )
