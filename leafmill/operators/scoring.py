"""Converter benchmarks: what outputs are expected to hold, what they hold, and how converters compare."""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import lines
from leafmill.operators.analytics import small

#: Measures of an output in Markdown, and of its structure, whose medians are compared; by the name of the median.
MARKDOWN = {
    "chars": "chars", "table_rows": "markdown_table_row_count", "headings": "heading_count", "links": "link_count", "image_references": "image_reference_count",
    "comments": "comment_marker_count", "bookmarks": "bookmark_marker_count", "formula_markers": "formula_marker_count", "unique_text_tokens": "unique_text_token_count",
}
STRUCTURE = [f"json_{k}_count" for k in "asset section_provenance table table_cell cell_provenance cell_paragraph run_provenance rich_run".split()]

_PLACEHOLDER = r"(?i)^!\[\s*\]\((?:.*/)?\s*Shape\d+\.(?:bmp|emf|gif|jpe?g|png|wmf)\s*\)$"
_GENERIC = r"^(?:|sheet|chart|notes|(?:sheet|hoja)\s*\d+)$"
_NO_SIGNAL = r"(?i)^(?:|nan|nat|unnamed:\s*\d+)$"
_DASHES = r"^:?-{3,}:?$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _rows(output: Column) -> Column:
    """The cells of each line between pipes, without those of dashes."""
    piped = F.filter(F.transform(lines(output), lambda x: F.trim(x)), lambda x: x.startswith("|") & x.endswith("|"))
    cells = F.transform(piped, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    return F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike(_DASHES)))


def meaningful_headings(output: Column | str) -> Column:
    """Texts of the headings that say more than that a sheet, a chart or notes begin."""
    own = F.filter(F.transform(lines(_col(output)), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    texts = F.transform(own, lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    return F.filter(texts, lambda x: ~F.trim(F.regexp_replace(F.lower(x), ":+$", "")).rlike(_GENERIC))


def meaningful_images(output: Column | str) -> Column:
    """References to images, without those of unnamed shapes that a converter made up."""
    return F.filter(F.regexp_extract_all(_col(output), F.lit(r"!\[.*?\]\([^)]+\)"), 0), lambda x: ~x.rlike(_PLACEHOLDER))


def unique_tokens(output: Column | str) -> Column:
    """Distinct words and numbers with letters, without addresses, images, bracketed text and empty-cell marks."""
    out = _col(output)
    for pattern in (r"https?://\S+", r"mailto:\S+", r"!\[.*?\]\([^)]+\)", r"\[[^\]]+\]", r"(?i)\bUnnamed:\s*\d+\b", r"(?i)\bNaN\b", r"(?i)\bNaT\b"):
        out = F.regexp_replace(out, pattern, " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(out), F.lit("[a-z0-9가-힣]+"), 0), lambda x: ~x.rlike(r"^\d+$")))


def _count(output: Column, pattern: str) -> Column:
    return F.regexp_count(output, F.lit(pattern)).cast("bigint")


def profile_output(output: Column | str) -> list[Column]:
    """The measures of an output, each aliased."""
    o = _col(output)
    trailing = F.when(o.endswith("\n") | (o == ""), 1).otherwise(0)
    size = lambda x: F.size(x).cast("bigint")
    return [
        F.length(o).cast("bigint").alias("chars"), (F.size(lines(o)) - trailing).cast("bigint").alias("line_count"), _count(o, r"\S+").alias("word_count"), size(unique_tokens(o)).alias("unique_text_token_count"), size(meaningful_headings(o)).alias("heading_count"),
        size(F.filter(_rows(o), lambda r: F.exists(r, lambda c: ~c.rlike(_NO_SIGNAL)))).alias("markdown_table_row_count"), _count(o, r"<(?:#|mailto:|https?://)[^>]+>").alias("link_count"), size(meaningful_images(o)).alias("image_reference_count"),
        _count(o, r"\[comment").alias("comment_marker_count"), _count(o, r"\[bookmark:").alias("bookmark_marker_count"), _count(o, r"\(=").alias("formula_marker_count"),
    ]


def score_output(results: DataFrame) -> DataFrame:
    """results with found and total of each kind of expectation and accuracy (null without any).

    results has output and asset_paths, and, null where a file has none, expected_text, expected_markdown,
    expected_assets (arrays of strings), expected_tables (an array of tables of rows of cells), expected_table_rows
    and expected_empty. A cell counts between pipes, white space or edges, a row by all its cells."""
    empty = lambda kind: F.array().cast(kind)
    given = lambda c, kind="array<string>": F.coalesce(F.col(c), empty(kind))
    o = F.coalesce("output", F.lit(""))
    cells = F.filter(F.flatten(F.flatten(given("expected_tables", "array<array<array<string>>>"))), lambda c: F.trim(c) != "")
    held = lambda x: F.contains(o, x)
    within = lambda c: F.regexp_like(o, F.concat(F.lit(r"(?:^|\||\s)\Q"), c, F.lit(r"\E(?:$|\||\s)")))
    rows = F.transform(given("expected_table_rows", "array<array<string>>"), lambda r: F.transform(r, lambda c: F.trim(c)))
    none = F.coalesce("expected_empty", F.lit(False))
    kinds = {
        "expected_text": (given("expected_text"), held), "expected_markdown": (given("expected_markdown"), held), "expected_table_cells": (cells, within),
        "expected_assets": (given("expected_assets"), lambda x: F.array_contains(F.coalesce("asset_paths", empty("array<string>")), x)),
    }
    out = results.withColumn("_parsed", _rows(o))
    for name, (every, found) in kinds.items():
        out = out.withColumn(f"{name}_total", F.size(every).cast("bigint")).withColumn(f"{name}_found", F.size(F.filter(every, found)).cast("bigint"))
    out = out.withColumn("expected_table_rows_total", F.size(rows).cast("bigint")).withColumn("expected_table_rows_found", F.size(F.filter(rows, lambda r: F.array_contains("_parsed", r))).cast("bigint"))
    out = out.withColumn("expected_empty_total", none.cast("bigint")).withColumn("expected_empty_found", (none & (F.trim(o) == "")).cast("bigint"))
    names = [*kinds, "expected_table_rows", "expected_empty"]
    total, found = (sum((F.col(f"{n}_{k}") for n in names), F.lit(0)) for k in ("total", "found"))
    return out.drop("_parsed").withColumn("accuracy", F.when(total > 0, found / total))


def success() -> Column:
    """Whether a run succeeded: no error, and an output unless none is expected."""
    return F.when(F.coalesce("error", F.lit("")) != "", False).when(F.col("expected_empty_total") > 0, F.col("expected_empty_found") == F.col("expected_empty_total")).when(F.coalesce("input_semantic_empty", F.lit(False)), True).otherwise(F.coalesce("nonempty", F.lit(False)))


def with_expectations(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """Every result and what its file (relative path) is expected to give."""
    return results.join(small(expectations), "file", "left")


def structured_profile(docs: DataFrame, column: str = "payload") -> DataFrame:
    """docs with the measures STRUCTURE of a document tree in JSON and json_asset_paths; zeros for what isn't one."""

    def walk(x: object, n: dict[str, int]) -> None:
        if not isinstance(x, dict):
            return
        kind = x.get("type")
        if kind == "paragraph":
            for run in x.get("runs") or ():
                if isinstance(run, dict):
                    n["json_run_provenance_count"] += bool(run.get("provenance"))
                    n["json_rich_run_count"] += any(run.get(k) for k in ("bold", "italic", "underline", "strikeout", "superscript", "subscript"))
        elif kind in ("footnote", "endnote", "comment"):
            for own in x.get("elements") or ():
                walk(own, n)
        elif kind == "table":
            n["json_table_count"] += 1
            for cell in (c for row in x.get("rows") or () for c in row if isinstance(c, dict)):
                n["json_table_cell_count"] += 1
                n["json_cell_provenance_count"] += bool(cell.get("provenance"))
                n["json_cell_paragraph_count"] += len(cell.get("paragraphs") or ())
                for p in cell.get("paragraphs") or ():
                    walk(p, n)

    def measures(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            try:
                tree = json.loads(text or "{}")
            except ValueError:
                tree = {}
            tree = tree if isinstance(tree, dict) else {}
            n = dict.fromkeys(STRUCTURE, 0)
            n["json_asset_count"] = len(tree.get("assets") or ())
            for section in tree.get("sections") or ():
                n["json_section_provenance_count"] += bool(section.get("provenance"))
                for element in section.get("elements") or ():
                    walk(element, n)
            rows.append(n | {"json_asset_paths": [a["source_path"] for a in tree.get("assets") or () if isinstance(a, dict) and a.get("source_path")]})
        return pa.array(rows, pa.struct([(k, pa.int64()) for k in STRUCTURE] + [("json_asset_paths", pa.list_(pa.string()))]))

    kind = ", ".join(f"{k} bigint" for k in STRUCTURE) + ", json_asset_paths array<string>"
    found = docs.withColumn("_profile", F.arrow_udf(measures, kind)(F.col(column)))
    return found.select(*docs.columns, "_profile.*")


def summarize_runs(results: DataFrame, *by: str) -> DataFrame:
    """Runs, seconds, accuracy, success rate, medians of all measures and the first output's path of each group."""
    first = F.min(F.when(F.coalesce("output_path", F.lit("")) != "", F.struct("run", "file", "output_path")))["output_path"]
    files = [] if "file" in by else [F.count_distinct("file").alias("files")]
    medians = [F.median(F.coalesce(c, F.lit(0))).alias(f"median_{k}") for k, c in [*MARKDOWN.items(), *((k, k) for k in STRUCTURE)]]
    return results.groupBy(*by).agg(
        F.count("*").alias("runs"), *files, F.min("seconds").alias("best_seconds"), F.median("seconds").alias("median_seconds"), F.avg("accuracy").alias("mean_accuracy"),
        F.avg(success().cast("int")).alias("success_rate"), *medians, F.coalesce(first, F.lit("")).alias("representative_output_path"),
    )


def deltas(summary: DataFrame, baseline: str, *by: str) -> DataFrame:
    """Every other converter's group against the baseline's of the same `by` (which has file, or format): seconds and speedup, accuracy,
    success rate, and the differences of all medians; null where there is no baseline. Groups by file also have both outputs' paths."""
    medians = [f"median_{k}" for k in (*MARKDOWN, *STRUCTURE)]
    taken = ["median_seconds", "mean_accuracy", "success_rate", *medians, "representative_output_path"]
    keys = [k for k in by if k == "file"] or list(by)
    base = F.max(F.when(F.col("converter") == baseline, F.struct(F.lit(True).alias("there"), *taken))).over(Window.partitionBy(*keys))
    joined = summary.withColumn("_base", base).where(F.col("converter") != baseline).select("*", F.col("_base.there").alias("_there"), *[F.col(f"_base.{c}").alias(f"_{c}") for c in taken])
    paths = [F.coalesce("_representative_output_path", F.lit("")).alias("baseline_output_path"), F.col("representative_output_path").alias("competitor_output_path")] if "file" in by else []
    return joined.select(
        *by, F.col("converter").alias("competitor"), F.coalesce("_there", F.lit(False)).alias("baseline_available"), F.lit(True).alias("competitor_available"),
        F.col("_median_seconds").alias("baseline_median_seconds"), F.col("median_seconds").alias("competitor_median_seconds"), F.try_divide("median_seconds", "_median_seconds").alias("speedup"),
        F.col("_mean_accuracy").alias("baseline_mean_accuracy"), F.col("mean_accuracy").alias("competitor_mean_accuracy"), (F.col("_mean_accuracy") - F.col("mean_accuracy")).alias("accuracy_delta"),
        F.col("_success_rate").alias("baseline_success_rate"), F.col("success_rate").alias("competitor_success_rate"), (F.col("_success_rate") - F.col("success_rate")).alias("success_rate_delta"),
        *[(F.col(f"_{m}") - F.col(m)).alias(f"{m}_delta") for m in medians], *paths,
    )


def printed(number: Column | str, form: str) -> Column:
    """A number of up to nine places as C's printf shows it: its binary value decides at halves, and what is less than zero
    keeps its sign (-0.000). Noise of sums beyond nine places has none."""

    @F.arrow_udf("string")
    def shown(numbers: pa.Array) -> pa.Array:
        return pa.array([None if x is None else form % (round(x, 9) + 0.0) for x in numbers.to_pylist()], pa.string())

    return shown((F.col(number) if isinstance(number, str) else number).cast("double"))


def gaps(compared: DataFrame) -> DataFrame:
    """Rows of deltas() in which the baseline trails, with reasons and a score rounded to three places. Fewer
    table rows or headings count only if there are fewer words too, or nothing is known of words."""
    fewer = lambda c: F.col(c) <= -1
    words = F.col("median_unique_text_tokens_delta").isNull() | fewer("median_unique_text_tokens_delta")
    rules = [("accuracy", F.col("accuracy_delta") <= -0.25, F.abs("accuracy_delta")), ("success_rate", F.col("success_rate_delta") < 0, F.abs("success_rate_delta"))]
    rules += [(k, fewer(f"median_{k}_delta") & (words if k in ("table_rows", "headings") else F.lit(True)), F.lit(0.05)) for k in ("table_rows", "headings", "links", "image_references", "comments", "bookmarks", "formula_markers")]
    amount = {k: F.abs(f"{k}_delta" if k in ("accuracy", "success_rate") else f"median_{k}_delta") for k, _, _ in rules}
    holds = {k: F.coalesce(c, F.lit(False)) for k, c, _ in rules}
    reasons = F.filter(F.array(*[F.when(holds[k], F.concat(F.lit(f"{k}_trails_by="), printed(amount[k], "%.3f"))) for k, _, _ in rules]), lambda x: x.isNotNull())
    score = sum((F.when(holds[k], w).otherwise(0.0) for k, _, w in rules), F.lit(0.0))
    keep = [c for c in ("format", "file", "competitor", "baseline_output_path", "competitor_output_path") if c in compared.columns]
    return compared.select(*keep, F.round(score, 3).alias("worst_gap_score"), reasons.alias("reasons")).where(F.size("reasons") > 0)


def index_table(compared: DataFrame) -> DataFrame:
    """competitor, format and the line of a Markdown table for each comparison; nulls are blank."""
    shown = lambda c, form: F.coalesce(printed(c, form), F.lit(""))
    cells = [F.col("competitor"), F.col("format"), F.when(F.col("speedup").isNull(), "").otherwise(F.concat(shown("speedup", "%.2f"), F.lit("x"))), *[shown(c, "%+.3f") for c in ("accuracy_delta", "success_rate_delta", "median_json_asset_count_delta", "median_json_run_provenance_count_delta")]]
    return compared.select("competitor", "format", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def run_benchmark(files: DataFrame, converters: dict[str, Callable[[str, bytes], str]], runs: int = 1, timeout: float = 120.0) -> DataFrame:
    """converter, file, run, seconds, output and error of every converter on every file (path, content), so many
    times. A task times the files that it has; contents are never shuffled or multiplied. A run over `timeout`
    seconds is an error, where the worker's main thread converts and the system has alarms."""

    def timed(call: Callable[[], str]) -> tuple[str | None, str | None, float]:
        began = time.perf_counter()
        alarm = hasattr(signal, "setitimer") and threading.current_thread() is threading.main_thread() and timeout > 0

        def late(*_: object) -> None:
            raise TimeoutError(f"over {timeout:g} seconds")

        before = signal.signal(signal.SIGALRM, late) if alarm else None
        try:
            if alarm:
                signal.setitimer(signal.ITIMER_REAL, timeout)
            return call(), None, time.perf_counter() - began
        except Exception as e:  # a converter's failure is a result
            return None, f"{type(e).__name__}: {e}", time.perf_counter() - began
        finally:
            if alarm:
                signal.setitimer(signal.ITIMER_REAL, 0)
                signal.signal(signal.SIGALRM, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for name, convert in converters.items():
                    for k in range(1, runs + 1):
                        output, error, seconds = timed(lambda convert=convert: convert(path, content))
                        rows.append({"converter": name, "file": path, "run": k, "seconds": seconds, "output": output, "error": error})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("converter", pa.string()), ("file", pa.string()), ("run", pa.int32()), ("seconds", pa.float64()), ("output", pa.string()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "converter string, file string, run int, seconds double, output string, error string")


def capture_path(root: str) -> Column:
    """Where a run's output belongs: root, converter, the file's own path, run."""
    return F.concat(F.lit(root.rstrip("/") + "/"), "converter", F.lit("/"), F.regexp_replace("file", "^/+", ""), F.lit(".run"), "run", F.lit(".md"))


def write_captures(results: DataFrame, folder: str) -> None:
    """Outputs below folder, partitioned by converter and run, with the path that each would have as a file."""
    results.select("converter", "run", "file", capture_path("").alias("path"), "output").write.mode("overwrite").partitionBy("converter", "run").parquet(folder)
