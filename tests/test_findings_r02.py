"""What the second review found: small cases that gave other results, or needed more of the machine."""

from __future__ import annotations

import weakref

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill import catalog
from leafmill.operators import scoring, structure, tables, validation
from leafmill.plans import office
from leafmill.sources import writers as W
from leafmill.sources.reader import batches_of, elements
from leafmill.sources.web import read_html


def test_index_keeps_the_sign_of_small_differences(spark):
    row = spark.range(1).select(F.lit("a").alias("competitor"), F.lit("en").alias("format"), F.lit(1.125).alias("speedup"), F.lit(-0.0003).alias("accuracy_delta"), F.lit(0.0005).alias("success_rate_delta"), F.lit(-1e-15).alias("median_json_asset_count_delta"), F.lit(None).cast("double").alias("median_json_run_provenance_count_delta"))
    assert scoring.index_table(row).first().line == "| a | en | 1.12x | -0.000 | +0.001 | +0.000 |  |"


def test_references_end_with_a_semicolon():
    got, links = read_html('<h1>a &amp; b &lt;c &#65;&#x42; d&amp</h1><p>x &ampc &nope; &copy<a href="/?a=1&copy=2&amp;b=3">l &am</a>')
    assert [e.text for e in got] == ["a & b <c AB d&amp", "x &ampc &nope; &copyl &am"] and links == [("/?a=1&copy=2&b=3", "l &am")]


def test_documents_that_pack_well_are_read(spark, tmp_path):
    texts = ["Erge " * 20_000 + "\nend", "same line\n" * 9_000]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("docx_elements", "hwpx_elements"):
        got = {(r.doc_id, r.element): r.text for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {(d, k): x for d, t in enumerate(texts, 1) for k, x in enumerate(t.strip("\n").split("\n"))}
    checked = {r.doc_id: r.semantic_empty for r in catalog.QUERIES["package_checks"](spark, str(tmp_path)).collect()}
    assert checked == {1: False, 2: False}


def test_negative_zero_has_no_sign():
    sheet = [("s", [[(-0.0, 0), (-0.001, 0), (0.0, 0), -0.0]])]
    for name, make in (("a.xlsx", W.xlsx), ("a.xls", W.xls)):
        assert elements(name, make(sheet, ["#,##0.00"]))[1][0].rows == [["0.00", "-0.00", "0.00", "0"]]


def same(spark, name, folder, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["hwp_cells", "hwpx_tables", "xls_formulas", "xls_cells", "xlsx_cells", "xls_parts"])
def test_a_nation_in_several_files(spark, sf, tmp_path, monkeypatch, name):
    monkeypatch.setattr(office, "FILE_ROWS", 2)
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    same(spark, name, tmp_path, "customer")


def test_a_nation_of_more_rows_than_a_sheet_has(spark, tmp_path):
    rows = spark.range(66_000).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), (F.col("id") / 4).alias("c_acctbal"))
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    for name, text in (("hwp_cells", "16499.75"), ("xls_formulas", "16499.75")):
        found = catalog.QUERIES[name](spark, str(tmp_path))
        last = found.where(F.col("r") >= 65_999).collect()
        assert text in {r.text for r in last} and name == "hwp_cells" or "1 (=SUM(A66000:B66000)*2+IF(B66000>0,1,-1))" in {r.text for r in last}


def test_validation_makes_what_is_wanted_of_sources_side_by_side(spark):
    long, short = "Alpha beta gamma. 12 delta epsilon zeta eta.", "Alpha beta gamma."
    rows = spark.createDataFrame([(1, "a", long), (1, "b", short), (2, "b", short)], "doc_id int, name string, raw_text string")
    wide = spark.createDataFrame([(1, long, short), (2, None, short)], "doc_id int, raw0 string, raw1 string")
    for name in validation.FOUND:
        found = validation.validate_wide(wide, ["a", "b"], "b", wanted=[name])
        assert found.columns == ["doc_id", name] and found.orderBy("doc_id").collect() == validation.validate(rows, ["a", "b"], "b").select("doc_id", name).orderBy("doc_id").collect()
    assert [r.missing for r in found.orderBy("doc_id").collect()] == [["12 delta epsilon zeta eta"], []]


def test_numbering_sorts_once_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Also with items at one place, and without a place or level: a reference by SQL."""
    monkeypatch.setattr(tables, "TASK_ITEMS", 200)
    n = F.col("id")
    place = F.when(n % 41 > 0, (F.hash(n, F.lit(1)) % 9).cast("int"))
    rows = spark.range(3_000).select(F.when(n % 97 > 0, n % 230).alias("l_orderkey"), place.alias("l_linenumber"), F.when(n % 37 > 0, (F.hash(n) % 50).cast("double")).alias("l_quantity"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    same(spark, "list_numbering", tmp_path, "lineitem")
    found = catalog.QUERIES["list_numbering"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1 and found.rdd.getNumPartitions() == 16


@pytest.mark.parametrize("name", ["pdf_elements", "pptx_elements", "docx_elements", "xlsx_cells", "docx_runs"])
def test_files_are_read_by_the_worker_that_makes_them(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_one_made_file_is_held():
    log = []

    def make(row):
        log.append(("made", row["name"]))
        return W.pdf([[row["name"]] * 3])

    batches = office._written(iter([pa.RecordBatch.from_pylist([{"name": "1"}, {"name": "2"}])]), make, "pdf")
    found = batches_of(((p, log.append(("taken", p)) or c) for p, c in batches))
    assert [r["text"] for b in found for r in b.to_pylist()] == ["1"] * 3 + ["2"] * 3
    assert log == [("made", "1"), ("taken", "1.pdf"), ("made", "2"), ("taken", "2.pdf")]


def test_blocks_are_objects_by_slices(spark, sf, monkeypatch):
    monkeypatch.setattr(structure, "SLICE", 50)
    alive, most = weakref.WeakSet(), []

    class Made(list):
        __hash__ = object.__hash__

    def make(text):
        made = Made(b["kind"] for b in structure.parse(text))
        alive.add(made)
        most.append(len(alive))
        return made

    texts = ["A line\n\na: 1\nb: 2\n\nx | y", None, "", "Head\n====\ntext"] * 20
    got = structure._by_slice(pa.array(texts), make, pa.string())
    assert got.to_pylist() == [["text", "pair", "table"], [], [], ["heading", "text"]] * 20 and len(got) == len(texts) and max(most) <= 12
    assert structure._by_slice(pa.array([], pa.string()), make, pa.string()).to_pylist() == []
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    assert [[b.kind for b in r.blocks] for r in structure.blocks(rows).orderBy("doc_id").collect()] == [r.kinds for r in structure.kinds(rows).orderBy("doc_id").collect()] == got.to_pylist()
    assert "struct" not in catalog.QUERIES["find_elements"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "blocks" not in catalog.QUERIES["find_elements"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def talks(spark, folder, turns):
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(folder / "conversations.parquet"))


@pytest.mark.parametrize("name", ["pptx_elements", "ppt_elements", "docx_comments"])
def test_a_conversation_in_several_files(spark, tmp_path, monkeypatch, name):
    """Also with turns at one place, blank lines, and conversations that go on in the next batch."""
    monkeypatch.setattr(office, "FILE_TURNS", 4)
    talks(spark, tmp_path, [(c, k // 2, "user" if k % 2 else "bot", "\n".join(["word", "  ", f"line {c} {k}"][: 1 + k % 3])) for c, n in ((1, 11), (2, 1), (3, 4), (4, 8), (5, 9), (6, 2)) for k in range(n)])
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        same(spark, name, tmp_path, "conversations")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_conversation_longer_than_a_file_and_a_batch(spark, tmp_path):
    talks(spark, tmp_path, [(c, k, "user", f"line\n\n{k}") for c, n in ((7, 10_500), (8, 2)) for k in range(n)])
    same(spark, "pptx_elements", tmp_path, "conversations")


def test_some_turns_are_held(spark, sf, monkeypatch):
    rows = [{"conv_id": c, "turn": k} for c, n in ((1, 1), (2, 5_000), (None, 1), (3, 2), (4, 4)) for k in range(n)]
    batches = (pa.RecordBatch.from_pylist(rows[k : k + 700]) for k in range(0, len(rows), 700))
    got = [(r["name"], r["first"], [t["turn"] for t in r["turns"]]) for r in office._talks(batches, 2_000)]
    assert [(n, first, len(t)) for n, first, t in got] == [(1, 0, 1), (2, 0, 2_000), (2, 2_000, 2_000), (2, 4_000, 1_000), (None, 0, 1), (3, 0, 2), (4, 0, 4)]
    assert all(t == list(range(first, first + len(t))) for _, first, t in got) and list(office._talks(iter([]), 2)) == []
    monkeypatch.setattr(office, "TASK_TURNS", 10)
    for name in ("pptx_elements", "ppt_elements", "docx_comments"):
        found = catalog.QUERIES[name](spark, sf)
        plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "collect_list" not in plan and plan.count("Exchange ") == 1 and plan.count("MapInArrow") == 1
        assert found.rdd.getNumPartitions() == spark.read.parquet(f"{sf}/conversations.parquet").count() // 10 + 1
