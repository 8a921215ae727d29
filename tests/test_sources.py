from __future__ import annotations

import io
import zipfile

import pytest

from leafmill.operators import render
from leafmill.sources import writers as W
from leafmill.sources.compound import Compound, inflate
from leafmill.sources.legacy import clean_text
from leafmill.sources.package import Package, PackageError, detect
from leafmill.sources.reader import elements, parse_assets, parse_files, read_files, register, rows_of
from leafmill.sources.spread import render as shown
from leafmill.sources.spread import shift, span
from leafmill.sources.web import read_html
from leafmill.streaming.ingest import event_counts, ingest


@pytest.mark.parametrize(
    ("value", "code", "want"),
    [(0.125, "0.00%", "12.50%"), (12.345, "0.00", "12.35"), (1234.5, "$#,##0.00", "$1,234.50"), (1234, "#,##0", "1,234"), (1234.56, "#,##0.0", "1,234.6"), (-1234.5, "$#,##0.00;($#,##0.00)", "($1,234.50)"), (-1234, "#,##0;(#,##0)", "(1,234)"), (-0.125, "0.0%;(0.0%)", "(12.5%)"),
     (0.5, "h:mm", "12:00"), (1.5, "[h]:mm:ss", "36:00:00"), (123, "00000", "00123"), (1234567, "000-0000", "123-4567"), (12, '0 "kg"', "12 kg"), (3.5, '0.0"x"', "3.5x"), (42, '"SKU-"0000', "SKU-0042"), (0.5, "# ?/?", "1/2"), (3.25, "# ?/?", "3 1/4"), (-1.125, "# ?/?", "-1 1/8"),
     (12345, "0.00E+00", "1.23E+04"), (0.0012, "0.00E+00", "1.20E-03"), (-9900, "0.0E+00", "-9.9E+03"), (45292, "yyyy-mm-dd", "2024-01-01"), (7, "General", "7"), (0.1, "", "0.1")],
)
def test_number_formats(value, code, want):
    assert shown(value, code) == want


def test_formula_shift_and_spans():
    assert shift('SUM(A1,$B$2,C$3,$D4)&"A1"', 2, 1) == 'SUM(B3,$B$2,D$3,$D6)&"A1"'
    assert shift("A1+LOG10(B1)", -1, 0) == "#REF!+LOG10(#REF!)"
    assert span("B2:C4") == (1, 1, 3, 2) and span("AA1") == (0, 26, 0, 26)


def test_docx():
    numbering = f'<w:numbering {W._W}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
    item = lambda t, k: ("xml", W.word_paragraph(t, inner=f'<w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="5"/></w:numPr>'))
    merged = '<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    runs = '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>B</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t> in</w:t></w:r></w:ins><w:hyperlink r:id="h"><w:r><w:t> link</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
    content = W.docx(
        [("xml", W.word_paragraph("Head", "Sub")), item("x", 0), item("y", 1), item("z", 1), item("w", 0), item("v", 1), ("xml", merged), ("xml", runs)],
        {"word/numbering.xml": numbering, "word/_rels/document.xml.rels": W.relations(("h", "hyperlink", "http://x.org", "External")), "word/footnotes.xml": f'<w:footnotes {W._W}><w:footnote w:id="0">{W.word_paragraph("sep")}</w:footnote><w:footnote w:id="2">{W.word_paragraph("note")}</w:footnote></w:footnotes>',
         "docProps/core.xml": '<c xmlns:d="d"><d:title>T</d:title><d:creator>Me</d:creator></c>'},
    )
    kind, got = elements("a.docx", content)
    assert kind == "docx"
    assert [(e.kind, e.text) for e in got if e.rows is None] == [("heading", "T"), ("paragraph", "Author: Me"), ("heading", "Head"), ("paragraph", "1. x"), ("paragraph", "  1.a) y"), ("paragraph", "  1.b) z"), ("paragraph", "2. w"), ("paragraph", "  2.a) v"), ("paragraph", "**B** in link <http://x.org>[^2]"), ("note", "note")]
    table = next(e for e in got if e.rows is not None)
    assert table.rows == [["a", "b", ""], ["", "c"]] and table.spans == [(0, 0, 2, 1), (0, 1, 1, 2)]


def test_xlsx():
    tail = '<mergeCells><mergeCell ref="A1:B1"/></mergeCells><hyperlinks><hyperlink ref="A2" r:id="u"/></hyperlinks>'
    extra = {"xl/worksheets/_rels/sheet1.xml.rels": W.relations(("u", "hyperlink", "http://x.org", "External"), ("c", "comments", "../comments1.xml")), "xl/comments1.xml": f'<comments {W._S}><authors><author>Ann</author></authors><commentList><comment ref="C2" authorId="0"><text><t>why</t></text></comment></commentList></comments>'}
    kind, got = elements("a.xlsx", W.xlsx([("Plan", [["Title"], ["x", True, (0.5, 0)], [None, 7, "y"]]), ("Other", [])], ["0%"], extra, [tail]))
    assert kind == "xlsx" and [e.name for e in got] == ["Plan", "Other"]
    assert got[0].rows == [["Title", "", ""], ["x <http://x.org>", "TRUE", "50% [comment: Ann: why]"], ["", "7", "y"]] and got[0].spans == [(0, 0, 1, 2)] and got[1].rows == []


def test_charts():
    series = lambda n, c, v: f"<ser><tx><strRef><strCache><pt idx='0'><v>{n}</v></pt></strCache></strRef></tx><cat><strCache>{c}</strCache></cat><val><numCache>{v}</numCache></val></ser>"
    p = lambda i, v: f"<pt idx='{i}'><v>{v}</v></pt>"
    part = "<chartSpace><chart><title><tx><rich><t>Sales</t></rich></tx></title><plotArea><barChart>" + series("A", p(0, "Q1") + p(1, "Q2"), p(0, 1) + p(1, 2)) + series("B", p(0, "Q1"), p(0, 3) + p(2, 4)) + "</barChart></plotArea></chart></chartSpace>"
    extra = {"ppt/charts/chart1.xml": part, "ppt/slides/_rels/slide1.xml.rels": W.relations(("c", "chart", "../charts/chart1.xml"))}
    want = [["", "A", "B"], ["Q1", "1", "3"], ["Q2", "2", ""], ["3", "", "4"]]
    assert [(e.name, e.rows) for e in elements("a.pptx", W.pptx([""], extra))[1]] == [("Sales", want)]
    extra = {"xl/charts/chart1.xml": part, "xl/worksheets/_rels/sheet1.xml.rels": W.relations(("d", "drawing", "../drawings/d.xml")), "xl/drawings/d.xml": "<d/>", "xl/drawings/_rels/d.xml.rels": W.relations(("c", "chart", "../charts/chart1.xml"))}
    assert [e.rows for e in elements("a.xlsx", W.xlsx([("S", [["x"]])], extra=extra))[1]] == [[["x"]], want]


def test_pptx_order_and_groups():
    group = '<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="1000"/><a:ext cx="100" cy="100"/><a:chOff x="0" y="0"/><a:chExt cx="200" cy="200"/></a:xfrm></p:grpSpPr>' + W.slide_shape(["in group"], y=200) + "</p:grpSp>"
    kind, got = elements("a.pptx", W.pptx([W.slide_shape(["last"], y=2000) + group + W.slide_shape(["right"], x=9, y=5) + W.slide_shape(["left"], x=1, y=5) + W.slide_shape(["Top"], title=True)]))
    assert [e.text for e in got] == ["Top", "left", "right", "in group", "last"] and got[0].kind == "heading" and kind == "pptx"


def test_legacy_formats():
    assert [(e.kind, e.text) for e in elements("a.doc", W.doc("Head\n====\nbody é 日"))[1]] == [("heading", "Head"), ("paragraph", "body é 日")]
    assert [(e.kind, e.text, e.section) for e in elements("x", W.ppt([("T", ["a", "b"]), ("U", [])]))[1]] == [("heading", "T", 0), ("paragraph", "a", 0), ("paragraph", "b", 0), ("heading", "U", 1)]
    many = [[f"long text {k} é" * 20, k, (k / 7, 0), k % 2 == 0] for k in range(300)]
    got = elements("x", W.xls([("One", many), ("Two", [["z"]])], ["0.00"]))[1]
    assert got[0].rows == [[f"long text {k} é" * 20, str(k), f"{k / 7:.2f}", str(k % 2 == 0).upper()] for k in range(300)] and got[1].rows == [["z"]]
    for packed in (True, False):
        assert [(e.text, e.section) for e in elements("x", W.hwp([["가나다", "b" * 3000], ["c"]], packed))[1]] == [("가나다", 0), ("b" * 3000, 0), ("c", 1)]
    assert clean_text('see \x13 HYPERLINK "http://a" \x14here\x15!\rx') == "see here <http://a>!\nx"


def test_hostile_packages():
    def made(*parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in parts:
                z.writestr(name, data)
        return out.getvalue()

    for name in ("../x", "a\\..\\b", "/abs"):
        with pytest.raises(PackageError):
            Package(made((name, "x")))
    with pytest.raises(PackageError, match="too large"):
        Package(made(("bomb.xml", b" " * 10_000_000))).read("bomb.xml")
    bomb = '<!DOCTYPE x [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]><x>&b;ok&amp;</x>'
    assert Package(made(("a.xml", bomb))).xml("a.xml").text == "ok&"
    for bad in (b"", b"PK\x03\x04junk", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\xff" * 600, W.docx([])[:-40], None):
        rows = list(rows_of("a.docx", bad))
        assert len(rows) == 1 and rows[0][-1]
    assert detect("a.bin", W.docx([])) == "docx" and detect("x.PPT", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1") == "ppt"
    with pytest.raises(PackageError):
        import zlib

        worker = zlib.compressobj(wbits=-15)
        inflate(worker.compress(b"\0" * 100_000) + worker.flush(), 1000)


def test_compound_reader():
    data = {"a": b"x" * 5000, "f/b": b"y" * 10, "f/g/c": bytes(range(256)) * 40}
    file = Compound(W.compound(data))
    assert set(file.streams) == set(data) and all(file.read(k)[: len(v)] == v for k, v in data.items())


def test_html():
    got, links = read_html('<head><title>no</title></head><body><h2>A &amp; b</h2><p>one<p>two <a href="/x?a=1&amp;b=2">link</a> .<script>no</script><ul><li>i</ul><table><tr><td>1<td>2</td></tr></table>')
    assert [(e.kind, e.text) for e in got if e.rows is None] == [("heading", "A & b"), ("paragraph", "one"), ("paragraph", "two link."), ("paragraph", "- i")] and links == [("/x?a=1&b=2", "link")]


def test_folder_source_render_and_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    (inbox / "sub").mkdir(parents=True)
    (inbox / "a.docx").write_bytes(W.docx([("heading", "H"), ("paragraph", "p"), ("table", [["a", "b|c"], ["d"]])]))
    (inbox / "sub/b.xlsx").write_bytes(W.xlsx([("Plan", [["x", 1]]), ("Sheet2", [["y"]])]))
    (inbox / "c.pptx").write_bytes(b"PK broken")
    register(spark)
    a = read_files(spark, str(inbox))
    b = spark.read.format("office").load(str(inbox))
    assert sorted((r.kind or "", r.text or "") for r in a.collect()) == sorted((r.kind or "", r.text or "") for r in b.collect())
    shown = {r.path.rpartition("/")[2]: r for r in render.to_markdown(a).collect()}
    assert shown["a.docx"].markdown == "# H\n\np\n\n| a | b\\|c |\n| --- | --- |\n| d |  |"
    assert shown["b.xlsx"].markdown == "## Plan\n\n| x | 1 |\n| --- | --- |\n\n| y |\n| --- |" and shown["c.pptx"].error
    assert render.batch_summary(render.to_plain_text(a)).first().asDict() == {"total": 3, "success": 2, "failed": 1, "success_rate": 66.6667}
    assert '"tables":1' in {r.path.rpartition("/")[2]: r for r in render.to_json(a).collect()}["a.docx"].json
    ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    n = spark.read.parquet(str(tmp_path / "out")).count()
    (inbox / "d.docx").write_bytes(W.docx([("paragraph", "new")]))
    ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n + 1
    with pytest.raises(Exception, match="known"):
        spark.read.format("office").option("mode", "FAILFAST").load(str(inbox)).collect()


def test_event_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = sorted(map(tuple, event_counts(events).collect()))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = event_counts(stream.withColumn("ts", stream.ts.cast("timestamp"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n) for r in spark.table("counts").orderBy("start", "event_type").collect()] == [(e, n) for _, e, n, _ in batch]


def test_parse_files_of_nulls(spark):
    files = spark.createDataFrame([(None, None), ("a.docx", None), ("b.txt", b"x")], "path string, content binary")
    assert parse_files(files).where("error is not null").count() == 3
    assert parse_files(files.limit(0)).count() == 0


def test_assets(spark):
    files = spark.createDataFrame([("a", W.docx([], {"word/media/i.PNG": "xx", "word/embeddings/o.xlsx": "y"})), ("b", b"no"), (None, None)], "path string, content binary")
    assert [tuple(r) for r in parse_assets(files).orderBy("part").collect()] == [("a", "word/embeddings/o.xlsx", "o.xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", 1), ("a", "word/media/i.PNG", "i.PNG", "image/png", 2)]
