"""Parts of office files that the round trips over tables don't hold."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from leafmill.functions.text import latex
from leafmill.operators import render, scoring
from leafmill.sources import writers as W
from leafmill.sources.biff import Formulas, header_text, link_target, read_xls, records
from leafmill.sources.checks import bad_member, has_signal
from leafmill.sources.compound import Compound
from leafmill.sources.hwp import Shape, info_of, shape_starts
from leafmill.sources.legacy import clean_text, heading_of, quality, read_doc, read_ppt, sections_of, with_marker
from leafmill.sources.package import Package, PackageError, parse_xml
from leafmill.sources.reader import elements, gather_files, parse_files
from leafmill.sources.spread import header_text as sheet_header


def texts(name, content):
    return [(e.kind, e.text) for e in elements(name, content)[1] if e.rows is None]


def test_docx_text_boxes_boxes_to_tick_and_pictures():
    box = '<w:drawing><wp:anchor><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></wp:anchor></w:drawing>'
    tick = '<w:fldChar><w:ffData><w:checkBox><w:default w:val="0"/><w:checked/></w:checkBox></w:ffData></w:fldChar>'
    open_box = '<w:fldChar><w:ffData><w:checkBox><w:default w:val="0"/></w:checkBox></w:ffData></w:fldChar>'
    picture = '<w:drawing><wp:docPr title="T" descr="D"/><a:blip r:embed="i"/></w:drawing>'
    alternate = "<mc:AlternateContent><mc:Choice><w:p><w:r><w:t>chosen</w:t></w:r></w:p></mc:Choice><mc:Fallback><w:p><w:r><w:t>other</w:t></w:r></w:p></mc:Fallback></mc:AlternateContent>"
    moved = "<w:moveFrom><w:p><w:r><w:t>was here</w:t></w:r></w:p></w:moveFrom>"
    space = W._W + ' xmlns:wp="wp" xmlns:a="a" xmlns:mc="mc"'
    body = f"<w:p><w:r>{box}</w:r></w:p><w:p><w:r>{tick}<w:t> yes </w:t>{open_box}</w:r></w:p><w:p><w:r>{picture}</w:r></w:p>{alternate}{moved}<w:altChunk r:id='h'/><w:p><w:bookmarkStart w:name='_x'/><w:bookmarkStart w:name='here'/><w:r><w:rPr><w:u/></w:rPr><w:t>under</w:t></w:r></w:p>"
    content = W.docx([], {"word/document.xml": f"<w:document {space}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": W.relations(("i", "image", "media/a.png"), ("h", "aFChunk", "in.mht")),
                          "word/in.mht": "MIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n<html><body><h2>Imported</h2><p>page</p></body></html>"})
    assert texts("a.docx", content) == [("paragraph", "boxed\n"), ("paragraph", "[x] yes [ ]"), ("paragraph", "![T D](a.png)"), ("paragraph", "chosen"), ("paragraph", "was here"), ("heading", "Imported"), ("paragraph", "page"), ("paragraph", "[bookmark: here] <u>under</u>")]


def test_pptx_layouts_diagrams_and_authors():
    layout = f'<p:sldLayout {W._P}><p:cSld><p:spTree>{W.slide_shape(["From layout"])}{W.slide_shape(["Place"], title=True)}</p:spTree></p:cSld></p:sldLayout>'
    frame = '<p:graphicFrame><a:graphic><dgm:relIds xmlns:dgm="d" r:dm="dm"/></a:graphic></p:graphicFrame>'
    data = '<dgm:dataModel xmlns:dgm="d" xmlns:a="a"><dgm:pt><dgm:t><a:p><a:r><a:t>One</a:t></a:r></a:p></dgm:t></dgm:pt><dgm:pt/></dgm:dataModel>'
    content = W.pptx([W.slide_shape(["Body"], y=5) + frame], {
        "ppt/slides/_rels/slide1.xml.rels": W.relations(("l", "slideLayout", "../slideLayouts/l.xml"), ("dm", "diagramData", "../diagrams/data1.xml"), ("c", "comments", "../comments/c.xml")), "ppt/slideLayouts/l.xml": layout, "ppt/diagrams/data1.xml": data,
        "ppt/comments/c.xml": f'<p:cmLst {W._P}><p:cm authorId="0"><p:text>Why?</p:text></p:cm></p:cmLst>', "ppt/commentAuthors.xml": f'<p:cmAuthorLst {W._P}><p:cmAuthor id="0" name="Ann"/></p:cmAuthorLst>',
    })
    assert texts("a.pptx", content) == [("paragraph", "From layout"), ("paragraph", "One"), ("paragraph", "Body"), ("comment", "Ann: Why?")]


def test_xlsx_sheets_of_any_extent_and_headers():
    book = W.xlsx([("far", [["x"]])], extra={"xl/worksheets/sheet1.xml": f'<worksheet {W._S}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c></row><row r="1048576"><c r="XFD1048576"><v>7</v></c></row></sheetData></worksheet>'})
    rows = elements("a.xlsx", book)[1][0].rows
    assert len(rows) == 1_048_576 and rows[0] == ["a"] and rows[1] == [] and rows[-1][-1] == "7" and len(rows[-1]) == 16_384
    assert sheet_header('&L&"Arial,Bold"Left &&&C&K00FF00Mid &P&R') == "Left & | Mid" and sheet_header("plain") == "plain"


def test_entities_are_never_expanded():
    bomb = b'<?xml version="1.0"?><!--' + b"x" * 5000 + b'--><!DOCTYPE a [<!ENTITY b "aaaa">]><a>1&b;2</a>'
    assert parse_xml(bomb).text == "12" and parse_xml(bomb.decode().encode("utf-16")).text == "12"
    assert [x.text for x in parse_xml(b"<a><b>x</b><c>y<d></a>")] == ["x", "y"]
    with pytest.raises(PackageError):
        parse_xml(b"no xml")
    with pytest.raises(PackageError):
        list(Package(W.package({"s.xml": '<!DOCTYPE w [<!ENTITY b "x">]><w><row>&b;</row></w>'})).rows("s.xml", "row"))


def test_xls_formulas_shared_dates_and_damage():
    t = W.tokens
    shared = W.xls_formula(0, 1, b"\x01\0\0\1\0") + W._biff(0x4BC, struct.pack("<HHBBBBH", 0, 2, 1, 1, 0, 3, len(t((0, 0), 2, b"\x05"))) + t((0, 0), 2, b"\x05")) + W.xls_formula(1, 1, b"\x01\0\0\1\0", 4.0)
    tail = shared + W.xls_formula(2, 1, t((5, 0), b"\x21\xff\x00", b"\x1f"), 1.0) + W.xls_merge((3, 3, 0, 1), (3, 3, 2, 3)) + W.xls_link(9, 0, 9, 0, r"C:\x\y.txt")
    got = list(read_xls(Compound(W.xls([("s", [[1], [2], [3], [(45292, 0)]])], ["yyyy-mm-dd"], tails=[tail], days_1904=True))))
    assert got[-1].rows[:4] == [["1", "0 (=A1*2)"], ["2", "4 (=A2*2)"], ["3", "1 (=F255(A6))"], ["2028-01-02", "", ""]] and got[-1].rows[9] == [r"C:\x\y.txt"] and got[-1].spans == [(3, 0, 1, 2), (3, 2, 1, 2)]
    f = Formulas(["A b", "C"], [(0, 1), (9, 9)], [])
    assert f.text(b"\x3a\0\0\0\0\1\0") == "'A b':C!$B$1" and f.text(b"\x3a\1\0\0\0\1\0") == "$B$1" and f.text(b"\x23\7\0\0\0") == "Name7" and f.text(t((0, 0)), -1, 0) == "#REF!" and f.text(t(1, b"\x03")) == "1" and f.text(t(True, b"\x15")) == "(TRUE)"
    assert f.text(b"\x2c\xff\xff\xff\xc0", cell=(4, 2)) == "B4" and f.text(b"\x2d\0\0\1\0\0\xc0\1\x40", cell=(4, 2)) == "C5:D$2"
    assert header_text('&L&"Arial,Bold"&14Left && &P&RRight &D') == "Left & # Right date"
    assert link_target("see https://x.org/long and".encode("utf-16-le")) == "https://x.org/long"
    good = W._biff(0x203, b"x" * 14)
    assert [k for _, k, _ in records(struct.pack("<HH", 5, 60_000) + b"\0" + good)] == [5, 0x203]
    far = W.xls([("s", [])], tails=[W._biff(0x203, struct.pack("<HHHd", 65_535, 255, 0, 1.5))])
    rows = list(read_xls(Compound(far)))[0].rows
    assert len(rows) == 65_536 and sum(map(len, rows)) == 256


def test_doc_recovery_and_structure():
    assert clean_text('a \x13 HYPERLINK "http://x" \\l "p" \x14b\x15 \x13 HYPERLINK \\l "q" \x14c\x15\x0cd') == "a b <http://x#p> c <#q>\n\u241c\nd"
    assert heading_of("### Three") == (3, "Three") and heading_of("Heading 2: Two") == (2, "Two") and heading_of("제목: 하나") == (1, "하나") and heading_of("소제목: 둘") == (2, "둘") and heading_of("title") == (0, "title")
    assert [with_marker(x) for x in ("• a", "3) b", "(4) c", "iv. d", "☑ e", "[ ] f", "① g", "3.14 h")] == ["- a", "3. b", "4. c", "- d", "- [x] e", "- [ ] f", "- g", "3.14 h"]
    assert sections_of(["a", "\u241c", "\u241c", "b"]) == [["a"], ["b"]] and quality(["abc"]) == 18 and quality(["\ufffd"]) == 2
    got = list(read_doc(Compound(W.doc("Title: One\nText\n\x0cName\tQ\nA\t1"))))
    assert [(e.kind, e.level, e.section, e.text if e.rows is None else e.rows) for e in got] == [("heading", 1, 0, "One"), ("paragraph", 0, 0, "Text"), ("table", 0, 1, [["Name", "Q"], ["A", "1"]])]
    cut = W.compound({"WordDocument": b"\xec\xa5" + bytes(0x16) + struct.pack("<II", 0x40, 0x40 + 20) + bytes(0x20) + "plain text".encode("utf-16-le")})
    assert [e.text for e in read_doc(Compound(cut))] == ["plain text"]


def test_ppt_notes_comments_and_streams():
    atom = lambda kind, body, options=0: struct.pack("<HHI", options, kind, len(body)) + body
    text = lambda x, kind=1: atom(3999, struct.pack("<I", kind)) + atom(4000, x.encode("utf-16-le"))
    deck = atom(1006, text("One", 0) + text("body"), 15) + atom(1008, text("said"), 15) + atom(12000, atom(4026, "why".encode("utf-16-le")), 15) + atom(1006, text("Two", 6), 15)
    got = list(read_ppt(Compound(W.compound({"PowerPoint Document": deck, "Contents": atom(1006, text("other"), 15)}))))
    assert [(e.kind, e.level, e.section, e.text, e.part.partition("#")[2]) for e in got] == [
        ("heading", 1, 0, "One", "slide1"), ("paragraph", 0, 0, "body", "slide1"), ("heading", 2, 0, "Notes", "slide1#notes"), ("paragraph", 0, 0, "said", "slide1#notes"),
        ("heading", 2, 0, "Comments", "slide1#comments"), ("paragraph", 0, 0, "why", "slide1#comments"), ("heading", 1, 1, "Two", "slide2"),
    ]
    assert [e.text for e in read_ppt(Compound(W.compound({"Contents": text("bare")})))] == ["bare"]


def test_hwp_info_and_nested_lists():
    info = info_of(Compound(W.hwp([["x"]], info=W.hwp_info([(10, 0), (20, 3 | 1 << 2 | 1 << 16)], ["바탕글", "제목"], [(2, "PNG")]))))
    assert info.sections == 1 and info.fonts == ["Batang"] and info.paragraphs == [("center", 100, 200, 50)] and info.shapes[1] == Shape(20.0, "biu_") and [s[0] for s in info.styles] == ["바탕글", "제목"] and info.files == [(2, "PNG")]
    assert shape_starts(struct.pack("<IHIH", 0, 1, 5, 2)) == [(0, 1), (5, 2)] and shape_starts(struct.pack("<IIII", 0, 1, 5, 2)) == [(0, 1), (5, 2)] and Shape.of(b"short") == Shape()
    inner = W.hwp_table([["in 1", "in 2"]], level=3)
    outer = W._hwp_record(71, 1, b" lbt" + bytes(40)) + W._hwp_record(77, 2, struct.pack("<IHH", 0, 1, 1) + bytes(10)) + W._hwp_record(72, 2, struct.pack("<IIHHHH", 1, 0, 0, 0, 1, 1) + bytes(18)) + W.hwp_paragraph("cell", 2, controls=inner)
    got = elements("a.hwp", W.hwp([W.hwp_paragraph("p", controls=outer)]))[1]
    assert [e.rows for e in got if e.rows is not None] == [[["cell\nin 1\nin 2"]]]
    bad = W.compound({"FileHeader": (b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x03000000, 0)).ljust(256, b"\0")})
    with pytest.raises(PackageError):
        elements("a.hwp", bad)


def test_hwpx_order_headings_objects():
    head = '<hh:charPr id="7" height="2000"><hh:bold/><hh:underline type="NONE"/></hh:charPr>'
    inside = f'<hp:p>{W.hwpx_run("Big", 0)}<hp:run><hp:t>be</hp:t><hp:lineBreak/><hp:ctrl><hp:footNote><hp:subList><hp:p>{W.hwpx_run("note")}</hp:p></hp:subList></hp:footNote></hp:ctrl><hp:pic><hp:img binaryItemIDRef="image1"/></hp:pic><hp:t>fore</hp:t></hp:run></hp:p>'
    got = elements("a.hwpx", W.hwpx([["second"], [inside]], head, order=[1], files={"image1.png": b"x"}))[1]
    assert [(e.kind, e.level, e.text, e.name) for e in got] == [("heading", 1, "Bigbe\n", ""), ("note", 0, "note", "footnote"), ("image", 0, "", "image1.png"), ("paragraph", 0, "fore", ""), ("paragraph", 0, "second", "")]
    assert got[0].runs[0] == ("Big", "b", 20.0)


def test_packages_that_say_nothing():
    assert not has_signal("docx", W.docx([("paragraph", " ")])) and has_signal("docx", W.docx([("paragraph", "x")])) and has_signal("docx", b"broken") and has_signal("txt", b"")
    assert not has_signal("xlsx", W.xlsx([("Sheet1", [])])) and has_signal("xlsx", W.xlsx([("Plan", [])])) and has_signal("xlsx", W.xlsx([("Sheet1", [[1]])]))
    assert bad_member(b"PK no") and bad_member(W.docx([])) is None


def test_gathered_documents_render_as_grouped_ones(spark):
    files = [("a.docx", W.docx([("heading", "H"), ("paragraph", "p"), ("table", [["a", "b"], ["c", "d"]])])), ("b.hwp", W.hwp([W.hwp_paragraph("t", controls=W.hwp_equation("alpha over 2"))])), ("c.docx", b"broken"), ("d.docx", W.docx([])), ("e.docx", None)]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in files], "path string, content binary")
    for make in (render.to_markdown, render.to_plain_text, render.to_json):
        one, two = ({r.path: r[2] for r in make(x).collect()} for x in (parse_files(df), gather_files(df)))
        assert {p: two[p] for p in one} == one
    got = {r.path: (r.markdown, bool(r.error)) for r in render.to_markdown(gather_files(df)).collect()}
    assert got == {"a.docx": ("# H\n\np\n\n| a | b |\n| --- | --- |\n| c | d |", False), "b.hwp": (r"t" + "\n\n" + r"$$ \frac{\alpha}{2} $$", False), "c.docx": ("", True), "d.docx": ("", False), "e.docx": ("", True)}
    assert "Exchange" not in render.to_markdown(gather_files(df))._jdf.queryExecution().executedPlan().toString()


def test_equations(spark):
    rows = [("Omega times sum x", r"\Omega \times \sum x"), ("a <= b != c", r"a \leq b \neq c"), ("sqrt x over 2", r"\frac{\sqrt{x}}{2}"), ("alphabet", "alphabet")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "s string").select(latex("s")).collect()]
    assert got == [b for _, b in rows]


def test_runs_that_take_too_long(spark):
    import time

    def slow(path, content):
        time.sleep(5)

    got = scoring.run_benchmark(spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary"), {"slow": slow}, timeout=0.2).first()
    assert got.output is None and "TimeoutError" in got.error and got.seconds < 3


def test_scores_without_expectations(spark):
    row = spark.range(1).select(F.lit("| a | b |\n| --- | --- |\n| x.y | 2 |").alias("output"), *[F.lit(None).cast(k).alias(n) for n, k in (("expected_text", "array<string>"), ("expected_markdown", "array<string>"), ("expected_tables", "array<array<array<string>>>"), ("expected_table_rows", "array<array<string>>"), ("expected_assets", "array<string>"), ("expected_empty", "boolean"), ("asset_paths", "array<string>"))])
    assert scoring.score_output(row).first().accuracy is None
    cells = row.withColumn("expected_tables", F.array(F.array(F.array(F.lit("x.y"), F.lit("xzy"), F.lit("2"), F.lit("")))))
    got = scoring.score_output(cells).first()
    assert (got.expected_table_cells_total, got.expected_table_cells_found, got.accuracy) == (3, 2, 2 / 3)


def test_pdf_strings_arrays_forms_and_object_streams():
    import zlib

    content = b"q 1 0 0 1 0 100 cm BT /F1 12 Tf 1 0 0 1 10 700 Tm (Par\\(en\\)s \\101) Tj 0 -20 Td [(Hel) 20 (lo) -300 (there)] TJ ET Q /X1 Do /I1 Do BT /F1 12 Tf 300 800 Td (right) Tj ET BI /W 1 ID xyz EI"
    form = b"BT /F1 12 Tf 5 50 Td (in form) ' ET"
    packed = b"6 0 7 60 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>".ljust(8 + 60) + b"(other)"
    first = 8
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents [4 0 R] /Resources << /Font << /F1 6 0 R >> /XObject << /X1 5 0 R /I1 9 0 R >> >> >>"}
    stream = lambda head, raw: b"<< %s /Length %d >> stream\r\n%s\nendstream" % (head, len(raw), raw)
    objects |= {4: stream(b"", content), 5: stream(b"/Type /XObject /Subtype /Form", form), 8: stream(b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % first, zlib.compress(packed)), 9: stream(b"/Subtype /Image", b"x")}
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj %s endobj\n" % x for x in objects.items())
    got = elements("a.pdf", data)[1]
    assert [(e.kind, e.text or e.name) for e in got] == [("paragraph", "Parens A right".replace("Parens", "Par(en)s")), ("paragraph", "Hello there"), ("paragraph", "in form"), ("image", "I1"), ("image", "inline")]
    with pytest.raises(PackageError):
        elements("a.pdf", data + b"trailer << /Encrypt 5 0 R >>")
    assert elements("a.pdf", W.pdf([["one"], ["two"]], packed=False)[:-60])[1][0].text == "one"


def test_guards_are_options(spark):
    book = W.docx([("paragraph", "a" * 300_000)])
    df = spark.createDataFrame([("a.docx", bytearray(book))], "path string, content binary")
    assert parse_files(df).first().error and len(parse_files(df, guards={"max_ratio": 10_000}).first().text) == 300_000
