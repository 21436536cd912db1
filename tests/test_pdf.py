"""PDF files made by hand and by the library's writer, read again."""

import json
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartulary.api import Collection
from cartulary.sources import files, pdf, recognition


def build(objects, root=1, stream_xref=False, packed=(), prev=None):
    """objects: number -> body, or (dictionary, data) of a stream. packed: numbers that go into an object stream."""
    out, places = b"%PDF-1.7\n", {}
    body = lambda x: x if isinstance(x, bytes) else b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(x[1]), x[0], x[1])
    if packed:
        heads, inner = b"", b""
        for n in packed:
            heads += b"%d %d " % (n, len(inner))
            inner += objects[n] + b" "
        data = zlib.compress(heads + inner)
        objects = {k: v for k, v in objects.items() if k not in packed} | {90: (b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(packed), len(heads)), data)}
    for n, x in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body(x))
    at = len(out)
    if stream_xref:
        rows = {0: (0, 0, 65535), **{n: (1, p, 0) for n, p in places.items()}, **{n: (2, 90, i) for i, n in enumerate(packed)}, 99: (1, at, 0)}
        plain = b"".join(bytes([k]) + p.to_bytes(4, "big") + g.to_bytes(2, "big") for k, p, g in (rows[n] for n in sorted(rows)))
        up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(plain[i : i + 7], plain[i - 7 : i] if i else bytes(7))) for i in range(0, len(plain), 7))
        index = b" ".join(b"%d 1" % n for n in sorted(rows))
        out += b"99 0 obj\n" + body((b"/Type /XRef /Size 100 /W [1 4 2] /Index [%s] /Root %d 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>" % (index, root), zlib.compress(up))) + b"\nendobj\n"
    else:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items()) + b"trailer\n<< /Size 100 /Root %d 0 R >>\n" % root
    return out + b"startxref\n%d\n%%%%EOF" % at


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /aacute /Euro /uni65E5] >> /FirstChar 65 /Widths [700 600] >>"
CONTENT = b"""q 1 0 0 1 10 20 cm BT /F 10 Tf 12 TL 100 700 Td (AB) Tj 0 -12 Td [(A) -300 (B) -100 (A\\)\\
\\101)] TJ T* (next\\053) ' ET Q
BI /W 1 /H 1 /BPC 8 /CS /G ID \xff( EI
BT /F 20 Tf 1 0 0 1 300 100 Tm <4142 43> Tj (\001\002\003) Tj /Nope 9 Tf (unseen) Tj ET /X Do % a comment ( not text
"""


def simple(content=CONTENT, **options):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 7 0 R] /Count 2 /MediaBox [0 0 600 800] /Resources << /Font << /F 4 0 R >> /XObject << /X 6 0 R /I 8 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>",
        4: FONT,
        5: (b"/Filter [/ASCIIHexDecode /FlateDecode]", zlib.compress(content).hex().encode() + b">"),
        6: (b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 0] /Resources << /Font << /F 4 0 R >> /XObject << /X 6 0 R >> >>", b"BT /F 10 Tf 0 50 Td (form) Tj ET /X Do"),
        7: b"<< /Type /Page /Parent 2 0 R /Rotate 90 /Contents 9 0 R >>",
        8: (b"/Type /XObject /Subtype /Image /Width 1 /Height 1", b"\x00"),
        9: (b"", b"BT /F 10 Tf 100 200 Td (turned) Tj ET"),
    }
    return build(objects, **options)


def spans_of(data):
    return {p[0]: pdf.draw_page(p[4], p[5]) if p[6] is None else p[6] for p in pdf.read_pages(data)}


WANT = [
    ("AB", [110.0, 72.0, 123.0, 82.0], 10.0), ("A BA)A", [110.0, 84.0, None, 94.0], 10.0), ("next+", [110.0, 108.0, None, 118.0], 10.0), ("ABC", [300.0, 684.0, None, 704.0], 20.0), ("á€日", [326.0, 684.0, None, 704.0], 20.0),
    ("form", [5.0, 742.0, None, 752.0], 10.0),
]


@pytest.mark.parametrize("options", [{}, {"stream_xref": True}, {"stream_xref": True, "packed": (1, 2, 3, 4, 7)}])
@pytest.mark.parametrize("broken", [False, True])
def test_a_file_made_by_hand(options, broken):
    data = simple(**options)
    if broken:
        data = data.replace(b"startxref", b"startxxxx")
    got = spans_of(data)
    for (text, box, size), (want, known, points) in zip(got[1], WANT, strict=True):
        assert (text, size) == (want, points) and all(k is None or abs(k - b) < 0.01 for k, b in zip(known, box))
    assert [(t, b[:2]) for t, b, _ in got[2]] == [("turned", [198.0, 100.0])]
    assert [p[1:4] for p in pdf.read_pages(data)] == [(600.0, 800.0, 1), (800.0, 600.0, 1)]


def test_wide_fonts_and_their_unicode_maps():
    program = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<D83DDE00> <00660069>] endbfrange"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /MediaBox [0 0 100 100] /Contents 5 0 R /Resources << /Font << /F 4 0 R >> >> >>",
        4: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", 5: (b"", b"BT /F 10 Tf 0 0 Td <001000110012000300200021> Tj ET"),
        6: b"<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [16 [500 250] 18 19 100] >>", 7: (b"", program),
    }
    (text, box, _), = spans_of(build(objects))[1]
    assert text == "ABC 😀fi" and box == [0.0, 92.0, 38.5, 102.0]


@pytest.mark.parametrize("data", [b"", b"no file", b"%PDF-1.7 and nothing", b"%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj trailer << /Root 1 0 R /Encrypt 2 0 R >>"])
def test_broken_files_are_told(data):
    with pytest.raises(ValueError):
        list(pdf.read_pages(data))


def test_any_cut_or_changed_file_ends():
    whole, r = simple(), random.Random(3)
    for i in range(300):
        data = bytearray(whole[: r.randrange(len(whole))] if i % 2 else whole)
        for _ in range(r.randrange(6)):
            if data:
                data[r.randrange(len(data))] = r.randrange(256)
        try:
            for p in pdf.read_pages(bytes(data)):
                if p[6] is None:
                    pdf.draw_page(p[4], p[5])
        except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, zlib.error):
            pass  # what the table makes a warning of


@settings(max_examples=150, deadline=None)
@given(pages=st.lists(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12), max_size=4), min_size=1, max_size=3))
def test_what_is_written_is_read(pages):
    got = spans_of(pdf.write_pdf(pages))
    assert {i: [t for t, _, _ in s] for i, s in got.items()} == {i: [x for x in rows if x.strip(" ")] for i, rows in enumerate(pages, 1)}


def test_tables_of_files(spark, tmp_path):
    rows = [(d, i, f"line {i} of {d} ação") for d in ("a", "b") for i in range(1, 120)] + [("c", 1, None)]
    for r in pdf.write_documents(spark.createDataFrame(rows, "document_id string, line_no int, line string"), rows_a_page=50).collect():
        (tmp_path / f"{r['document_id']}.PDF").write_bytes(bytes(r["content"]))
        assert r["n_pages"] == (1 if r["document_id"] == "c" else 3)
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "hand.pdf").write_bytes(simple())
    got = {(r["path"].rsplit("/", 1)[1], r["page"]): r for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.PDF", 3]["text"] == "\n".join(f"line {i} of a ação" for i in range(101, 120)) and got["a.PDF", 3]["source"] == "native" and got["a.PDF", 3]["warning"] is None
    assert got["broken.pdf", 1]["text"] is None and "ValueError" in got["broken.pdf", 1]["warning"] and got["c.PDF", 1]["warning"] == "little native text"
    assert got["hand.pdf", 1]["text"] == "AB\nA BA)A\nnext+\nABCá€日\nform" and got["hand.pdf", 1]["n_images"] == 1
    spans = recognition.layout_spans(spark, str(tmp_path)).where(F.col("path").endswith("b.PDF"))
    assert spans.count() == 119 and spans.where("page = 2 AND span_ord = 0").first()["bbox"][:2] == [50.0, 52.0]


def test_from_files_to_the_better_reading(spark, tmp_path):
    note = "ATESTADO MÉDICO\nPaciente: ANA MARIA SOUZA\nCID F32.1\nSão Paulo, 10 de março de 2024\nCRM-SP: 123456 e mais palavras que fazem a página boa"
    (tmp_path / "good.pdf").write_bytes(pdf.write_pdf([note.split("\n")]))
    (tmp_path / "scan.pdf").write_bytes(pdf.write_pdf([["x"]]))
    (tmp_path / "photo.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x08\0\0\0\x09")
    (tmp_path / "slow.jpg").write_bytes(b"slow")
    calls = spark.sparkContext.accumulator(0)

    def engine(data):
        calls.add(1)
        if data == b"slow":
            import time

            time.sleep(20)
        words = "PARECER MÉDICO do paciente com muitas palavras legíveis".split()
        return [(1, 0, w, [float(i), 0.0, i + 1.0, 1.0], 95.0) for i, w in enumerate(words)] + [(2, 0, "beyond", [0, 0, 1, 1], 95.0)] * (data[:4] == b"\x89PNG")

    got = Collection.of_files(spark, str(tmp_path), engine=engine, recognise=recognition.Options(max_pages=1, seconds=1.0))
    names = {r["document_id"]: r["artifact_uri"].rsplit("/", 1)[1] for r in got.facts.collect()}
    pages = {names[r["document_id"]]: r for r in got.pages.collect()}
    assert pages["good.pdf"]["text"] == note and pages["good.pdf"]["source"] == "native"
    assert pages["scan.pdf"]["text"].startswith("PARECER MÉDICO") and pages["scan.pdf"]["source"] == "ocr"
    assert pages["photo.png"]["warning"] == "1 pages beyond the first 1 left out" and "no answer within 1 s" in pages["slow.jpg"]["warning"] and pages["slow.jpg"]["text"] == ""
    assert calls.value == 4  # once a file
    boxes = {names[r["document_id"]] for r in got.spans.where("text = 'PARECER'").collect()}
    assert boxes == {"photo.png"}  # a page with native spans keeps them


def test_pages_share_the_tables_of_their_fonts(monkeypatch):
    pages = [p for p in pdf.read_pages(pdf.write_pdf([["one (1)", "Привет"], ["two", "três"], ["three"]]))]
    fonts, read = json.dumps(json.loads(pages[0][5]) | {"only": "here"}), []
    monkeypatch.setattr(pdf.json, "loads", lambda x, of=json.loads: read.append(x) or of(x))
    drawn = [[s[0] for s in pdf.draw_page(p[4], fonts)] for p in pages]
    assert drawn == [["one (1)", "Привет"], ["two", "três"], ["three"]] and read == [fonts]


def test_rows_of_many_pages_travel_together():
    sizes = lambda n, size: [b.num_rows for b in pdf._batches(((i,) for i in range(n)), ["i"], [pdf.pa.int64()], lambda row: size)]
    assert sizes(9000, 8) == [4096, 4096, 808] and sizes(5, 1 << 19) == [2, 2, 1] and sizes(0, 8) == []
