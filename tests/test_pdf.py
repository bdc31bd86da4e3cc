"""PDF files as a source."""

import random
import zlib

import pytest

from folium.sources import pdf, tables


def test_what_is_written_is_read():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("ab() \\\n\n<>%éß¿[]/1 Tj endobj endstream 1 0 obj") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 6))]
        assert pdf.page_texts(pdf.pdf_of(texts).encode()) == texts


def made(objects, tail=b""):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + tail


TREE = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] >>", 3: b"<< /Type /Pages /Kids [5 0 R] /Parent 2 0 R >>"}
PAGE = b"<< /Type /Page /Parent 2 0 R /Contents %s /Resources << /Font << /F1 9 0 R >> >> >>"


def stream(data, kind=b""):
    return b"<< %s/Length %d >>\nstream\n%s\nendstream" % (kind, len(data), data)


def test_page_trees_operators_and_fonts():
    cmap = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0010> <0012> <4E2D> endbfrange"
    objects = TREE | {
        4: PAGE % b"[6 0 R 7 0 R]",
        5: PAGE % b"8 0 R",
        6: stream(zlib.compress(b"BT /F0 9 Tf 1 0 0 1 5 5 Tm [(Wo) -20 (rd) -300 (gap)] TJ ET"), b"/Filter /FlateDecode "),
        7: stream(b"% a comment (x)\nBT 0 -12 Td (nested (paren) \\101\\n\\\ncut) Tj (next) ' ET"),
        8: stream(b"BT /F1 9 Tf <00010010 0012> Tj ET"),
        9: b"<< /Type /Font /ToUnicode 10 0 R >>",
        10: stream(cmap),
    }
    assert pdf.page_texts(made(objects)) == ["é中丯", "Word gap\nnested (paren) A\ncut\nnext"]


def test_objects_in_streams_and_wrong_lengths():
    inner = b"4 0 5 %d " % len(PAGE % b"8 0 R")
    packed = inner + (PAGE % b"8 0 R") + b"<< /Type /Page /Parent 2 0 R >>"
    objects = TREE | {7: b"<< /Type /ObjStm /N 2 /First %d /Length %d >>\nstream\n%s\nendstream" % (len(inner), len(packed), packed), 8: b"<< /Length 3 >>\nstream\nBT (whole) Tj ET\nendstream"}
    assert pdf.page_texts(made(objects)) == ["", "whole"]


@pytest.mark.parametrize(("content", "why"), [(b"hello", "no PDF"), (made(TREE, b"trailer << /Encrypt 5 0 R >>"), "encrypted"), (made({1: TREE[1]}), "no pages"), (made(TREE | {4: PAGE % b"6 0 R", 5: PAGE % b"6 0 R", 6: stream(b"x", b"/Filter /DCTDecode ")}), "DCTDecode")])
def test_errors(content, why):
    with pytest.raises(ValueError, match=why):
        pdf.page_texts(content)


def test_files_with_errors_as_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.pdf_of(["one", "two\nlines", ""]).encode())
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"other")
    good, bad = tables.extracted(tables.files(spark, str(tmp_path)), pdf.page_texts)
    assert sorted((r.document.rsplit("/", 1)[1], r.page, r.text) for r in good.collect()) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two\nlines"), ("a.pdf", 3, "")]
    assert [(r.document.rsplit("/", 1)[1], r.error) for r in bad.collect()] == [("b.pdf", "no PDF file")]
