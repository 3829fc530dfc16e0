"""Text layers of files written here by hand."""

import zlib

from sheafline.sources import pdf, store


def made(pages, packed=True, cmap=None):
    """A file with a page for each list of (x, y, text)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    if cmap:
        objects[3] = b"<< /Type /Font /ToUnicode 4 0 R >>"
        objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    kids = []
    for i, lines in enumerate(pages):
        body = b"BT /F1 10 Tf " + b" ".join(b"1 0 0 1 %d %d Tm %s Tj" % (x, y, t if t.startswith(b"<") else b"(" + t.replace(b"(", rb"\(").replace(b")", rb"\)") + b")") for x, y, t in lines) + b" ET"
        if packed:
            body = zlib.compress(body)
        n = 10 + 2 * i
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (n + 1)
        objects[n + 1] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", body)
        kids.append(b"%d 0 R" % n)
    objects[2] = b"<< /Type /Pages /Count %d /MediaBox [0 0 200 400] /Kids [%s] >>" % (len(pages), b" ".join(kids))
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in objects.items()) + b"\ntrailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF"


def test_pages_of_files(spark, tmp_path):
    first = made([[(20, 360, b"Order (no) 115"), (20, 348, b"second line"), (20, 100, b"foot")], [(50, 200, b"page two")], []])
    cmap = b"begincmap 1 beginbfchar <0001> <0935> endbfchar 1 beginbfrange <0002> <0003> <0928> endbfrange endcmap"
    files = {"a.pdf": first, "B.PDF": made([[(0, 0, b"<000100020003>")]], packed=False, cmap=cmap), "broken.pdf": b"not a file", "empty.pdf": b"", "note.txt": b"x"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {(r["path"].split("/")[-1], r["page"]): r for r in pdf.read_pages(store.scan_files(spark, str(tmp_path), "*.{pdf,PDF}")).collect()}
    assert set(got) == {("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3), ("B.PDF", 1), ("broken.pdf", None)}  # Spark leaves empty files out
    page = got["a.pdf", 1]
    assert page["text"] == "Order (no) 115\nsecond line\n\nfoot" and len(page["boxes"]) == 2
    assert page["boxes"][0] == [0.1, 0.075, 0.35, 0.055] and all(0 <= v <= 1 for b in page["boxes"] for v in b)
    assert got["a.pdf", 2]["text"] == "page two" and got["a.pdf", 3]["text"] == "" and got["a.pdf", 3]["boxes"] == []
    assert got["B.PDF", 1]["text"] == "वनऩ"
    assert got["broken.pdf", None]["error"].startswith("ValueError")
    assert [r["name"] for r in store.scan_files(spark, str(tmp_path), "*.{pdf,PDF}", "b").collect()] == ["B.PDF"]


def test_object_streams_and_escapes():
    inner = b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [5 0 R] /MediaBox [0 0 100 100] >>"
    heads = b"1 0 2 %d " % inner.index(b"<< /Type /Pages")
    body = zlib.compress(heads + inner)
    page = b"BT /F 9 Tf 14 TL 10 90 Td (a\\051\\n\\\\) Tj T* [(b) -300 (c)] TJ (d) ' ET"
    raw = b"%PDF-1.5\n7 0 obj << /Type /ObjStm /N 2 /First " + str(len(heads)).encode() + b" /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj\n"
    raw += b"5 0 obj << /Type /Page /Contents 6 0 R >> endobj\n6 0 obj << /Length 9 >> stream\n" + page + b"\nendstream endobj"
    file = pdf.Pdf(raw)
    text, boxes = pdf.page_text(file, file.pages()[0])
    assert text == "a)\n\\\nb c\nd" and len(boxes) == 1
