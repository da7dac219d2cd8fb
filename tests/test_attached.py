"""Text of attachments, from files made here."""

import io
import zipfile
import zlib

from epistle.sources import attached


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://w"'


def pdf(*contents, pack=True, extra=b""):
    out = b"%PDF-1.4\n"
    for n, c in enumerate(contents, 1):
        data = zlib.compress(c) if pack else c
        out += b"%d 0 obj\n<< /Length %d %s>>\nstream\n" % (n, len(data), b"/Filter /FlateDecode " if pack else b"") + data + b"\nendstream\nendobj\n"
    return out + extra + b"trailer\n%%EOF"


CASES = {
    "a.TXT": ("Grüße".encode(), "done", "Grüße"),
    "b.csv": ("Grüße".encode("cp1252"), "done", "Grüße"),
    "c.log": ("x".encode("utf-16"), "done", "x"),
    "d.html": (b"<p>one</p><script>no</script><p>two</p>", "done", "one\ntwo"),
    "e.rtf": (rb"{\rtf1\ansi hello\par there}", "done", "hello\nthere"),
    "f.docx": (zipped(word__document_xml=f"<w:d {W}><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:p><w:t>World</w:t></w:p></w:d>", word__footnotes_xml=f"<w:d {W}><w:p><w:t>note</w:t></w:p></w:d>"), "done", "Hello\nWorld\nnote"),
    "g.xlsx": (zipped(xl__sharedStrings_xml="<s><si><t>Name</t></si><si><r><t>To</t></r><r><t>tal</t></r></si></s>", xl__worksheets__sheet2_xml="<w><row><c><v>7</v></c></row></w>", xl__worksheets__sheet1_xml='<w><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>1.5</v></c><c t="inlineStr"><is><t>in</t></is></c></row></w>'), "done", "Name\tTotal\n1.5\tin\n7"),
    "h.pptx": (zipped(ppt__slides__slide10_xml="<a><p><t>ten</t></p></a>", ppt__slides__slide2_xml="<a><p><t>two</t></p></a>"), "done", "two\nten"),
    "i.odt": (zipped(content_xml='<o xmlns:x="u"><x:h>Title</x:h><x:p>some <x:span>styled</x:span> text</x:p></o>'), "done", "Title\nsome styled text"),
    "j.pdf": (pdf(rb"BT /F1 12 Tf 10 20 Td (Hello \(w\)orld) Tj 0 -14 Td [(spl)-20(it)-300(gap)] TJ ET", b"q BT <FEFF00e9> Tj (o\\303) ' ET"), "done", "Hello (w)orld\nsplit gap\né\noÃ"),
    "k.pdf": (pdf(b"BT (plain) Tj ET", pack=False), "done", "plain"),
    "l.pdf": (pdf(b"0 0 m"), "done", ""),
    "m.pdf": (pdf(b"BT (x) Tj ET", extra=b"<< /Encrypt 5 0 R >>"), "failed", ""),
    "n.docx": (b"no zip", "failed", ""),
    "o.docx": (zipped(word__document_xml=f"<w:d {W}><w:p><w:t>kept</w:t></w:p></w:d>", word__footnotes_xml="<broken"), "failed", "kept"),
    "p.docx": (zipped(word__document_xml="<d>" + " " * 3_000_000 + "</d>"), "failed", ""),
    "q.exe": (b"MZ", "unsupported", ""),
    "noending": (b"x", "unsupported", ""),
    "r.txt": (b"", "skipped", ""),
    "s.txt": (None, "skipped", ""),
    "t.txt": (b"x" * 70_000, "done", "x" * 70_000),
}


def test_attachments(spark, monkeypatch):
    rows = [(i, name, data, 1) for i, (name, (data, _, _)) in enumerate(CASES.items())] + [(None, "z.txt", b"z", 1), (500, None, b"x", 1)]
    df = spark.createDataFrame(rows, "attachment_id long, filename string, data binary, part int").repartition(3)
    found = attached.parts(df)
    got = {r["attachment_id"]: r for r in attached.extracted(found).collect()}
    for i, (name, (_, status, text)) in enumerate(CASES.items()):
        assert (got[i]["status"], got[i]["text"]) == (status, text), name
    assert got[None]["text"] == "z" and got[500]["status"] == "unsupported" and "encrypted" in got[list(CASES).index("m.pdf")]["detail"]
    sheets = [(r["part"], r["name"]) for r in found.where(f"attachment_id = {list(CASES).index('g.xlsx')}").collect()]
    assert sorted(sheets) == [(0, "xl/worksheets/sheet1.xml"), (1, "xl/worksheets/sheet2.xml")]
    assert attached.parts(df.limit(0)).count() == 0


def test_too_large(spark):
    df = spark.createDataFrame([(1, "a.txt")], "attachment_id long, filename string").selectExpr("*", f"cast(repeat('x', {attached.MOST_BYTES + 1}) as binary) as data")
    assert attached.extracted(attached.parts(df)).first()["status"] == "skipped"
