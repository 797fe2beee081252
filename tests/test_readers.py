"""Document formats, each built in the test."""

import zipfile
from email.message import EmailMessage

from vellum.sources import readers


def test_formats(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>Para one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.txt").write_bytes(b"plain \xff text")
    (tmp_path / "c.rtf").write_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 \{x\}}")
    (tmp_path / "d.html").write_text("<html><script>x</script><p>A &amp; B</p></html>")
    (tmp_path / "e.cdax").write_text('<c xmlns="urn:x"><title>T</title><section><title>sec</title><text> one <b>two</b></text></section></c>')
    (tmp_path / "bad.cdax").write_text("<oops")
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@x.com", "b@x.com", "Hi"
    m.set_content("Body text")
    m.add_attachment("attached".encode(), maintype="text", subtype="plain", filename="n.txt")
    (tmp_path / "f.eml").write_bytes(bytes(m))
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("in/h.txt", "inside")
        z.writestr("in/h.exe", "no")
        z.writestr("in/m.eml", bytes(m))
    (tmp_path / "i.png").write_bytes(b"x")
    (tmp_path / "j.exe").write_bytes(b"x")
    got = {(r["name"], r["kind"]): r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    text = {k[0]: r["text"] for k, r in got.items()}
    assert text["a.docx"] == "Para one\nCell" and text["b.txt"] == "plain \ufffd text" and text["d.html"] == "A & B"
    assert text["c.rtf"] == "Hello bold\ncafé {x}" and text["e.cdax"] == "DOCUMENT: T\nSEC\none\ntwo" and text["bad.cdax"] == "Could not parse CDA document"
    assert "Subject: Hi" in text["f.eml"] and "Body text" in text["f.eml"] and text["f__att__n.txt"] == "attached"
    assert text["h.txt"] == "inside" and "m.eml" in text and "m__att__n.txt" not in text  # of a message in an archive only the first row
    assert got[("i.png", "png")]["note"].startswith("image") and "j.exe" not in text and "h.exe" not in text


def test_unique_names(spark):
    df = spark.createDataFrame([("1", "a.pdf"), ("2", "a.pdf"), ("3", "b"), ("4", "a.pdf"), ("5", "b")], "path string, name string")
    assert {r["path"]: r["unique_name"] for r in readers.unique_names(df).collect()} == {"1": "a.pdf", "2": "a-2.pdf", "3": "b", "4": "a-3.pdf", "5": "b-2"}
