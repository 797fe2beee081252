"""Readers of document formats: files in, rows of (path, name, part, kind, text) out.

One binary scan lists and reads the files; each Arrow batch is converted where it is read. Containers give several rows.
Formats whose libraries are missing, and images, give a row without text and a note, so nothing disappears silently."""

from __future__ import annotations

import html
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.lexicons import ALLOWED_TYPES

SCHEMA = "path string, name string, kind string, text string, note string"

# Limits of an archive: entries, bytes in all, bytes of one entry; and of an e-mail's attachments.
ZIP_ENTRIES, ZIP_BYTES, ZIP_ENTRY_BYTES, MAIL_BYTES = 2000, 4 << 30, 800 << 20, 100 << 20


def kind_of(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_txt(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def read_html(data: bytes) -> str:
    t = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", read_txt(data))
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", t))).strip()


def read_rtf(data: bytes) -> str:
    """Text of an RTF file: groups of fonts, colours, styles and information are skipped."""
    src, out, skip, depth = data.decode("latin-1"), [], None, 0
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
    for m in token.finditer(src):
        word, number, byte, symbol, brace, char = m.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            if skip is not None and depth < skip:
                skip = None
        elif skip is not None:
            continue
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict") or symbol == "*":
            skip = depth
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif byte:
            out.append(bytes.fromhex(byte).decode("cp1252", "replace"))
        elif symbol and symbol in "\\{}":
            out.append(symbol)
        elif char:
            out.append(char)
    return "".join(out).strip()


def read_cda(data: bytes) -> str:
    """Title, then each section's title in capitals and its text chunks."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return "Could not parse CDA document"
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    lines = []
    for e in root:
        if local(e) == "title" and (e.text or "").strip():
            lines.append(f"DOCUMENT: {e.text.strip()}")
    for s in (e for e in root.iter() if local(e) == "section"):
        for e in s:
            if local(e) == "title" and (e.text or "").strip():
                lines.append(e.text.strip().upper())
            elif local(e) == "text":
                lines += [c.strip() for c in e.itertext() if c.strip()]
    return "\n".join(lines)


def read_docx(data: bytes) -> str:
    """Paragraphs of the body, then those of table cells that aren't blank."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda p: "".join(t.text or "" for t in p.iter(f"{w}t"))
    lines = [text(p) for p in body.findall(f"{w}p")]
    lines += [t for c in body.iter(f"{w}tc") for p in c.findall(f"{w}p") if (t := text(p)).strip()]
    return "\n".join(lines)


def mail_text(sender: str, to: str, cc: str, date: str, subject: str, body: str, attachments: list[str]) -> str:
    lines = [f"From: {sender}", f"To: {to}", *([f"Cc: {cc}"] if cc else []), f"Date: {date}", f"Subject: {subject}", "", body]
    return "\n".join([*lines, "", "Attachments:", *[f"  - {a}" for a in attachments]] if attachments else lines)


def safe_name(file: str) -> str:
    """A file name without folders, made of ASCII letters, digits, `_`, `-` and `.`, and no dots or underscores at its ends."""
    plain = unicodedata.normalize("NFKD", file).encode("ascii", "ignore").decode().replace("\\", " ").replace("/", " ")
    return re.sub(r"[^\w.-]", "", "_".join(plain.split()), flags=re.ASCII).strip("._")


def read_mail(name: str, data: bytes) -> Iterator[tuple[str, str, str | None, str | None]]:
    """The message, then each attachment named after it."""
    m = message_from_bytes(data, policy=policy.default)
    body, listed, kept = "", [], []
    for part in m.walk():
        kind, attached, file = part.get_content_type(), part.get_content_disposition() == "attachment", part.get_filename()
        if kind in ("text/plain", "text/html") and not attached and not body:
            body = part.get_content() if kind == "text/plain" else re.sub(r"<[^>]+>", "", part.get_content())
        elif attached or file:
            file, content = file or "attachment", part.get_payload(decode=True) or b""
            if len(content) > MAIL_BYTES:
                listed.append(f"{file} (too large, not ingested)")
                continue
            listed.append(file)
            if kind_of(file) in set(ALLOWED_TYPES) - {"zip", "eml", "msg"}:
                kept.append((file, content))
    yield name, "eml", mail_text(*(str(m.get(h, "")) for h in ("from", "to", "cc", "date", "subject")), body or "(no body)", listed), None
    base = name.rsplit(".", 1)[0]
    for file, content in kept:
        called = safe_name(f"{base}__att__{file}")
        try:
            yield from convert(called, content)
        except Exception as e:  # noqa: BLE001  one bad attachment must not stop the others
            yield called, kind_of(file), None, f"failed: {e}"


def read_zip(data: bytes) -> Iterator[tuple[str, str, str | None, str | None]]:
    """Entries of allowed types within the limits; one that can't be read is skipped, of a message only the first row counts."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = [e for e in z.infolist() if not e.is_dir() and kind_of(e.filename.rsplit("/", 1)[-1]) in ALLOWED_TYPES]
        if len(files) > ZIP_ENTRIES:
            raise ValueError("too many entries")
        for e in files:
            total += e.file_size
            if e.file_size > ZIP_ENTRY_BYTES or total > ZIP_BYTES:
                raise ValueError("archive too large")
            try:
                yield next(iter(convert(e.filename.rsplit("/", 1)[-1], z.read(e))))
            except Exception:  # noqa: BLE001, S112
                continue


def convert(name: str, data: bytes) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(name, kind, text, note) rows of one file."""
    kind = kind_of(name)
    simple = {"txt": read_txt, "rtf": read_rtf, "html": read_html, "htm": read_html, "cdax": read_cda, "docx": read_docx}
    if kind in simple:
        yield name, kind, simple[kind](data), None
    elif kind == "eml":
        yield from read_mail(name, data)
    elif kind == "zip":
        yield from read_zip(data)
    elif kind in ("tif", "tiff", "png", "jpg", "jpeg"):
        yield name, kind, None, "image: not screened"
    elif kind in ("pdf", "msg"):
        yield name, kind, None, f"no {kind} library installed"


def read_contents(files: DataFrame) -> DataFrame:
    """SCHEMA rows of files(path, content): what each file, its attachments and its entries say, or why they can't be read.

    Files of types that aren't allowed give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                if kind_of(name) not in ALLOWED_TYPES:
                    continue
                try:
                    rows = [(p, *r) for r in convert(name, data.as_py())]
                except Exception as e:  # noqa: BLE001  one bad file must not stop the others
                    rows = [(p, name, kind_of(name), None, f"failed: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "name", "kind", "text", "note"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same of all files under a path."""
    return read_contents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def unique_names(files: DataFrame, name: str = "name", order: str = "path") -> DataFrame:
    """Names made unique in order: the second report.pdf is report-2.pdf."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    base, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(base, F.lit("-"), n.cast("string"), ext)))
