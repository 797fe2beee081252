"""WARC archives: a native writer, and a PySpark Python data source that reads them.

The writer composes each record as text in the JVM and leaves the bytes to Spark's text sink, so archives go to any
store Spark writes to. Of records with equal payloads of at least `least` bytes, that with the smallest id is a
response and the others are revisits, which carry the payload's digest and length but not the payload.

The reader plans one partition per group of whole files, takes predicates on the record type and on headers, parses
headers first and skips past the payload of every record that they reject, or of all records with payload=false.

Defined cases: a null payload is empty; an id that is null is never the smallest unless all are; rows that repeat the
smallest id are all responses; a null URL writes no target header; control characters in a URL are percent-encoded; a
file that ends within a record gives the records before it and then an error naming the file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from vellum.llm.common import join_with_hot_keys, shared_dir

LEAST = 100
TRAILER = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
    "content_length long, payload_bytes long, payload binary, file string"
)
#: Columns that are headers, and so can be pushed down.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def plan_revisits(pages: DataFrame, key: str, payload: str, least: int = LEAST) -> DataFrame:
    """pages with payload as text, digest, payload_bytes and, for revisits, the id that they refer to."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumn("__body", body).withColumns(
        {"payload_bytes": F.octet_length("__body").cast("long"), "digest": F.sha2(F.encode("__body", "UTF-8"), 256)}
    )
    first = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("digest")
        .agg(F.min(key).alias("first_id"), F.count("*").alias("n_same"))
        .filter("n_same > 1")
    )
    out = join_with_hot_keys(rows, first, "digest", "n_same", pages.count())
    revisit = F.col("n_same").isNotNull() & F.col("first_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_id"))
    return out.withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id", "n_same")


def records(planned: DataFrame, key: str, url: str) -> DataFrame:
    """One text value per record."""
    is_revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    clean = F.col(url)
    for n in (*range(32), 127):
        clean = F.replace(clean, F.lit(chr(n)), F.lit(f"%{n:02X}"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    length = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(key)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {profile}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    )
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("__body"))
    return planned.select(F.concat(head, F.lit("\r\n\r\n"), http, body).alias("value"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> str:
    own = pages.select(key, url, payload)
    records(plan_revisits(own, key, payload, least), key, url).write.option("lineSep", TRAILER).text(path)
    return path


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _local(path: str) -> str | None:
    u = urlparse(path)
    return (u.path if u.scheme == "file" else path) if u.scheme in ("", "file") else None


def _open(path: str):
    if (own := _local(path)) is not None:
        return open(own, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _listed(path: str) -> list[tuple[str, int]]:
    visible = lambda p: os.path.basename(p)[:1] not in "._"
    if (own := _local(path)) is not None:
        if os.path.isfile(own):
            return [(own, os.path.getsize(own))]
        return sorted((e.path, e.stat().st_size) for e in os.scandir(own) if e.is_file() and visible(e.path))
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(inner, recursive=False))
    scheme = path.split("://", 1)[0]
    return sorted((f"{scheme}://{x.path}", x.size) for x in found if x.is_file and visible(x.path))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[name], "=", f.value))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[name], "in", list(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[name], "starts", f.value))
            else:
                yield f

    def partitions(self):
        groups, own, size = [], [], 0
        for path, n in _listed(self.path):
            if own and size + n > self.split:
                groups.append(Files(own))
                own, size = [], 0
            own.append(path)
            size += n
        return [*groups, Files(own)]

    def _wanted(self, head: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            have = head.get(name)
            if name == "warc-payload-digest" and have is not None:
                have = have.removeprefix("sha256:")
            if have is None or not (have == value if kind == "=" else have in value if kind == "in" else have.startswith(value)):
                return False
        return True

    def read(self, partition):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.binary(), pa.string()]
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for path in partition.paths:
            for row in self._records(path):
                rows.append(row)
                held += len(row[7] or b"")
                if len(rows) >= 2000 or held > 16 << 20:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    def _records(self, path: str) -> Iterator[tuple]:
        with _open(path) as f:
            while True:
                line = f.readline()
                if not line:
                    return
                if not line.strip():
                    continue
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no record at byte {f.tell() - len(line)}")
                head = _headers(f)
                size = int(head.get("content-length", 0))
                if not self._wanted(head):
                    f.seek(size, 1)
                    continue
                after = f.tell() + size
                http: dict[str, str] = {}
                if head.get("content-type", "").startswith("application/http") and size:
                    f.readline()
                    http = _headers(f)
                body = None
                if self.payload and head.get("warc-type") != "revisit":
                    body = f.read(after - f.tell())
                    if f.tell() != after:
                        raise ValueError(f"{path}: the file ends within a record")
                f.seek(after)
                full = http.get("content-length")
                yield (
                    head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"),
                    (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None, head.get("warc-refers-to"),
                    size, int(full) if full else None, body, path,
                )


def _headers(f) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := f.readline()) and line.strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(urn: str):
    text = F.regexp_extract(urn, "^<urn:x-page:(.*)>$", 1)
    return F.when(text != "", text).cast("long")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write an archive of pages(page_id, url, html) and describe its records as read back."""
    spark = pages.sparkSession
    if path is None:
        import uuid

        path = f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    full = read(spark, path).filter("record_type = 'response'")
    thin = read(spark, path, payload=False).filter("record_type = 'revisit'")
    cols = lambda size, digest: [
        page_of("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", page_of("refers_to").alias("refers_to"), F.col("target_uri").alias("url"),
    ]
    return full.select(*cols(F.length("payload").cast("long"), F.sha2("payload", 256))).unionByName(
        thin.select(*cols(F.col("payload_bytes"), F.col("payload_digest")))
    )
