"""Case packages: a zip archive a case, with a manifest, the case document and its files.

Written by a Python data source in two phases: tasks stream the members of their cases into archives under a folder of
the attempt, and only the commit of the whole job moves them to their names, so that a failed task or job leaves none and
a repeated task none twice. Rows are dealt by case and sorted, a row a member, so no case is ever held as a whole. Many
archives lie in `folders`, by a checksum of their ids: a folder is written by one task, moved by the commit as a whole where
it is new, and listed by the task that reads it, so that neither knows of single archives on the driver. Read by a data source
that looks for the manifest and the document before anything else; a partition takes some folders, or some archives of the
given folder itself. Without `members` no file is unpacked.

Members' names lose their folders when read, and ids must be plain words, so that nothing leads out of a target folder.
Defined cases: an archive that isn't one, lacks a member, or has an unreadable document or a bad id gives one row that says
so; a case without files is an archive of two members; two files of one name are both kept in an archive, the later one under
its name and number; null data is an empty file; an empty table writes no archive. Member names and the suffix are those of
the format.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The format's version, members and suffix, and the ids that it allows.
FORMAT_VERSION, MANIFEST, DOCUMENT, FILES, SUFFIX = 1, "manifest.json", "sar.json", "pdfs/", ".sarpack"
GOOD_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}")

MEMBER = "id string, ord int, name string, data binary"
READ = "path string, outcome string, id string, doc string, name string, data binary"
PENDING = "_pending"
#: Names of folders; how many of them, or of single archives, a partition reads; archives up to this size are read at once.
FOLDER, FOLDERS_A_TASK, ARCHIVES_A_TASK, SMALL = re.compile(r"in-[0-9]+"), 4, 256, 1 << 23


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def base_name(name: str) -> str:
    return name.replace("\\", "/").rsplit("/", 1)[-1]


# ---- writing ---------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """Where the archives of one task are."""

    pending: str


def folder_of(case_id: str, folders: int) -> str:
    """The folder of a case's archive, with a slash; nothing where all lie side by side."""
    return f"in-{zlib.crc32(case_id.encode()) % folders}/" if folders else ""


def _manifest(doc: dict) -> dict:
    subject = doc.get("subject") or {}
    return {
        "format_version": FORMAT_VERSION, "sar_id": doc.get("id"), "last_modified": doc.get("last_modified", ""),
        "subject_name": subject.get("full_name", "") if isinstance(subject, dict) else "", "workflow_status": doc.get("workflow_status", ""),
    }


class PackageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, folders: int):
        self.path, self.overwrite, self.folders, self.job = path, overwrite, folders, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = _files(self.path)
        task, made = TaskContext.get(), set()
        pending = f"{root}/{PENDING}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        where.create_dir(pending)
        members = (m for batch in iterator for m in zip(*(batch.column(c) for c in ("id", "ord", "name", "data")), strict=True))
        rows = ((case_id.as_py(), ord_.as_py(), name.as_py(), data) for case_id, ord_, name, data in members)
        for case_id, of_case in groupby(rows, key=lambda r: r[0]):
            first = next(of_case)
            if first[1]:  # files of a case that isn't there
                continue
            if not GOOD_ID.fullmatch(case_id or ""):
                raise ValueError(f"not an id: {case_id!r}")
            folder = folder_of(case_id, self.folders)
            if folder and folder not in made:
                where.create_dir(f"{pending}/{folder}")
                made.add(folder)
            with where.open_output_stream(f"{pending}/{folder}{case_id}{SUFFIX}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                self._fill(archive, chain([first], of_case))
        return Written(pending)

    @staticmethod
    def _fill(archive: zipfile.ZipFile, members: Iterator[tuple]) -> None:
        used: set[str] = set()
        for _, ord_, name, data in members:
            data = data.as_py() or b""
            if ord_ == 0:
                archive.writestr(MANIFEST, json.dumps(_manifest(json.loads(data))))
                archive.writestr(DOCUMENT, data)
                continue
            stem, dot, kind = base_name(name or "file").rpartition(".")
            stem, tail = (stem, dot + kind) if dot else (kind, "")
            name, n = stem + tail, 1
            while name in used:
                n += 1
                name = f"{stem}-{n}{tail}"
            used.add(name)
            archive.writestr(FILES + name, data)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _files(self.path)
        done = [m.pending for m in messages if m]
        if self.overwrite:
            self._clear(where, root, done)
        for pending in done:
            for made in where.get_file_info(fs.FileSelector(pending)):
                self._move(where, made, f"{root}/{made.base_name}")
        self._forget(where, root)

    def _move(self, where: fs.FileSystem, made: fs.FileInfo, to: str) -> None:
        """An archive, or a folder of them: as a whole where there is none, else one by one."""
        if made.type == fs.FileType.Directory and where.get_file_info(to).type != fs.FileType.NotFound:
            for one in where.get_file_info(fs.FileSelector(made.path)):
                where.move(one.path, f"{to}/{one.base_name}")
        else:
            where.move(made.path, to)

    @staticmethod
    def _clear(where: fs.FileSystem, root: str, done: list[str]) -> None:
        """Archives that the new ones don't replace go, those in folders too."""

        def under(at: str) -> Iterator[str]:
            for f in where.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if f.type == fs.FileType.Directory and FOLDER.fullmatch(f.base_name):
                    yield from (x.path for x in where.get_file_info(fs.FileSelector(f.path)) if x.path.endswith(SUFFIX))
                elif f.path.endswith(SUFFIX):
                    yield f.path

        new = {path[len(pending):] for pending in done for path in under(pending)}
        for old in under(root):
            if old[len(root):] not in new:
                where.delete_file(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._forget(*_files(self.path))

    def _forget(self, where: fs.FileSystem, root: str) -> None:
        """Whatever tasks of this job have left, those of failed attempts too."""
        if where.get_file_info(f"{root}/{PENDING}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{PENDING}/{self.job}")


# ---- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Some(InputPartition):
    """Archives, or folders of them."""

    paths: list[str]
    are_folders: bool


def _archives(where: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return [f for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(SUFFIX)]


class PackageReader(DataSourceReader):
    def __init__(self, path: str, members: bool):
        self.path, self.members = path, members

    def partitions(self) -> list[Some]:
        where, root = _files(self.path)
        found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
        folders = [f.path for f in found if f.type == fs.FileType.Directory and FOLDER.fullmatch(f.base_name)]
        single = [f.path for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX)]
        cut = lambda paths, n, are: [Some(paths[i : i + n], are) for i in range(0, len(paths), n)]
        return cut(folders, FOLDERS_A_TASK, True) + cut(single, ARCHIVES_A_TASK, False)

    def read(self, part: Some | None) -> Iterator[tuple]:
        if part is None or not getattr(part, "paths", None):  # an empty folder
            return
        where, _ = _files(self.path)
        found = chain.from_iterable(_archives(where, p) for p in part.paths) if part.are_folders else where.get_file_info(part.paths)
        for info in found:
            with where.open_input_file(info.path) as f:
                yield from self.rows(info.path, io.BytesIO(f.read()) if info.size <= SMALL else f)

    def rows(self, path: str, f) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BufferedReader(f) if not hasattr(f, "seekable") else f)
            names = archive.namelist()
            if not {MANIFEST, DOCUMENT} <= set(names):
                yield path, "not a package", None, None, None, None
                return
            json.loads(archive.read(MANIFEST))
            text = archive.read(DOCUMENT).decode()
            doc = json.loads(text)
            case_id = doc.get("id")
        except Exception as e:  # noqa: BLE001  whatever is wrong with an archive, the others are read
            yield path, f"unreadable: {type(e).__name__}", None, None, None, None
            return
        if not (isinstance(case_id, str) and GOOD_ID.fullmatch(case_id)):
            yield path, "invalid id", None, None, None, None
            return
        yield path, "ok", case_id, text, None, None
        if self.members:
            for name in names:
                if name.startswith(FILES) and base_name(name):
                    try:
                        yield path, "ok", case_id, None, base_name(name), archive.read(name)
                    except Exception as e:  # noqa: BLE001
                        yield path, f"unreadable: {type(e).__name__}", case_id, None, base_name(name), None


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "case_package"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> PackageReader:
        return PackageReader(self.options["path"], self.options.get("members", "true") == "true")

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options["path"], overwrite, int(self.options.get("folders", "0")))


# ---- for DataFrames --------------------------------------------------------------------------------------------------


def write_packages(cases: DataFrame, files: DataFrame, path: str, overwrite: bool = False, folders: int = 0) -> None:
    """An archive for each of cases(id, doc) with its files(id, name, data), in the order of their names.

    Files of other cases are left out. overwrite: archives of other cases in the folder go once all new ones are there.
    folders: so many folders share the archives, which many archives need; always the same number for one path."""
    spark = cases.sparkSession
    spark.dataSource.register(PackageSource)
    docs = cases.select("id", F.lit(0).alias("ord"), F.lit(DOCUMENT).alias("name"), F.encode("doc", "UTF-8").alias("data"))
    rows = docs.unionByName(files.select("id", F.lit(1).alias("ord"), "name", "data"))
    # the writer leaves out files that no document goes before
    dealt = rows.repartition(F.crc32(F.encode("id", "UTF-8")) % folders) if folders else rows.repartition("id")
    sorted_ = dealt.sortWithinPartitions("id", "ord", "name")
    sorted_.write.format("case_package").option("folders", str(folders)).mode("overwrite" if overwrite else "append").save(path)


def read_packages(spark: SparkSession, path: str, members: bool = True) -> DataFrame:
    """READ rows: for each archive its case (name is null), then its files, or what is wrong with it."""
    spark.dataSource.register(PackageSource)
    return spark.read.format("case_package").option("members", str(members).lower()).load(path)


def incoming(packages: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """What becomes of each read archive in a store(id, doc): imported, conflict (not forced, the id is there), or its fault.

    A conflict shows when both were changed last; of several archives with one id, that with the smallest path counts."""
    get = lambda doc, path: F.get_json_object(doc, path)
    ok = F.col("outcome") == "ok"
    nth = F.row_number().over(W.partitionBy(F.when(ok, F.col("id")).otherwise(F.col("path")), ok).orderBy("path"))
    cases = packages.filter("name IS NULL").select("path", "outcome", "id", "doc").withColumn("first", ok & (nth == 1))
    have = store.select(F.col("id").alias("__id"), get("doc", "$.last_modified").alias("existing_modified"), F.lit(True).alias("__have"))
    known = cases.join(have, (F.col("id") == F.col("__id")) & F.col("first"), "left")
    conflict = F.coalesce("__have", F.lit(False)) & F.lit(not force)
    outcome = F.when(~ok, F.col("outcome")).when(~F.col("first"), "another has its id").when(conflict, "conflict").otherwise("imported")
    shown = lambda path: F.when(F.col("first"), get("doc", path))
    return known.select("path", outcome.alias("outcome"), "id", "doc", "existing_modified", shown("$.last_modified").alias("import_modified"), shown("$.subject.full_name").alias("subject_name"))


def import_packages(packages: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """store(id, doc) with the imported cases in place of those they replace."""
    new = incoming(packages, store, force).filter("outcome = 'imported'").select("id", "doc")
    return store.select("id", "doc").join(new.select("id"), "id", "left_anti").unionByName(new)


def migrate_folder(spark: SparkSession, path: str, store: DataFrame) -> DataFrame:
    """store(id, doc) with the case documents of a folder's .json files, one a file; files without a document or an id are left out."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_path"))
    docs = texts.select(F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("doc"), "file").filter("id IS NOT NULL")
    new = docs.groupBy("id").agg(F.max_by("doc", "file").alias("doc"))
    return store.select("id", "doc").join(new.select("id"), "id", "left_anti").unionByName(new)
