"""Sizes of folders, from what the file system says of files: no file is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, length, modified) of every file under a path; folder: the names below the path, joined by /.

    Files without a byte aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    root = F.concat(F.rtrim(F.lit(path.split("://", 1)[-1]), F.lit("/")), F.lit("/"))
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.when(F.startswith(plain, root), F.substring(plain, F.length(root) + 1, F.length(plain))).otherwise(plain)
    name = F.substring_index(below, "/", -1)
    folder = F.when(F.contains(below, F.lit("/")), F.substring(below, F.lit(1), F.length(below) - F.length(name) - 1)).otherwise(F.lit(""))
    return files.select(folder.alias("folder"), name.alias("name"), "length", F.col("modificationTime").alias("modified"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """(folder, depth, n_files, bytes): of every folder with all that lies below it, the empty name being the top."""
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    rows = files.select(F.explode(above).alias("a"), "length").select("a.folder", "a.depth", "length")
    return rows.groupBy("folder", "depth").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def status(cases: DataFrame, files: DataFrame) -> DataFrame:
    """One row: how many of cases(archived) are active and archived, and the files and bytes of the whole folder."""
    archived = F.coalesce("archived", F.lit(False))
    counts = cases.agg(F.count(F.when(~archived, 1)).alias("active"), F.count(F.when(archived, 1)).alias("archived"))
    return counts.crossJoin(files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))
