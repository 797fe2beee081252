"""Snapshots of tables in folders of their own, and which of them are kept.

A snapshot is written table by table and only counts once its marker is there, so a reader never takes a half-written one and a
writer that died leaves nothing that counts. Defined cases: a snapshot of a stamp that is there already is refused; unfinished
ones are removed with the old ones; keep 0 removes all.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREFIX, MARKER = "backup-", "_complete"
#: Snapshots that are kept.
KEEP = 7


def _files(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def snapshots(root: str, complete: bool = True) -> list[str]:
    """Stamps, the oldest first."""
    where, path = _files(root)
    found = [f for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name.startswith(PREFIX)]
    done = [f for f in found if not complete or where.get_file_info(f"{f.path}/{MARKER}").type == fs.FileType.File]
    return sorted(f.base_name.removeprefix(PREFIX) for f in done)


def snapshot(tables: dict[str, DataFrame], root: str, stamp: str, keep: int = KEEP) -> str:
    """Write a snapshot, then remove all but the newest `keep`; its folder."""
    if stamp in snapshots(root):
        raise ValueError(f"there is a snapshot of {stamp}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{PREFIX}{stamp}/{name}")
    where, path = _files(root)
    with where.open_output_stream(f"{path}/{PREFIX}{stamp}/{MARKER}") as f:
        f.write(json.dumps(sorted(tables)).encode())
    kept = snapshots(root)[-keep:] if keep else []
    for old in set(snapshots(root, complete=False)) - set(kept):
        where.delete_dir(f"{path}/{PREFIX}{old}")
    return f"{root}/{PREFIX}{stamp}"


def restore(spark: SparkSession, root: str, stamp: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, the newest unless one is named."""
    there = snapshots(root)
    stamp = stamp or (there[-1] if there else None)
    if stamp not in there:
        raise ValueError("there is no such snapshot")
    where, path = _files(root)
    with where.open_input_stream(f"{path}/{PREFIX}{stamp}/{MARKER}") as f:
        names = json.loads(f.read())
    return {n: spark.read.parquet(f"{root}/{PREFIX}{stamp}/{n}") for n in names}


def surplus(listed: DataFrame, owner: str, stamp: str, tie: str, keep: int = KEEP) -> DataFrame:
    """The rows of a listing of many owners' snapshots that aren't among an owner's newest."""
    n = F.row_number().over(W.partitionBy(owner).orderBy(F.col(stamp).desc(), F.col(tie).desc()))
    return listed.withColumn("__n", n).filter(F.col("__n") > keep).drop("__n")
