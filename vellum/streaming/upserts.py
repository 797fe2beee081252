"""A case store that streams write to: the latest version of every key, written batch by batch, each batch once.

The store is dealt by key into parts. A batch reads the parts that its keys lie in, merges, and writes each of them as a new
version; then one small ledger entry names the version of every part. Readers follow the last entry, so they never
see half a batch, and a batch whose entry is there already is not merged again: a replayed batch changes nothing. What a crash
leaves between data and entry is written over by the replay.

Defined cases: of a key's rows that with the greatest order counts, whether it comes first or last, and of equal ones the one
written already; null keys are a key of their own; an empty batch is entered too; a store that has no entries is empty.
One stream writes to a store; its batches come in their order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    """Rows of `schema` in `parts` parts under a path; key names them, order says which of two versions is later."""

    path: str
    schema: str
    key: str = "id"
    order: str = "last_modified"
    parts: int = 64

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def entries(self) -> list[int]:
        where, root = self._files()
        found = where.get_file_info(fs.FileSelector(f"{root}/ledger", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def versions(self) -> dict[int, int]:
        """The batch that wrote each part last."""
        where, root = self._files()
        done = self.entries()
        if not done:
            return {}
        with where.open_input_stream(f"{root}/ledger/{done[-1]}.json") as f:
            return {int(k): v for k, v in json.loads(f.read()).items()}

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/batch={b}/part={p}" for p, b in sorted(self.versions().items()) if only is None or p in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Whether the batch was merged; not if the ledger has it."""
        if batch_id in self.entries():
            return False
        spark, names = batch.sparkSession, batch.columns
        new = latest(batch, self.key, self.order).withColumn("part", self._part())
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # as many as there are parts
        versions = self.versions()
        if touched:
            old = self.read(spark, touched)
            merged = upsert(old, new.select(*names), self.key, self.order).withColumn("part", self._part())
            merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/batch={batch_id}")
        self._enter(batch_id, versions | dict.fromkeys(touched, batch_id))
        return True

    def _enter(self, batch_id: int, versions: dict[int, int]) -> None:
        where, root = self._files()
        where.create_dir(f"{root}/ledger")
        with where.open_output_stream(f"{root}/ledger/_{batch_id}") as f:
            f.write(json.dumps(versions).encode())
        where.move(f"{root}/ledger/_{batch_id}", f"{root}/ledger/{batch_id}.json")

    def tidy(self) -> None:
        """Remove versions that the last entry doesn't name; no reader may still follow an earlier one."""
        where, root = self._files()
        keep = {(b, p) for p, b in self.versions().items()}
        for f in where.get_file_info(fs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True)):
            batch, _, part = f.path.rpartition("/")
            if f.type == fs.FileType.Directory and part.startswith("part=") and (int(batch.rsplit("=", 1)[1]), int(part[5:])) not in keep:
                where.delete_dir(f.path)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A key's row with the greatest order; rows with a null one come before all others."""
    return rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*rows.columns), F.struct(order)).alias("__r")).select("__r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of both, of a key in both the later one, and the old one where they are equally late; keys are unique in each."""
    o, n = old.select(F.struct(*old.columns).alias("o"), F.col(key).alias("__ok")), new.select(F.struct(*old.columns).alias("n"), F.col(key).alias("__nk"))
    both = o.join(n, F.col("__ok").eqNullSafe(F.col("__nk")), "full_outer")
    later = F.struct(F.col("n")[order]) > F.struct(F.col("o")[order])
    return both.select(F.when(F.col("o").isNull() | (F.col("n").isNotNull() & later), F.col("n")).otherwise(F.col("o")).alias("r")).select("r.*")


def to_store(stream: DataFrame, store: Store, checkpoint: str):
    """A started query that merges every micro-batch of the stream, each once whatever is replayed."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: store.merge(batch, batch_id)).option("checkpointLocation", checkpoint)


def append_once(events: DataFrame, path: str, batch_id: int) -> None:
    """Audit events as JSON lines by month, in a folder of their batch: a replay writes the same folder again."""
    by_month = events.withColumn("yyyymm", F.date_format(F.col("ts").cast("timestamp"), "yyyyMM"))
    by_month.write.partitionBy("yyyymm").mode("overwrite").json(f"{path}/batch={batch_id}")
