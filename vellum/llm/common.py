"""Shared pieces of the training-data operators: table loading, durable intermediates, skew-safe joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; texts may be long, so batches are short.
ARROW_ROWS = 512
#: Rows of a counted table that may be broadcast whole.
BROADCAST_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset on a local master, as in tests, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vellum-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stash(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder, partitioned by a column if named, and read it back.

    The files outlive executors, so a lost one costs only its running tasks. They stay until drop() or clear()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*stashed: DataFrame) -> None:
    """Remove the files of intermediates that no result still to be computed reads."""
    for df in stashed:
        _remove(df.sparkSession, df._stashed_at)


def clear(spark: SparkSession) -> None:
    """Remove all intermediates of this application, once its results have been written."""
    _remove(spark, f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}")


def join_with_hot_keys(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, hot_share: int = 1000, broadcast_rows: int = BROADCAST_ROWS, stashed: DataFrame | None = None) -> DataFrame:
    """Left join to a table with unique keys, where a few keys may hold most rows of left.

    right carries in `weight` how many rows of left have its key. At most hot_share keys can hold total/hot_share rows
    or more each, so that many rows at most are broadcast; all other keys are shuffled. Rows of hot keys, and rows whose
    key is null, get a key of their own in the shuffle and so spread evenly. Null keys match nothing. Where right is
    counted to have no more than broadcast_rows rows, all of it is broadcast and left isn't shuffled at all. right is
    stashed unless it is a projection of the table given as stashed."""
    if stashed is None:
        right = stash(right, "keyed")
    if right.count() <= broadcast_rows:
        all_of_it = right.withColumnRenamed(key, "__bk")
        out = left.join(F.broadcast(all_of_it), left[key] == F.col("__bk"), "left")
        return out.select(*[left[c] for c in left.columns], *[F.col(c) for c in right.columns if c != key])
    hot = right.filter(F.col(weight) * hot_share >= F.lit(total))
    cold = right.filter(F.col(weight) * hot_share < F.lit(total))
    names = [c for c in right.columns if c != key]
    h = hot.select(F.col(key).alias("__hk"), F.struct(*names).alias("__hv"))
    c = cold.select(F.col(key).cast("string").alias("__ck"), F.struct(*names).alias("__cv"))
    spread = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    out = left.join(F.broadcast(h), left[key] == h["__hk"], "left")
    own = F.when(F.col(key).isNull() | F.col("__hk").isNotNull(), spread).otherwise(F.col(key).cast("string"))
    out = out.withColumn("__lk", own).join(c, F.col("__lk") == F.col("__ck"), "left")
    picked = [F.coalesce(F.col("__hv")[n], F.col("__cv")[n]).alias(n) for n in names]
    return out.select(*left.columns, *picked)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; the component is its smallest node.

    Each round hooks every node to the smallest label around it and then jumps pointers, so rounds grow with the
    logarithm of a component's diameter; labels only fall, so the rounds end. Aggregates are minima, which combine before
    the shuffle. Nodes with many edges and labels of many nodes are joined as hot keys. Only counts reach the driver."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = stash(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    n_edges = both.count()
    lab = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")).select("u", F.least("u", "m").alias("c"), "deg")
    lab = stash(lab, "labels")
    n_nodes = lab.count()
    small = n_nodes <= BROADCAST_ROWS  # every table joined below has a row a node at most
    side, keep = (F.broadcast, lambda df, name: df) if small else (lambda df: df, stash)
    while n_edges:
        labels = lab.select(F.col("u").alias("v"), F.col("c").alias("cv"), "deg")
        around = both.join(F.broadcast(labels), "v") if small else join_with_hot_keys(both, labels, "v", "deg", n_edges, stashed=lab)
        near = around.groupBy("u").agg(F.min("cv").alias("m"))
        hop = keep(lab.join(side(near), "u", "left").select("u", "c", "deg", F.least("c", F.coalesce("m", "c")).alias("n")), "hops")
        # a root learns of a smaller label from any of its members
        root = hop.filter("n < c").groupBy(F.col("c").alias("u")).agg(F.min("n").alias("r"))
        told = keep(hop.join(side(root), "u", "left").select("u", "c", "deg", F.least("n", F.coalesce("r", "n")).alias("n")), "told")
        up = told.select(F.col("u").alias("n"), F.col("n").alias("nn"))
        if small:
            new = told.join(F.broadcast(up), "n", "left")
        else:
            new = join_with_hot_keys(told, told.groupBy("n").agg(F.count("*").alias("w")).join(up, "n"), "n", "w", n_nodes)
        new = stash(new.select("u", F.col("c").alias("old"), F.least("n", F.coalesce("nn", "n")).alias("c"), "deg"), "labels")
        drop(*([lab] if small else [hop, told, lab]))
        lab = new
        if not lab.filter("c <> old").limit(1).count():
            break
    drop(both)
    return lab.select(F.col("u").alias("node"), F.col("c").alias("component"))


def sha256_utf8(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def in_order(df: DataFrame, order: list[Column], within: str | None = None, name: str = "place") -> tuple[DataFrame, DataFrame]:
    """(df with each row's place, from 0, in `order` among the rows with an equal `within`; a row per `within`: its rows as "n").

    order must begin with `within`. Rows are sorted by range, so that equal ones may lie in several tasks, and numbered
    there; places only need the tasks' counts: a row for each task and each value of `within`."""
    ranged = stash(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumns({"__part": F.shiftright("__at", 33), "__low": F.col("__at").bitwiseAND((1 << 33) - 1)})
    whole = F.lit(0) if within is None else F.col(within)
    runs = ranged.groupBy(whole.alias("__in"), "__part").agg(F.count("*").alias("__n"), F.min("__low").alias("__first"))
    runs = stash(runs, "runs")
    before = W.partitionBy("__in").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    starts = starts.select(F.col("__in"), F.col("__part").alias("__p"), "__start")
    side = F.broadcast(starts) if runs.count() <= BROADCAST_ROWS else starts
    out = ranged.join(side, (F.col("__part") == F.col("__p")) & whole.eqNullSafe(F.col("__in")))
    out = out.withColumn(name, F.col("__start") + F.col("__low")).drop("__at", "__part", "__low", "__in", "__p", "__start")
    return out, runs.groupBy(F.col("__in").alias(within or "__in")).agg(F.sum("__n").alias("n"))
