"""What several operators need: lineage cuts in the shared folder, gapless ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a local session gets one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once to the shared folder, of which readers take the columns they need."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so that a lost executor costs no rerun."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranks(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, buckets: int, name: str) -> DataFrame:
    """Adds `name`, a gapless rank from 0 within `keys`, without sorting a whole group in one task.

    Rows of a group are dealt into `buckets` by the value `bucket`; a rank is the number of rows in
    lower buckets plus the place within the own one. df is read twice, so it should be cheap.
    """
    from pyspark.sql import Window

    b, base = "__bucket", "__base"
    df = df.withColumn(b, F.pmod(bucket, F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*keys, b).orderBy(*order)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, b]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    placed = df.withColumn("__at", F.row_number().over(within) - 1).alias("l").join(sizes.alias("r"), on, "left")
    return placed.select("l.*", (F.col(base) + F.col("__at")).cast("long").alias(name)).drop(b, "__at")


def sized(df: DataFrame, rows: int = 100_000) -> tuple[DataFrame, int]:
    """(df cut, its number of rows), in as many partitions as its rows are worth: small tables go on in few tasks and files."""
    df = cut(df)
    n = df.count()
    return df.coalesce(min(partitions(df.sparkSession), 4 + n // rows)), n


def _forest(batches):
    """A spanning forest of the links (u, v) of a task, as stars around the smallest id; links wait in runs of bounded size."""
    import numpy as np
    import pyarrow as pa

    def stars(u, v):
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(ids))
        while True:  # the smaller root of both ends, then shortcuts
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n > 1_000_000:
            yield stars(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if n:
        yield stars(*(np.concatenate(x) for x in zip(*held)))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a, b); component is the smallest id reachable.

    Tasks first reduce their own edges to stars. Then large-star and small-star steps alternate over DataFrames:
    every step is a min-aggregation and a join on the id, so that a hub is summed before the shuffle and its join can
    be split. Each round is checkpointed, in as many partitions as its edges are worth; rounds end when the set of
    edges no longer changes. Null ids are no ids: their edges are left out.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, n = sized(pairs.mapInArrow(_forest, "u long, v long").distinct())
    last = None
    while n:
        k = min(partitions(e.sparkSession), 4 + n // 100_000)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(k)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(k)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).coalesce(k).distinct().coalesce(k)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(k)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, n = sized(small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(k).mapInArrow(_forest, "u long, v long").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    pairs = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component").distinct())
