"""A chunk store on Parquet: versions of a table, each a folder of its own.

Writes make a new version and then a pointer to it, a folder with the next number, both through Spark, so that
any store Spark writes will do. The greatest number counts; a crash in between leaves the version before. Older
versions but the last are retired at the next write, so running readers keep their files. Upserts keep
the newest row of each key; the key is (doc_id, chunk_index), since chunk ids may collide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.vector import conditions

KEY = ("doc_id", "chunk_index")


def scratch(spark: SparkSession) -> str:
    """A new folder for tables that a query makes: in spark.checkpoint.dir, or a local one in a local session."""
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.gettempdir()
    return f"{at}/store-{uuid.uuid4().hex}"


def chunk_rows(chunks: DataFrame, kb_id: str, document_name: str, dimension: int, vector: str = "vector") -> DataFrame:
    """Chunks as the store keeps them: kb_id, docnm_kwd, time, and the vector under both field names; a row's own values stay."""
    given = {"kb_id": F.lit(kb_id), "docnm_kwd": F.lit(document_name), "create_time": F.current_timestamp(), "vector": F.col(vector), f"q_{dimension}_vec": F.col(vector)}
    missing = {k: c for k, c in given.items() if k not in chunks.columns}
    filled = {k: F.coalesce(F.col(k), given[k]) for k in ("kb_id", "docnm_kwd", "create_time") if k in chunks.columns}
    return chunks.withColumns(missing | filled).where(F.size(F.coalesce(F.col(vector), F.array())) == dimension)


class ChunkStore:
    """One named table under a folder."""

    def __init__(self, spark: SparkSession, root: str, name: str = "chunks", key: tuple[str, ...] = KEY, partition_by: tuple[str, ...] = ()):
        self.spark, self.root, self.key, self.partition_by = spark, f"{root.rstrip('/')}/{name}", key, partition_by

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _pointers(self) -> list[int]:
        """Numbers of the pointers that are written whole."""
        found = self._fs().globStatus(self._path("_at-*/_SUCCESS"))
        return sorted(int(x.getPath().getParent().getName()[4:]) for x in found or [])

    def _version(self, number: int) -> str:
        return self.spark.read.text(f"{self.root}/_at-{number:09d}").first()[0]

    def _current(self) -> str | None:
        numbers = self._pointers()
        return self._version(numbers[-1]) if numbers else None

    def exists(self) -> bool:
        return self._current() is not None

    def create(self, schema) -> None:
        """An empty table, unless there is one."""
        if not self.exists():
            self._commit(self.spark.createDataFrame([], schema))

    def read(self) -> DataFrame:
        version = self._current()
        if version is None:
            raise FileNotFoundError(self.root)
        return self.spark.read.parquet(f"{self.root}/{version}")

    def _commit(self, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*self.partition_by) if self.partition_by else df.write
        writer.parquet(f"{self.root}/{version}")
        numbers = self._pointers()
        at = f"_at-{numbers[-1] + 1 if numbers else 1:09d}"
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.text(f"{self.root}/{at}")
        for number in numbers[:-1]:  # the version before stays for its readers
            old = self._version(number)
            self._fs().delete(self._path(f"_at-{number:09d}"), True)
            self._fs().delete(self._path(old), True)

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows; of rows with one key the newest stays."""
        self._commit(latest(rows, self.read() if self.exists() else None, self.key))

    def delete(self, condition: dict) -> None:
        self._commit(self.read().where(~F.coalesce(conditions(condition), F.lit(False))))

    def delete_document(self, doc_id) -> None:
        self.delete({"doc_id": doc_id})

    def drop(self) -> None:
        self._fs().delete(self._path(""), True)

    def count(self, condition: dict | None = None) -> int:
        return self.read().where(conditions(condition or {})).count() if self.exists() else 0

    def documents(self) -> DataFrame:
        """(doc_id, chunks) of what is stored."""
        return self.read().groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


def latest(new: DataFrame, old: DataFrame | None = None, key: tuple[str, ...] = KEY, order: str | None = None) -> DataFrame:
    """Old and new rows, of each key the new one; among new ones the last by `order`, if given, then by a hash of the whole row."""
    rows = new.withColumn("__new", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumn("__new", F.lit(0)), allowMissingColumns=True)
    first = [F.desc("__new"), *([F.desc(order)] if order else []), F.desc(F.xxhash64(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "__new")))))]
    w = Window.partitionBy(*key).orderBy(*first)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__new", "__r")
