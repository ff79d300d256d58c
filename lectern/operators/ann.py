"""Approximate nearest neighbours for a table of queries over a stored index.

Rows of unit length are dealt to the nearest of `lists` centroids, and what is left of them is product-quantised: cut into parts, each
part replaced by the number of its nearest code word. The index is written by list. A query's share in a row's cosine is then a sum of looked-up
numbers, one for each part, plus its cosine with the list's centroid, which is the product with the row's code words put together: a product of matrices for
some thousand rows and queries at once. Only the `refine` best by that sum count, and they are scored exactly where they are read, so no vector is shuffled.

Centroids and code words are fitted on a sample of about `sample` rows, drawn by a hash of the id; every row is indexed. Rows without
a vector, of length 0 or of another dimension than most rows aren't.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import vectors as V
from lectern.operators import vector

#: Queries sent to all tasks at once.
QUERY_BLOCK = 1000
#: Rows and queries that are multiplied at once.
ROWS, TILE = 20_000, 64


def _means(x: np.ndarray, k: int, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """Centres of k groups of the rows of x; a group that gets empty keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)


def _encode(centres: np.ndarray, words: np.ndarray, batches):
    """(id, list, codes, v): rows (id, v) with the list they are dealt to and the code words of what is left of them."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = _nearest(unit, centres)
        left = (unit - centres[near]).reshape(len(x), len(words), -1)
        codes = np.stack([_nearest(left[:, m], w) for m, w in enumerate(words)], 1).astype(np.int8)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), lists, batch.column(1)], names=["id", "list", "codes", "v"])


def _probed(centres: np.ndarray, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the queries, and the `probes` lists nearest to each."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit, np.argsort((centres**2).sum(1) - 2 * (unit @ centres.T), axis=1, kind="stable")[:, :probes]


def _probe(centres: np.ndarray, probes: int, batches):
    """(list): the lists that the queries (query, vector) probe."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_probed(centres, x, probes)[1]).astype(np.int32))], names=["list"])


def _near(sent, centres: np.ndarray, words: np.ndarray, probes: int, most: int, batches):
    """(query_id, id, about, score): what can be among the `most` best of each query by their shares, from rows (id, list, codes, vector, norm), with the exact score."""
    import pyarrow as pa

    which, q, m = sent
    unit, near = _probed(centres, q, probes)
    asks = np.zeros((len(q), len(centres)), bool)
    asks[np.arange(len(q))[:, None], near] = True
    best = vector.Best(len(q), most)

    def meet(held: list) -> None:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lists, n = batch.column(1).to_numpy(), batch.column(4).to_numpy()
        codes, x = (batch.column(c).flatten().to_numpy().reshape(len(lists), -1) for c in (2, 3))
        made = (centres[lists] + words[np.arange(len(words)), codes].reshape(len(lists), -1)).T
        for t in range(0, len(q), TILE):
            about = unit[t : t + TILE] @ made
            about[~asks[t : t + TILE, lists]] = -np.inf
            least = best.bound[t : t + TILE]
            if len(lists) > most and np.isinf(least).any():
                least = np.maximum(least, np.partition(about, len(lists) - most, axis=1)[:, len(lists) - most])
            at = np.flatnonzero(about >= np.maximum(least, -1e300)[:, None])
            asked, row = np.divmod(at, len(lists))
            asked += t
            best.add(asked, about.ravel()[at], vector._scores(x, n, q, m, row, asked), batch.column(0).take(pa.array(row)))

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            meet(held)
            held, size = [], 0
    if size:
        meet(held)
    best.tidy()
    for asked, about, score, ids in best.held:
        yield pa.RecordBatch.from_arrays([which.take(pa.array(asked)), ids, pa.array(about), pa.array(score)], names=["query_id", "id", "about", "score"])


class VectorIndex:
    """An index under a folder: rows (id, codes, vector) by list."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, words: np.ndarray, id_col: str, id_kind: str):
        #: words[m, c]: code word c of part m.
        self.spark, self.path, self.centres, self.words, self.id_col = spark, path, centres, words, id_col
        self.schema = f"id {id_kind}, codes array<tinyint>, v array<double>, list int"

    @classmethod
    def build(cls, table: DataFrame, path: str, lists: int = 128, parts: int | None = None, codes: int = 16, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """Fits and writes the index. parts must divide the dimension; more parts and codes cost space and gain recall.

        Without a number, a part has two dimensions: in coarser ones a fixed number of candidates finds fewer of the neighbours the more rows there are.
        """
        rows = table.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), V.as_double(F.col(vector_col)).alias("v"))
        rows = rows.where(V.norm(F.col("v")) > 0)
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        dimension, n = sizes or (parts or 2, 0)
        parts = parts or (dimension if dimension % 2 else dimension // 2)
        rows = rows.where(F.size("v") == dimension)
        chosen = rows if n <= sample else rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * sample / n))
        x = np.array([r["v"] for r in chosen.select("v").limit(sample).collect()], float)  # at most `sample` rows
        if dimension % parts:
            raise ValueError(f"{parts} parts don't divide {dimension} dimensions")
        x = x if len(x) else np.zeros((1, dimension))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centres = _means(x, lists)
        left = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
        words = np.stack([_means(left[:, m], codes) for m in range(parts)])
        kind = rows.schema["id"].dataType.simpleString()
        index = cls(table.sparkSession, path, centres, words, id_col, kind)
        dealt = rows.mapInArrow(lambda it: _encode(centres, words, it), f"id {kind}, list int, codes array<tinyint>, v array<double>")
        dealt.write.partitionBy("list").parquet(path)
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)  # no list is written for an empty table

    def search(self, queries: DataFrame, k: int = 10, probes: int = 20, refine: int = 100, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """(query_id, id, score, rank): about the k nearest rows of each query, by cosine; queries without a usable vector have none.

        Queries go in blocks of about QUERY_BLOCK, each sent to all tasks; lists that none of them probes aren't read.
        """
        q = F.col(query_vector)
        asked = queries.where(q.isNotNull() & (F.size(q) == self.centres.shape[1])).select(F.col(query_id).alias("query_id"), V.as_double(q).alias("q"), V.norm(q).alias("m")).where("m > 0")
        kind, own = asked.schema["query_id"].dataType.simpleString(), self.schema.split()[1].rstrip(",")
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        centres, words, most, sc = self.centres, self.words, max(refine, k), self.spark.sparkContext
        rows, out = self.rows().select("id", "list", "codes", "v", V.norm(F.col("v")).alias("n")), None
        for b in range(blocks):
            some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
            held = some.toArrow().combine_chunks()
            ids, vectors, norms = (held.column(c).combine_chunks() for c in range(3))
            sent = sc.broadcast((ids, vectors.flatten().to_numpy().reshape(held.num_rows, -1) if held.num_rows else np.zeros((0, centres.shape[1])), norms.to_numpy()))
            lists = some.select("query_id", "q").mapInArrow(lambda it: _probe(centres, probes, it), "list int").distinct()
            read = rows.join(F.broadcast(lists), "list", "left_semi").select("id", "list", "codes", "v", "n").coalesce(vector.parts(sc, blocks))
            near = read.mapInArrow(lambda it, sent=sent: _near(sent.value, centres, words, probes, most, it), f"query_id {kind}, id {own}, about double, score double")
            out = near if out is None else out.unionByName(near)
        order = lambda score: Window.partitionBy("query_id").orderBy(F.desc(score), "id")
        out = out.withColumn("r", F.row_number().over(order("about"))).where(F.col("r") <= most)
        best = out.select("query_id", "id", "score").withColumn("rank", F.row_number().over(order("score"))).where(F.col("rank") <= k)
        return best.withColumnsRenamed({"query_id": query_id, "id": self.id_col})


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """(queries, recall): the share of exact neighbours that were found, over all queries."""
    hit = exact.select(query_id, id_col).join(found.select(query_id, id_col, F.lit(1).alias("hit")), [query_id, id_col], "left")
    return hit.agg(F.countDistinct(query_id).alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
