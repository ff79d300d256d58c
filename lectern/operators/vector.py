"""Vector search: exact, filtered, in batches, and approximate over a coarse quantiser.

Exact search is a projection and a distributed top-k (no sort of all rows). Filters apply before it.
A batch of queries is a stated set, sent to all tasks in blocks of bounded size. There a product of matrices finds, for some
thousand rows at once, the pairs that can count; these alone are scored as `V.cosine` scores them, so results are the same to the last bit. A task keeps
the k best of each query. Similarities are plain cosines, rank follows the final order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import vectors as V

#: Query vectors sent to all tasks at once.
QUERY_BLOCK = 2000
#: Rows (or pairs) that are multiplied (or scored) at once.
ROWS, TILE, PAIRS = 8192, 256, 1 << 12
#: Pairs are held until a task has so many; then the best are kept.
HELD = 1 << 20
#: How far the product of matrices may be from the cosine.
NEAR = 1e-9


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def conditions(condition: dict) -> Column:
    """AND of equalities; a list means any of its values. Values are literals, never part of a string."""
    out = F.lit(True)
    for name, value in condition.items():
        out = out & (F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return out


def request_filters(kb_ids=None, doc_ids=None, available: int | None = None, removed: str | None = None) -> dict:
    """Conditions of a retrieval request; what isn't given doesn't filter."""
    given = {"kb_id": kb_ids, "doc_id": doc_ids, "available_int": available, "removed_kwd": removed}
    return {k: v for k, v in given.items() if v is not None and v != []}


def knn(table: DataFrame, query: list[float], k: int | None = 5, threshold: float | None = None, condition: dict | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows most similar to the query, with score and rank; rows of another dimension don't count. Without k all rows over the threshold, unranked."""
    rows = table.where(conditions(condition)) if condition else table
    rows = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)))
    size = sum(x * x for x in map(float, query)) ** 0.5
    rows = rows.withColumn("score", V.cosine(F.col(vector_col), literal(query), norm_b=F.lit(size)))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    if k is None:
        return rows
    best = rows.orderBy(F.desc_nulls_last("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), id_col)))


def _scores(x: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, row: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (row of x, query), summed in the order of `V.cosine`; n and m are the norms."""
    out = np.empty(len(row))
    with np.errstate(all="ignore"):
        for i in range(0, len(row), PAIRS):
            r, a = row[i : i + PAIRS], asked[i : i + PAIRS]
            dot = np.zeros(len(r))
            for left, right in zip(x[r].T, q[a].T, strict=True):
                dot += left * right
            out[i : i + PAIRS] = dot / (n[r] * m[a])
    return out


def _units(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return x / n[:, None]


def _norms(column) -> np.ndarray:
    """Norms as numbers, null as a negative one."""
    return column.fill_null(-1.0).to_numpy(zero_copy_only=False)


def _plain(n: np.ndarray) -> np.ndarray:
    """Whether norms are such that products of units and of norms neither vanish nor overflow."""
    return (n > 1e-100) & (n < 1e100)


def _known(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether `V.cosine` has a score: the product of both norms is positive or NaN."""
    with np.errstate(all="ignore"):
        return ~(n < 0) & ~(m < 0) & ~(n * m == 0)


def _key(score: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What scores are ordered by, as Spark orders them: NaN is the greatest, null the least."""
    return np.where(known, np.where(np.isnan(score), np.inf, score), -np.inf)


class Best:
    """The k best pairs of each query by key (the greatest first) and id, of those that a task has seen."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.size = k, [], 0
        #: A key that k rows of the query have or exceed.
        self.bound = np.full(queries, -np.inf)

    def add(self, asked: np.ndarray, key: np.ndarray, score: np.ndarray, ids) -> None:
        self.held.append((asked, key, score, ids))
        self.size += len(asked)
        if self.size > max(HELD, 2 * self.k * len(self.bound)):
            self.tidy()

    def tidy(self) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.held:
            return
        asked, key, score = (np.concatenate([x[i] for x in self.held]) for i in range(3))
        ids = pa.concat_arrays([x[3] for x in self.held])
        placed = np.empty(len(ids), np.int64)
        placed[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        by = np.lexsort((placed, -key, asked))
        owner = asked[by]
        first = np.searchsorted(owner, owner)
        by = by[np.arange(len(by)) - first < self.k]
        self.held, self.size = [(asked[by], key[by], score[by], ids.take(pa.array(by)))], len(by)
        last = np.append(np.flatnonzero(np.diff(asked[by])), len(by) - 1) if len(by) else np.zeros(0, int)
        n = np.bincount(asked[by], minlength=len(self.bound))
        full = last[n[asked[by[last]]] >= self.k]
        self.bound[asked[by[full]]] = key[by[full]]


def _vectors(batch, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the rows whose array in the column `at` has that many elements."""
    lists = batch.column(at)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(rows) == len(sizes):
        return rows, flat.reshape(len(rows), width)
    begins = np.cumsum(sizes) - sizes
    return rows, flat[(begins[rows][:, None] + np.arange(width)).ravel()].reshape(len(rows), width)


def _pairs(sent, k: int | None, batches):
    """(query, id, score) of pairs that can be among the k best of a query, from rows (id, vector, norm); without k those that reach the query's own bound."""
    import pyarrow as pa

    groups = [(q, m, np.nan_to_num(_units(q, m), posinf=0, neginf=0), own, which, k and Best(len(q), k)) for q, m, own, which in sent]

    def made(asked, score, known, ids):
        return pa.RecordBatch.from_arrays([asked, ids, pa.array(score, mask=~known)], names=["query_id", "id", "score"])

    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            norms = _norms(batch.column(2))
            for q, m, unit, own, which, best in groups:
                rows, x = _vectors(batch, 1, q.shape[1])
                if not len(rows):
                    continue
                n, ids = norms[rows], batch.column(0).take(pa.array(rows))
                plain = _plain(n).all() and _plain(m).all()
                right = np.nan_to_num(_units(x, n), posinf=0, neginf=0).T
                for t in range(0, len(q), TILE):
                    about = unit[t : t + TILE] @ right
                    if not plain:  # no score where a norm is null or their product 0; where one isn't plain, the product of matrices can't tell the score
                        none = ~_known(n, m[t : t + TILE, None])
                        unsure = ~(_plain(n) & _plain(m[t : t + TILE, None])) & ~none
                        about[none | unsure] = -np.inf
                    least = own[t : t + TILE] if k is None else best.bound[t : t + TILE]
                    if k is not None and len(n) > k and np.isinf(least).any():
                        least = np.maximum(least, np.partition(about, len(n) - k, axis=1)[:, len(n) - k])
                    if not plain:
                        about[unsure] = np.inf
                    asked, row = np.divmod(np.flatnonzero(about >= (least - NEAR)[:, None]), len(n))
                    asked += t
                    known = _known(n[row], m[asked])
                    score = _scores(x, n, q, m, row, asked)
                    key = _key(score, known)
                    if k is None:
                        good = known & (key >= own[asked])
                        yield made(which.take(pa.array(asked[good])), score[good], known[good], ids.take(pa.array(row[good])))
                    else:
                        best.add(asked, key, score, ids.take(pa.array(row)))
                if k is not None and np.isinf(best.bound).any():
                    best.tidy()
    for *_, which, best in groups:
        if k is not None:
            best.tidy()
            for asked, key, score, ids in best.held:
                yield made(which.take(pa.array(asked)), score, key > -np.inf, ids)


def parts(sc, blocks: int) -> int:
    """Into how many tasks the rows go for each block: all cores are busy, and no task more than needed begins anew with each query's best."""
    return max(1, -(-3 * sc.defaultParallelism // blocks))


def _blocks(rows: DataFrame, asked: DataFrame, k: int | None, id_col: str, query_id: str) -> DataFrame:
    """(query_id, id, score) of rows (id, vector, norm) for queries (id, vector, norm, own bound) in blocks of about QUERY_BLOCK."""
    import pyarrow as pa

    sc = rows.sparkSession.sparkContext
    asked = asked.where(F.col("v").isNotNull())
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (rows, "id"))]
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    pairs = None
    for i in range(blocks):
        some = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else asked).toArrow().combine_chunks().to_batches()
        groups = []
        for batch in some:
            for d in np.unique(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)):
                at, q = _vectors(batch, 1, int(d))
                groups.append((q, _norms(batch.column(2))[at], batch.column(3).to_numpy(zero_copy_only=False)[at], batch.column(0).take(pa.array(at))))
        sent = sc.broadcast(groups)
        found = rows.coalesce(parts(sc, blocks)).mapInArrow(lambda it, sent=sent: _pairs(sent.value, k, it), f"query_id {kinds[0]}, id {kinds[1]}, score double")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.withColumnsRenamed({"query_id": query_id, "id": id_col})


def _with_norm(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    v = F.col(vector_col)
    return df.where(v.isNotNull()).select(F.col(id_col).alias(name), V.as_double(v).alias("v"), V.norm(v).alias("n"))


def knn_batch(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, score, rank) of the k best rows for each query, exact.

    Queries go in blocks of about QUERY_BLOCK, each sent to all tasks; a task keeps the k best of each query before the shuffle.
    """
    asked = _with_norm(queries, query_id, query_vector, "query_id").withColumn("own", F.lit(0.0))
    pairs = _blocks(_with_norm(table, id_col, vector_col, "id"), asked, k, id_col, query_id)
    order = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("score"), id_col)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within(table: DataFrame, queries: DataFrame, least: str, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, score) of all rows whose similarity is at least the number in the query's column `least`; none is left out."""
    own = queries.where(F.col(query_vector).isNotNull())
    asked = own.select(F.col(query_id).alias("query_id"), V.as_double(F.col(query_vector)).alias("v"), V.norm(F.col(query_vector)).alias("n"), F.col(least).cast("double").alias("own"))
    return _blocks(_with_norm(table, id_col, vector_col, "id"), asked, None, id_col, query_id)


class CoarseIndex:
    """Rows dealt to the nearest of `lists` centroids; a query reads the `probes` nearest lists.

    Centroids are fitted on a sample of at most `sample` rows; every row is indexed.
    """

    def __init__(self, lists: int = 128, probes: int = 20, sample: int = 50_000, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.lists, self.probes, self.sample, self.seed, self.id_col, self.vector_col = lists, probes, sample, seed, id_col, vector_col

    def fit(self, table: DataFrame) -> CoarseIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.feature import Normalizer

        rows = table.where(F.col(self.vector_col).isNotNull()).select(array_to_vector(V.as_double(F.col(self.vector_col))).alias("__v"))
        n = rows.count()
        if n > self.sample:
            rows = rows.sample(self.sample / n, seed=self.seed)
        unit = Normalizer(inputCol="__v", outputCol="features").transform(rows)
        self.model = KMeans(k=self.lists, seed=self.seed, maxIter=20).fit(unit)
        self.centres = [[float(x) for x in c] for c in self.model.clusterCenters()]
        return self

    def _nearest(self, vector: Column, n: int) -> Column:
        """Numbers of the n centroids with the least distance to the unit vector."""
        centres = F.array(*[literal(c) for c in self.centres])
        far = F.transform(centres, lambda c, i: F.struct((F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) - 2 * V.dot(vector, c) / V.norm(vector)).alias("d"), i.alias("list")))
        return F.transform(F.slice(F.array_sort(far), 1, n), lambda x: x["list"])

    def index(self, table: DataFrame) -> DataFrame:
        """table with its list number; write it partitioned by `list` and queries prune the other lists."""
        return table.where(F.col(self.vector_col).isNotNull()).withColumn("list", F.get(self._nearest(F.col(self.vector_col), 1), 0))

    def search(self, indexed: DataFrame, query: list[float], k: int = 5) -> DataFrame:
        import math

        unit = math.sqrt(sum(x * x for x in query)) or 1.0
        far = sorted((sum(c * c for c in centre) - 2 * sum(a * b for a, b in zip(query, centre, strict=True)) / unit, i) for i, centre in enumerate(self.centres))
        return knn(indexed.where(F.col("list").isin([i for _, i in far[: self.probes]])), query, k, id_col=self.id_col, vector_col=self.vector_col)


def hybrid_in_row(table: DataFrame, query_vector: list[float], query: str, k: int = 5, vector_weight: float = 0.7, id_col: str = "vec_id", vector_col: str = "embedding", text_col: str = "text") -> DataFrame:
    """0.7 cosine + 0.3 share of the query's blank-delimited words that occur in the text; positive scores only."""
    score = F.lit(vector_weight) * F.coalesce(V.cosine(F.col(vector_col), literal(query_vector)), F.lit(0.0)) + F.lit(1 - vector_weight) * keyword_overlap(F.col(text_col), query)
    return table.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def keyword_overlap(text: Column, query: str) -> Column:
    words = [w for w in query.lower().split() if w]
    hits = sum((F.when(F.instr(F.lower(text), w) > 0, 1).otherwise(0) for w in words), F.lit(0))
    return F.coalesce(hits / F.lit(float(max(1, len(words)))), F.lit(0.0))
