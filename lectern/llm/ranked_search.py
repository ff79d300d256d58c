"""Ranked lexical search: the best documents for each query text, score-at-a-time over impact-ordered postings.

A document's score for a term is its exact integer impact times the term's weight, and the counts behind it (documents,
lengths, document frequencies) are over all documents. One pass tokenises the texts and writes, for each document, the
query terms it holds; documents stay where they are, so no posting is shuffled. A second one takes the
documents of a task block by block: postings of a term are grouped by exact impact and lie in descending order, and
for a query the groups of all its terms are added to the accumulators from the largest contribution down. After each round what is left of every
term bounds what a document can still gain; once no document but the k best can reach the k-th score, the groups that are left are
skipped and the scores of the contenders are completed from their own terms. The k best of earlier blocks
raise the bar for later ones. Each task gives its k best of each query, of which a window takes the k best of all.

Queries go to tasks in blocks of about BLOCK_TERMS (query, term) rows, never a whole table of any size: more
queries mean more passes. Terms are told apart by 64-bit hashes.

Defined cases: null and empty texts have no terms, on both sides; a document's rows that repeat rank each; queries that
repeat are ranked each; equal scores go by the smaller id, null ids last; very long texts are counted whole; other
columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import words as W
from lectern.llm.shared import cut, written

#: (query, term) rows sent to tasks at once.
BLOCK_TERMS = 250_000
#: Documents of a task searched at once, and the most marks (documents by terms of a query) kept for them.
BLOCK_DOCS, BLOCK_MARKS = 65_536, 64_000_000
#: Postings of the first round of a search; every further round takes twice as many.
ROUND = 4096
#: Bytes of text looked at together.
BYTES = 8_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass
class Queries:
    """A block of queries: q[i] has the terms term[ptr[i]:ptr[i + 1]], each with its number of repeats, later times its weight."""

    q: np.ndarray
    ptr: np.ndarray
    term: np.ndarray
    factor: np.ndarray
    n_terms: int


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((q, query id), (q, term, repeats)): queries numbered, and their terms."""
    named = cut(queries.select(F.col(id_col).alias("query"), F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, UPPER.lower()).alias("__t")).withColumn("q", F.monotonically_increasing_id()))
    found = F.regexp_extract_all("__t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    terms = named.select("q", F.explode_outer(found).alias("term")).where("term is not null")
    return named.select("q", "query"), cut(terms.groupBy("q", "term").agg(F.count(F.lit(1)).alias("repeats")))


def _postings(known: np.ndarray, batches):
    """(doc_id, n, terms, tfs) of the documents that have terms: their length, and the query terms they hold with frequencies."""
    import pyarrow as pa

    W.settle()
    order = np.argsort(known)
    keys = known[order]
    for batch in batches:
        _, offs = W.text_buffer(batch.column(1))
        for i, j in W.cuts(offs, BYTES):
            buf, offs_in = W.text_buffer(batch.column(1).slice(i, j - i))
            starts, ends, per = W.spans(buf, offs_in, W.ALNUM_WORDS)
            h = W.hashes(buf, starts, ends)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == h)
            doc = np.repeat(np.arange(j - i), np.diff(per))
            pair, tf = np.unique(doc[hit] * len(keys) + order[at[hit]], return_counts=True)
            n = np.diff(per)
            rows = np.flatnonzero(n)
            # documents without terms have no pairs, so the places of the others' pairs lie one after another
            ptr = pa.array(np.append(np.searchsorted(pair, rows * len(keys)), len(pair)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ptr, pa.array(x.astype(np.int32))) for x in (pair % len(keys), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(n[rows].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])


def _statistics(n_terms: int, batches):
    """Partial counts of a task: documents by term; under -1 its documents, under -2 their terms."""
    import pyarrow as pa

    df, docs, length = np.zeros(n_terms, np.int64), 0, 0
    for batch in batches:
        df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
        docs, length = docs + batch.num_rows, length + int(batch.column(0).to_numpy().sum())
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[some], [docs, length]]))], names=["term", "c"])


class Index:
    """Impact-ordered postings of a block of documents, and their own terms to complete scores from."""

    def __init__(self, n: np.ndarray, ptr: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, docs: int, length: int):
        self.size, self.ptr, self.term = len(n), ptr, term
        m = 100 - 75 + 75 * n * docs // length
        doc = np.repeat(np.arange(len(n)), np.diff(ptr))
        tf = tf.astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -self.impact, term))
        self.doc = doc[order]
        t, i = term[order], self.impact[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
        #: A group is the documents with one impact for one term; of_term[t]:of_term[t + 1] are the groups of a term.
        self.start = np.flatnonzero(fresh)
        self.many = np.diff(np.append(self.start, len(t)))
        self.level, self.of_term = i[self.start], np.searchsorted(t[self.start], np.arange(n_terms + 1))
        self.weights = np.zeros(n_terms, np.int64)

    def search(self, terms: np.ndarray, factors: np.ndarray, k: int, bar: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings used): all that can be among the k best, or tie with the k-th, of those that score at least `bar` > 0."""
        used = 0
        first, last = self.of_term[terms], self.of_term[terms + 1]
        held = np.flatnonzero((last > first) & (factors > 0))
        terms, factors, first, last = terms[held], factors[held], first[held], last[held]
        sizes = last - first
        group = W.ragged(np.arange(len(self.level)), first, sizes)
        owner = np.repeat(np.arange(len(terms)), sizes)
        value = factors[owner] * self.level[group]
        down = np.argsort(-value, kind="stable")
        reached = np.cumsum(self.many[group[down]])
        sums, marks = np.zeros(self.size, np.int64), np.zeros((self.size, len(terms)), bool)
        next_group, done, goal, lively = first.copy(), 0, ROUND, np.zeros(0, np.int64)
        while done < len(down):
            upto = max(done + 1, int(np.searchsorted(reached, goal, side="right")))
            now = down[done:upto]
            many = self.many[group[now]]
            docs, of = W.ragged(self.doc, self.start[group[now]], many), np.repeat(owner[now], many)
            np.add.at(sums, docs, np.repeat(value[now], many))
            marks[docs, of] = True
            next_group += np.bincount(owner[now], minlength=len(terms))
            done, goal, used = upto, goal * 2, int(reached[upto - 1])
            # what each term can still give, and the k-th score so far
            rest = np.where(next_group < last, factors * self.level[np.minimum(next_group, last - 1)], 0)
            low = max(bar, 1, int(np.partition(sums, self.size - k)[self.size - k]) if self.size >= k else 0)
            if rest.sum() < low:  # no document without a mark can come in
                lively = np.flatnonzero(sums + rest.sum() >= low)
                lively = lively[sums[lively] + rest.sum() - marks[lively] @ rest >= low]
                if len(lively) <= k:
                    break
        if done == len(down):
            low = max(bar, 1, int(np.partition(sums, self.size - k)[self.size - k]) if self.size >= k else 0)
            lively = np.flatnonzero(sums >= low)
        self.weights[terms] = factors
        at = W.ragged(np.arange(len(self.term)), self.ptr[lively], self.ptr[lively + 1] - self.ptr[lively])
        whole = np.zeros(len(lively), np.int64)
        np.add.at(whole, np.repeat(np.arange(len(lively)), self.ptr[lively + 1] - self.ptr[lively]), self.weights[self.term[at]] * self.impact[at])
        self.weights[terms] = 0
        return lively, whole, used


def _search(asked: Queries, k: int, docs: int, length: int, batches):
    """(q, doc_id, score): the k best of a task for each query."""
    import pyarrow as pa

    W.settle()
    longest = int(np.diff(asked.ptr).max())
    most = min(BLOCK_DOCS, max(1024, BLOCK_MARKS // longest))
    best: list[list] = [[] for _ in asked.q]
    kind = None

    def look(table: pa.Table):
        ids, n = table.column("doc_id").combine_chunks(), table.column("n").combine_chunks().to_numpy()
        term, tf = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        ptr = np.concatenate([[0], np.cumsum(term.value_lengths().to_numpy())]).astype(np.int64)
        index = Index(n, ptr, term.flatten().to_numpy(), tf.flatten().to_numpy(), asked.n_terms, docs, length)
        for i, held in enumerate(best):
            a, b = asked.ptr[i], asked.ptr[i + 1]
            found, scores, _ = index.search(asked.term[a:b], asked.factor[a:b], k, held[-1][0] if len(held) == k else 0)
            if len(found):
                rows = [*held, *zip(scores.tolist(), ids.take(pa.array(found)).to_pylist(), strict=True)]
                best[i] = sorted(rows, key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[:k]

    held, n = [], 0
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for i in range(0, batch.num_rows, most):
            piece = batch.slice(i, most)
            if held and n + piece.num_rows > most:
                look(pa.Table.from_batches(held))
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        look(pa.Table.from_batches(held))
    rows = [(q, d, s) for q, found in zip(asked.q.tolist(), best, strict=True) for s, d in found]
    if rows:
        q, d, s = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, kind), pa.array(s, pa.int64())], names=["q", "doc_id", "score"])


def _block(rows: list) -> tuple[Queries, np.ndarray]:
    """The queries of (q, term, repeats) rows, and the hashes of their terms."""
    import pyarrow as pa

    terms = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    buf, offs = W.text_buffer(pa.array(terms))
    rows = sorted(rows, key=lambda r: (r["q"], r["term"]))
    q, ptr = np.unique(np.array([r["q"] for r in rows]), return_index=True)
    block = Queries(q, np.append(ptr, len(rows)), np.array([number[r["term"]] for r in rows]), np.array([r["repeats"] for r in rows], np.int64), len(terms))
    return block, W.hashes(buf, offs[:-1], offs[1:])


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query with a score above 0."""
    spark = docs.sparkSession
    named, terms = query_terms(queries, query_id, query_text)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"q long, doc_id {kind}, score long"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = spark.createDataFrame([], shape)
    blocks = -(-terms.count() // BLOCK_TERMS)
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        asked, known = _block(rows)
        posts = written(texts.mapInArrow(lambda it, known=known: _postings(known, it), f"doc_id {kind}, n long, terms array<int>, tfs array<int>"), "postings")
        told = posts.select("n", "terms").mapInArrow(lambda it, n=asked.n_terms: _statistics(n, it), "term int, c long")
        told = {r["term"]: r["c"] for r in told.groupBy("term").agg(F.sum("c").alias("c")).collect()}
        n, length = told.pop(-1, 0), told.pop(-2, 0)
        if not n:
            continue
        weight = np.zeros(asked.n_terms, np.int64)
        for t, df in told.items():
            weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        asked.factor = asked.factor * weight[asked.term]
        found = found.unionByName(posts.mapInArrow(lambda it, asked=asked, n=n, length=length: _search(asked, k, n, length, it), shape))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named, "q").select(F.col("query").alias("item_id"), "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
q AS (SELECT item_id, term, count(*) AS many FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
x AS (SELECT item_id, r, any_value(n.doc_id) AS doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n.n * docs) // l)))) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (r), s GROUP BY item_id, r)
SELECT item_id, rank, doc_id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""
