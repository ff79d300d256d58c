"""Benchmark decontamination with an FM-index over each shard of the training texts.

A shard is a batch of documents. Its words become numbers of the benchmark's vocabulary; a word that
the benchmark lacks ends a run, and runs shorter than the shortest test phrase can hold none. Over the
runs stand a suffix array, the Burrows-Wheeler transform and a wavelet matrix with ranks. All test
phrases are searched backward at once; their occurrences are located by walking back to sampled suffix
positions; overlapping ones merge to removal spans.

Documents need no shuffle: each batch is indexed, searched and given back in one narrow pass, and a
batch holds SHARD_BYTES of text or one longer text. The benchmark is sent to the executors in blocks of
at most BLOCK_WORDS words; a larger one takes a pass for each block, which adds to the same spans.

Defined cases: a null or empty text has no words and no hits; an item without words has no phrase;
repeated rows are searched once each; items with one id count as one; null item ids are left out of
the items (their phrases still hit); other columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words as W

SHARD_BYTES, BLOCK_WORDS = 8 << 20, 4_000_000
#: Every SAMPLE-th text position keeps its suffix position.
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order, by prefix doubling; the end sorts before everything."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(steps)])
        k *= 2
        if steps.all() or k >= n:
            return order


class FMIndex:
    """Backward search and location in a text of small numbers (0 only separates)."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text, [-1]]) + 1  # 0 is now the end, 1 separates
        self.n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels, self.low = [], {}
        self.bits = max(1, int(text.max()).bit_length())
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = level >> b & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((b, ones, self.n - int(ones[-1])))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.first = np.zeros(len(self.before), np.int64)  # where each number begins below the last level
        found, at = np.unique(level, return_index=True)
        self.first[found] = at
        self.sampled = order % SAMPLE == 0
        self.kept = order[self.sampled]
        self.nth = np.concatenate([[0], np.cumsum(self.sampled)])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands among the first i numbers of the transform."""
        for b, ones, zeros in self.levels:
            o = ones[i]
            i = np.where(c >> b & 1, zeros + o, i - o)
        return i - self.first[c]

    def back(self, i: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that are one number longer."""
        at, c = i, np.zeros_like(i)
        for b, ones, zeros in self.levels:
            o = ones[at]
            bit = ones[at + 1] - o
            c |= bit << b
            at = np.where(bit, zeros + o, at - o)
        return self.before[c] + at - self.first[c]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases that are right-aligned in a matrix."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n)
        for j in range(width):
            on = np.flatnonzero((lengths > j) & (lo < hi))
            if len(on):
                c = phrases[on, width - 1 - j] + 1
                known = c < len(self.before) - 1
                hi[on[~known]] = lo[on[~known]]
                on, c = on[known], c[known]
                present = self.before[c + 1] > self.before[c]
                hi[on[~present]] = lo[on[~present]]
                on, c = on[present], c[present]
                lo[on], hi[on] = self.before[c] + self.rank(c, lo[on]), self.before[c] + self.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes, from the nearest sampled place before each."""
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        at = rows.copy()
        while len(open_):
            done = self.sampled[at]
            out[open_[done]] = self.kept[self.nth[at[done]]] + steps
            open_, at = open_[~done], self.back(at[~done])
            steps += 1
        return out


class Phrases:
    """The test phrases of a block of benchmark items: windows of `n` words, or a shorter item whole."""

    def __init__(self, items: list[tuple[int | None, str]], n: int):
        buf, offs = W.text_buffer(pa.array([t for _, t in items], pa.string()))
        s, e, at = W.spans(buf, offs, W.ALNUM_WORDS)
        self.vocabulary, ids = np.unique(W.hashes(buf, s, e), return_inverse=True)
        found: dict[tuple, set] = {}
        for k, (item, _) in enumerate(items):
            w = (ids[at[k] : at[k + 1]] + 1).tolist()
            for i in range(max(1, len(w) - n + 1) if w else 0):
                found.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [item])
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.table = np.zeros((len(found), n), np.int64)
        for k, p in enumerate(found):
            self.table[k, n - len(p) :] = p
        self.items = [sorted(x) for x in found.values()]
        self.count = np.array([len(x) for x in self.items], np.int64)
        self.flat = np.array([i for x in self.items for i in x], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.count)])

    def occurrences(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word place, phrase) of each occurrence in texts whose word hashes are h, text k from at[k] on."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(h) or not len(self.lengths):
            return none
        i = np.searchsorted(self.vocabulary, h)
        i[i == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[i] == h, i + 1, 0)
        fresh = np.zeros(len(ids) + 1, bool)  # a run begins where the word before is unknown or of another text
        fresh[at] = True
        inside = np.flatnonzero(ids)
        if not len(inside):
            return none
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(inside) > 1) | fresh[inside[1:]]]))
        sizes = np.diff(np.append(starts, len(inside)))
        keep = np.repeat(sizes >= self.lengths.min(), sizes)
        if not keep.any():
            return none
        run = np.cumsum(np.repeat((sizes >= self.lengths.min()).astype(np.int64), 1))
        run = np.repeat(run, sizes)[keep] - 1
        place = inside[keep]
        text = np.zeros(len(place) + int(run[-1]) + 1, np.int64)
        where = np.arange(len(place)) + run  # one separator between runs
        text[where] = ids[place]
        index = FMIndex(text)
        lo, hi = index.search(self.table, self.lengths)
        phrase = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        spots = index.locate(rows)
        back = np.zeros(len(text), np.int64)
        back[where] = place
        return back[spots], phrase


_SCHEMA = "doc_id long, text string, n_words long, spans array<struct<first:long,last:long>>, items array<long>"


def _scan(phrases, with_text: bool, clean: bool):
    """One pass: adds the block's hits to the spans (of words) and items so far."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    @W.tidy
    def run(batches):
        p = phrases.value
        for batch in batches:
            _, offs = W.text_buffer(batch.column(1))
            for i, j in W.cuts(offs, SHARD_BYTES):
                yield one(p, batch.slice(i, j - i))

    def one(p, batch):
        buf, offs = W.text_buffer(batch.column(1))
        s, e, at = W.spans(buf, offs, W.ALNUM_WORDS)
        place, phrase = p.occurrences(W.hashes(buf, s, e), at)
        doc = np.searchsorted(at, place, side="right") - 1
        cover = np.zeros(len(s) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + p.lengths[phrase], -1)
        pairs = np.unique(np.stack([doc, phrase]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
        n = p.count[pairs[1]]
        who = np.repeat(pairs[0], n)
        what = p.flat[np.repeat(p.at[pairs[1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else np.zeros(0, np.int64)
        old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for k in np.flatnonzero([bool(x) for x in old_spans]):
            for x in old_spans[k]:
                cover[at[k] + x["first"]] += 1
                cover[at[k] + x["last"] + 1] -= 1
        hit = np.cumsum(cover[:-1]) > 0
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        cutoff = np.zeros(len(s) + 1, bool)
        cutoff[at] = True
        first = np.flatnonzero((edge[:-1] == 1) | (hit & cutoff[:-1]))  # spans end with their text
        last = np.flatnonzero((edge[1:] == -1) | (hit & cutoff[1:]))
        spans, items, texts = [[] for _ in old_spans], [set(x or ()) for x in old_items], batch.column(1) if with_text else None
        owner = np.searchsorted(at, first, side="right") - 1
        for k, a, b in zip(owner.tolist(), (first - at[owner]).tolist(), (last - at[owner]).tolist(), strict=True):
            spans[k].append({"first": a, "last": b})
        for k, x in zip(who.tolist(), what.tolist(), strict=True):
            items[k].add(x)
        if clean and len(first):
            texts = texts.to_pylist()
            for k in np.unique(owner).tolist():
                raw, mine = buf[offs[k] : offs[k + 1]].tobytes(), owner == k
                ends = [0, *(e[last[mine]] - offs[k]).tolist()]
                texts[k] = b"".join(raw[a:b] for a, b in zip(ends, [*(s[first[mine]] - offs[k]).tolist(), len(raw)], strict=True)).decode()
        columns = [batch.column(0), pa.array(texts, pa.string()) if isinstance(texts, list) else (texts if texts is not None else pa.nulls(batch.num_rows, pa.string())), pa.array(np.diff(at), pa.int64()), pa.array(spans, kind), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *batch.columns[5:]], names=["doc_id", "text", "n_words", "spans", "items", *batch.schema.names[5:]])

    return run


def _blocks(benchmark: DataFrame, n: int):
    """The benchmark's phrases in blocks of bounded size; the driver holds one block at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1]) // 2 + 1
        if size > BLOCK_WORDS:
            yield Phrases(held, n)
            held, size = [], 0
    if held:
        yield Phrases(held, n)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, clean: bool = False, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, spans, items) for each document.

    spans: merged removal spans as (first, last) word numbers; items: ids of the items with occurring
    windows. `clean` gives the text without the spans' words; else text is null. `keep` adds the other
    columns of docs.
    """
    sc = docs.sparkSession.sparkContext
    others = [c for c in docs.columns if c not in (id_col, text_col)] if keep else []
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)").alias("spans"),
        F.expr("cast(array() as array<bigint>)").alias("items"),
        *[F.col(c).alias(f"__{k}") for k, c in enumerate(others)],
    )
    schema = ", ".join([_SCHEMA, *[f"`__{k}` {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(others)]])
    blocks = _blocks(benchmark, n)
    now = next(blocks, None) or Phrases([], n)
    while now is not None:
        after = next(blocks, None)
        out = out.mapInArrow(_scan(sc.broadcast(now), clean or after is not None, clean and after is None), schema)
        now = after
    return out.select("doc_id", "text", "n_words", "spans", "items", *[F.col(f"__{k}").alias(c) for k, c in enumerate(others)])


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from the result of scan."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: For ten words: windows of ten, and shorter items as one window of their own length.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p ON s.n = p.n AND s.g = p.g),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
