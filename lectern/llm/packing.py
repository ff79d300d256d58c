"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Best-fit decreasing depends only on how many pieces there are of each length, and lengths are at most
the sequence size. So the packing itself is planned on that histogram: lengths fall from the largest,
a segment tree over remaining capacities finds the tightest open bin in logarithmic time, and equal
bins are moved together. The plan is the one that best-fit decreasing gives piece by piece; its size
depends on the sequence size, not on the corpus. Pieces then look up their place by length and rank.

Work per step: tokenising is one narrow pass; the ranks of equal lengths come from counts of small
buckets, so that no length is sorted in one task; the ids are shuffled once, to their places.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows are packed
once each; a null id is kept as null; columns other than id and text are ignored; an empty table gives
an empty result; texts of any length are tokenised whole and cut into full pieces.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words as W
from lectern.llm.shared import partitions, ranks, written

#: Bytes of text encoded together; a longer text stands alone.
BATCH_BYTES = 2 << 20
#: Words that are encoded in one call, and marks that may stand behind them.
TOGETHER, MARKS = 400, ".,;:!?"
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class WordEncoder:
    """Token ids of texts, word by word: no token of the vocabulary spans an ASCII blank, and A-Z are a-z to it.

    Different words are encoded once and remembered in bounded memory, since the same words come again
    and again. New words of letters, with or without marks behind them, are encoded together, as one text,
    and told apart by the tokens that end a run of letters or marks; if these are more than expected, the
    whole group is encoded word by word.
    """

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known = W.Remembered(self.learn, np.dtype("<u4"))

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, one after another, and how many each has."""
        texts = [w.decode() for w in words]
        letters = [w.rstrip(MARKS) for w in texts]
        alpha = np.array([x.isalpha() for x in letters], bool)
        runs = 1 + np.array([len(x) < len(y) for x, y in zip(letters, texts, strict=True)], bool)
        plain, other = np.flatnonzero(alpha), [np.flatnonzero(~alpha)]
        order, flat, sizes = [], [], []
        groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for g, e in zip(groups, self.batch([" ".join(map(texts.__getitem__, g.tolist())) for g in groups], add_special_tokens=False), strict=True):
            ids, last = np.array(e.ids, dtype="<u4"), np.cumsum(runs[g])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != last[-1]:
                other.append(g)
                continue
            order.append(g)
            flat.append(ids)
            sizes.append(np.diff(ends[last - 1], prepend=0))
        one = np.concatenate(other)
        for at in range(0, len(one), 5000):
            each = [e.ids for e in self.batch([texts[k] for k in one[at : at + 5000].tolist()], add_special_tokens=False)]
            order.append(one[at : at + 5000])
            flat.append(np.array([i for e in each for i in e], dtype="<u4"))
            sizes.append(np.array([len(e) for e in each], np.int64))
        flat, sizes = np.concatenate([np.zeros(0, "<u4"), *flat]), np.concatenate([np.zeros(0, np.int64), *sizes])
        starts, back = np.cumsum(sizes) - sizes, np.argsort(np.concatenate([np.zeros(0, np.int64), *order]))
        return W.ragged(flat, starts[back], sizes[back]), sizes[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of all texts one after another, each with the end id behind, and how many each has."""
        buf, offs = W.text_buffer(texts)
        s, e, at = W.spans(buf, offs, W.BLANK_WORDS)
        # a mark behind a letter or digit is a token of its own, so it is told from the word
        marked = np.flatnonzero(e - s > 1)
        marked = marked[_MARK[buf[e[marked] - 1]] & _LETTER[buf[e[marked] - 2]]]
        s, at = np.insert(s, marked + 1, e[marked] - 1), at + np.searchsorted(marked, at)
        e[marked] -= 1
        e = np.insert(e, marked + 1, e[marked] + 1)
        which, starts, sizes = self.known.look_up(W.hashes(buf, s, e), W.speller(buf, s, e))
        flat = np.append(self.known.flat, np.array([self.end_id], "<u4"))  # the end stands behind each text like a word
        which = np.insert(which, at[1:], len(starts))
        starts, sizes = np.append(starts, len(flat) - 1)[which], np.append(sizes, 1)[which]
        done = np.concatenate([[0], np.cumsum(sizes)])
        return W.ragged(flat, starts, sizes), np.diff(done[at + np.arange(len(at))])


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int = 0) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def _cut_pieces(path: str, cap: int, end_id: int):
    @W.tidy
    def run(batches):
        enc = encoder(path, end_id)
        for batch in batches:
            _, offs = W.text_buffer(batch.column(1))
            for i, j in W.cuts(offs, BATCH_BYTES):
                ids, sizes = enc.encode(batch.column(1).slice(i, j - i))
                pieces = -(-sizes // cap)
                doc = np.repeat(np.arange(j - i), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(cap, sizes[doc] - nth * cap)
                places = np.concatenate([[0], 4 * np.cumsum(length)])
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(places), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(nth, pa.int32()), pa.array(nth * cap), pa.array(length), data], names=["doc_id", "piece", "start", "length", "ids"])

    return run


class CapacityTree:
    """Segment tree over remaining capacities 0..cap; a leaf counts the groups of open bins with that rest."""

    def __init__(self, cap: int):
        self.width = 1 << cap.bit_length()
        self.counts = [0] * (2 * self.width)

    def add(self, rest: int, by: int) -> None:
        at = rest + self.width
        while at:
            self.counts[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least rest >= need that has open bins."""
        at = need + self.width
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if self.counts[2 * at] else 2 * at + 1
        return at - self.width


def best_fit_plan(counts: dict[int, int], cap: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on a histogram of lengths.

    Rows (length, from_rank, to_rank, per_bin, first_bin, offset): pieces of that length with ranks in
    [from_rank, to_rank) go, per_bin at a time, to bins first_bin, first_bin + 1, ... from offset on.
    """
    tree, open_bins, rows, bins = CapacityTree(cap), {}, [], 0

    def push(rest: int, first: int, n: int) -> None:
        if rest and n:
            open_bins.setdefault(rest, []).append((first, n))
            tree.add(rest, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            rest = tree.tightest(length)
            if rest is None:
                rest, first, n = cap, bins, -(-left // (cap // length))
                bins += n
            else:
                first, n = open_bins[rest].pop()
                tree.add(rest, -1)
            per = rest // length
            for m, each in ((min(n, left // per), per), (1, left % per)):
                if each == per or (n and left < per and left):
                    if m:
                        rows.append((length, rank, rank + m * each, each, first, cap - rest))
                        push(rest - each * length, first, m)
                    rank, left, first, n = rank + m * each, left - m * each, first + m, n - m
            push(rest, first, n)
    return rows


def pack(docs: DataFrame, tokenizer_path: str, cap: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) for each piece of each document.

    ids are little-endian unsigned 32-bit numbers. Pieces are written once, with their ids, to the shared
    folder; ranks and places are worked out without them, and the ids join their places by one shuffle.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = texts.mapInArrow(_cut_pieces(tokenizer_path, cap, end_id), "doc_id long, piece int, start long, length long, ids binary")
    pieces = written(pieces.withColumn("__key", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most cap rows
    plan = spark.createDataFrame(best_fit_plan(counts, cap), "at_length long, low long, high long, per long, first long, at long")
    slim = pieces.select("__key", "doc_id", "piece", "length")
    ranked = ranks(slim, ["length"], [F.col("doc_id"), F.col("piece"), F.col("__key")], F.xxhash64("__key"), max(256, 4 * partitions(spark)), "rank")
    placed = ranked.join(F.broadcast(plan), F.expr("length = at_length and rank >= low and rank < high"))  # bounded by cap
    placed = placed.select("__key", F.expr("first + (rank - low) div per").alias("sequence_id"), F.expr("at + (rank - low) % per * length").alias("offset"))
    return pieces.join(placed, "__key").drop("__key")
