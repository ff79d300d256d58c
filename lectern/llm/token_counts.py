"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a blank-delimited word behind the vocabulary's word mark. Distinct pre-tokens are
inserted in a trie, which is built depth by depth over the sorted words: words with a common prefix share
its node. A node's forward score is the best log probability of a segmentation of its prefix into pieces
(on ties, the one with fewer pieces), computed once from the nodes above it, for all nodes of a depth
together. Terminal nodes store the number of pieces, and documents sum them.

The pieces are those of a public vocabulary file, given as a parameter. Their chance is their share, plus
one half each, among the pieces into which the public tokenizer itself cuts the words of all documents:
one pass that sends at most one row for each piece and task. A character that no piece holds costs its
UTF-8 bytes as byte pieces. No tokenizer is trained.

Two narrow passes, no shuffle of texts or words; what a worker remembers of words is bounded and changes
no count.

Defined cases: a null or empty text has no pre-tokens and no tokens; a repeated row is counted again;
a word of any length is scored whole (one longer than LONGEST outside of the trie); other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import words as W

#: Longest pre-token that is inserted in the trie, and the words inserted together.
LONGEST, TOGETHER = 64, 20_000
MARK = "▁"
BATCH_BYTES = 2 << 20


class Vocabulary:
    """The pieces of a sentencepiece file."""

    made: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i))]
        self.pieces = {self.sp.id_to_piece(i): i for i in ids if not self.sp.is_byte(i)}
        self.bytes = [i for i in ids if self.sp.is_byte(i)]
        self.known = W.Remembered(self.cut, np.int32)

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of each word by the public tokenizer, one after another, and how many each has."""
        out = self.sp.encode([w.decode() for w in words], num_threads=1) if words else []
        return np.array([i for x in out for i in x], np.int32), np.array([len(x) for x in out], np.int64)

    def log_chances(self, counts: dict[int, int]) -> tuple[dict[str, float], float]:
        """Log probability of each piece, and of one byte piece, from counts of all pieces."""
        some = sum(counts.get(i, 0) for i in self.bytes) / max(1, len(self.bytes))
        total = sum(counts.get(i, 0) + 0.5 for i in [*self.pieces.values(), *self.bytes])
        return {p: float(np.log((counts.get(i, 0) + 0.5) / total)) for p, i in self.pieces.items()}, float(np.log((some + 0.5) / max(total, 1)))


def _piece_counts(path: str):
    """(piece, count) of a task's words."""

    def run(batches):
        W.settle()
        v = Vocabulary.of(path)
        total = np.zeros(v.sp.get_piece_size(), np.int64)
        for batch in batches:
            _, offs = W.text_buffer(batch.column(0))
            for i, j in W.cuts(offs, BATCH_BYTES):
                buf, o = W.text_buffer(batch.column(0).slice(i, j - i))
                s, e, _ = W.spans(buf, o, W.BLANK_WORDS)
                which, starts, sizes = v.known.look_up(W.hashes(buf, s, e, W.AS_IT_IS), W.speller(buf, s, e))
                times = np.bincount(which, minlength=len(starts))
                total += np.bincount(W.ragged(v.known.flat, starts, sizes), weights=np.repeat(times, sizes), minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["piece", "n"])

    return run


def piece_counts(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> dict[int, int]:
    """How often each piece occurs in all texts, as the public tokenizer cuts them: at most one row for each piece."""
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_piece_counts(vocabulary_path), "piece int, n long")
    return {r["piece"]: r["n"] for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Trie:
    """Forward scores of pre-tokens: all nodes of a depth at once."""

    def __init__(self, pieces: dict[str, float], byte: float):
        self.pieces, self.byte, self.widest = pieces, byte, max(map(len, pieces), default=1)
        # every suffix of a piece by its hash, with the log probability where it is a piece itself
        ends: dict[int, float] = {}
        for p, logp in pieces.items():
            h = 0
            for k in range(len(p) - 1, -1, -1):
                h = W.step_one(h, ord(p[k]))
                ends.setdefault(h, -np.inf)
            ends[h] = logp
        self.ends = np.array(sorted(ends), np.uint64)
        self.logp = np.array([ends[h] for h in self.ends.tolist()], float)
        self.single = np.array(sorted(ord(p) for p in pieces if len(p) == 1), np.uint32)
        self.nodes = 0

    def insert(self, words: list[str]) -> np.ndarray:
        """The number of pieces of each of these sorted, different pre-tokens of at most LONGEST characters."""
        n, size = len(words), np.array([len(w) for w in words])
        wide = int(size.max())
        chars = np.array(words, dtype=f"U{wide}").view(np.uint32).reshape(n, wide)
        scores, counts = np.zeros((n, wide + 1)), np.zeros((n, wide + 1), np.int32)
        fresh = np.zeros(n, bool)
        fresh[0] = True
        places = np.arange(n)
        for end in range(1, wide + 1):
            fresh[1:] |= chars[1:, end - 1] != chars[:-1, end - 1]
            node = places[fresh & (size >= end)]  # the first word below each node of this depth
            self.nodes += len(node)
            best, fewest = np.full(len(node), -np.inf), np.zeros(len(node), np.int32)
            h, on = np.zeros(len(node), np.uint64), np.arange(len(node))
            for at in range(end - 1, max(0, end - self.widest) - 1, -1):
                h = W.step(h, chars[node[on], at])
                i = np.minimum(np.searchsorted(self.ends, h), len(self.ends) - 1)
                go = self.ends[i] == h
                on, h, i = on[go], h[go], i[go]
                if not len(on):
                    break
                s, c = scores[node[on], at] + self.logp[i], counts[node[on], at] + 1
                win = (s > best[on]) | ((s == best[on]) & (s > -np.inf) & (c < fewest[on]))
                best[on[win]], fewest[on[win]] = s[win], c[win]
            last = chars[node, end - 1]
            odd = np.flatnonzero(~np.isin(last, self.single))  # characters without a piece: as bytes, where that is better
            if len(odd):
                some = 1 + (last[odd] >= 0x80).astype(np.int32) + (last[odd] >= 0x800) + (last[odd] >= 0x10000)
                s = scores[node[odd], end - 1] + some * self.byte
                win = s > best[odd]
                best[odd[win]], fewest[odd[win]] = s[win], (counts[node[odd], end - 1] + some)[win]
            of = np.maximum.accumulate(np.where(fresh, places, 0))
            scores[node, end], counts[node, end] = best, fewest
            scores[:, end], counts[:, end] = scores[of, end], counts[of, end]
        return counts[places, size]

    def alone(self, word: str) -> int:
        """The same for one pre-token of any length."""
        scores, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            best, fewest = -np.inf, 0
            for at in range(end - 1, max(0, end - self.widest) - 1, -1):
                p = self.pieces.get(word[at:end])
                if p is not None and (scores[at] + p, -counts[at] - 1) > (best, -fewest):
                    best, fewest = scores[at] + p, counts[at] + 1
            if word[end - 1] not in self.pieces:
                n = len(word[end - 1].encode())
                if scores[end - 1] + n * self.byte > best:
                    best, fewest = scores[end - 1] + n * self.byte, counts[end - 1] + n
            scores.append(best)
            counts.append(fewest)
        return counts[-1]

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of pieces of each word."""
        texts = [MARK + w.decode() for w in words]
        out = np.zeros(len(texts), np.int32)
        # an array of strings forgets zeros at their ends
        short = [k for k, t in enumerate(texts) if len(t) <= LONGEST and t[-1] != "\0"]
        short.sort(key=texts.__getitem__)
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            out[some] = self.insert([texts[k] for k in some])
        for k in sorted(set(range(len(texts))) - set(short)):
            out[k] = self.alone(texts[k])
        return out, np.ones(len(out), np.int64)


_latest: dict[str, W.Remembered] = {}


def _count(shared, name: str):
    def run(batches):
        W.settle()
        if name not in _latest:  # a worker keeps its words from task to task
            _latest.clear()
            _latest[name] = W.Remembered(Trie(*shared.value).learn, np.int32)
        known = _latest[name]
        for batch in batches:
            _, offs = W.text_buffer(batch.column(1))
            for i, j in W.cuts(offs, BATCH_BYTES):
                buf, o = W.text_buffer(batch.column(1).slice(i, j - i))
                s, e, at = W.spans(buf, o, W.BLANK_WORDS)
                which, starts, _ = known.look_up(W.hashes(buf, s, e, W.AS_IT_IS), W.speller(buf, s, e))
                upto = np.concatenate([[0], np.cumsum(known.flat[starts][which], dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(np.diff(upto[at]))], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row."""
    chances = Vocabulary.of(vocabulary_path).log_chances(piece_counts(docs, vocabulary_path, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(chances)  # bounded by the vocabulary
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_count(shared, uuid.uuid4().hex), "doc_id long, n_pretokens long, n_tokens long")
