"""Embedding providers and vectorisation of chunks.

A provider is an object with `dimension`, `name` and `encode(list of texts) -> list of vectors`; it runs
on Arrow batches, is made once for each task and may fail for a batch, whose vectors are then null.
Equal texts are embedded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HashingEmbedder:
    """Deterministic vectors of hashed words, of unit length; for tests and for want of a model."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.name = dimension, f"hashing-{dimension}"

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else v)
        return out


class LetterCounts:
    """How often a text has each of some letters, in either case: vectors that can be told by hand."""

    def __init__(self, letters: str):
        self.letters, self.dimension, self.name = letters, len(letters), f"letters-{letters}"

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in self.letters] for t in texts]


def vector_field(dimension: int) -> str:
    return f"q_{dimension}_vec"


def embed(c: Column, make: Callable[[], object], batch: int = 32) -> Column:
    """Vectors of texts by the provider that `make` gives; null where it fails or a text is null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            out = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(known), batch):
                some = known[at : at + batch]
                try:
                    vectors = model.encode([texts.iloc[i] for i in some])
                except Exception:  # a provider may be away for a while
                    continue
                for i, v in zip(some, vectors, strict=True):
                    out[i] = v
            yield pd.Series(out)

    return run(c)


def vectorise(chunks: DataFrame, make: Callable[[], object], content: str = "content", vector: str = "vector") -> DataFrame:
    """chunks with vectors; each different text, told by a hash of 128 bits, is embedded once."""
    keyed = chunks.withColumn("__key", F.unhex(F.md5(F.col(content).cast("binary"))))
    texts = keyed.where(F.col(content).isNotNull()).select(F.col("__key").alias("__made"), F.col(content).alias("__text")).dropDuplicates(["__made"])
    made = texts.select("__made", embed(F.col("__text"), make).alias(vector))
    return keyed.join(made, F.col("__key") == F.col("__made"), "left").drop("__key", "__made")


def failures(df: DataFrame, content: str = "content", vector: str = "vector") -> DataFrame:
    """(texts, failed): how many rows have a text, and how many of them no vector: a provider that fails shows here."""
    lacking = F.col(content).isNotNull() & (F.col(vector).isNull() | (F.size(vector) == 0))
    return df.agg(F.count(content).alias("texts"), F.count_if(lacking).alias("failed"))


class Remote:
    """A provider over HTTP: texts in calls of `batch`, each tried `tries` times; the texts of a call that fails in all have null vectors.

    Where every call fails the last error is raised, so that another provider can take over.
    """

    def __init__(self, url: str, model: str, key: str = "", batch: int = 10, tries: int = 3, timeout: float = 60.0, wait: float = 1.0, send=None, dimensions: int | None = None):
        self.more = {"encoding_format": "float"} | ({"dimensions": dimensions} if dimensions else {})
        self.url, self.model, self.key, self.batch, self.tries, self.timeout, self.wait, self.send = url, model, key, batch, tries, timeout, wait, send or self._post

    def _post(self, body: dict) -> dict:
        import json
        import urllib.request

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
            return json.load(r)

    def encode(self, texts: list[str]) -> list[list[float] | None]:
        import time

        out: list[list[float] | None] = []
        error = None
        for at in range(0, len(texts), self.batch):
            some = texts[at : at + self.batch]
            for left in range(self.tries - 1, -1, -1):
                try:
                    data = self.send({"model": self.model, "input": some, **self.more})["data"]
                    if len(data) != len(some):
                        raise ValueError(f"{len(data)} vectors for {len(some)} texts")
                    out += [x["embedding"] for x in sorted(data, key=lambda x: x.get("index", 0))]
                    break
                except Exception as e:
                    if left:
                        time.sleep(self.wait)
                    else:
                        error = e
                        out += [None] * len(some)
        if error is not None and not any(out):
            raise error
        return out


class Switch:
    """The remote provider where there is one, else, or where it fails, the local one."""

    def __init__(self, remote=None, local=None):
        self.remote, self.local = remote, local

    def encode(self, texts: list[str]) -> list[list[float]]:
        if self.remote is not None:
            try:
                return self.remote.encode(texts)
            except Exception:
                if self.local is None:
                    raise
        return self.local.encode(texts)


def usable(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows that have a vector."""
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))


def documents(chunks: DataFrame, kb_id: str | None = None, dimension: int = 64, vector: str = "vector", **overrides) -> DataFrame:
    """Rows as a store keeps them: ids, names, term lists, the vector under its field name; rows without vectors go."""
    from lectern.functions import text as T

    rows = usable(chunks, vector)
    extra = {k: F.lit(v) for k, v in overrides.items()}
    return rows.select(
        "*",
        F.lit(kb_id).alias("kb_id"),
        T.xxh64_hex(F.concat(F.col("content"), F.lit(kb_id or ""))).alias("id"),
        F.col("content").alias("content_with_weight"),
        T.tokens(F.col("content")).alias("content_ltks"),
        F.current_timestamp().alias("create_time"),
        F.col(vector).alias(vector_field(dimension)),
        *[c.alias(k) for k, c in extra.items()],
    )
