"""Audit of five text filters in every order: what each step removes, and what an earlier step took from it.

What a document fails is a set of five bits, so all 120 orders need one look at its text: a table of 32 sets by 120
orders says at which step the first failed filter stands. Tasks look their documents up in it and count by part, order,
step and label with np.bincount; the counts of the tasks are summed, 600 rows for each part and task.

The filters read whole texts as DataFrame expressions. Filter E (a copy of a smaller id's text) takes the smallest id of
each text's SHA-256, summed before the shuffle, and joins it back by id and digest, so that a group of copies
spreads over tasks. What is known of each document is checkpointed, texts are read once.

Defined cases: a null text is empty (and a copy of every empty text of a smaller id); a null lang is the part ''; a
null id is no copy and no text is a copy of it; rows that repeat with id and text count each and aren't copies of one
another, though copies of a smaller id's; very long texts are counted whole; a label that stands more than once holds
if one row says so; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import cut

BLANKS = " \t\n\x0b\f\r"
FILTERS = "ABCDE"
#: All orders of the filters, alphabetically.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Rows of a task looked up at once, and parts whose counts it holds.
ROWS, PARTS = 2048, 256
COUNTS = ["docs", "fails", "only", "removed", "good_lost", "toxic_lost"]


def first_failure() -> np.ndarray:
    """(32, 120): the step, from 0, of the first failed filter, by the set of failed filters (bit f for filter f) and the order; 5 if none failed."""
    at = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    failed = np.arange(1 << len(FILTERS))[:, None, None] >> at & 1
    return np.where(failed.any(2), failed.argmax(2), len(FILTERS))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, failed) of each row; failed has bit f for each filter f that the document fails."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    df = df.withColumn("__w", F.split(F.btrim("__t", F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    some = F.btrim("__t", F.lit(BLANKS)) != ""
    df = df.select(
        "doc_id", "part", "__t",
        F.when(some, F.size("__w")).otherwise(0).cast("long").alias("__n"), F.when(some, F.size(F.array_distinct("__w"))).otherwise(0).cast("long").alias("__u"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("__c"), F.length("__t").cast("long").alias("__l"),
    )
    bits = [F.col("__n") < 100, 100 * F.col("__u") < 80 * F.col("__n"), 100 * F.col("__c") > 10 * F.col("__l"), F.col("__t").rlike("[#$%&*|]")]
    own = sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))
    known = cut(df.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("__t", 256)).alias("digest")))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return known.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("failed"))


def _count(batches):
    """Partial counts of a task: (part, filter_order, step, COUNTS) for all orders and steps of each part it met."""
    import pyarrow as pa

    first, orders, steps = first_failure(), len(ORDERS), len(FILTERS)
    at = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    sets = np.arange(1 << steps)
    fails = (sets[:, None] >> np.arange(steps) & 1).astype(np.int64)
    only = fails * (fails.sum(1) == 1)[:, None]
    held: dict[str, np.ndarray] = {}  # part -> counts by COUNTS, order and step

    def rows():
        names = list(held)
        flat = np.concatenate([held[p].reshape(len(COUNTS), -1) for p in names], axis=1)
        n = orders * steps
        columns = [pa.array([p for p in names for _ in range(n)]), pa.array(np.tile(np.repeat(ORDERS, steps), len(names))), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), orders * len(names)))]
        held.clear()
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, flat)], names=["part", "filter_order", "step", *COUNTS])

    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            piece = batch.slice(i, ROWS)
            part = piece.column(0).dictionary_encode()
            names, part = part.dictionary.to_pylist(), part.indices.to_numpy()
            failed, good, toxic = (piece.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            # every document's step in every order, as a cell of part, order and step; the last step stands for kept ones
            cell = (part[:, None] * orders + np.arange(orders)) * (steps + 1) + first[failed]
            gone = [np.bincount(cell[chosen].ravel(), minlength=len(names) * orders * (steps + 1)).reshape(len(names), orders, steps + 1)[:, :, :steps] for chosen in (slice(None), good, toxic)]
            seen = np.bincount(part * len(sets) + failed, minlength=len(names) * len(sets)).reshape(len(names), len(sets))
            by_filter = np.stack([np.repeat(seen.sum(1)[:, None], steps, 1), seen @ fails, seen @ only])  # 3 x parts x filters
            for k, name in enumerate(names):
                now = np.concatenate([by_filter[:, k, :][:, at], np.stack([g[k] for g in gone])])
                held[name] = held[name] + now if name in held else now
            if len(held) > PARTS:
                yield rows()
    if held:
        yield rows()


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all 120 orders and their steps."""
    told = labels.select(F.col("doc_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).groupBy("doc_id").agg(F.max("g").alias("good"), F.max("t").alias("toxic"))
    known = failures(docs, id_col, text_col, part_col).join(told, "doc_id", "left")
    known = known.select("part", F.col("failed").cast("int"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    counted = known.mapInArrow(_count, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    sums = counted.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("part", F.substr("filter_order", "step", F.lit(1)))
    return sums.select(
        "part", "filter_order", "step", (F.col("docs") - F.sum("removed").over(so_far)).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        F.col("only").alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(every).alias("shapley"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(d.t, '[A-Z]')) > 10 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS b, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN e ON d.t = e.t LEFT JOIN g ON d.doc_id = g.doc_id),
m AS (SELECT part, b, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, b),
l(c, k) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.k, w.k, x.k, y.k, z.k] AS ks FROM l v, l w, l x, l y, l z WHERE len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5),
s AS (SELECT part, filter_order, step, ks[step] AS f, n, good, toxic, b[ks[step]] AS fails, len(list_filter(ks[1:step - 1], lambda k: b[k])) > 0 AS earlier, len(list_filter(b, lambda x: x)) = 1 AS alone FROM m, o, range(1, 6) r(step)),
c AS (SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT earlier AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant,
    coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM c
"""
