"""Host-level quality rules: failures by host, shrunk by an empirical beta prior, joined back to documents.

Rules are counts over whole texts, as DataFrame expressions. A host's failure rate (f of n documents)
is shrunk to (f + a) / (n + a + b); a and b come from the mean of all documents and from how much more hosts' rates differ than
chance alone would have them (method of moments, the binomial part taken off), so that a host with few documents is judged mostly by
the others, and hosts that don't differ are judged alike. A host whose shrunk rate exceeds `limit` is rejected as a whole.

Counts per document are checkpointed, so texts are read once; failures are summed before the shuffle.

Defined cases: a null text has no words and fails; a null host is one host of its own; null ids stay null; repeated rows
count and come out once each; very long texts are counted whole; a host at the limit itself is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import cut

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window, the least words of a text, and the most percent of its words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20


def with_counts(docs: DataFrame, text: Column) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    # every step is a projection of its own: what a lambda uses must be a column, else it is computed anew for each element
    df = docs.withColumn("__t", F.coalesce(text.cast("string"), F.lit("")))
    df = df.withColumn("__w", F.split(F.btrim("__t", F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    df = df.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    df = df.withColumn("n_words", F.when(F.btrim("__t", F.lit(BLANKS)) == "", F.lit(0)).otherwise(F.size("__w")).cast("long"))
    last = F.col("n_words").cast("int") - WINDOW
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WINDOW)]))
    df = df.withColumn("__g", F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("__g")) < F.size("__g")
    paired = F.array_sort(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("__s", F.when(again, paired).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    twice = F.filter("__s", lambda x, k: (F.get("__s", k - 1)["g"] == x["g"]) | F.coalesce(F.get("__s", k + 1)["g"] == x["g"], F.lit(False)))
    df = df.withColumn("__p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    # windows at sorted places cover the least of 5 and the step from the place before
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
    covered = F.aggregate("__p", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at")))["n"]
    df = df.withColumn("__l", F.transform(F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.xxhash64(x)))
    return df.select(
        *docs.columns,
        "n_words",
        F.length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(counts: DataFrame, host: str, failed: str, limit: float) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_ok) of each host; host_rate is the shrunk one."""
    hosts = counts.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed"))
    n, f = F.col("host_docs"), F.col("host_failed")
    k, docs, fails, squares, spread = hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(f), F.sum((n * n).cast("double")), F.sum(f * f / n)).first()
    mean = fails / docs if docs else 0.0
    share = _likeness(k, docs or 0, mean, squares or 0.0, spread or 0.0)
    shrunk = (f * F.lit(share) + F.lit(mean * (1 - share))) / (n * F.lit(share) + F.lit(1 - share))
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= limit).alias("host_ok"))


def _likeness(k: int, docs: int, mean: float, squares: float, spread: float) -> float:
    """How alike documents of one host are, 1 / (a + b + 1), from 0 (hosts don't differ) to 1: by moments, hosts weighted by
    their documents. squares: sum of n * n, spread: sum of f * f / n. Hosts of one document each tell nothing of it, so it is 0."""
    noise, room = mean * (1 - mean), docs - squares / docs - (k - 1) if docs else 0.0
    if noise <= 0 or room <= 1e-9:
        return 0.0
    return min(1.0, max(0.0, ((spread - mean * mean * docs) / noise - (k - 1)) / room))


def judge(docs: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", text_key: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept) for each row.

    text_key adds host and text_key, the xxhash64 of the text, which tell rows of one id apart.
    """
    more = [F.xxhash64(F.col(text_col).cast("string")).alias("text_key")] * text_key
    rows = docs.select(F.col(id_col).alias("doc_id"), *more, F.col(host_col).cast("string").alias("__host"), F.col(text_col).alias("__text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counts = cut(with_counts(rows, F.col("__text")).drop("__text").withColumn("base_failed", failed))
    hosts = host_verdicts(counts, "__host", "base_failed", limit)
    judged = counts.join(hosts, F.col("__host").eqNullSafe(F.col("host")), "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept"),
        *["host", "text_key"] * text_key,
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, i - prev)) AS n FROM (SELECT doc_id, i, lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS bad FROM f GROUP BY source),
p AS (SELECT count(*) AS hosts, sum(n)::DOUBLE AS docs, sum(bad) / sum(n) AS mu, sum(n * n)::DOUBLE AS sq, sum(bad * bad / n) AS spread FROM h),
k AS (SELECT mu, CASE WHEN mu * (1 - mu) <= 0 OR docs - sq / docs - (hosts - 1) <= 1e-9 THEN 0 ELSE least(1, greatest(0, ((spread - mu * mu * docs) / (mu * (1 - mu)) - (hosts - 1)) / (docs - sq / docs - (hosts - 1)))) END AS s FROM p),
r AS (SELECT source, (bad * s + mu * (1 - s)) / (n * s + (1 - s)) AS host_rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) AS host_rate, NOT base_failed AND host_rate <= 0.5 AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
