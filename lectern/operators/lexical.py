"""Lexical retrieval: postings, BM25 in three variants, synonym expansion, score normalisation.

Terms are distinct in a document, so a term's frequency is 1 and a document's length is its number of
terms. `bm25` scores a corpus that isn't indexed: it reads the texts for the query's terms, for the corpus's size and for the
scores; `inverted.InvertedIndex` tokenises once and serves many questions. Variants plus and l give every document a constant part for
each query term that the corpus holds, so lengths are scored for all documents, postings added.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import clamp
from lectern.operators.relational import touching

K1, B = 1.5, 0.75
DELTA = {"plus": 1.0, "l": 0.5}


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length, term, head): one row for each distinct term of a document, head on its first; documents without terms go."""
    terms = docs.select(F.col(id_col), T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    # posexplode_outer: for posexplode Spark would first filter by the size of the array, and tokenise every text once more for that
    rows = terms.select(id_col, F.size("terms").alias("length"), F.posexplode_outer("terms").alias("__p", "term")).where("term is not null")
    return rows.select(id_col, "length", "term", (F.col("__p") == 0).alias("head"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length) of the documents that have terms."""
    return docs.where(T.has_tokens(F.col(text_col))).select(F.col(id_col), F.size(T.tokens(F.col(text_col))).alias("length"))


def doc_freq(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _tokens(text: str) -> list[str]:
    kept = re.sub(r"[^一-鿿A-Za-z0-9\s]", " ", text)
    return re.findall(r"[一-鿿]{2,}", kept) + re.findall(r"[a-z]{2,}", kept.lower()) + re.findall(r"[0-9]+", kept)


def parse_or_query(query: str) -> list[str]:
    """Sorted distinct terms: those of each (a OR b) group as they stand, and the tokens of the rest."""
    found: set[str] = set()
    for group in re.findall(r"\(([^()]+)\)", query or ""):
        found.update(t.strip() for t in group.split(" OR "))
        query = query.replace(f"({group})", "")
    return sorted(found | set(_tokens(query or "")))


def expand_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(term, expanded): each term with the synonyms of entries that equal or contain it, or lie in it.

    An entry whose synonym matches so adds its word too. Terms meet names by shared grams, so a dictionary may be of any size.
    """
    entries = synonyms.select("word", "synonyms", F.md5(F.to_json(F.struct("word", "synonyms"))).alias("__entry"))
    names = entries.select("__entry", F.explode(F.concat(F.array(F.struct(F.col("word").alias("name"), F.lit(False).alias("by"))), F.transform("synonyms", lambda s: F.struct(s.alias("name"), F.lit(True).alias("by"))))).alias("n")).select("__entry", "n.name", "n.by")
    pairs = touching(terms.select("term"), names, "term", "name")
    hit = pairs.join(names, "name").groupBy("term", "__entry").agg(F.max("by").alias("by")).join(entries, "__entry")
    added = F.when(F.col("by"), F.concat(F.array("word"), F.col("synonyms"))).otherwise(F.col("synonyms"))
    more = hit.select("term", F.explode(added).alias("expanded"))
    return terms.select("term", F.col("term").alias("expanded")).unionByName(more).distinct()


def _idf(variant: str, n: int, df: int) -> float:
    if variant == "okapi":
        return math.log(n - df + 0.5) - math.log(df + 0.5)
    return math.log((n + 1) / df) if variant == "plus" else math.log(n + 1) - math.log(df + 0.5)


def bm25(posts: DataFrame, terms: list[str] | DataFrame, variant: str = "okapi", combine: str = "sum", k1: float = K1, b: float = B, delta: float | None = None, id_col: str = "doc_id", terms_freq: DataFrame | None = None) -> DataFrame:
    """(id, score) of documents with score > 0.

    posts: result of `postings`. terms: list of terms, or rows (term, weight). combine: `sum` or `max`
    over a document's terms. terms_freq: result of `doc_freq` where it is kept, else worked out if a term is in most documents.
    """
    if variant not in ("okapi", "plus", "l"):
        raise ValueError(f"unknown BM25 variant {variant!r}")
    spark = posts.sparkSession
    query = terms if isinstance(terms, DataFrame) else spark.createDataFrame([(t, 1.0) for t in sorted(set(terms))], "term string, weight double")
    delta = DELTA.get(variant, 0.0) if delta is None else delta
    # the query's terms filter postings before anything is grouped; size and number of documents are one row
    asked = posts.join(F.broadcast(query.select("term", "weight")), "term")  # a query's terms are few
    found = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("weight")).collect()
    docs = posts.where("head").select(id_col, "length")
    if not found:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    n, size = docs.agg(F.count(F.lit(1)), F.sum("length")).first()
    average = size / n
    idfs = [(r["term"], _idf(variant, n, r["df"]), r["weight"]) for r in found]
    if variant == "okapi" and min(x for _, x, _ in idfs) < 0:  # only then the mean over all terms counts
        spread = (terms_freq if terms_freq is not None else doc_freq(posts)).groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
        value = F.ln(F.lit(n + 0.5) - F.col("df")) - F.ln(F.col("df") + 0.5)
        mean = spread.agg(F.sum(value * F.col("terms")) / F.sum("terms")).first()[0]
        idfs = [(t, 0.25 * mean if idf < 0 else idf, w) for t, idf, w in idfs]
    idfs = [(t, idf * w) for t, idf, w in idfs]
    known = spark.createDataFrame(idfs, "term string, idf double")
    ratio = F.lit(1 - b) + F.lit(b) * F.col("length") / F.lit(float(average))

    def part(tf: float) -> Column:
        if variant == "l":
            c = F.lit(tf) / ratio
            return (k1 + 1) * (c + delta) / (k1 + c + delta)
        saturated = F.lit(tf) * (k1 + 1) / (k1 * ratio + tf)
        return saturated + delta if variant == "plus" else saturated

    hits = posts.join(F.broadcast(known), "term")
    if variant == "okapi":
        scored = hits.select(id_col, (F.col("idf") * part(1.0)).alias("s"))
        how = F.sum("s") if combine == "sum" else F.max("s")
        return scored.groupBy(id_col).agg(how.alias("score")).where("score > 0")
    # what an absent term adds depends on the length at most, so present terms add only the difference
    all_idf, top_idf = sum(i for _, i in idfs), max(i for _, i in idfs)
    if combine == "sum":
        more = hits.groupBy(id_col).agg(F.sum("idf").alias("present"))
        scored = docs.join(more, id_col, "left").select(id_col, (F.lit(all_idf) * part(0.0) + F.coalesce("present", F.lit(0.0)) * (part(1.0) - part(0.0))).alias("score"))
    else:
        more = hits.groupBy(id_col).agg(F.max("idf").alias("present"))
        # the largest absent term bounds the rest; a present one counts for more than the same when absent
        scored = docs.join(more, id_col, "left").select(id_col, F.greatest(F.lit(top_idf) * part(0.0), F.coalesce("present", F.lit(0.0)) * part(1.0)).alias("score"))
    return scored.where("score > 0")


def normalize(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds keyword_score, 0.1 to 0.9 in proportion to the best score."""
    top = scores.agg(F.max(score).alias("__top"))
    return scores.join(F.broadcast(top)).withColumn("keyword_score", clamp(F.lit(0.1) + F.lit(0.8) * F.col(score) / F.col("__top"), 0.05, 0.95)).drop("__top")


def normalize_min_max(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds normalized, 0.1 to 0.9 between the least and the best positive score; 0.5 where all are equal."""
    ends = scores.where(F.col(score) > 0).agg(F.min(score).alias("__low"), F.max(score).alias("__top"))
    span = F.col("__top") - F.col("__low")
    return scores.join(F.broadcast(ends)).withColumn("normalized", F.when(span > 0, F.lit(0.1) + F.lit(0.8) * (F.col(score) - F.col("__low")) / span).otherwise(F.lit(0.5))).drop("__low", "__top")


def term_weights(original: list[str], expanded: list[str], synonym_weight: float = 0.8) -> dict[str, float]:
    """Weights of terms: original ones count in full, those that only expansion adds for less."""
    return dict.fromkeys(sorted(set(original)), 1.0) | dict.fromkeys(sorted(set(expanded) - set(original)), synonym_weight)


def weighted_terms(original: list[str], expanded: list[str], synonym_weight: float = 0.8, spark=None) -> DataFrame:
    """The same as rows (term, weight)."""
    return spark.createDataFrame(list(term_weights(original, expanded, synonym_weight).items()), "term string, weight double")


def search(posts: DataFrame, query: str, top_k: int = 5, variant: str = "okapi", id_col: str = "doc_id") -> DataFrame:
    """(id, score, keyword_score, rank): best documents for a query with OR groups; its best term decides."""
    found = normalize(bm25(posts, parse_or_query(query), variant, combine="max", id_col=id_col))
    from pyspark.sql import Window

    best = found.orderBy(F.desc("score"), id_col).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))
