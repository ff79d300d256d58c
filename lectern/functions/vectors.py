"""Vector and set similarities as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null where a norm is 0 or the lengths differ. Norms may be given if already known."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def token_similarity(query: Column, terms: Column) -> Column:
    """Share of the query's term occurrences that the document holds."""
    # terms is bound by a lambda of its own: an expression inside of the filter would be computed anew for each term of the query
    found = F.get(F.transform(F.array(terms), lambda held: F.size(F.filter(query, lambda t: F.array_contains(held, t)))), F.lit(0))
    return (found + F.lit(1e-9)) / (F.size(query) + F.lit(1e-9))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
