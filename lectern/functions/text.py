"""Text functions as Column expressions.

All but NFKC stay in the JVM. Patterns name Unicode classes explicitly ([\\p{L}\\p{N}_] for a word
character), so that Java and RE2 agree. Lengths are in code points.

Parity with the default cleaner: characters outside the kept set are deleted, among them the
ideographic full stop, the enumeration comma and the percent sign; `keep` adds characters to the set.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CJK = r"[\x{4e00}-\x{9fff}]"
# Patterns of the cleaning rules.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
URL = r"https?://(?:[-\p{L}\p{N}_.]|(?:%[\da-fA-F]{2}))+[^\s]*|www\.[-\p{L}\p{N}_.]+[^\s]*"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
SPECIAL_KEPT = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\p{L}\p{N}_\s.,!?;:'\"()\[\]{}<>/\\|\-=+*&^$#@~`"
NOISE_LINES = [
    r"^\s*\d+\s*$",
    r"^\s*第\s*\d+\s*页\s*$",
    r"^\s*Page\s+\d+\s*$",
    r"^\s*\d+\s*/\s*\d+\s*$",
    r"(?i)^\s*Copyright\s+©?\s*\d{4}\s*$",
    r"(?i)^\s*All\s+Rights\s+Reserved\s*$",
    r"(?i)^\s*Confidential\s*$",
    r"(?i)^\s*Draft\s*$",
    r"^[-=_*]{10,}$",
    r"^[─━]{10,}$",
]
# Keywords that mark a line as noise.
NOISE_WORDS = ["请勿转载", "版权所有", "翻印必究", "confidential", "proprietary", "all rights reserved", "仅供内部使用", "内部资料", "注意保密", "www.", "http://", "https://", "第1页", "page 1", "图1", "Figure 1", "如表1", "见上图", "详见下文"]


def strip(c: Column) -> Column:
    """Without blanks at both ends (every Unicode blank, not just spaces)."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$", "")


def token_count(c: Column) -> Column:
    """Estimated tokens: 1.5 ideographs or 4 other characters each."""
    cjk = F.regexp_count(c, F.lit(CJK))
    return F.coalesce(F.floor(cjk / F.lit(1.5) + (F.length(c) - cjk) / F.lit(4.0)).cast("int"), F.lit(0))


def truncate(c: Column, n: int) -> Column:
    """At most n characters, an ellipsis standing for the rest."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def chunk_id(index: Column, content: Column) -> Column:
    """Identifier by position and the first 100 characters. It isn't unique across documents: keys are (doc_id, index)."""
    return F.concat(F.lit("chunk_"), index.cast("string"), F.lit("_"), F.substring(F.md5(F.concat(index.cast("string"), F.lit("_"), F.substring(content, 1, 100))), 1, 16))


def text_id(content: Column) -> Column:
    return F.concat(F.lit("vec_"), F.substring(F.md5(F.substring(content, 1, 100)), 1, 16))


@F.pandas_udf(StringType())
def xxh64_hex(values: pd.Series) -> pd.Series:
    """xxh64 with seed 0, in hex, of UTF-8 text (Spark's own xxhash64 has another seed and form)."""
    import xxhash

    return values.map(lambda x: None if x is None else xxhash.xxh64(x.encode()).hexdigest())


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).replace("　", " "))


def normalize_unicode(c: Column) -> Column:
    """NFKC, which also narrows full-width forms. Apply to a column that may hold more than ASCII."""
    return _nfkc(c)


def remove_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def normalize_whitespace(c: Column) -> Column:
    """Runs of spaces and tabs become one space; every line is stripped."""
    return F.array_join(F.transform(F.split(F.regexp_replace(c, "[ \t]+", " "), "\n", -1), strip), "\n")


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, "[URL]")


def mask_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "[EMAIL]")


def remove_special(c: Column, keep: str = "") -> Column:
    return F.regexp_replace(c, f"[^{SPECIAL_KEPT}{keep}]", "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER, "")


def is_noise_pattern(line: Column) -> Column:
    """Page numbers, rules, copyright and draft marks that fill a whole line."""
    out = F.lit(False)
    for p in NOISE_LINES:
        out = out | line.rlike(p)
    return out


def clean_lines(c: Column, min_length: int = 2, max_length: int | None = None) -> Column:
    """Stripped lines that are long enough and no noise."""
    lines = F.transform(F.split(c, "\n", -1), strip)
    lines = F.filter(lines, lambda x: F.length(x) >= max(1, min_length))
    if max_length:
        lines = F.transform(lines, lambda x: F.substring(x, 1, max_length))
    return F.array_join(F.filter(lines, lambda x: ~is_noise_pattern(x)), "\n")


def clean_text(c: Column, urls: bool = False, emails: bool = False, numbers: bool = False, special: bool = True, whitespace: bool = True, unicode: bool = True, keep: str = "", min_length: int = 2, max_length: int | None = None) -> Column:
    """The cleaning steps in their fixed order; null is empty."""
    c = F.coalesce(c, F.lit(""))
    c = normalize_unicode(c) if unicode else c
    c = remove_control(c)
    c = normalize_whitespace(c) if whitespace else c
    c = mask_urls(c) if urls else c
    c = mask_emails(c) if emails else c
    c = remove_special(c, keep) if special else c
    c = remove_numbers(c) if numbers else c
    return clean_lines(c, min_length, max_length)


def is_noise(line: Column, threshold: float = 0.3) -> Column:
    """Empty, all symbols, or with more noise keywords than `threshold` for each 20 characters."""
    low = F.lower(line)
    hits = sum((F.when(F.instr(low, w.lower()) > 0, 1).otherwise(0) for w in NOISE_WORDS), F.lit(0))
    return F.coalesce(line == "", F.lit(True)) | (hits / F.greatest(F.length(line) / F.lit(20.0), F.lit(1.0)) > threshold) | line.rlike(r"^[^\p{L}\p{N}]+$")


def drop_noise_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~is_noise(x)), "\n")


#: Ideograph runs of two and more, words of two and more letters, digit runs.
TOKENS = [r"[\x{4e00}-\x{9fff}]{2,}", "[A-Za-z]{2,}", "[0-9]+"]


def tokens(c: Column) -> Column:
    """Distinct terms: ideograph runs of two and more, lower-cased words of two and more letters, digit runs.

    Words are lower-cased once found, as other letters (the Kelvin sign) have lower cases in a-z. A filter by the result, or a lambda that
    uses it, computes it anew: see `has_tokens`.
    """
    han, words, digits = (F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in TOKENS)
    return F.array_distinct(F.concat(han, F.transform(words, F.lower), digits))


def has_tokens(c: Column) -> Column:
    """Whether `tokens` has any; found at the first."""
    return c.rlike(r"[\x{4e00}-\x{9fff}]{2}|[A-Za-z]{2}|[0-9]")


def sentences(c: Column) -> Column:
    """Cut at blanks that follow an end mark."""
    return F.split(F.regexp_replace(c, r"([。！？.!?])\s+", "$1\u0001"), "\u0001", -1)


# Inline marks of Markdown, of which the text inside stays.
INLINE = [r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*", r"_([^_]+)_", r"`([^`]+)`", r"\[([^\]]+)\]\([^)]+\)"]


def clean_markdown(c: Column) -> Column:
    """Text without bold, italic, code, link and tag marks."""
    c = F.regexp_replace(c, r"^#+\s*", "")
    for pattern in INLINE:
        c = F.regexp_replace(c, pattern, "$1")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_cell(c: Column) -> Column:
    """A table cell: as clean_markdown, also without formulas and marks, at most 2000 characters."""
    for pattern in INLINE:
        c = F.regexp_replace(c, pattern, "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\$[^$]+\$", "")
    c = strip(F.regexp_replace(F.translate(c, "\\*_", ""), r"\s+", " "))
    return F.when(F.length(c) > 2000, F.concat(F.substring(c, 1, 2000), F.lit("..."))).otherwise(c)


def clean_table(c: Column) -> Column:
    """Cells of an array of rows: null becomes empty, blanks collapse."""
    return F.transform(c, lambda row: F.transform(row, lambda x: strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))))


def table_markdown(c: Column) -> Column:
    """Markdown of an array of rows; empty under two rows."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(F.get(c, 0))), " | "), F.lit(" |"))
    body = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), row)
    return F.when(F.size(c) < 2, F.lit("")).otherwise(F.array_join(F.concat(F.array(row(F.get(c, 0)), rule), body), "\n"))


def parse_pipe_table(lines: Column) -> Column:
    """Rows of cells from an array of pipe-table lines: the rule in the second line and empty rows go, rows are padded."""
    cells = F.transform(lines, lambda x: F.transform(F.split(strip(x), r"\|", -1), strip))
    inner = F.transform(cells, lambda r: F.slice(r, 2, F.greatest(F.size(r) - 2, F.lit(0))))
    is_rule = lambda r: F.forall(r, lambda x: (x != "") & x.rlike("^[-: ]*$"))
    kept = F.filter(inner, lambda r, i: ~((i == 1) & is_rule(r)) & F.exists(r, lambda x: x != ""))
    cleaned = F.transform(kept, lambda r: F.transform(r, clean_cell))
    width = F.coalesce(F.array_max(F.transform(kept, lambda r: F.size(r))), F.lit(0))
    padded = F.transform(cleaned, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    return F.when(F.size(lines) < 2, F.array().cast("array<array<string>>")).otherwise(padded)


def parse_html_table(html: Column) -> Column:
    """Rows of cells of the tr, td and th elements; rows without text go."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))
    clean = F.transform(cells, lambda r: F.transform(r, lambda x: clean_cell(strip(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), r"\s+", " ")))))
    return F.filter(clean, lambda r: F.exists(r, lambda x: x != ""))


def row_fields(header: Column, row: Column) -> Column:
    """`name：value` of the cells that aren't null, empty, 0 or false, joined by semicolons."""
    pairs = F.transform(row, lambda x, i: F.when(F.coalesce(x, F.lit("")).isin("", "0", "0.0", "False", "false"), F.lit(None)).otherwise(F.concat(F.when(F.coalesce(F.get(header, i), F.lit("")) != "", F.concat(F.get(header, i), F.lit("："))).otherwise(F.lit("")), x)))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "; ")
