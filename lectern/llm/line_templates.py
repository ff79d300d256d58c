"""Line dedup by a log-template tree: recurring line templates across documents are dropped.

A line descends a tree of fixed depth: its token count, then its LEADING first tokens; tokens with digits,
addresses or links stand as a variable field (in lines where they are the lesser part). At the leaf its
template is the whole line with those fields masked. Besides, the tokens behind the leading ones are cut
into RUNS equal runs, and each run in turn may be variable as a whole, so that lines of any length that differ
in one name or word share a template; a template must keep FIXED tokens at least, so lines of up to four
tokens recur only as they are. A text of a single line has no variable runs: there they would make it a near
copy of the document, which is left to near-duplicate removal. Paths and templates are hashes of 96 bits made by
DataFrame expressions outside of lambdas, so they are compiled.

A template that occurs in at least `min_docs` different texts is recurring; one of a whole line of more than
PASSAGE tokens, a passage, in at least `passage_docs`. Its lines are dropped from all texts or, with
`keep_first`, from all but the text whose document has the smallest id; so then nothing vanishes from the
corpus altogether. Exact copies of a document are one text here: a whole-document copy is no boilerplate, and
is left to near-duplicate removal.

Scale: up to 1 + RUNS rows for each line, hashes only. Templates of at least two texts are found by least and
greatest text key, which is summed before the shuffle; only their rows are counted further. The joins with a
hot template and of copies with a hot text are skewed joins of plain shuffles that Spark splits; texts are
shuffled once.

Defined cases: a null text stays null; lines without tokens, or of fewer than `min_tokens`, are never dropped;
texts without dropped lines stay as they are to the byte; rows that repeat and null ids are treated by their
text (a null id is smallest); all other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import cut

BLANKS = " \t\n\x0b\f\r"
#: Leading tokens on the path, runs of the others that may vary, and the tokens that a template keeps at least.
LEADING, RUNS, FIXED = 2, 4, 4
FIELD = "<*>"
#: Tokens that are variable fields by themselves: with a digit or @, or with ://.
VARIABLE = r"(?<![^ ])(?:[^ 0-9@]*+[0-9@]|[^ :]*+:(?=//))[^ ]*+"
#: Lines of more tokens are passages, which are no chance in two texts.
PASSAGE = 50


def _has(c: str, *parts: str) -> Column:
    """Whether a column holds one of some strings; faster than a pattern."""
    out = F.col(c).contains(parts[0])
    for p in parts[1:]:
        out = out | F.col(c).contains(p)
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line of docs (several, text, ...): its place and `m`, its tokens with fields masked; an empty line has one empty token.

    What is used twice is a column of a projection of its own, and no filter stands behind, else Spark computes it twice.
    """
    others = [c for c in docs.columns if c != "__text"]
    blanks = F.when(_has("__text", *"\t\x0b\f\r"), F.translate("__text", "\t\x0b\f\r", "    ")).otherwise(F.col("__text"))
    df = docs.select(*others, F.posexplode(F.split(blanks, "\n", -1)).alias("__at", "__s"))
    df = df.select(*others, "__at", F.btrim(F.when(_has("__s", "  "), F.regexp_replace("__s", " +", " ")).otherwise(F.col("__s")), F.lit(" ")).alias("__s"))
    df = df.withColumn("__m", F.when(F.col("__s").rlike("[0-9@:]"), F.regexp_replace("__s", VARIABLE, FIELD)))
    # fields stand masked unless they are most of the line
    spaces = F.length("__s") - F.length(F.replace(F.col("__s"), F.lit(" "), F.lit("")))
    fields = (F.length("__m") - F.length(F.replace(F.col("__m"), F.lit(FIELD), F.lit("")))) / len(FIELD)
    return df.select(*others, "__at", F.split(F.when(2 * fields <= spaces + 1, F.col("__m")).otherwise(F.col("__s")), " ").alias("__m"))


def with_templates(docs: DataFrame, min_tokens: int) -> DataFrame:
    """A row (..., __at, __t, __u) for each template of each line of docs (__several, __text, ...); the lowest bit of __t tells passages."""
    others = [c for c in docs.columns if c not in ("__several", "__text")]
    df = _lines(docs)
    df = df.select(*others, "__several", "__at", "__m", F.when(F.get("__m", 0) == "", 0).otherwise(F.size("__m")).alias("__n"))
    n = F.col("__n")
    bounds = [F.lit(LEADING) + F.floor(F.greatest(n - LEADING, F.lit(0)) * k / RUNS).cast("int") for k in range(RUNS + 1)]
    parts = [F.slice("__m", 1, LEADING), *[F.slice("__m", a + 1, b - a) for a, b in zip(bounds, bounds[1:])]]
    sizes = [b - a for a, b in zip(bounds, bounds[1:])]
    df = df.select(*others, "__several", "__at", "__n", *[F.xxhash64(p).alias(f"h{k}") for k, p in enumerate(parts)], *[F.hash(p).alias(f"g{k}") for k, p in enumerate(parts)], *[x.alias(f"s{k + 1}") for k, x in enumerate(sizes)])

    def template(free: int | None) -> Column:
        names = lambda c: [F.lit(f"run {free}") if free == k else F.col(f"{c}{k}") for k in range(RUNS + 1)]
        passage = F.lit(0) if free else F.when(n > PASSAGE, 1).otherwise(0)
        both = F.struct((F.xxhash64(n, *names("h")).bitwiseAND(F.lit(-2)) + passage).alias("t"), F.hash(n, *names("g")).alias("u"))
        size = F.col(f"s{free}")
        return F.when((n >= max(1, min_tokens)) & (F.col("__several") & (size > 0) & (n - size >= FIXED) if free else F.lit(True)), both)

    df = df.select(*others, "__at", F.explode(F.array(*map(template, [None, *range(1, RUNS + 1)]))).alias("x")).where("x is not null")
    return df.select(*others, "__at", F.col("x.t").alias("__t"), F.col("x.u").alias("__u"))


def drop_recurring(docs: DataFrame, min_docs: int = 3, passage_docs: int = 2, min_tokens: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with recurring lines dropped from the text, and n_dropped, the number of them."""
    text = F.col(text_col).cast("string")
    key = [F.when(text.isNotNull(), F.xxhash64(text)).alias("__k1"), F.when(text.isNotNull(), F.hash(F.lit(1), text)).alias("__k2")]  # 96 bits for a text
    several = F.locate("\n", F.btrim(text, F.lit(BLANKS))) > 0
    own = ["__k1", "__k2", *["__id"] * keep_first]
    slim = docs.where(text.isNotNull()).select(*key, *[F.col(id_col).alias("__id")] * keep_first, several.alias("__several"), text.alias("__text"))
    rows = with_templates(slim, min_tokens)
    template = ["__t", "__u"]
    twice = rows.groupBy(*template).agg(F.min("__k1").alias("__low"), F.max("__k1").alias("__high")).where("__low < __high").select(*template)
    seen = cut(rows.join(cut(twice), template).select(*template, *own, "__at"))
    homes = seen.groupBy(*template, "__k1", "__k2").agg(F.min("__id").alias("__id")) if keep_first else seen.select(*template, "__k1", "__k2").distinct()
    first = [F.min(F.struct("__id", "__k1", "__k2")).alias("__first")] * keep_first
    least = F.when(F.col("__t").bitwiseAND(F.lit(1)) == 1, passage_docs).otherwise(min_docs)
    often = cut(homes.groupBy(*template).agg(F.count(F.lit(1)).alias("__n"), *first).where(F.col("__n") >= least).drop("__n"))
    dropped = seen.join(often, template)
    if keep_first:
        dropped = dropped.where("__k1 <> __first.__k1 or __k2 <> __first.__k2")
    dropped = dropped.groupBy(F.col("__k1").alias("__j1"), F.col("__k2").alias("__j2")).agg(F.collect_set("__at").alias("__drop"))  # at most a text's lines

    keyed = docs.select("*", *key).join(cut(dropped), F.expr("__k1 = __j1 and __k2 = __j2"), "left")
    changed = F.col("__drop").isNotNull()
    lines = F.when(changed, F.split(text, "\n", -1)).alias("__lines")
    keyed = keyed.select(*docs.columns, "__drop", lines)
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")  # in order
    kept = F.when(changed, F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    out = {c: F.col(c) for c in docs.columns} | {text_col: F.coalesce(kept, F.col(text_col)).alias(text_col)}
    return keyed.select(*out.values(), F.coalesce(F.when(changed, F.size("__drop")), F.lit(0)).cast("long").alias("n_dropped"))
