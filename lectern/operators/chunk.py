"""Chunking strategies: one row for each chunk of a document.

All are Column expressions, so chunks never leave the JVM and need no shuffle. Strategies whose cuts depend on what came
before are folds over a document's pieces: the state is what is held and what is done. The recursive strategy is a fold
over steps that takes the leftmost open piece from a stack; as a recursive query every level would be a job over all
documents, and levels grow with the longest one. All yield the text meant for each chunk (never empty slices), fixed
windows end once the text does, and ids don't decide identity: chunks are keyed by document and index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V

# Where a text may be cut, in order of preference.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", "，", ", ", " "]
LIMIT, LEAST, SENTENCES = 256, 20, 5
#: Least tokens of a section that carries its tag, and where delimited text may be cut.
TAGGED, DELIMITERS = 8, "\n!?;。；！？"


def _none() -> Column:
    return F.array().cast("array<string>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with(done: Column, held: Column) -> Column:
    """done with what is held, unless that is empty."""
    return F.when(held == "", done).otherwise(F.concat(done, F.array(held)))


def _over(text: Column, n: Column, limit: int) -> Column:
    """Whether a text of n characters has more than `limit` tokens; a character is a quarter of one at least."""
    return (n >= 4 * (limit + 1)) | (T.token_count(text) > limit)


def recursive(c: Column, limit: int = LIMIT, least: int = LEAST) -> Column:
    """Pieces of at most `limit` tokens: cut at the first place of the first separator that leaves `least` before it, else in half."""
    piece = lambda s, n: F.struct(s.alias("s"), n.cast("int").alias("n"))

    def cut(p: Column, present: Column) -> Column:
        """Place (from 1) and width of the cut in p; place 0 if no separator will do."""
        enough = lambda at: (at - 1 >= 4 * least) | ((at > 1) & (T.token_count(F.substring(p["s"], F.lit(1), at - 1)) >= least))
        none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("w"))
        found = lambda at, s: F.when((at > 0) & enough(at), F.struct(at.alias("at"), F.length(s).alias("w"))).otherwise(none)
        return F.aggregate(present, none, lambda a, s: F.when(a["at"] > 0, a).otherwise(_let(F.position(s, p["s"]), lambda at: found(at, s))))

    def parts(p: Column, k: Column) -> Column:
        """The right and the left part of p, the left one on top of the stack."""
        before = F.when(k["at"] > 0, k["at"] - 1).otherwise(F.floor(p["n"] / 2).cast("int"))
        return _let(before, lambda n: F.array(piece(F.substring(p["s"], n + k["w"] + 1, p["n"]), p["n"] - n - k["w"]), piece(F.substring(p["s"], F.lit(1), n), n)))

    def run(text: Column) -> Column:
        present = F.filter(F.array(*map(F.lit, SEPARATORS)), lambda s: F.contains(text, s))

        def step(a: Column, present: Column) -> Column:
            rest = F.slice(a["todo"], 1, F.size(a["todo"]) - 1)
            taken = lambda p: F.when(_over(p["s"], p["n"], limit), F.struct(F.concat(rest, parts_of(p)).alias("todo"), a["done"].alias("done"))).otherwise(F.struct(rest.alias("todo"), F.concat(a["done"], F.array(p["s"])).alias("done")))
            parts_of = lambda p: _let(cut(p, present), lambda k: parts(p, k))
            return F.when(F.size(a["todo"]) == 0, a).otherwise(_let(F.element_at(a["todo"], -1), taken))

        def steps(n: Column, a: Column, present: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), n.cast("int")), a, lambda a, _: step(a, present))

        n = F.length(text)
        start = F.struct(F.array(piece(text, n)).alias("todo"), _none().alias("done"))
        # few texts need more steps than these; a left part has `least` tokens or more, and at most a cut by each separator, and by halves, leads down to it
        usual = n * F.lit(6.0 / limit) + 9
        most = (2 * (n / max(1.0, 1.5 * min(least, limit / 2)) + 1) * (len(SEPARATORS) + F.log2(n + 2))) + 9
        return _let(present, lambda present: _let(steps(usual, start, present), lambda a: F.when(F.size(a["todo"]) == 0, a).otherwise(steps(most, a, present))["done"]))

    return F.when(F.coalesce(c, F.lit("")) == "", _none()).otherwise(_let(c, run))


def semantic(c: Column, threshold: float = 0.7, least: int = LEAST) -> Column:
    """Sentences joined until a neighbour shares too few words with the one before and the chunk holds `least` tokens; see `semantic_chunks` for vectors."""
    said = F.filter(F.transform(T.sentences(F.coalesce(c, F.lit(""))), T.strip), lambda s: s != "")
    words = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    marked = F.transform(said, lambda s: F.struct(s.alias("s"), words(s).alias("w")))
    near = lambda m: F.transform(m, lambda x, i: F.struct(x["s"].alias("s"), F.when(i == 0, 1.0).otherwise(V.jaccard(F.get(m, i - 1)["w"], x["w"])).alias("near")))
    return _let(marked, lambda m: fold_sentences(near(m), threshold, least))


def fold_sentences(sentences: Column, threshold: float, least: int) -> Column:
    """Chunks of an array of (s, near): sentences in order, each with its likeness to the one before."""
    start = F.struct(_none().alias("done"), F.lit("").alias("held"))

    def step(a: Column, x: Column) -> Column:
        fresh = (x["near"] < threshold) & (a["held"] != "") & (T.token_count(a["held"]) >= least)
        return F.when(fresh, F.struct(_with(a["done"], a["held"]).alias("done"), x["s"].alias("held"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["held"], x["s"]).alias("held")))

    return F.aggregate(sentences, start, step, lambda a: _with(a["done"], a["held"]))


def paragraph(c: Column, limit: int = LIMIT, least: int = LEAST) -> Column:
    """Paragraphs packed up to `limit` tokens; a longer one is cut recursively."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n[\s\p{Z}\x{85}\x{1c}-\x{1f}]*\n", -1), T.strip), lambda p: p != "")
    start = F.struct(_none().alias("done"), F.lit("").alias("held"))
    state = lambda done, held: F.struct(done.alias("done"), held.alias("held"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["held"] == "", p).otherwise(F.concat_ws("\n", a["held"], p))
        packed = _let(joined, lambda j: F.when(_over(j, F.length(j), limit), state(_with(a["done"], a["held"]), p)).otherwise(state(a["done"], j)))
        return F.when(_over(p, F.length(p), limit), state(F.concat(_with(a["done"], a["held"]), recursive(p, limit, least)), F.lit(""))).otherwise(packed)

    return F.aggregate(paragraphs, start, step, lambda a: _with(a["done"], a["held"]))


def merge(sections: Column, limit: int = 128) -> Column:
    """Chunks (text, image) of an array of sections (text, tag, image).

    Sections are appended until a chunk exceeds `limit` tokens, so it may overshoot. A section of TAGGED tokens or more carries its
    tag unless the chunk has it already; a chunk keeps the image of the section that opened it. Empty chunks go.
    """
    made = lambda text, image: F.struct(text.alias("text"), image.alias("image"))
    image = F.get(sections, F.lit(0))["image"]
    none = F.slice(F.array(made(F.lit(""), image)), 1, 0)
    start = F.struct(none.alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"), F.when(F.lit(False), image).alias("image"))

    def step(a: Column, x: Column) -> Column:
        text = F.coalesce(x["text"], F.lit(""))

        def put(n: Column) -> Column:
            tag = F.when(n >= TAGGED, F.coalesce(x["tag"], F.lit(""))).otherwise(F.lit(""))
            tagged = lambda host: F.concat(text, F.when(F.contains(host, tag), F.lit("")).otherwise(tag))
            fresh = F.struct(F.concat(a["done"], F.array(made(a["held"], a["image"]))).alias("done"), tagged(text).alias("held"), n.alias("n"), x["image"].alias("image"))
            more = F.struct(a["done"].alias("done"), F.concat(a["held"], tagged(a["held"])).alias("held"), (a["n"] + n).alias("n"), a["image"].alias("image"))
            return F.when(a["n"] > limit, fresh).otherwise(more)

        return _let(T.token_count(text), put)

    chunks = F.aggregate(sections, start, step, lambda a: F.concat(a["done"], F.array(made(a["held"], a["image"]))))
    return F.filter(chunks, lambda x: x["text"] != "")


def merge_sections(sections: DataFrame, limit: int = 128, id_col: str = "doc_id", order_col: str = "section_no", text_col: str = "text", tag_col: str | None = None, image_col: str | None = None) -> DataFrame:
    """(id, chunk_index, content, image): a document's sections, one row each, merged in their order; see `merge`."""
    tag = F.col(tag_col).cast("string") if tag_col else F.lit("")
    image = F.col(image_col) if image_col else F.lit("").cast("string")
    rows = sections.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("text"), tag.alias("tag"), image.alias("image")))).alias("__s"))
    return rows.select(id_col, F.posexplode_outer(merge(F.col("__s"), limit)).alias("chunk_index", "__c")).where("__c is not null").select(id_col, "chunk_index", F.col("__c.text").alias("content"), F.col("__c.image").alias("image"))


def naive(c: Column, limit: int = 128) -> Column:
    """Lines merged as sections without tags."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: F.struct(x.alias("text"), F.lit("").alias("tag"), F.lit("").alias("image")))
    return F.transform(merge(lines, limit), lambda x: x["text"])


def delimited(c: Column, limit: int = 128, delimiters: str = DELIMITERS) -> Column:
    """Cut behind no delimiter but keep them, packed to at most `limit` half-characters where that can be."""
    marks = "".join(f"\\x{{{ord(d):x}}}" for d in delimiters)
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"[^{marks}]+|[{marks}]"), F.lit(0))
    start = F.struct(_none().alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        half = F.floor(F.length(x) / 2).cast("int")
        fresh = F.struct(_with(a["done"], a["held"]).alias("done"), x.alias("held"), half.alias("n"))
        return F.when((a["n"] + half > limit) & (a["held"] != ""), fresh).otherwise(F.struct(a["done"].alias("done"), F.concat(a["held"], x).alias("held"), (a["n"] + half).alias("n")))

    return F.aggregate(parts, start, step, lambda a: _with(a["done"], a["held"]))


def fixed(c: Column, limit: int = 128, overlap: int = 20) -> Column:
    """Windows of limit * 4 characters that step back overlap * 4; the last ends with the text."""
    wide, step = limit * 4, (limit - overlap) * 4
    n = F.coalesce(F.length(c), F.lit(0))
    last = F.greatest(F.lit(0), F.ceil((n - wide) / step).cast("int"))
    starts = F.sequence(F.lit(0), last)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(c, i * step + 1, F.lit(wide))))


def sentence(c: Column, per_chunk: int = SENTENCES) -> Column:
    """Groups of sentences, joined without a separator."""
    s = T.sentences(c)
    groups = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / per_chunk).cast("int"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(groups, lambda g: F.array_join(F.slice(s, g * per_chunk + 1, F.lit(per_chunk)), "")))


#: Chunkers by name; an unknown name is the recursive one.
STRATEGIES: dict[str, Callable[..., Column]] = {"recursive": recursive, "fixed": fixed, "semantic": semantic, "sentence": sentence, "paragraph": paragraph, "naive": naive, "delimited": delimited}


def register(name: str, builder: Callable[..., Column]) -> None:
    """Adds a chunker: a function of a text column (and options) to an array of chunks."""
    STRATEGIES[name] = builder


def chunk(docs: DataFrame, strategy: str = "recursive", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, chunk_index, chunk_id, content, token_count): chunks that aren't blank; indices keep their gaps."""
    pieces = STRATEGIES.get(strategy, recursive)(F.col(text_col), **options)
    return _rows(docs.select(id_col, pieces.alias("__pieces")), id_col)


def _rows(pieces: DataFrame, id_col: str) -> DataFrame:
    """Arrays of chunks as rows with their ids and sizes."""
    # posexplode_outer: for posexplode Spark would first filter by the size of the array, and cut every text once more for that
    rows = pieces.select(id_col, F.posexplode_outer("__pieces").alias("chunk_index", "content"))
    rows = rows.where(T.strip(F.col("content")) != "")
    return rows.select(id_col, "chunk_index", T.chunk_id(F.col("chunk_index"), F.col("content")).alias("chunk_id"), "content", T.token_count(F.col("content")).alias("token_count"))


def semantic_chunks(docs: DataFrame, make: Callable[[], object], threshold: float = 0.7, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The semantic strategy by vectors: the columns of `chunk`.

    Sentences become rows, each different one is embedded once by the provider that `make` gives, and a sentence's likeness is its
    cosine with the one before; one without a vector (the provider failed) is unlike. Rows that repeat an id are documents of their own.
    """
    from lectern.operators import embed

    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    said = F.filter(F.transform(T.sentences(F.col("__t")), T.strip), lambda s: s != "")
    sentences = rows.select(id_col, "__row", F.posexplode_outer(said).alias("__i", "s")).where("s is not null")
    made = embed.vectorise(sentences, make, "s", "__v")
    before = Window.partitionBy("__row").orderBy("__i")
    made = made.withColumn("__u", F.lag("__v").over(before))
    # one root of both squares: rounded twice, a cosine that is the threshold itself would be less
    length = F.sqrt(V.dot(F.col("__u"), F.col("__u")) * V.dot(F.col("__v"), F.col("__v")))
    near = F.when(F.col("__i") == 0, 1.0).otherwise(F.coalesce(V.cosine(F.col("__u"), F.col("__v"), length, F.lit(1.0)), F.lit(0.0)))
    told = made.withColumn("near", near).groupBy("__row", id_col).agg(F.array_sort(F.collect_list(F.struct("__i", "s", "near"))).alias("__s"))
    pieces = told.select(id_col, fold_sentences(F.transform("__s", lambda x: F.struct(x["s"].alias("s"), x["near"].alias("near"))), threshold, least).alias("__pieces"))
    return _rows(pieces, id_col)


def process(docs: DataFrame, strategy: str = "recursive", clean: bool = True, drop_noise: bool = True, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Cleaned texts in chunks, those that are noise dropped."""
    if clean:
        docs = docs.withColumn(text_col, T.clean_text(F.col(text_col)))
    out = chunk(docs, strategy, id_col, text_col, **options)
    return out.where(~T.is_noise(F.col("content"))) if drop_noise else out


def statistics(chunks: DataFrame, *by: str) -> DataFrame:
    """Count, average, least, most and sum of token_count; zeros for no chunks."""
    t = F.col("token_count")
    agg = [F.count(F.lit(1)).alias("total_chunks"), F.avg(t).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.sum(t).alias("total_tokens")]
    return (chunks.groupBy(*by) if by else chunks).agg(*agg).fillna(0, ["avg_tokens", "min_tokens", "max_tokens", "total_tokens"])
