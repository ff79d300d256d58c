"""Registered queries of the library and their DuckDB equivalents.

Each query runs over its whole tables. Doubles are rounded to six places in both engines, and every
order ends in a unique key. `documents` and `embeddings` have no common key; hybrid queries pair
doc_id with vec_id.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import ann, answer, chunk, embed, hybrid, inverted, lexical, parse, pipeline, prompt, questions, relational, rewrite, vector
from lectern.plans import oracles as O
from lectern.sources import files, store
from lectern.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = ["the", "tion", "les", "der", "que", "license", "zzz"]
QUESTION = "(the OR tion OR license) les der 2.0"
EXPANDED = [*TERMS, "and", "une"]


def query(sql: str | None = None):
    """Registers a function under its name, with its DuckDB query if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name):
    return F.round(c, 6).alias(name)


# --- text ------------------------------------------------------------------------------------------


@query(O.TOKEN_COUNT)
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query(O.CLEAN_LINES)
def clean_lines(spark, sf):
    clean = table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.length("clean").alias("n"), F.md5("clean").alias("digest"))


@query(O.NOISE_LINES)
def noise_lines(spark, sf):
    lines = F.split("text", "\n", -1)
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(lines, lambda x: T.is_noise(x))).alias("noise"), F.size(F.filter(lines, lambda x: T.is_noise_pattern(x))).alias("patterns"))


@query(O.masked(O.EMAIL, "[EMAIL]"))
def mask_email(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.mask_emails(F.col("text"))).alias("digest"))


@query(O.masked(O.URL, "[URL]", "pages", "page_id", "html"))
def mask_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.mask_urls(F.col("html"))).alias("digest"))


@query(O.masked(O.NUMBER, "", "part", "p_partkey", "p_type || ' ' || p_size || ' x' || p_size || ' ' || p_retailprice::DECIMAL(12,2)"))
def remove_numbers(spark, sf):
    c = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"), F.concat(F.lit("x"), F.col("p_size").cast("string")), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.md5(T.remove_numbers(c)).alias("digest"))


@query(O.SPECIAL_CHARS)
def special_chars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.remove_special(F.col("text"))).alias("digest"), F.md5(T.remove_special(F.col("text"), "%")).alias("kept_percent"))


@query(O.TRUNCATE)
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("short"))


@query(O.TEXT_IDS)
def text_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.text_id(F.col("text")).alias("text_id"), T.chunk_id(F.lit(0), F.col("text")).alias("chunk_id"))


@query()
def xxh64_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.xxh64_hex(F.col("text")).alias("xxh64"))


@query(O.MARKDOWN_INLINE)
def markdown_inline(spark, sf):
    rows = [(1, "# A **bold** _move_"), (2, "see [this](http://x) and `code`"), (3, "<b>tag</b>  two   blanks"), (4, "__x__ *y* plain")]
    return spark.createDataFrame(rows, "id int, s string").select("id", T.clean_markdown(F.col("s")).alias("clean"))


@query(O.TABLE_MARKDOWN)
def table_markdown(spark, sf):
    grids = F.array(F.array(F.lit("name"), F.lit("region")), F.array("n_name", F.col("n_regionkey").cast("string")))
    cleaned = T.clean_table(grids)
    return table(spark, sf, "nation").select("n_nationkey", T.table_markdown(cleaned).alias("markdown"))


@query(O.HTML_LINKS)
def html_table_cells(spark, sf):
    """Tables made of the pages' list items, parsed back."""
    items = F.regexp_extract_all("html", F.lit("<li><a[^>]*>([^<]*)</a></li>"), F.lit(1))
    made = F.concat(F.lit("<table><TR class=x><th>item</th></TR>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<tr><td> <i>"), x, F.lit("</i>  </td></tr>"))), "\n"), F.lit("</table>"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.flatten(T.parse_html_table(made)), "|").alias("cells"))


@query(O.PIPE_TABLE)
def pipe_table(spark, sf):
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    lines = F.array(line(F.lit("name"), F.lit("key")), F.lit("| --- | :--: |"), line(F.concat(F.lit("**"), F.col("n_name"), F.lit("**")), F.col("n_nationkey").cast("string")), F.lit("|  |  |"), F.lit("| lone |"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.transform(T.parse_pipe_table(lines), lambda r: F.array_join(r, ",")), ";").alias("grid"))


@query(O.ROW_FIELDS)
def row_fields(spark, sf):
    head = F.array(*[F.lit(x) for x in ("key", "acctbal", "")])
    row = F.array(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 > 0, F.lit("5")).otherwise(F.lit("0")), F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", T.row_fields(head, row).alias("line"))


# --- parsing and layout ----------------------------------------------------------------------------


def _blocks(spark, sf):
    rows = parse.simple_blocks(table(spark, sf, "documents"))
    return rows.withColumn("page_num", (F.floor(F.col("block_no") / 4) + 1).cast("int"))


@query(O.PARAGRAPHS)
def paragraph_islands(spark, sf):
    out = parse.connect_paragraphs(_blocks(spark, sf))
    return out.select("doc_id", "para_no", "page_num", "members", F.col("pages").cast("int").alias("pages"), F.md5("content").alias("digest"))


@query(O.PAGE_TEXT)
def page_text(spark, sf):
    return parse.page_text(_blocks(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


def _chars(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    x = ((F.col("doc_id") * 31 + F.col("i") * F.col("i") * 17) % 600).cast("double")
    y = ((F.col("i") * 7) % 23).cast("double")
    return docs.select("doc_id", F.lit(1).alias("page_num"), x.alias("x0"), (x + 5).alias("x1"), y.alias("y0"), F.col("i").cast("string").alias("text"), F.lit(600.0).alias("page_width"))


@query(O.LAYOUT_COLUMNS)
def layout_columns(spark, sf):
    return parse.column_intervals(_chars(spark, sf)).select("doc_id", "column_no", F.col("left").alias("x_left"), F.col("right").alias("x_right"))


@query(O.LAYOUT_LINES)
def layout_lines(spark, sf):
    chars = _chars(spark, sf)
    return parse.lines_of_chars(chars, parse.column_intervals(chars)).select("doc_id", "y0", "x0", "x1", "content", F.col("column").alias("column_no"))


@query(O.CROSS_PAGE_TABLES)
def cross_page_tables(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") % 7).alias("page_num"), F.lit(0).alias("pos"), F.array(F.array(F.concat(F.lit(" h"), (F.col("n_nationkey") % 2).cast("string"))), F.array("n_name")).alias("data"))
    rows = rows.groupBy("doc_id", "page_num", "pos").agg(F.min("data").alias("data"))
    out = parse.connect_tables(rows)
    return out.select("doc_id", "page_num", "pages", F.array_join(F.transform("data", lambda r: F.trim(F.get(r, 0))), ",").alias("cells"))


@query()
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", parse.html_text(F.col("html")).alias("text"))


@query()
def html_main(spark, sf):
    return table(spark, sf, "pages").select("page_id", parse.html_main(F.col("html")).alias("m")).select("page_id", "m.title", F.size("m.lines").alias("lines"), F.md5(F.array_join("m.lines", "\n")).alias("digest"))


@query(O.MARKDOWN_SECTIONS)
def markdown_sections(spark, sf):
    made = F.concat(F.lit("# head "), "doc_id", F.lit("\n"), F.regexp_replace("text", "[|#*_`<>\\[\\]]", ""), F.lit("\n\n| a | b |\n| - | - |\n| 1 | 2 |\n"))
    sections, _ = parse.markdown_sections(table(spark, sf, "documents").select("doc_id", made.alias("text")))
    return sections.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "\n")).alias("digest"))


@query(O.JSON_SECTIONS)
def json_sections(spark, sf):
    """Events as JSON with nested lists, their keys packed into objects of up to 50 characters."""
    made = F.concat(F.lit('{"id":'), "event_id", F.lit(', "props": '), "props", F.lit(',"tags" : ["'), "event_type", F.lit('", ['), "user_id", F.lit(', {"v": '), F.col("event_id") % 7, F.lit("}], []]}"))
    return table(spark, sf, "events").select("event_id", F.array_join(parse.json_sections(made, 25), ";").alias("sections"))


@query(O.PARSE_DOCUMENTS)
def parse_documents(spark, sf):
    out = pipeline.parse_documents(table(spark, sf, "documents"), connect=False)
    return out.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query(O.FILE_KINDS)
def file_kinds(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.kind(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.get(F.array(*map(F.lit, [".PDF", ".docx", ".xlsx", ".md", ""])), (F.col("page_id") % 5).cast("int")))).alias("kind"))


# --- chunking --------------------------------------------------------------------------------------


def _chunks(spark, sf, strategy, **options):
    out = chunk.chunk(table(spark, sf, "documents"), strategy, **options)
    return out.select("doc_id", "chunk_index", "chunk_id", "token_count", F.md5("content").alias("digest"))


@query(O.CHUNK_FIXED)
def chunk_fixed(spark, sf):
    return _chunks(spark, sf, "fixed")


@query(O.CHUNK_SENTENCE)
def chunk_sentence(spark, sf):
    return _chunks(spark, sf, "sentence")


@query(O.CHUNK_RECURSIVE)
def chunk_recursive(spark, sf):
    return _chunks(spark, sf, "recursive")


@query(O.CHUNK_SEMANTIC)
def chunk_semantic(spark, sf):
    return _chunks(spark, sf, "semantic")


@query(O.CHUNK_PARAGRAPH)
def chunk_paragraph(spark, sf):
    """Every line a paragraph of its own."""
    docs = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n \n"))
    return chunk.chunk(docs, "paragraph").select("doc_id", "chunk_index", "chunk_id", "token_count", F.md5("content").alias("digest"))


@query(O.CHUNK_SEMANTIC_VECTORS)
def chunk_semantic_vectors(spark, sf):
    """Semantic chunks by a provider's vectors: counts of five letters."""
    out = chunk.semantic_chunks(table(spark, sf, "documents"), lambda: embed.LetterCounts("aeiou"), 0.95)
    return out.select("doc_id", "chunk_index", "chunk_id", "token_count", F.md5("content").alias("digest"))


@query(O.CHUNK_SECTIONS)
def chunk_sections(spark, sf):
    """Turns of conversations merged as sections, tagged by role."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_no"), "text", F.concat(F.lit("@"), "role").alias("tag"))
    return chunk.merge_sections(turns, tag_col="tag").select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(O.CHUNK_NAIVE)
def chunk_naive_merge(spark, sf):
    return _chunks(spark, sf, "naive")


@query(O.CHUNK_DELIMITED)
def chunk_delimited(spark, sf):
    return _chunks(spark, sf, "delimited")


@query(O.CHUNK_PROCESS)
def chunk_process(spark, sf):
    return chunk.process(table(spark, sf, "documents"))


@query(O.CHUNK_STATS)
def chunk_stats_by_lang(spark, sf):
    docs = table(spark, sf, "documents")
    rows = chunk.chunk(docs, "fixed").join(docs.select("doc_id", "lang"), "doc_id")
    return chunk.statistics(rows, "lang").withColumn("avg_tokens", F.round("avg_tokens", 6))


# --- lexical ---------------------------------------------------------------------------------------


def _posts(spark, sf):
    return lexical.postings(table(spark, sf, "documents"))


_INDEXES: dict = {}


def _index(spark, sf):
    """The inverted index of documents, built once a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = inverted.InvertedIndex.build(table(spark, sf, "documents"), store.scratch(spark))
    return _INDEXES[key]


def _scores(df):
    return df.select("doc_id", r6(F.col("score"), "score"))


@query(O.TOKENIZE)
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query(O.DOC_FREQ)
def doc_freq(spark, sf):
    return _index(spark, sf).doc_freq()


@query(O.POSTINGS_LEN)
def postings_len(spark, sf):
    return lexical.lengths(table(spark, sf, "documents"))


@query(O.bm25("okapi", TERMS))
def bm25_okapi(spark, sf):
    return _scores(_index(spark, sf).bm25(TERMS))


@query(O.bm25("plus", TERMS))
def bm25_plus(spark, sf):
    return _scores(_index(spark, sf).bm25(TERMS, "plus"))


@query(O.bm25("l", TERMS))
def bm25_l(spark, sf):
    return _scores(_index(spark, sf).bm25(TERMS, "l"))


@query(O.bm25("okapi", ["the", "tion", "license", "les", "der", "2", "0"], combine="max"))
def bm25_or_max(spark, sf):
    return _scores(_index(spark, sf).bm25(lexical.parse_or_query(QUESTION), combine="max"))


@query(O.bm25("plus", ["the", "tion", "license", "les", "der", "2", "0"], combine="max"))
def bm25_plus_max(spark, sf):
    return _scores(_index(spark, sf).bm25(lexical.parse_or_query(QUESTION), "plus", combine="max"))


@query(O.bm25("okapi", TERMS, more=["and", "une"]))
def bm25_weighted_synonyms(spark, sf):
    return _scores(_index(spark, sf).bm25(lexical.term_weights(TERMS, EXPANDED)))


@query(O.bm25("okapi", TERMS))
def bm25_unindexed(spark, sf):
    """The same as bm25_okapi over texts that aren't indexed."""
    return _scores(lexical.bm25(_posts(spark, sf), TERMS))


@query(O.normalized("okapi", TERMS))
def bm25_normalized(spark, sf):
    found = lexical.normalize(_index(spark, sf).bm25(TERMS))
    return lexical.normalize_min_max(found).select("doc_id", r6(F.col("keyword_score"), "keyword_score"), r6(F.col("normalized"), "normalized"))


@query(O.top_bm25("okapi", ["the", "tion", "license", "les", "der", "2", "0"], 20))
def bm25_search(spark, sf):
    return _index(spark, sf).search(QUESTION, 20).select("doc_id", r6(F.col("score"), "score"), r6(F.col("keyword_score"), "keyword_score"))


SYNONYM_ROWS = [("part", ["piece", "item"]), ("small", ["tiny", "little"]), ("brass", ["metal", "copper"]), ("economy", ["standard"])]


@query(O.SYNONYM_EXPAND)
def synonym_expand(spark, sf):
    terms = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("term")).distinct()
    return lexical.expand_synonyms(terms, spark.createDataFrame(SYNONYM_ROWS, "word string, synonyms array<string>"))


@query("SELECT unnest(['0', '2', 'der', 'les', 'license', 'the', 'tion']) AS term")
def or_query_terms(spark, sf):
    return spark.createDataFrame([(t,) for t in lexical.parse_or_query(QUESTION)], "term string")


@query(O.REWRITES)
def query_rewrite(spark, sf):
    questions = [(1, "公司的主要业务是什么"), (2, "毛利率和营收增长"), (3, "plain words"), (4, "产品与市场，以及客户群体")]
    df = spark.createDataFrame(questions, "id int, q string")
    return df.select("id", rewrite.rewrite_column(F.col("q")).alias("rewritten"), F.array_join(rewrite.keywords_column(F.col("q")), "|").alias("keywords"))


@query(O.KEYWORD_OVERLAP)
def keyword_overlap(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(vector.keyword_overlap(F.col("text"), "The des tion 2.0"), "overlap"))


@query(O.JACCARD)
def jaccard_pairs(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    after = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return t.join(after, "doc_id").select("doc_id", r6(V.jaccard(F.col("t"), F.col("u")), "jaccard"))


@query(O.TOKEN_SIMILARITY)
def token_similarity(spark, sf):
    asked = F.array(*[F.lit(t) for t in ("the", "the", "les", "tion", "zzz")])
    return table(spark, sf, "documents").select("doc_id", r6(V.token_similarity(asked, T.tokens(F.col("text"))), "similarity"))


# --- vectors ---------------------------------------------------------------------------------------


def _vector(spark, sf, vec_id=0):
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def _hits(df):
    return df.select("vec_id", r6(F.col("score"), "score"), "rank")


@query(O.knn(10))
def knn_exact(spark, sf):
    return _hits(vector.knn(table(spark, sf, "embeddings"), _vector(spark, sf), 10))


@query(O.knn(10, "label IN (1, 3, 5)"))
def knn_filtered(spark, sf):
    return _hits(vector.knn(table(spark, sf, "embeddings"), _vector(spark, sf), 10, condition={"label": [1, 3, 5]}))


@query(O.KNN_THRESHOLD)
def knn_threshold(spark, sf):
    return vector.knn(table(spark, sf, "embeddings"), _vector(spark, sf), None, threshold=0.2).select("vec_id", r6(F.col("score"), "score"))


@query(O.KNN_BATCH)
def knn_batch(spark, sf):
    rows = table(spark, sf, "embeddings")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.knn_batch(rows, asked, 5).select("query_id", "vec_id", r6(F.col("score"), "score"), "rank")


@query()
def knn_ivf(spark, sf):
    rows = table(spark, sf, "embeddings")
    index = vector.CoarseIndex(lists=16, probes=8).fit(rows)
    return _hits(index.search(index.index(rows), _vector(spark, sf), 10))


def _near_by_index(spark, sf):
    """Ten neighbours of every vector whose number 50 divides, by an index over all vectors."""
    rows = table(spark, sf, "embeddings")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = ann.VectorIndex.build(rows, store.scratch(spark), lists=16)
    return index.search(asked, 10, probes=13, refine=300), vector.knn_batch(rows, asked, 10)


@query()
def knn_join(spark, sf):
    return _near_by_index(spark, sf)[0].select("query_id", "vec_id", r6(F.col("score"), "score"), "rank")


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def knn_join_recall(spark, sf):
    """Whether knn_join finds nine tenths of the exact neighbours."""
    return ann.recall(*_near_by_index(spark, sf)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query(O.VECTOR_NORMS)
def vector_norms(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(V.norm(F.col("embedding")), "norm"), F.size("embedding").alias("dim"))


@query()
def vectorise_chunks(spark, sf):
    rows = chunk.chunk(table(spark, sf, "documents"), "fixed")
    return embed.documents(embed.vectorise(rows, lambda: embed.HashingEmbedder(64)), "kb").drop("create_time")


# --- fusion, reranking, pages ----------------------------------------------------------------------


def _paired(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, sf, "documents").join(e, "doc_id", "left")


def _legs(spark, sf):
    near = vector.knn(table(spark, sf, "embeddings"), _vector(spark, sf), 200, 0.0).select(F.col("vec_id").alias("doc_id"), "score")
    words = lexical.normalize(_index(spark, sf).top(TERMS, 200))
    return near, words.select("doc_id", "keyword_score")


@query(O.FUSE + "SELECT doc_id, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, round(fs, 6) AS final_score FROM fused")
def hybrid_fuse(spark, sf):
    return hybrid.fuse(*_legs(spark, sf)).select("doc_id", *[r6(F.col(c), c) for c in ("vector_score", "keyword_score", "final_score")])


@query(O.FUSE + O.RERANK)
def hybrid_rerank(spark, sf):
    near, words = _legs(spark, sf)
    hits = hybrid.fuse(near, words).where(F.round("final_score", 9) >= 0.3).select("doc_id", F.round("final_score", 9).alias("final_score"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    best = hybrid.rerank_cosine(hits.join(e, "doc_id", "left"), _vector(spark, sf), 20)
    return best.select("doc_id", r6(F.col("rerank_score"), "rerank_score"), "rank")


@query(O.LINEAR)
def linear_hybrid(spark, sf):
    asked = F.array(*[F.lit(t) for t in ("the", "les", "tion")])
    cos = F.coalesce(V.cosine(F.col("embedding"), vector.literal(_vector(spark, sf))), F.lit(0.0))
    return _paired(spark, sf).select("doc_id", r6(hybrid.linear_similarity(V.token_similarity(asked, T.tokens(F.col("text"))), cos), "similarity"))


@query(O.IN_ROW)
def hybrid_in_row(spark, sf):
    return vector.hybrid_in_row(_paired(spark, sf), _vector(spark, sf), "the les tion", 20, id_col="doc_id").select("doc_id", r6(F.col("score"), "score"))


@query(O.FUSE + "SELECT doc_id, round(fs, 6) AS final_score, rank FROM (SELECT *, row_number() OVER (ORDER BY fs DESC, doc_id) AS rank FROM (SELECT doc_id, round(fs, 9) AS fs FROM fused) WHERE fs >= 0.1) WHERE rank BETWEEN 11 AND 20")
def retrieve_page(spark, sf):
    hits = hybrid.fuse(*_legs(spark, sf)).select("doc_id", F.round("final_score", 9).alias("final_score"))
    return hybrid.page(hits, "final_score", "doc_id", 2, 10).select("doc_id", r6(F.col("final_score"), "final_score"), "rank")


@query(O.FUSE + "SELECT source AS document_name, count(*) AS count FROM fused JOIN documents USING (doc_id) GROUP BY source")
def doc_aggs(spark, sf):
    hits = hybrid.fuse(*_legs(spark, sf)).join(table(spark, sf, "documents"), "doc_id")
    return hybrid.document_counts(hits, "source").withColumnRenamed("source", "document_name")


@query(O.COMPARE)
def compare_methods(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("question"))
    first = _index(spark, sf).bm25(TERMS).join(docs, "doc_id")
    second = _index(spark, sf).bm25(TERMS, "plus").join(docs, "doc_id")
    out = hybrid.compare(first, second)
    return out.select("question", "n_first", "n_second", "n_diff", *[r6(F.col(c), c) for c in ("mean_first", "mean_second", "mean_diff")])


@query(O.READING_ORDER)
def reading_order(spark, sf):
    hits = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("page_num"), F.floor(F.col("l_quantity") / 10).alias("top"), F.col("l_shipdate").alias("create_time"))
    return hybrid.in_reading_order(hits, by="l_orderkey", key="l_linenumber").select("l_orderkey", "l_linenumber", "place")


# --- joins and ranks --------------------------------------------------------------------------------


@query(O.NAME_PAIRS)
def substring_pairs(spark, sf):
    """Part names and the words of part types that lie in them, or they in."""
    words = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).unionByName(table(spark, sf, "part").select(F.concat(F.substring(F.lower("p_name"), 2, 4)).alias("word")))
    return relational.touching(table(spark, sf, "part").select(F.lower("p_name").alias("name")), words, "name", "word")


@query(O.IN_TRANSIT)
def orders_in_transit(spark, sf):
    """For every order date, how many orders are between their first and last shipment, and the least of them."""
    spans = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    days = table(spark, sf, "orders").select(F.col("o_orderdate").alias("day")).distinct()
    held = relational.stabbed(days, spans, "day", "first_ship", "last_ship", "l_orderkey")
    return held.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.sum("n").alias("n"), F.min("least").alias("least"))


@query(O.FIRST_IN_TRANSIT)
def first_in_transit(spark, sf):
    """Every order with the least order of the same customer that was in transit on its date."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    spans = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    spans = spans.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").hint("merge"), "l_orderkey")
    return relational.range_join(orders, spans, "o_orderdate", "first_ship", "last_ship", keys=("o_custkey",), first="l_orderkey").select("o_orderkey", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem")
def rank_all(spark, sf):
    """Every line's rank by price over the whole table."""
    return relational.rank_all(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")).select("l_orderkey", "l_linenumber", "rank")


# --- tables of questions ---------------------------------------------------------------------------


def _questions(spark, sf):
    """Every benchmark item as a question, with the vector of the same number."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), "text").join(e, "question", "left")


@query(O.BATCH_TERMS)
def batch_terms(spark, sf):
    """Terms of every benchmark item, its first two words made an OR group."""
    made = F.concat(F.lit("("), F.substring_index("text", " ", 1), F.lit(" OR "), F.get(F.split("text", " "), 1), F.lit(") "), F.col("text"))
    rows = inverted.question_terms(table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), made.alias("text")))
    return rows.groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("term")), " ")).alias("digest"))


@query(O.BATCH_BM25)
def batch_bm25(spark, sf):
    """The 20 best documents for every benchmark item, by the sum over its terms."""
    best = questions.lexical_hits(_index(spark, sf), _questions(spark, sf), 20, "sum")
    return best.select("question", "doc_id", r6(F.col("score"), "score"), r6(F.col("keyword_score"), "keyword_score"), "rank")


@query(O.BATCH_HYBRID)
def batch_hybrid(spark, sf):
    """Hybrid search for every benchmark item."""
    out = questions.batch_hybrid(_index(spark, sf), table(spark, sf, "embeddings"), _questions(spark, sf), 5)
    return out.select("question", "doc_id", *[r6(F.col(c), c) for c in ("vector_score", "keyword_score", "final_score")], "rank")


def _dealt(spark, sf):
    return questions.dealer_search(_index(spark, sf), table(spark, sf, "embeddings"), _questions(spark, sf), condition={"label": [1, 3, 5]})


@query(O.DEALER + " SELECT question, doc_id, round(vector_score, 6) AS vector_score, round(term_score, 6) AS term_score, round(score, 6) AS score, fell_back, rank FROM ranked")
def dealer_search(spark, sf):
    """Search over three labels for every benchmark item; items without a hit over 0.3 take those over 0.17."""
    return _dealt(spark, sf).select("question", "doc_id", *[r6(F.col(c), c) for c in ("vector_score", "term_score", "score")], "fell_back", "rank")


@query(O.DEALER + O.RETRIEVAL)
def dealer_retrieval(spark, sf):
    """The second page of three reranked hits of every item, by share of terms (text, and source as title) and cosine."""
    found = _dealt(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "left")
    out = questions.retrieval(found, _questions(spark, sf), _index(spark, sf), page=2, size=3, title=F.col("source"))
    return out.select("question", "doc_id", r6(F.col("term_similarity"), "term_similarity"), r6(F.col("similarity"), "similarity"), "rank")


@query(O.DEALER + " SELECT question, source, count(*) AS count FROM ranked JOIN documents USING (doc_id) GROUP BY question, source")
def dealer_aggs(spark, sf):
    """Hits of every item by source."""
    return questions.document_counts(_dealt(spark, sf).join(table(spark, sf, "documents"), "doc_id"), "source")


# --- prompts ---------------------------------------------------------------------------------------


@query(O.HISTORY)
def history_last6(spark, sf):
    return prompt.format_history(table(spark, sf, "conversations"))


@query(O.LAST_TURNS)
def last_turns(spark, sf):
    return prompt.last_turns(table(spark, sf, "conversations"), 10).select("conv_id", "turn", "role", "back")


def _context_hits(spark, sf):
    """The ten best hits of a hybrid search."""
    hits = hybrid.fuse(*_legs(spark, sf)).select("doc_id", F.round("final_score", 9).alias("score"))
    best = hybrid.page(hits, "score", "doc_id", 1, 10).join(table(spark, sf, "documents"), "doc_id")
    return best.select(F.lit("q").alias("question"), "rank", F.col("text").alias("content"), F.col("lang").alias("document_name"), "score")


@query(O.CONTEXT)
def context_format(spark, sf):
    return prompt.format_documents(_context_hits(spark, sf), 900)


@query(O.CONTEXT_META)
def context_metadata(spark, sf):
    return prompt.format_with_metadata(_context_hits(spark, sf), ("document_name", "rank"))


@query(O.MESSAGES)
def prompt_messages(spark, sf):
    final = prompt.fill("concise", F.lit("c"), F.concat(F.lit("q"), F.max("turn").cast("string")))
    rows = prompt.build_messages(table(spark, sf, "conversations"), final, "s")
    return rows.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("said"))


@query(O.ANSWERS)
def answer_context(spark, sf):
    """Every conversation's last user turn as a question: its three best documents, the history and the turn in a filled template."""
    talk = table(spark, sf, "conversations")
    asked = talk.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("asked"))
    best = questions.lexical_hits(_index(spark, sf), asked.select(F.col("conv_id").alias("question"), F.col("asked").alias("text")), 3, "sum")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("document_name"))
    hits = best.join(docs, "doc_id").select(F.col("question").alias("conv_id"), "rank", "content", "document_name", F.round("keyword_score", 9).alias("score"))
    rows = answer.prompts(answer.contexts(hits, asked, talk, 900, question="conv_id"), "conversation", "asked")
    return rows.select("conv_id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


@query(O.PLAIN_AND_HYBRID)
def plain_and_hybrid(spark, sf):
    """The ten best by vectors alone beside the ten best by fusion."""
    plain = vector.knn(table(spark, sf, "embeddings"), _vector(spark, sf), 10).select(F.col("vec_id").alias("doc_id"), F.col("rank").alias("plain_rank"))
    hits = hybrid.fuse(*_legs(spark, sf)).select("doc_id", F.round("final_score", 9).alias("final_score"))
    both = hybrid.page(hits, "final_score", "doc_id", 1, 10).select("doc_id", F.col("rank").alias("hybrid_rank"))
    return plain.join(both, "doc_id", "full")


# --- store and streams -----------------------------------------------------------------------------


@query(O.UPSERT)
def store_upsert(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "lang", F.lit(1).alias("version"))
    new = docs.where(F.col("doc_id") % 3 == 0).select((F.col("doc_id") * 2).alias("doc_id"), "chunk_index", "lang", F.lit(2).alias("version"))
    kept = store.ChunkStore(spark, store.scratch(spark))
    kept.upsert(docs)
    kept.upsert(new)
    return kept.read()


@query("SELECT doc_id, lang FROM documents WHERE NOT (lang IN ('fr', 'de') AND source = 'src0')")
def store_delete(spark, sf):
    kept = store.ChunkStore(spark, store.scratch(spark))
    kept.upsert(table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "lang", "source"))
    kept.delete({"lang": ["fr", "de"], "source": "src0"})
    return kept.read().select("doc_id", "lang")


@query("SELECT doc_id, 'kb' AS kb_id, 'name' AS docnm_kwd, 64 AS dimension, md5(text) AS digest, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM documents JOIN embeddings ON vec_id = doc_id")
def store_chunks(spark, sf):
    """Chunks with their vectors written to the store under the store's names, and read back."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.expr("vec_id = doc_id")).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.col("embedding").alias("vector"))
    kept = store.ChunkStore(spark, store.scratch(spark))
    kept.upsert(store.chunk_rows(rows, "kb", "name", 64))
    total = F.aggregate(V.as_double(F.col("q_64_vec")), F.lit(0.0), lambda s, x: s + x)
    return kept.read().select("doc_id", "kb_id", "docnm_kwd", F.size("vector").alias("dimension"), F.md5("content").alias("digest"), r6(total, "total"))


@query("SELECT lang, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') AND NOT (lang = 'fr' AND source = 'src1') GROUP BY lang")
def store_count(spark, sf):
    """Rows of a store by language, after one language of one source was deleted."""
    kept = store.ChunkStore(spark, store.scratch(spark))
    kept.upsert(table(spark, sf, "documents").select("doc_id", F.lit(0).alias("chunk_index"), "lang", "source"))
    kept.delete({"lang": "fr", "source": "src1"})
    return kept.read().where(vector.conditions({"source": ["src1", "src2"]})).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(O.TUMBLING)
def event_windows(spark, sf):
    out = ingest.tumbling(table(spark, sf, "events"), "1 hour")
    return out.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", r6(F.col("total"), "total"))


@query(O.SESSIONS)
def event_sessions(spark, sf):
    out = ingest.sessions(table(spark, sf, "events"), "30 minutes")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("largest"))
