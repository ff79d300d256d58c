"""Ingest and retrieval put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import text as T
from lectern.operators import chunk, embed, hybrid, lexical, parse, rewrite, vector


def parse_documents(docs: DataFrame, connect: bool = True, clean: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): blocks of lines, joined to paragraphs across pages, cleaned, noise lines dropped."""
    blocks = parse.simple_blocks(docs, id_col, text_col)
    if connect:
        blocks = parse.connect_paragraphs(blocks, id_col).select(id_col, "page_num", F.col("para_no").alias("block_no"), "content")
    out = parse.page_text(blocks, id_col)
    return out.withColumn("text", T.drop_noise_lines(T.clean_text(F.col("text")))) if clean else out


def ingest(docs: DataFrame, make=None, strategy: str = "recursive", config: Config | None = None, include_tables: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks with vectors; include_tables: rows (id, page_num, pos, data) whose Markdown joins the texts, in the order of their places."""
    config = config or Config()
    rows = parse_documents(docs, connect=False, id_col=id_col, text_col=text_col)
    if include_tables is not None:
        marked = include_tables.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[c for c in ("page_num", "pos") if c in include_tables.columns], "data"))), lambda t: T.table_markdown(t["data"])), "\n\n").alias("__tables"))
        rows = rows.join(marked, id_col, "left").withColumn("text", F.concat_ws("\n\n", "text", "__tables")).drop("__tables")
    options = {"limit": config.chunk_tokens} if strategy == "recursive" else {}
    return embed.vectorise(chunk.chunk(rows, strategy, id_col, "text", **options), make or (lambda: embed.HashingEmbedder()))


def statistics(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: pages, blocks, raw characters, chunks, vectors."""
    a = blocks.agg(F.countDistinct("doc_id", "page_num").alias("pages"), F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("raw_chars"))
    b = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("vector").isNotNull() & (F.size("vector") > 0)).alias("vectors"))
    return a.crossJoin(b)  # one row each


def search(chunks: DataFrame, question: str, provider, config: Config | None = None, rewriting: bool = True, rerank: bool = True, key: str = "chunk_key") -> DataFrame:
    """Hits of hybrid search, reranked: (rank, score, vector_score, keyword_score, rerank_score, content, ..., search_type)."""
    config = config or Config()
    top, recall = config.sizes()
    query = rewrite.QueryRewriter().rewrite(question) if rewriting else question
    query_vector = provider.encode([query])[0]
    near = vector.knn(chunks, query_vector, 2 * recall, 0.1, id_col=key, vector_col="vector").select(key, "score")
    posts = lexical.postings(chunks, key, "content")
    words = lexical.normalize(lexical.bm25(posts, lexical.parse_or_query(query), "plus", "max", id_col=key)).orderBy(F.desc("score"), key).limit(2 * recall)
    v, k = config.weights()
    hits = hybrid.hybrid_search(near, words, recall, v, k, config.threshold, key).drop("rank").join(chunks, key)
    if rerank:
        return hybrid.rerank_cosine(hits, query_vector, top, vector_col="vector", key=key)
    return hybrid.ranked(hits, "final_score", key, top)
