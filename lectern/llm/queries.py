"""The queries of this subpackage, as (spark, sf_dir) -> DataFrame, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm import attention_lm, decontaminate, filter_audit, license_scan, line_templates, ngram_join, packing, pii_crf, quality_hosts, ranked_search, shard_tree, token_counts, warc

TOKENIZERS = "/opt/tokenizers"


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    out = packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), cap=2048)
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), w=4, percent=85)


def op3_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_line_templates(spark, sf_dir):
    out = line_templates.drop_recurring(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_dropped")


def op6_shard_tree(spark, sf_dir):
    return shard_tree.shard(_table(spark, sf_dir, "documents"), shards=24)


def op7_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_attention_lm(spark, sf_dir):
    return attention_lm.score(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10))


def op10_quality_hosts(spark, sf_dir):
    return quality_hosts.judge(_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op11_pii_skip_chain(spark, sf_dir):
    return pii_crf.digest(pii_crf.find(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_ranked_search(spark, sf_dir):
    return ranked_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_line_templates": op5_line_templates,
    "op6_shard_tree": op6_shard_tree,
    "op7_license_scan": op7_license_scan,
    "op8_attention_lm": op8_attention_lm,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_hosts": op10_quality_hosts,
    "op11_pii_skip_chain": op11_pii_skip_chain,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL = {"op3_warc": warc.ORACLE_SQL, "op9_decontaminate": decontaminate.ORACLE_SQL, "op10_quality_hosts": quality_hosts.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_ranked_search": ranked_search.ORACLE_SQL}
