"""The pipeline's stages on awkward rows and planted cases."""

import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import queries
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    docs = real.unionByName(cases.frame(spark), allowMissingColumns=True)  # with columns whose names clash
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    planted = [(9_000_000 + i, f"{' '.join(f'p{i}w{k}' for k in range(60))}\n{passage} tail{i}", "en", "src0", 1) for i in range(2)]
    planted += [(9_100_000 + i, " ".join(f"near{k}" for k in range(80)) + f" end{i}", "en", "src0", 1) for i in range(3)]
    planted += [(9_200_000, "too short", "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(planted, real.schema), allowMissingColumns=True)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 9_200_000 not in kept["quality_rules"] and 9_000_000 in kept["quality_rules"]
    assert set(kept["line_dedup"]) == set(kept["quality_rules"])
    near = kept["near_duplicates"]
    assert 9_100_000 in near and not {9_100_001, 9_100_002} & set(near) and {9_000_000, 9_000_001} <= set(near)
    clean = kept["benchmark_decontamination"]
    assert set(clean) == set(near)
    assert passage not in clean[9_000_000] and clean[9_000_000].startswith("p0w0 p0w1") and clean[9_000_000].endswith("tail0")
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(clean)


def test_packed_ids(spark, tmp_path):
    """The last stage's pieces, put together by place, are the tokens of the texts."""
    rows = [(1, "One, two three. " * 1500, "en", "s", 1), (2, None, "en", "s", 1), (3, "Straße 12.5% <|endoftext|>", "en", "s", 1), (3, "again", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = queries.tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = sorted((r[0], np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in rows)
    pieces = corpus_pipeline.best_fit_packing(spark, docs, SF).orderBy("doc_id", "start").collect()
    texts, sequences = [], {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        if r.start:
            texts[-1] = (r.doc_id, texts[-1][1] + r.ids)
        else:
            texts.append((r.doc_id, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.ids))
    assert sorted(texts) == want
    assert sum(len(x) for s in sequences.values() for _, x in s) == sum(len(x) for _, x in want)
    for s in sequences.values():
        parts = sorted(s)
        assert [at for at, _ in parts] == [sum(len(x) for _, x in parts[:k]) // 4 for k in range(len(parts))]
    # the query's digest is taken from the ids that are placed
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_best_fit_packing(spark, str(tmp_path))
    assert Counter(r.ids_crc32 for r in got.collect()) == Counter(zlib.crc32(r.ids) for r in pieces)


def test_rows_of_one_id(spark):
    """Rows are judged one by one, also where they share an id."""
    good, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "gh")
    rows = [(1, good), (1, "bad"), (2, other), (2, other), (3, other), (3, "a b c d e f g h i j k l"), (None, other), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = lambda f: sorted(((r.doc_id, r.text) for r in f(spark, docs, None).collect()), key=str)
    assert out(corpus_pipeline.quality_rules) == sorted([r for r in rows if r[1] and r[1] != "bad"], key=str)
    assert out(corpus_pipeline.near_duplicates) == sorted([(1, good), (1, "bad"), (2, other), (3, "a b c d e f g h i j k l"), (None, other), (4, None), (5, "")], key=str)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
