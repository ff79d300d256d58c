"""The stored index against scores over texts that aren't indexed, and what it leaves unread."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import hybrid, inverted, lexical, questions
from tests.unit.test_catalogue import plan

SF = "/root/testdata/sf0.001"
TERMS = ["the", "tion", "les", "der", "que", "license", "zzz"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, "the"), (None, "der tion")], "doc_id long, text string"), allowMissingColumns=True)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return inverted.InvertedIndex.build(docs.repartition(3), f"{tmp_path_factory.mktemp('index')}/i")


def rows(df):
    return sorted(((r.doc_id, round(r.score, 9)) for r in df.select("doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("variant", ["okapi", "plus", "l"])
@pytest.mark.parametrize("combine", ["sum", "max"])
def test_scores_are_those_of_the_texts(docs, index, variant, combine):
    posts = lexical.postings(docs)
    got = {r.doc_id: round(r.score, 9) for r in index.bm25(TERMS, variant, combine).collect() if r.doc_id is not None}
    want = {r.doc_id: round(r.score, 9) for r in lexical.bm25(posts, TERMS, variant, combine).collect() if r.doc_id is not None}
    assert got == pytest.approx(want)


def test_statistics(docs, index):
    posts = lexical.postings(docs)
    assert sorted(map(tuple, index.doc_freq().collect())) == sorted(map(tuple, lexical.doc_freq(posts).collect()))
    assert index.totals["n"] == lexical.lengths(docs).count() and index.totals["size"] == lexical.lengths(docs).agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("combine", ["sum", "max"])
@pytest.mark.parametrize("few", [True, False])
def test_best_of_many_questions(spark, index, combine, few):
    """Skipped blocks lose no document of the k best, whichever way questions are sent."""
    asked = inverted.question_terms(spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("question"), "text"))
    every = {}
    for r in index.scores(asked, combine=combine).collect():
        every.setdefault(r.question, []).append((-round(r.score, 9), r.doc_id is not None, r.doc_id or 0))
    want = {(q, k + 1, i) for q, found in every.items() for k, (_, _, i) in enumerate(sorted(found)[:7])}
    got = {(r.question, r["rank"], r.doc_id or 0) for r in index.scores(asked, combine=combine, k=7, few=few).collect()}
    assert got == want


def test_blocks_that_cannot_matter_stay_shut(spark, tmp_path):
    """20,000 documents hold a common term; the shortest prove the score of the k best."""
    texts = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common u"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("id") % 20).cast("int")), lambda i: F.concat(F.lit("w"), F.translate(i.cast("string"), "0123456789", "abcdefghij"))), " ")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would go in one partition
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    index = inverted.InvertedIndex.build(texts, f"{tmp_path}/i")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    best = index.top(["common", "wb"], 5, "max")
    assert best.count() == 5
    assert [r.doc_id for r in best.where("rank <= 5").orderBy("rank").collect()] == [r.doc_id for r in index.bm25(["common", "wb"], combine="max").orderBy(F.round("score", 9).desc(), "doc_id").limit(5).collect()]
    text = plan(best)
    assert "PartitionFilters: [bucket#" in text and re.search(r"least#\d+ <= \d+", text) and "regexp" not in text
    blocks = spark.read.parquet(f"{tmp_path}/i/blocks")
    assert blocks.agg(F.max("n")).first()[0] <= inverted.BLOCK and blocks.where("term = 'common'").agg(F.sum("n")).first()[0] == 20_000
    # no range partition holds the whole of a frequent term
    assert blocks.where("term = 'common'").select("part").distinct().count() > 1


def test_empty_and_unknown(spark, index, tmp_path):
    assert index.top(["zzzz"], 3).count() == 0 and index.bm25(["zzzz"]).count() == 0 and index.search("zzzz", 3).count() == 0
    empty = inverted.InvertedIndex.build(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert empty.totals["n"] == 0 and empty.top(["the"], 3).count() == 0
    with pytest.raises(ValueError):
        index.bm25(["the"], "other")
    with pytest.raises(ValueError):
        index.bm25(["the"], combine="mean")


def test_question_terms_are_those_of_the_driver(spark):
    asked = ["(a OR bb) The 世运 2.0", "(x y OR  z ) plain", "no groups", "", None, "(one)(two OR two) one", "nested ((a OR b)) c"]
    got = inverted.question_terms(spark.createDataFrame(list(enumerate(asked)), "question int, text string"))
    found = {}
    for r in got.collect():
        found.setdefault(r.question, []).append(r.term)
    for i, q in enumerate(asked):
        assert sorted(found.get(i, [])) == lexical.parse_or_query(q)


def test_fusion_by_question_is_the_one_for_one(spark):
    near = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.3), (2, 7, -0.1), (3, 4, 0.2)], "question int, doc_id int, score double")
    words = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (2, 9, 0.4)], "question int, doc_id int, keyword_score double")
    got = {(r.question, r.doc_id): round(r.final_score, 9) for r in hybrid.fuse(near, words, by="question").collect()}
    want = {}
    for q in (1, 2, 3):
        for r in hybrid.fuse(near.where(F.col("question") == q).drop("question"), words.where(F.col("question") == q).drop("question")).collect():
            want[(q, r.doc_id)] = round(r.final_score, 9)
    assert got == want


def test_fallback_and_pages(spark, index):
    vectors = spark.createDataFrame([(i, [1.0, i / 10.0]) for i in range(30)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "the", [1.0, 0.0]), (2, "der", [-1.0, 0.5]), (3, "x", [-1.0, -1.0]), (4, None, None)], "question int, text string, vector array<double>")
    found = questions.dealer_search(index, vectors, asked, threshold=0.9, fallback=0.2).cache()
    kinds = {(r.question, r.fell_back) for r in found.collect()}
    assert kinds == {(1, False), (2, True)}
    assert questions.page_window(3, 10) == (1, 128) and questions.page_window(4, 10) == (31, 40) and questions.page_window(1, 100) == (1, 300)
    first = questions.retrieval(found, asked, index, 1, 2)
    second = questions.retrieval(found, asked, index, 2, 2)
    assert {r["rank"] for r in first.collect()} <= {1, 2} and {r["rank"] for r in second.collect()} <= {3, 4} and first.count() and second.count()
    assert questions.document_counts(found, "fell_back").count() == 2


def test_texts_of_one_file_are_tokenised_in_many_tasks_and_once(spark, docs, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        built = inverted.InvertedIndex.build(docs.coalesce(1), f"{tmp_path}/i")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "i/documents").glob("part-*"))) > 1
    assert rows(built.documents().withColumn("score", F.size("terms"))) == rows(lexical.lengths(docs).withColumn("score", F.col("length")))


def test_a_filter_of_terms_computes_them_once(spark):
    df = spark.createDataFrame([("The the les",), (None,)], "text string")
    asked = F.array(*[F.lit(t) for t in ("the", "the", "zzz")])
    shared = df.select(V.token_similarity(asked, T.tokens(F.col("text"))).alias("s"))
    assert [r.s and round(r.s, 6) for r in shared.collect()][0] == 0.666667
    for part in plan(shared).split("array_contains(")[1:]:
        assert "regexp" not in part.split(",")[0]


def test_letters_whose_lower_case_is_ascii_part_words(spark):
    df = spark.createDataFrame([("\u212aelvin \u0130stanbul A\u0130B x\u4e00\u4e01y 12a3",), ("\u00e9 a . \u4e00",)], "text string")
    found = [(sorted(r.t), r.h) for r in df.select(T.tokens(F.col("text")).alias("t"), T.has_tokens(F.col("text")).alias("h")).collect()]
    assert found == [(sorted(["\u4e00\u4e01", "elvin", "stanbul", "12", "3"]), True), ([], False)]


@pytest.mark.parametrize("variant", ["okapi", "plus", "l"])
@pytest.mark.parametrize("combine", ["sum", "max"])
def test_best_of_many_questions_are_those_of_all_scores(spark, docs, index, monkeypatch, variant, combine):
    monkeypatch.setattr(inverted, "PASS", 20)
    asked = docs.where("doc_id < 12").select(F.col("doc_id").alias("question"), F.substring("text", 1, 60).alias("text"))
    rows = inverted.question_terms(asked)
    order = lambda r: (-round(r.score, 9), r.doc_id is not None, r.doc_id or 0)
    every, best = {}, {}
    for r in index.scores(rows, variant, combine).collect():
        every.setdefault(r.question, []).append(r)
    for r in index.scores(rows, variant, combine, 7).collect():
        best.setdefault(r.question, []).append(r)
    shown = lambda rs: [(r.doc_id, round(r.score, 8), r.matched) for r in sorted(rs, key=order)]
    assert best.keys() == every.keys() and len(best) > 5
    assert all(shown(best[q]) == shown(every[q])[:7] for q in every)
    text = plan(index.scores(rows, variant, combine, 7))
    assert "MapInArrow" in text and "HashAggregate" not in text


def test_postings_are_sorted_by_one_number(spark, monkeypatch):
    """Sorts by radix need one number; terms with one hash and lengths beyond the order's make blocks that are right nevertheless."""
    import pyarrow as pa
    import pyspark

    ordered = inverted._ordered(spark.createDataFrame([(1, 3, "the"), (2, 1 << 21, "der"), (None, 2, "the"), (3, 1, "les")], "id long, length int, term string"))
    assert re.search(r"Sort \[key#\d+L ASC NULLS FIRST\], false", plan(ordered))
    for term, lengths in (("the", [2, 3]), ("der", [1 << 21])):
        some = ordered.where(F.col("term") == term).orderBy("length").collect()
        assert [r.length for r in some] == lengths and [r.key & inverted.LONGEST for r in some] == [min(x, inverted.LONGEST) for x in lengths]
        assert {r.key >> 57 for r in some} == {inverted.zlib.crc32(term.encode()) % inverted.BUCKETS}
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 5})())
    rows = [(7 << 57, "a", 4, 1), (7 << 57, "b", 4, 2), (7 << 57, "a", 9, 3), (7 << 57, "a", 5, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.int32(), pa.int64()])], names=["key", "term", "length", "id"])
    (made,) = inverted._blocks([batch])
    assert [(r["bucket"], r["term"], r["part"], r["least"], r["most"], r["n"], r["ids"]) for r in made.to_pylist()] == [(7, "a", 5, 4, 4, 1, [1]), (7, "b", 5, 4, 4, 1, [2]), (7, "a", 5, 5, 9, 2, [3, 4])]


def test_dealer_search_has_all_hits_over_the_threshold(spark, index):
    """1,500 vectors reach the threshold, more than 1,024; those of a question that falls back are all told too."""
    vectors = spark.range(1500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") / 15000.0).alias("embedding"))
    asked = spark.createDataFrame([(1, "the", [1.0, 0.0]), (2, "der", [0.2, 1.0]), (3, "x", [-1.0, 0.0])], "question int, text string, vector array<double>")
    found = questions.dealer_search(index, vectors, asked, threshold=0.9, fallback=0.17).groupBy("question", "fell_back").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"))
    assert {tuple(r) for r in found.collect()} == {(1, False, 1500, 1500), (2, True, 1500, 1500)}
    assert questions.dealer_search(index, vectors, asked, 100, threshold=0.9).where("question = 1").count() == 100
