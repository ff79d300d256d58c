"""Chunkers as folds against plain Python, on chosen and on random texts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunk, embed
from tests.unit import models
from tests.unit.test_catalogue import plan

SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(3)
    pieces = ["One two three. ", "Four five! ", "Six?\n", "Seven; eight, nine ", "\n\n", "\n \n", "世运电子的主要业务。", "，", "x" * 90, "ab", " ", "éè ", "12.5% ", "\n", "longer words without an end mark follow here and go on "]
    out = [None, "", " ", "\n", "a" * 80 + "\n" + "b" * 1000, "a" * 2000, "世" * 900, "One two three. Four five! Six?\nSeven; eight, nine " * 300, "word " * 3000, "x" * 70_000, ("y" * 1030 + ". ! ? ; , \n") * 3]
    out += ["".join(rng.choices(pieces, weights=[rng.random() for _ in pieces], k=rng.randint(1, 400))) for _ in range(150)]
    return out


@pytest.fixture(scope="module")
def frame(spark):
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return spark.createDataFrame(list(enumerate(texts() + real)), "doc_id int, text string").cache()


def check(frame, column, model):
    for r in frame.select("text", column.alias("got")).collect():
        assert list(r.got) == model(r.text), (r.text or "")[:200]


@pytest.mark.parametrize("limit,least", [(256, 20), (40, 20), (30, 5), (16, 2)])
def test_recursive(frame, limit, least):
    check(frame, chunk.recursive(F.col("text"), limit, least), lambda t: models.split_recursive(t, limit, least))


def test_recursive_is_the_definition():
    text = "One two three. Four five! Six?\nSeven; eight, nine " * 300

    def slow(t, limit=40, least=20):
        if models.estimate(t) <= limit:
            return [t]
        for s in chunk.SEPARATORS:
            left, sep, right = t.partition(s)
            if sep and models.estimate(left) >= least:
                return slow(left) + slow(right)
        return slow(t[: len(t) // 2]) + slow(t[len(t) // 2 :])

    assert models.split_recursive(text, 40, 20) == slow(text)


def test_paragraph(frame):
    check(frame, chunk.paragraph(F.col("text")), models.split_paragraphs)
    check(frame, chunk.paragraph(F.col("text"), 40, 10), lambda t: models.split_paragraphs(t, 40, 10))


def test_naive_and_delimited(frame):
    check(frame, chunk.naive(F.col("text")), lambda t: models.merge_sections([(x, "") for x in (t or "").split("\n")], 128))
    check(frame, chunk.delimited(F.col("text")), models.split_delimited)
    check(frame, chunk.delimited(F.col("text"), 7), lambda t: models.split_delimited(t, 7))


def test_semantic(frame):
    check(frame, chunk.semantic(F.col("text")), models.split_semantic)
    check(frame, chunk.semantic(F.col("text"), 0.3, 2), lambda t: models.split_semantic(t, 0.3, 2))


class Letters:
    """Counts of five letters."""

    dimension, name = 5, "letters"

    def encode(self, said):
        return [[float(s.lower().count(c)) for c in "aeiou"] for s in said]


class Failing(Letters):
    def encode(self, said):
        raise OSError("away")


def test_semantic_by_vectors(spark, frame):
    for make, told in ((Letters, lambda s: Letters().encode([s])[0]), (Failing, None)):
        for threshold, least in ((0.9, 20), (0.99, 0)):
            got = {}
            for r in chunk.semantic_chunks(frame, make, threshold, least).orderBy("chunk_index").collect():
                got.setdefault(r.doc_id, []).append(r.content)
            for r in frame.collect():
                want = models.split_semantic(r.text, threshold, least, embed=told or (lambda s: [0.0] * 5))
                assert got.get(r.doc_id, []) == [w for w in want if w.strip()]
    twice = frame.where("doc_id = 7").unionByName(frame.where("doc_id = 7"))
    assert chunk.semantic_chunks(twice, Letters).count() == 2 * chunk.semantic_chunks(frame.where("doc_id = 7"), Letters).count()
    assert "ArrowEvalPython" in plan(chunk.semantic_chunks(frame, Letters)) and embed.failures(frame.withColumn("vector", F.lit(None).cast("array<float>")), "text").first().failed == frame.where("text is not null").count()


def test_sections_with_tags_and_images(spark):
    rng = random.Random(1)
    rows, want, images = [], {}, {}
    for d in range(40):
        sections = [("".join(rng.choices(["ab ", "世运", "long word "], k=rng.randint(0, 90))), rng.choice([None, "", "@1", "@22"]), rng.choice([None, "i", "j"])) for _ in range(rng.randint(1, 12))]
        rows += [(d, k, *s) for k, s in enumerate(sections)]
        want[d] = models.merge_sections([(t, tag) for t, tag, _ in sections], 128)
        images[d] = models.merge_with_images([(t, i) for t, _, i in sections], 128)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, section_no int, text string, tag string, image string")
    tagged, pictured = {}, {}
    for r in chunk.merge_sections(df, 128, tag_col="tag", image_col="image").orderBy("chunk_index").collect():
        tagged.setdefault(r.doc_id, []).append(r.content)
    for r in chunk.merge_sections(df, 128, image_col="image").orderBy("chunk_index").collect():
        pictured.setdefault(r.doc_id, []).append((r.content, r.image))
    assert tagged == {k: v for k, v in want.items() if v} and pictured == {k: v for k, v in images.items() if v}


def test_no_python_in_any_strategy(frame):
    for name in chunk.STRATEGIES:
        text = plan(chunk.chunk(frame, name))
        assert "Python" not in text and "Exchange" not in text, name
    # clean_text's NFKC alone crosses to Python
    assert plan(chunk.process(frame)).count("ArrowEvalPython") <= 1


def test_a_likeness_that_is_the_threshold_joins(spark):
    pairs = [(a, b, c, d) for a in range(5) for b in range(5) for c in range(9) for d in range(9) if (a or b) and (c or d)]
    exact = [(x, math.isqrt((x[0] ** 2 + x[1] ** 2) * (x[2] ** 2 + x[3] ** 2))) for x in pairs]
    exact = [(x, r) for x, r in exact if r * r == (x[0] ** 2 + x[1] ** 2) * (x[2] ** 2 + x[3] ** 2)]
    off = [(x, r) for x, r in exact if (n := x[0] * x[2] + x[1] * x[3]) and n / (math.sqrt(x[0] ** 2 + x[1] ** 2) * math.sqrt(x[2] ** 2 + x[3] ** 2)) < n / r]
    assert off
    (a, b, c, d), r = off[0]
    text = "a" * a + "e" * b + "x" * 80 + ". " + "a" * c + "e" * d + "x" * 80 + "."
    out = chunk.semantic_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), lambda: embed.LetterCounts("ae"), (a * c + b * d) / r)
    assert out.count() == 1
