"""Answers, providers over HTTP, store rows and pointers."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import answer, embed, prompt, vector
from lectern.sources import store
from tests.unit.test_catalogue import plan


def test_answers(spark):
    hits = spark.createDataFrame([("a?", 1, "first", "d1", 0.5), ("a?", 2, "second", "d2", 0.4)], "question string, rank int, content string, document_name string, score double")
    asked = spark.createDataFrame([("a?", 1), ("b?", 2)], "question string, conv_id long")
    talk = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", "ho")], "conv_id long, turn int, role string, text string")
    rows = answer.contexts(hits, asked, talk)
    got = {r.question: r for r in answer.answers(rows, template="conversation", hits=hits).collect()}
    assert "first" in got["a?"].prompt and "用户: hi\n助手: ho" in got["a?"].prompt and got["a?"].answer == "first"
    assert got["b?"].context == prompt.EMPTY == got["b?"].answer and got["b?"].history == ""
    told = answer.answers(rows, lambda prompts: [p[-7:] for p in prompts])
    assert {r.answer for r in told.collect()} == {"Answer:"}
    one = spark.range(1).select(answer.with_roles(system=F.lit("s"), tool=F.lit(""), user=F.lit("u")).alias("m"), answer.prompt_text(F.lit("filled"), "be brief").alias("t"), answer.prompt_text(F.lit("filled"), "").alias("u")).first()
    assert [m.role for m in one.m] == ["system", "user"] and (one.t, one.u) == ("be brief\n\nfilled", "filled")


def test_stream():
    assert [json.loads(x)["type"] for x in answer.stream("q", ["a", "", "b"])] == ["start", "answer", "answer", "end"]

    def broken():
        yield "a"
        raise OSError("gone")

    lines = [json.loads(x) for x in answer.stream("q", broken())]
    assert [x["type"] for x in lines] == ["start", "answer", "error"] and "gone" in lines[-1]["content"] and {len(x) >= 2 and "content" in x for x in lines} == {True}


def test_remote_embedding():
    calls = []

    def send(body):
        calls.append(body["input"])
        if len(calls) == 2:
            raise OSError("away")
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    remote = embed.Remote("http://x", "m", batch=2, wait=0, send=send)
    assert remote.encode(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and [len(c) for c in calls] == [2, 1, 1]
    some = embed.Remote("http://x", "m", batch=1, tries=1, wait=0, dimensions=1, send=lambda body: {"data": [{"embedding": [1.0]}]} if body["input"] != ["b"] and body["dimensions"] == 1 else 1 / 0)
    assert some.encode(["a", "b", "c"]) == [[1.0], None, [1.0]]  # only the texts of the call that failed are without
    down = embed.Remote("http://x", "m", tries=2, wait=0, send=lambda body: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        down.encode(["a"])
    assert embed.Switch(down, remote).encode(["a"]) == [[1.0]] and embed.Switch(None, remote).encode(["bb"]) == [[2.0]]


def test_failures_show(spark):
    class Broken:
        def encode(self, texts):
            raise OSError("away")

    rows = embed.vectorise(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, content string"), Broken)
    assert tuple(embed.failures(rows).first()) == (2, 2) and rows.count() == 3


def test_store_pointers(spark, tmp_path):
    kept = store.ChunkStore(spark, str(tmp_path))
    row = lambda v: spark.createDataFrame([(1, 0, v)], "doc_id long, chunk_index int, v string")
    for v in "abcd":
        reader = kept.read() if kept.exists() else None
        kept.upsert(row(v))
        if reader is not None:
            assert reader.count() == 1  # of the version before
    assert [r.v for r in kept.read().collect()] == ["d"] and len(kept._pointers()) == 2
    tie = store.latest(row("x").unionByName(row("y")))
    assert tie.count() == 1 and tie.collect() == store.latest(row("y").unionByName(row("x"))).collect()


def test_knn_batch_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rows = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    asked = rows.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = vector.knn_batch(rows, asked, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "WindowGroupLimit" in plan
    assert {r.query_id: r.vec_id for r in got.where("rank = 1").collect()} == {i: i for i in range(10)} and got.count() == 20


def test_knn_batch_scores_as_cosine_does(spark, monkeypatch):
    """Pairs are found by products of matrices in tiles; scores, ties, nulls and odd vectors are those of the plain join, to the last bit."""
    import random

    from pyspark.sql import Window

    from lectern.functions import vectors as V

    rng = random.Random(4)
    x = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(4)], i % 3) for i in range(300)]
    x += [(400 + i, v, 0) for i, v in enumerate(([0.0] * 4, [0.0] * 4, None, [1.0], [], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 0.0], [1e-300] * 4, [1.0, None, 1.0, 1.0], [2.0]))]
    x += [(500 + i, x[7][1], 1) for i in range(40)]
    rows = spark.createDataFrame(x, "vec_id long, embedding array<double>, label int").repartition(3)
    asked = rows.where("vec_id < 30 or vec_id >= 400").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    pairs = rows.join(asked, F.size("embedding") == F.size("query_vector")).select("query_id", "vec_id", V.cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    for name, n in (("ROWS", 32), ("TILE", 8), ("PAIRS", 100), ("HELD", 50)):
        monkeypatch.setattr(vector, name, n)
    shown = lambda df: sorted(map(str, df.select("query_id", "vec_id", "score").collect()))
    for k in (1, 5, 400):
        got = vector.knn_batch(rows, asked, k)
        assert shown(got) == shown(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        assert "Join" not in plan(got) and "zip_with" not in plan(got)
    least = asked.withColumn("least", F.when(F.col("query_id") < "q2", 0.3).otherwise(-0.2))
    over = pairs.join(least.select("query_id", "least"), "query_id").where("score >= least")
    assert shown(vector.within(rows, least, "least")) == shown(over)
    assert vector.knn_batch(rows.limit(0), asked, 3).count() == vector.knn_batch(rows, asked.limit(0), 3).count() == 0
