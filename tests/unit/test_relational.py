"""Substring and range joins against every pair, ranks against a sort, and what their plans are made of."""

import json
import random

from pyspark.sql import functions as F

from lectern.operators import lexical, parse, relational
from lectern.plans.catalogue import QUERIES
from tests.unit.test_catalogue import plan

PAIRWISE = ("BroadcastNestedLoopJoin", "CartesianProduct")


def test_touching(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé世") for _ in range(rng.randint(0, 7)))
    a, b = [word() for _ in range(300)] + [None, "", "x"], [word() for _ in range(300)] + [None, "", "x", "xy"]
    left, right = spark.createDataFrame([(x,) for x in a], "l string"), spark.createDataFrame([(x,) for x in b], "r string")
    got = {tuple(r) for r in relational.touching(left, right, "l", "r").collect()}
    assert got == {(x, y) for x in a for y in b if x and y and (x in y or y in x)}
    assert not any(p in plan(relational.touching(left, right, "l", "r")) for p in PAIRWISE)
    assert relational.touching(left.limit(0), right, "l", "r").count() == 0


def test_synonyms_of_a_large_dictionary(spark):
    """100,000 entries: no side is sent to all tasks, no entry meets every term."""
    words = spark.range(100_000).select(F.concat(F.lit("w"), F.hex("id")).alias("word"), F.array(F.concat(F.lit("s"), F.md5(F.col("id").cast("string")))).alias("synonyms"))
    terms = spark.createDataFrame([("xxw1869Fyy",), ("W",), (None,), ("qq",)], "term string")
    got = {tuple(r) for r in lexical.expand_synonyms(terms, words).where("term = expanded or term like 'xx%'").collect()}
    near = {f"w{n}" for k in range(1, 6) for n in ["1869F"[:k]]}
    want = {("xxw1869Fyy", "xxw1869Fyy"), ("W", "W"), ("qq", "qq")} | {("xxw1869Fyy", r.synonyms[0]) for r in words.where(F.col("word").isin(*near)).collect()}
    assert got == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not any(p in plan(lexical.expand_synonyms(terms, words)) for p in PAIRWISE)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_join(spark):
    rng = random.Random(6)
    points = [(i, rng.choice([None, rng.uniform(-50, 50), float(rng.randint(-5, 5))]), rng.randint(0, 2)) for i in range(200)] + [(1000, 1.0, 0)] * 2
    spans = []
    for k in range(300):
        a = rng.choice([rng.uniform(-60, 60), float(rng.randint(-5, 5))])
        spans.append((k, a, a + rng.choice([0.0, 1e-9, rng.uniform(0, 1), rng.uniform(0, 500), -1.0]), rng.randint(0, 2)))
    p, s = spark.createDataFrame(points, "i int, x double, g int"), spark.createDataFrame(spans, "k int, a double, b double, g int")
    for keys in ((), ("g",)):
        both = s if keys else s.withColumnRenamed("g", "h")
        got = sorted((r.i, r.k) for r in relational.range_join(p, both, "x", "a", "b", keys).collect())
        want = sorted((i, k) for i, x, g in points for k, a, b, h in spans if x is not None and a <= x <= b and (not keys or g == h))
        assert got == want
        least = {}
        for i, k in want:
            least[i] = min(least.get(i, k), k)
        assert {(r.i, r.k) for r in relational.range_join(p, both, "x", "a", "b", keys, first="k").collect()} == set(least.items())
        assert not any(q in plan(relational.range_join(p, both, "x", "a", "b", keys)) for q in PAIRWISE)
    assert relational.range_join(p, s.limit(0).withColumnRenamed("g", "h"), "x", "a", "b").count() == 0


def test_rank_all(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    ranked = relational.rank_all(rows, F.desc("v"), F.asc("id"))
    got = [(r.v, r.id) for r in ranked.orderBy("rank").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 20_001))
    assert ranked.where("rank between 501 and 510").count() == 10
    assert relational.rank_all(rows.limit(0), F.asc("id")).count() == 0
    # only the sizes of the partitions, a row each, come together
    text = plan(ranked)
    assert text.count("Exchange SinglePartition") <= 1 and "Window [sum(__n" in text


def test_json(spark):
    texts = ['[1,{"a":[2]}]', '{"b": 1, "a": [true, null, "x,[]{}:\\"y\\\\"], "z": {}}', "no json", "", None, "0", "7", '"s"', "null", "[]", "{}", ' {"k" : [[[]]]} ', '{"é世": "ü"}', "[" + ",".join(["12"] * 3000) + "]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: list(r.s) for r in df.select("i", parse.json_sections(F.col("t"), 2000).alias("s")).collect()}

    def objects(x):
        if isinstance(x, list):
            x = {f"item_{i}": y for i, y in enumerate(x)}
        return {k: objects(v) for k, v in x.items()} if isinstance(x, dict) else x

    for i, t in enumerate(texts):
        try:
            data = objects(json.loads(t or ""))
        except ValueError:
            assert got[i] == []
            continue
        if not isinstance(data, dict):
            assert got[i] == ([json.dumps(data)] if data else [])
            continue
        assert {k: v for s in got[i] for k, v in json.loads(s).items()} == data
        assert all(len(json.loads(s)) == 1 or sum(len(json.dumps(v, ensure_ascii=False)) for v in json.loads(s).values()) <= 4000 for s in got[i])
    packed = df.where("i = 13").select(parse.json_sections(F.col("t"), 20).alias("s")).first().s
    assert packed[0] == json.dumps({f"item_{i}": 12 for i in range(20)}) and len(packed) == 150
    assert "Python" not in plan(df.select(parse.json_sections(F.col("t"))))


def test_range_joins_send_no_side_whole(spark):
    for name in ("orders_in_transit", "first_in_transit"):
        assert "Broadcast" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_stabbed(spark):
    """Counts and least values equal those over all pairs, and no side is sent whole."""
    rng = random.Random(8)
    points = [(rng.choice([None, rng.uniform(-50, 50), float(rng.randint(-5, 5))]),) for _ in range(300)]
    spans = [(k, a := rng.choice([rng.uniform(-60, 60), float(rng.randint(-5, 5))]), a + rng.choice([0.0, 1e-9, rng.uniform(0, 1), rng.uniform(0, 500), -1.0])) for k in range(400)] + [(None, 1.0, 2.0), (-5, None, 3.0)]
    p, s = spark.createDataFrame(points, "x double"), spark.createDataFrame(spans, "k int, a double, b double")
    for some in (points, points[:1], [(3.0,)], []):
        got = {r.x: (r.n, r.least) for r in relational.stabbed(spark.createDataFrame(some, "x double"), s, "x", "a", "b", "k").collect()}
        want = {}
        for x in {x for x, in some if x is not None}:
            held = [k for k, a, b in spans if a is not None and a <= x <= b]
            if held:
                want[x] = (len(held), min((k for k in held if k is not None), default=None))
        assert got == want
    wide = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 50 + 900).cast("double").alias("b"))
    days = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    found = relational.stabbed(days, wide, "x", "a", "b", "k")
    assert found.agg(F.sum("n")).first()[0] == 2000 * 901
    assert "__run" in plan(found) and not any(q in plan(found) for q in (*PAIRWISE, "Broadcast"))
