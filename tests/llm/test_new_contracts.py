"""Operators 11 to 13 against brute force, on awkward rows and on documents."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import filter_audit, pii_crf, queries, ranked_search
from tests import compare
from tests.llm import cases

SF = "/root/testdata/sf0.001"
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    return real.unionByName(cases.frame(spark), allowMissingColumns=True).cache()  # with columns whose names clash


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_ranked_search"])
def test_against_sql(spark, name):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert compare.same(queries.QUERIES[name](spark, sf), compare.connect(sf), queries.ORACLE_SQL[name]) is None


# --- personal data ---------------------------------------------------------------------------------

RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def naive_spans(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
            if (k == 1 and any(int(p) > 255 for p in m[0].split("."))) or (k == 2 and (not 14 <= len(digits) <= 19 or twice % 10)) or (k == 3 and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def said(spans):
    return ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in spans)


PLANTED = [
    "write to Jo.Doe+x@mail.example.com or é@x.y, a@b, a@@b.c d@e.f@g.h.", "4111 1111 1111 1111 and 4111-1111-1111-1112 and 1234567890123456, 5500005555555559!!",
    "+1 (755) 555-3798\n+49 30 1234567, +1 2 and ++1 (755) 555-3798.", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 " + "9" * 4000 + ".1.1.1", "世 +1 (826) 555-4081 190.137.223.204 世",
]


def test_base_rules():
    rng = random.Random(0)
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(["a@.b1", "a@.-", "12.55 ", "1 -2+", "+1 (2)-.3"])) for _ in range(rng.randint(0, 60)))
        assert pii_crf.base_spans(text, *pii_crf.runs(text)) == naive_spans(text)


def test_pii_contract(spark, docs):
    more = spark.createDataFrame([(2_000_000 + i, t) for i, t in enumerate(PLANTED)], "doc_id long, text string")
    rows = docs.unionByName(more, allowMissingColumns=True)
    got = pii_crf.digest(pii_crf.find(rows)).collect()
    want = Counter()
    for r in rows.collect():
        spans = naive_spans(r.text or "")
        n = Counter(k for _, k, _ in spans)
        want[(r.doc_id, *[n[k] for k in range(4)], hashlib.sha256(said(spans).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    texts = defaultdict(list)
    for r in rows.collect():
        texts[r.doc_id].append(r.text or "")
    for r in got:
        base = [naive_spans(t) for t in texts[r.doc_id]]
        spans = [(int(a), pii_crf.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(","))] if r.spans else []
        assert spans == sorted(spans) and any(set(b) <= set(spans) for b in base)
        assert len(spans) - r.n_added in map(len, base)
        if not any(re.search("[0-9@+]", t) for t in texts[r.doc_id]):
            assert not spans
    assert pii_crf.find(cases.empty(spark)).count() == 0


def test_missed_numbers_are_added(spark):
    """The base rule's match of a phone number that is followed by another number runs on and fails; the field knows better, and adds little else."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    field = pii_crf.train(documents)
    more = pii_crf.find(spark.createDataFrame([(i, t) for i, t in enumerate([PLANTED[4], "plain words only", "in 2024 and 1999, 3.5 of 1234567890123456"])], "doc_id long, text string"), field)
    assert [[(s.kind, s.start, s.end) for s in r.spans if not s.base] for r in more.orderBy("doc_id").collect()] == [[("phone", 2, 19)], [], []]
    assert pii_crf.digest(pii_crf.find(documents, field)).agg(F.sum("n_added")).first()[0] == 2


def test_field_is_the_same_for_any_tasks(docs):
    one, many = pii_crf.train(docs.coalesce(1)), pii_crf.train(docs.repartition(13))
    for a, b in ((one.shows, many.shows), (one.bias, many.bias), (one.near, many.near), (one.similar, many.similar)):
        assert np.array_equal(a, b)


def test_message_passing_is_exact_on_trees_and_links_agree():
    rng = np.random.default_rng(1)
    n = pii_crf.LABELS
    near, link = rng.normal(size=(n, n)), rng.normal(size=(n, n))
    field = pii_crf.Field(np.zeros((sum(pii_crf.SHOWS), n)), np.zeros(n), near, (link + link.T) / 2)
    # 0-1 neighbours, 2-3 neighbours, 3 similar to 0, 4 alone
    touch, linked = np.array([-1, 0, -1, 2, -1]), np.array([-1, -1, -1, 0, -1])
    own = rng.normal(size=(5, n))
    chance = np.zeros((5, n))
    for ys in product(range(n), repeat=5):
        p = math.exp(sum(own[i, y] for i, y in enumerate(ys)) + near[ys[0], ys[1]] + near[ys[2], ys[3]] + field.similar[ys[0], ys[3]])
        for i, y in enumerate(ys):
            chance[i, y] += p
    assert np.allclose(field.chances(own, touch, linked), chance / chance.sum(1, keepdims=True))
    # a token that tells nothing takes the label of its similar one, over any distance
    strong = pii_crf.Field(field.shows, field.bias, 0 * near, np.where(np.eye(n, dtype=bool), 5.0, 0.0))
    told = np.zeros((3, n))
    told[0, 4] = 20
    assert strong.chances(told, np.full(3, -1), np.array([-1, 0, 1]))[:, 4].min() > 0.9


def test_repeats_of_an_entity_are_found(spark):
    """Where a name before an @ stands alone as often as not as an address, its document's address decides."""
    rows = [(i, f"user.{i}x@example.com wrote\n{'so did' if i % 2 else 'then'} user.{i}x@example.com and {i * 7919 % 1000003}") for i in range(400)]
    field = pii_crf.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert field.similar[1, 1] > field.similar[0, 1] and field.similar[3, 3] == field.similar[1, 1]


def test_mask(spark):
    df = pii_crf.find(spark.createDataFrame([(i, t) for i, t in enumerate([*PLANTED, "plain", ""])], "doc_id long, text string"), pii_crf.Field(np.zeros((sum(pii_crf.SHOWS), 5)), np.array([9.0, 0, 0, 0, 0]), np.zeros((5, 5)), np.zeros((5, 5))))
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*PLANTED, "plain", ""])], "doc_id long, text string")
    out = [r.m for r in df.join(texts, "doc_id").orderBy("doc_id").select(pii_crf.mask(F.col("text"), F.col("spans")).alias("m")).collect()]
    assert out[0] == "write to [EMAIL] or é@x.y, a@b, a@@b.c [EMAIL]@g.h." or out[0].startswith("write to [EMAIL] or é@x.y")
    assert out[1].startswith("[CARD] and") and out[-2:] == ["plain", ""]


# --- filters ---------------------------------------------------------------------------------------


def naive_audit(rows, labels):
    rows = [(i, t or "", part or "") for i, t, part in rows]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    failed = []
    for i, t, part in rows:
        w = BLANK_WORDS.findall(t)
        bits = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        failed.append((part, i, {f for f, b in bits.items() if b}))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [(i, f) for p, i, f in failed if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                out[(part, order, k + 1)] = [len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def test_filter_audit(spark, docs):
    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect()]
    labels = [(i, k % 2, k % 3 // 2) for k, i in enumerate(ids)] + [(ids[0], 1, 1), (ids[1], None, None), (77_777_777, 1, 1)]
    told = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    more = [(3_000_000 + i, "the same text for many", "en") for i in range(500)] + [(None, "the same text for many", "en"), (3_000_000, "the same text for many", "en")]
    rows = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    want = naive_audit([(r.doc_id, r.text, r.lang) for r in rows.collect()], labels)
    got = filter_audit.audit(rows, told).collect()
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(cases.empty(spark), told).count() == 0
    assert {r.toxic_lost for r in filter_audit.audit(rows, told.limit(0)).collect()} == {0}


def test_many_parts_and_batches(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), (F.col("id") % 700).cast("string").alias("lang"))
    got = filter_audit.audit(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == 700 * 600 and got.where("step = 5").agg(F.sum("kept")).first()[0] == 0


def test_first_failure():
    table = filter_audit.first_failure()
    assert table.shape == (32, 120)
    for s, row in enumerate(table):
        for order, step in zip(filter_audit.ORDERS, row, strict=True):
            assert step == next((k for k, f in enumerate(order) if s >> "ABCDE".index(f) & 1), 5)


# --- search ----------------------------------------------------------------------------------------


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def naive_rank(rows, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(i, Counter(word.findall(lower(t or "")))) for i, t in rows]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    n, length = len(terms), sum(x for *_, x in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        asked = Counter(word.findall(lower(text or "")))
        found = []
        for i, c, size in terms:
            m = 100 - 75 + 75 * size * n // length
            score = sum(many * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, many in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


def test_ranked_search(spark, docs):
    items = [(i, t) for i, t in enumerate([None, "", "..", "zzzunknown", "the THE the and of", "lorem ipsum dolor", "世运电子 é ＡＢ", "one two three four", "brown fox " + " ".join(f"w{i}" for i in range(300))])]
    items += [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(None, "the quick fox"), (4, "the THE the and of")]
    asked = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, doc_id long, rank int")
    want = naive_rank([(r.doc_id, r.text) for r in docs.collect()], items)
    got = Counter(tuple(r) for r in ranked_search.rank(docs, asked).select("item_id", "rank", "doc_id", "score").collect())
    assert got == want
    assert ranked_search.rank(cases.empty(spark), asked).count() == 0 and ranked_search.rank(docs, asked.limit(0)).count() == 0
    tight, ranked_search.BLOCK_TERMS = ranked_search.BLOCK_TERMS, 300  # several passes
    try:
        assert Counter(tuple(r) for r in ranked_search.rank(docs.repartition(7), asked).select("item_id", "rank", "doc_id", "score").collect()) == want
    finally:
        ranked_search.BLOCK_TERMS = tight


def test_search_stops_when_the_best_are_proven():
    """A few documents with a rare term outrank thousands with a common one, whose groups are left unread."""
    rng = np.random.default_rng(0)
    size = 50_000
    n = np.full(size, 20, np.int64) + rng.integers(0, 30, size)
    rare = np.arange(size) % 4000 == 7
    each = 1 + rare
    ptr = np.append(0, np.cumsum(each))
    term, tf = np.zeros(ptr[-1], np.int64), rng.integers(1, 3, ptr[-1])
    term[ptr[1:][rare] - 1] = 1
    index = ranked_search.Index(n, ptr, term, tf, 2, size, int(n.sum()))
    factors = np.array([20, 9000])
    full = np.zeros(size, np.int64)
    np.add.at(full, np.repeat(np.arange(size), each), factors[term] * index.impact)
    found, scores, used = index.search(np.array([0, 1]), factors, 10)
    best = np.lexsort((np.arange(size), -full))[:10]
    assert set(best) <= set(found) and np.array_equal(scores, full[found]) and used < ptr[-1] / 2
    found, _, less = index.search(np.array([0, 1]), factors, 10, int(full.max()))
    assert set(np.flatnonzero(full == full.max())) <= set(found) and len(found) <= 10 and less <= used
    assert {int(s) for s in index.search(np.array([0]), np.array([20]), 10)[1]} <= set((20 * index.impact[ptr[:-1]]).tolist())
