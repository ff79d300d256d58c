"""Operators with a fixed result against brute force, on awkward rows and on documents."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, ngram_join, packing, quality_hosts, queries, shard_tree, warc
from lectern.llm.shared import components
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    return real.unionByName(cases.frame(spark), allowMissingColumns=True).cache()  # with columns whose names clash


def ids_of(text, tok):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = ids_of(r.text, tok)
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(r.doc_id, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack(docs, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    # plain best-fit decreasing, piece by piece
    rests = []
    for length in sorted((r.length for r in got), reverse=True):
        fit = [x for x in rests if x >= length]
        rest = min(fit) if fit else 2048
        if fit:
            rests.remove(rest)
        rests.append(rest - length)
    assert len(bins) == len(rests)


def test_packing_plan_is_best_fit():
    rng = np.random.default_rng(3)
    for cap in (7, 50, 333):
        sizes = rng.integers(1, cap + 1, 400) if cap != 50 else np.minimum(cap, rng.geometric(0.2, 900))
        plan = packing.best_fit_plan(Counter(sizes.tolist()), cap)
        fill = Counter()
        for length, low, high, per, first, at in plan:
            for k in range(high - low):
                b = first + k // per
                assert fill[b] == at + k % per * length
                fill[b] += length
        rests = []
        for length in sorted(sizes.tolist(), reverse=True):
            fit = [x for x in rests if x >= length]
            rest = min(fit) if fit else cap
            if fit:
                rests.remove(rest)
            rests.append(rest - length)
        assert sorted(cap - x for x in rests) == sorted(fill.values())


def brute_links(rows, w, percent):
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(r.text or ""))
        sets[r] = {tuple(words[i : i + w]) for i in range(max(1, len(words) - w + 1))} if words else set()
    root = {r.doc_id: r.doc_id for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    rows = list(sets)
    for i, x in enumerate(rows):
        for y in rows[:i]:
            a, b = sets[x], sets[y]
            if a and b and None not in (x.doc_id, y.doc_id) and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(x.doc_id), find(y.doc_id)))
                root[q] = p
    return Counter((r.doc_id, len(s), None if r.doc_id is None else find(r.doc_id)) for r, s in sets.items())


@pytest.mark.parametrize("w,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, w, percent):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, w, percent).collect()}
    assert got == set(brute_links(docs.collect(), w, percent))


def test_ngram_join_large_group(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for i in range(700):
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            words[k] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words[: 120 - int(rng.integers(0, 20))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 4, 85).collect()}
    assert got == set(brute_links(docs.collect(), 4, 85))


def test_ngram_join_requests_stay_small_with_many_buckets():
    """What is sent for a shingle doesn't grow with the number of buckets, which grows with the input."""
    words = np.random.default_rng(3).integers(0, 10**6, (400, 30))
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([" ".join(map(str, x)) for x in words]), pa.array(range(400))], names=["id", "text", "key"])
    for buckets in (1, 20_000):
        sent = 0
        with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 0)):
            for out in ngram_join._requests(5, buckets)([batch]):
                sent += sum(len(a) + len(b) for a, b, ids in zip(*(out.column(c).to_pylist() for c in (2, 3, 6))) if ids is None)
        assert sent <= 8 * 400 * 26


def test_ngram_join_packed_numbers():
    for doc, n in ([[0], 70_000], [[1, 1, 5], 9], [[0, 1, 1, 2, 3], 4], [[2] * 300, 3], [[], 5], [[7, 69_999], 70_000]):
        assert ngram_join._unpacked(ngram_join._packed(np.array(doc, np.int64), n)).tolist() == doc


def test_ngram_join_bitmaps_keep_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > share], rng.integers(0, 2**63, int(300 * share)).astype(np.uint64)])) for share in rng.random(60) * 0.3]
    maps = [ngram_join._bitmaps([x], 1024 << (k % 3))[0].tobytes() for k, x in enumerate(sets)]
    parts, n = np.arange(60) // 2, np.array([len(x) for x in sets])
    linked = [any(parts[i] != parts[j] and 180 * len(np.intersect1d(x, y)) >= 80 * (len(x) + len(y)) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    may = ngram_join.may_link(parts, n, maps, 80, 100)
    assert 0 < sum(linked) and may[linked].all() and not may.all()


def test_ngram_join_parts_apart(spark, monkeypatch):
    """One group of several families that share rare shingles but don't link, and links between texts of different blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(6)
    rows = []
    for family in range(4):
        base = [f"c{k}" for k in range(60)] + [f"f{family}x{k}" for k in range(40)]
        for _ in range(30):
            words = list(base)
            for k in rng.integers(0, 100, rng.integers(0, 4)):
                words[k] = f"n{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words[: 100 - int(rng.integers(0, 30))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turns, verify = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda *a: turns.append(a) or verify(*a))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 4, 85).collect()}
    assert got == set(brute_links(docs.collect(), 4, 85)) and len(turns) == 3
    assert 1 < len({c for _, _, c in got}) < len(rows)


def test_components(spark):
    """Chains, hubs and repeated links against a plain union."""
    rng = np.random.default_rng(7)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5000, 5000)] + [tuple(map(int, rng.integers(2000, 2600, 2))) for _ in range(400)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    edges = spark.createDataFrame(links * 2, "a long, b long").repartition(16)
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {a: find(a) for a in root if any(a in x and x[0] != x[1] for x in links)}
    assert components(edges.where("false")).count() == 0


def test_warc(spark):
    html = "<p>" + "x" * 120 + "</p>"
    odd = [(1, "u", html), (2, None, html), (3, "a b\nc", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (0, "u", "é" * 50), (0, "u", "é" * 50), (None, "u", html), (9, "u", "y" * 300_000)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 100 as page_id", "url", "html")
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    firsts, want = {}, Counter()
    rows = pages.collect()
    for r in rows:
        if r.page_id is not None:
            firsts[r.html or ""] = min(firsts.get(r.html or "", r.page_id), r.page_id)
    for r in rows:
        data = (r.html or "").encode()
        first = firsts[r.html or ""]
        revisit = len(data) >= 100 and r.page_id != first
        want[(r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    got = warc.round_trip(pages)
    assert Counter(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_damage(spark):
    rec = warc._record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "d")
    assert [r["payload"] for r in warc.records(warc.pieces(rec * 2), keep_payload=True)] == [b"payload"] * 2
    assert [r["payload"] for r in warc.records((bytes([b]) for b in rec), keep_payload=True)] == [b"payload"]
    bad = warc._record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None, False, "d")
    for data in (rec[:-9], bad, rec[:30] + b"\x00\x01" + rec[32:], b"plain"):
        with pytest.raises(ValueError):
            list(warc.records(warc.pieces(data)))


def test_warc_of_others(spark, tmp_path):
    """Records of all kinds, as other writers make them."""
    import base64
    import gzip

    def record(kind, block, *more):
        lines = [f"WARC/1.0\r\nWARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *more, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    page, http = "né".encode() * 50, "Content-Type: application/http; msgtype=response"
    sha1 = base64.b32encode(hashlib.sha1(page).digest()).decode()
    data = record("warcinfo", b"software: x\r\nformat: WARC 1.0\r\n", "Content-Type: application/warc-fields")
    data += record("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://x/")
    data += record("response", b"HTTP/1.1 200 OK\r\nServer: caf\xe9\r\n\r\n" + page, http, "WARC-Target-URI: http://x/", f"WARC-Payload-Digest: sha1:{sha1}")
    data += record("response", b"HTTP/1.1 204 No\r\n\r\n", http)
    data += record("metadata", b"a: b", "Content-Type: application/warc-fields") + record("resource", page, "Content-Type: text/plain")
    data += record("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 150\r\n\r\n", http, f"WARC-Payload-Digest: sha1:{sha1}")
    (tmp_path / "a.warc.gz").write_bytes(data)
    of = lambda x: hashlib.sha256(x).hexdigest()
    want = [("warcinfo", 31, of(b"software: x\r\nformat: WARC 1.0\r\n")), ("request", 0, of(b"")), ("response", 150, of(page)), ("response", 0, of(b"")), ("metadata", 4, of(b"a: b")), ("resource", 150, of(page)), ("revisit", 150, sha1)]
    for limit in (0, 1 << 20):  # streamed, and through Spark
        got = warc.read_files(spark, str(tmp_path), limit).collect()
        assert [(r.record_type, r.payload_bytes, r.payload_digest) for r in got] == want and {r.page_id for r in got} == {None}
    with pytest.raises(ValueError):
        list(warc.records([record("response", b"HTTP/1.1 200 OK\r\n\r\nother", http, f"WARC-Payload-Digest: sha1:{sha1}")]))


def brute_descent(key, nodes, at=""):
    """The shard a key comes to, drawing level by level."""
    import struct

    import xxhash

    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    draws = []
    for i, n in enumerate(nodes):
        if n.weight > 0:
            u = ((xxhash.xxh64_intdigest(f"{at}/{n.name}".encode(), seed=seed) >> 11) + 0.5) / (1 << 53)
            draws.append((-math.log(u) / n.weight, i))
    n = nodes[min(draws)[1]]
    return n.shard if not n.children else brute_descent(key, n.children, f"{at}/{n.name}")


def test_shard_descent(spark):
    tree = shard_tree.even_tree(24)
    more = shard_tree.grown(tree, 24)

    def heavier(n, factor):
        return shard_tree.Node(n.name, n.weight * factor, n.children, n.shard)

    r0, r1 = tree
    rack = (shard_tree.Node("r0", r0.weight, (heavier(r0.children[0], 3), *r0.children[1:])), r1)
    gone = (shard_tree.Node("r0", r0.weight, (heavier(r0.children[0], 0), *r0.children[1:])), r1)
    flat = (shard_tree.Node("r0", 1.0, (shard_tree.Node("k0", 1.0, tuple(shard_tree.Node(f"s{i}", 1.0, shard=i) for i in range(24))),)),)
    trees = {"plain": tree, "more": more, "rack": rack, "gone": gone, "flat": flat}
    rows = shard_tree.assign(spark.range(20_000).unionByName(spark.createDataFrame([(None,)], "id long")), F.col("id"), trees).collect()
    for r in rows[:300] + rows[-1:]:
        for name, t in trees.items():
            assert r[name] == brute_descent(r.id, t)
    where = {s.shard: (i, j) for i, x in enumerate(tree) for j, y in enumerate(x.children) for s in y.children}
    assert sum(r.plain != r.flat for r in rows) > 18_000  # the levels matter
    counts = Counter(r.plain for r in rows)
    assert len(counts) == 24 and all(700 < n < 970 for n in counts.values())
    for r in rows:
        assert r.more in (r.plain, 24)
        for changed in (r.rack, r.gone):  # only between the rack and its siblings, never among these or in the other region
            a, b = where[r.plain], where[changed]
            assert a == b and changed == r.plain or a[0] == b[0] == 0 and (a[1] == 0) != (b[1] == 0)
    moved = sum(r.rack != r.plain for r in rows) / len(rows)
    assert abs(moved - 0.5 * (3 / 5 - 1 / 3)) < 0.01 and all(where[r.gone] != (0, 0) for r in rows)
    assert abs(sum(r.more == 24 for r in rows) / len(rows) - 1 / 25) < 0.005


def test_shards(spark, docs):
    got = shard_tree.shard(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_hits(docs, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or ""))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[i : i + n])].add(item)
    lengths = {len(x) for x in wins}
    for r in docs:
        w = word.findall(lower(r.text or ""))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (x := tuple(w[i : i + m])) in wins:
                    hit.update(range(i, i + m))
                    found |= wins[x]
        names = ",".join(sorted(map(str, found)))
        yield r.doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    more = [(1000, "Lazy dog"), (1001, None), (1002, "..."), (1003, "three four five six seven eight nine ten eleven twelve thirteen"), (1004, "dolor SIT amet"), (1005, "zz top"), (1003, "fox")]
    bench = bench.unionByName(spark.createDataFrame(more, "item_id long, text string"))
    want = Counter(brute_hits(docs.collect(), [(r.item_id, r.text) for r in bench.collect()]))
    assert sum(n for w, n in want.items() if w[2]) > 5
    assert Counter(tuple(r) for r in decontaminate.digest(decontaminate.scan(docs, bench)).collect()) == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)  # the benchmark in many blocks
    assert Counter(tuple(r) for r in decontaminate.digest(decontaminate.scan(docs, bench)).collect()) == want
    assert decontaminate.digest(decontaminate.scan(docs, bench.where("false"))).where("contaminated").count() == 0


def test_decontaminate_cleans(spark):
    docs = spark.createDataFrame([(1, "keep This, test phrase here! end"), (2, "untouched  text"), (3, "test phrase here test phrase here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Test phrase here")], "item_id long, text string")
    got = {r.doc_id: (r.text, [tuple(s) for s in r.spans]) for r in decontaminate.scan(docs, bench, clean=True).collect()}
    assert got == {1: ("keep This, ! end", [(2, 4)]), 2: ("untouched  text", []), 3: ("", [(0, 5)])}


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_quality(spark, docs):
    got = quality_hosts.judge(docs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == Counter((r.doc_id, *brute_counts(r.text)) for r in docs.collect())
    bad = [(i, "short" if i % 10 else "one two three four five six seven eight nine ten", f"bad{i % 4}") for i in range(200)]
    good = [(1000 + i, f"a{i} b c d e f g h i j k l", f"good{i % 9}") for i in range(400)]
    made = spark.createDataFrame(bad + good, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_hosts.judge(made).where("kept").collect()}
    assert kept == {i for i, *_ in good}


def test_empty_tables(spark):
    none = cases.empty(spark)
    path = queries.tokenizer("word_bpe_49k.json")
    for df in (packing.pack(none, path), ngram_join.jaccard_components(none), shard_tree.shard(none), quality_hosts.judge(none), decontaminate.scan(none, spark.createDataFrame([(1, "a b")], "item_id long, text string"))):
        assert df.count() == 0


def test_quality_prior_is_free_of_noise(spark):
    """Hosts of two documents that fail by one chance are judged alike; hosts that differ keep their own rates."""
    rng = np.random.default_rng(4)
    alike = spark.createDataFrame([(f"h{i}", bool(x)) for i in range(5000) for x in rng.random(2) < 0.2], "host string, failed boolean")
    rates = [r.host_rate for r in quality_hosts.host_verdicts(alike, "host", "failed", 0.5).collect()]
    assert max(rates) - min(rates) < 0.1 and abs(np.mean(rates) - 0.2) < 0.02
    apart = spark.createDataFrame([(f"h{i}", i % 2 == 0) for i in range(100) for _ in range(20)], "host string, failed boolean")
    assert {round(r.host_rate, 6) for r in quality_hosts.host_verdicts(apart, "host", "failed", 0.5).collect()} == {0.0, 1.0}
    p = rng.beta(2, 6, 4000)
    mixed = spark.createDataFrame([(f"h{i}", bool(rng.random() < q)) for i, q in enumerate(p) for _ in range(6)], "host string, failed boolean")
    got = {r.host: (r.host_failed, r.host_rate) for r in quality_hosts.host_verdicts(mixed, "host", "failed", 0.5).collect()}
    assert max(abs(rate - (f + 2) / (6 + 8)) for f, rate in got.values()) < 0.03
    single = spark.createDataFrame([(f"h{i}", i < 3) for i in range(10)], "host string, failed boolean")
    assert {round(r.host_rate, 9) for r in quality_hosts.host_verdicts(single, "host", "failed", 0.5).collect()} == {0.3}
