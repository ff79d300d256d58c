"""Operators whose results are their own: against brute force, planted cases and held-out texts."""

import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lectern.llm import attention_lm, license_scan, line_templates, queries, token_counts
from lectern.llm import words as W
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    return real.unionByName(cases.frame(spark), allowMissingColumns=True).cache()  # with columns whose names clash


def test_token_counts(docs):
    path = queries.tokenizer("piece_bpe_32k.model")
    rows, v = docs.collect(), token_counts.Vocabulary.of(path)
    told = Counter(i for r in rows for w in (r.text or "").encode().split() for i in v.sp.encode(w.decode()))
    assert token_counts.piece_counts(docs, path) == told
    pieces, byte = v.log_chances(told)
    assert abs(sum(map(math.exp, pieces.values())) + len(v.bytes) * math.exp(byte) - 1) < 1e-9
    widest = max(map(len, pieces))

    def best(word):
        scores = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(scores[at][0] + pieces[word[at:end]], scores[at][1] - 1) for at in range(max(0, end - widest), end) if word[at:end] in pieces]
            if word[end - 1] not in pieces:
                n = len(word[end - 1].encode())
                ways.append((scores[end - 1][0] + n * byte, scores[end - 1][1] - n))
            scores.append(max(ways))
        return -scores[-1][1]

    memo = {}
    want = Counter()
    for r in rows:
        words = (r.text or "").encode().split()
        want[(r.doc_id, len(words), sum(memo[w] if w in memo else memo.setdefault(w, best("▁" + w.decode())) for w in words))] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, path).collect()) == want


def test_trie_shares_prefixes():
    trie = token_counts.Trie({"▁": -1.0, "a": -1.0, "b": -2.0, "ab": -1.5}, -9.0)
    words = [b"ab", b"abab", b"c", "é".encode(), b"b\0", b"a" * 100]
    assert trie.learn(words)[0].tolist() == [2, 3, 2, 3, 3, 101]
    assert trie.nodes == len({"▁", "▁a", "▁ab", "▁aba", "▁abab", "▁c", "▁é"})


def test_remembered_words_are_bounded():
    rng, learned = np.random.default_rng(0), []

    def learn(words):
        learned.extend(words)
        return np.array([len(w) for w in words]), np.ones(len(words), np.int64)

    known = W.Remembered(learn, np.int64, most=50, long=60)
    buf, offs = W.text_buffer(pa.array(["yz xyz"]))
    two = np.sort(W.hashes(buf, *W.spans(buf, offs, W.BLANK_WORDS)[:2]))
    known.given = two, np.array([-1, -1]), 1
    known.forget()
    for _ in range(30):
        texts = [" ".join("x" * k + "yz" for k in rng.integers(0, 200, 20)) for _ in range(2)]
        buf, offs = W.text_buffer(pa.array(texts))
        s, e, _ = W.spans(buf, offs, W.BLANK_WORDS)
        which, starts, sizes = known.look_up(W.hashes(buf, s, e), W.speller(buf, s, e))
        assert known.flat[starts][which].tolist() == [len(w) if len(w) > 3 else -1 for t in texts for w in t.split()] and set(sizes) == {1}
        assert len(known.keys) <= 2 + 50 + 40 and len(known.flat) <= 2 + 60 + 40
    assert len(learned) < 30 * 40 and not {b"yz", b"xyz"} & set(learned)


def test_lines(spark):
    notice = "Posted by {} on 2024-01-0{} at http://x.org/{}"
    rows = [(i, f"unique {'abcdefgh'[i]} line of text number words here\n{notice.format('editor', i, i)}\nhi {'abcdefgh'[i]}") for i in range(5)]
    rows += [(10 + i, f"Please contact {n} for more help on this page\nbody {n} of its own says nothing twice") for i, n in enumerate(["ann", "bob", "cy", "di"])]
    rows += [(20, "whole copy line one is here\nand line two is here"), (21, "whole copy line one is here\nand line two is here"), (22, "whole copy line one is here\nand line two is here"), (30, None), (31, "")]
    rows += [(40, "tail stays  as it is \n\n"), (None, "Share\nnull one"), (50, "Share\nfifty"), (51, "fifty one \n Share")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as token", "1 as length", "2 as n", "3 as s")
    got = {r.doc_id: r for r in line_templates.drop_recurring(docs, keep_first=True).collect()}
    assert len(got) == len(rows) and got[0].token == "k" and got[0].s == 3
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for i in range(1, 5):
        assert got[i].text == f"unique {'abcdefgh'[i]} line of text number words here\nhi {'abcdefgh'[i]}" and got[i].n_dropped == 1  # a leading token
    assert got[10].text.startswith("Please contact ann")
    assert all(got[k].text.startswith("body") for k in (11, 12, 13))
    assert all(got[k].text == rows[9][1] and got[k].n_dropped == 0 for k in (20, 21, 22))
    assert got[30].text is None and got[31].text == "" and got[40].text == "tail stays  as it is \n\n"
    assert got[None].text == "Share\nnull one" and got[50].text == "fifty" and got[51].text == "fifty one "
    plain = {r.doc_id: r.text for r in line_templates.drop_recurring(docs).collect()}
    assert plain[0].endswith("here\nhi a") and plain[10].startswith("body") and plain[None] == "null one" and plain[20] == rows[9][1]
    assert line_templates.drop_recurring(cases.empty(spark)).count() == 0
    odd = line_templates.drop_recurring(cases.frame(spark))
    assert odd.count() == len(cases.rows()) and odd.columns[:-1] == cases.frame(spark).columns


def test_passages_in_two_texts(spark, tmp_path):
    passage, short = (" ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(n)) for n in (51, 50))
    rows = [(3, f"{passage}\n{short}\nof the third"), (3, f"{passage}\n{short}\nof the third"), (1, f"first text\n{passage}\n{short}"), (5, f"more {short}\nalone")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op5_line_templates(spark, str(tmp_path)).collect())
    assert got == [(1, f"first text\n{short}", 1), (3, f"{short}\nof the third", 1), (3, f"{short}\nof the third", 1), (5, rows[3][1], 0)]
    stage = corpus_pipeline.line_dedup(spark, docs, None).collect()
    assert sorted((r.doc_id, r.text) for r in stage) == [(1, rows[2][1]), *[r[:2] for r in got[1:]]]


def test_lines_of_any_length_with_a_free_word(spark, tmp_path):
    notice = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)]
    put = lambda n, at, w: " ".join([*notice[:at], w, *notice[at + 1 : n]])
    names = ["ann", "bob", "cy"]
    rows = [(10 * g + i, f"{put(n, at, w)}\nown{w}{g}") for g, (n, at) in enumerate([(5, 4), (6, 2), (17, 2), (17, 16), (20, 11), (40, 20), (60, 59)]) for i, w in enumerate(names)]
    rows += [(90 + i, put(45, 30, w)) for i, w in enumerate(names)]  # near copies of a whole document
    rows += [(80 + i, f"{put(30, 5 + 9 * i, 'far')} {i}\nown") for i in range(2)]  # differ in several runs
    rows += [(100 + i, f"{put(4, 3, w)}\nown too{w}") for i, w in enumerate(names)]  # too short for a free word
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op5_line_templates(spark, str(tmp_path)).collect()}
    assert got == {i: t.split("\n")[1] if i < 80 else t for i, t in rows}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, None).collect()} == {i: t.split("\n")[1] if i < 80 and i % 10 else t for i, t in rows}


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_against_brute_force(docs, keep_first):
    rows = docs.collect()

    def templates(line, several):
        raw = re.findall(r"[^\x20\x09-\x0D]+", line)
        m = ["<*>" if re.search("[0-9@]|://", t) else t for t in raw]
        m = m if 2 * sum(t == "<*>" for t in m) <= len(m) else raw
        n = len(m)
        if not n:
            return set()
        out = {tuple(m)}
        ends = [2 + max(0, n - 2) * k // 4 for k in range(5)]
        if several:
            out |= {(k, *m[:a], None, *m[b:], n) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a and n - (b - a) >= 4}
        return out

    homes, of = {}, {}
    for r in rows:
        t = r.text or ""
        of[r.text] = [templates(x, "\n" in t.strip(" \t\n\x0b\f\r")) for x in t.split("\n")]
        for x in {x for some in of[r.text] for x in some}:
            at = homes.setdefault(x, {})
            ids = [-1 if i is None else i for i in (at.get(r.text, r.doc_id), r.doc_id)]
            at[r.text] = min(ids)
    often = {x: min(at.items(), key=lambda y: y[1])[0] for x, at in homes.items() if len(at) >= (2 if len(x) > 50 and None not in x else 3)}
    want = Counter()
    for r in rows:
        gone = [any(x in often and not (keep_first and often[x] == r.text) for x in some) for some in of[r.text]]
        want[(r.doc_id, None if r.text is None else "\n".join(x for x, y in zip(r.text.split("\n"), gone) if not y), 0 if r.text is None else sum(gone))] += 1
    got = line_templates.drop_recurring(docs, keep_first=keep_first)
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in got.collect()) == want


def test_licenses(spark, docs):
    t = license_scan.TEMPLATES
    filler = " ".join(f"word{i} filler" for i in range(300))
    words = t["MIT"].split()
    near = " ".join(w if i != 20 else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 4 else "changed" for i, w in enumerate(words))
    rows = [(1, f"{filler} {t['MIT']} {filler}"), (2, near.upper()), (3, far), (4, None), (5, ""), (6, f"x\n{t['GPL-3.0-line']}"), (7, "a license of no kind"), (8, f"{t['CC-BY-NC-4.0-line']} {t['Apache-2.0']}"), (9, filler + filler), (10, "all RIGHTS\nreserved"), (11, f"all rights {filler} All rights reserved. x. All rights reserved")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert found == {(1, "MIT"), (2, "MIT"), (6, "GPL-3.0-line"), (8, "CC-BY-NC-4.0-line"), (8, "Apache-2.0"), (10, "All-rights-reserved"), (11, "All-rights-reserved")}
    assert [r.windows for r in got if r.doc_id == 11] == [2]
    assert {r.first_word // 100 for r in got if r.doc_id == 1} <= {5, 6}
    # on documents, against containment at every place
    want = set()
    for r in docs.collect():
        w = license_scan.words(r.text or "")
        for name, text in t.items():
            k = license_scan.words(text)
            n = min(5, len(k))
            grams, need = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (w, k))
            if len(need & grams) >= 0.8 * len(need):
                want.add((r.doc_id, name))
    assert {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()} == want
    assert license_scan.scan(cases.empty(spark)).count() == 0


def test_gradient():
    rng = np.random.default_rng(1)
    w = {k: x.astype(np.float64) for k, x in attention_lm.first_weights(rng.integers(0, 50, (attention_lm.CLASSES,) * 2).astype(float)).items()}
    inputs, targets, owner = attention_lm.layout([rng.integers(0, attention_lm.CLASSES, n) for n in (5, 40, 70)])
    r = np.flatnonzero(owner >= 0)
    args = np.concatenate([inputs[r - 1], inputs[r]], axis=1), inputs[r], targets[r]

    def loss(w):
        return -attention_lm.log_scores(w, inputs, targets, owner).sum() / 115

    g = attention_lm.gradient(w, *args)
    for name in ("q", "k", "v", "o", "far"):
        flat = np.argsort(-np.abs(g[name]).ravel())[:2]
        for at in flat:
            place = np.unravel_index(at, w[name].shape)
            eps, old = 1e-4, w[name][place]
            w[name][place] = old + eps
            up = loss(w)
            w[name][place] = old - eps
            down = loss(w)
            w[name][place] = old
            assert abs((up - down) / (2 * eps) - g[name][place]) < 1e-3 * max(1, abs(g[name][place])) + 1e-4, name


def test_lm_chances_sum_to_one():
    rng = np.random.default_rng(5)
    c, k = attention_lm.CLASSES, attention_lm.INNER
    w = attention_lm.first_weights(rng.integers(0, 50, (c, c)).astype(float))
    w["o"] = rng.normal(0, 2, w["o"].shape).astype(np.float32)
    # of all classes in one context
    text = rng.integers(0, c, 40)
    total = 0.0
    for last in range(c):
        inputs, targets, owner = attention_lm.layout([np.append(text, last)])
        total += math.exp(attention_lm.log_scores(w, inputs, targets, owner)[targets != c][-1])
    assert abs(total - 1) < 1e-5
    # of all words of a class, and of all ids and stops of a chain
    starts = np.arange(300) % 3 == 0
    cls = np.where(starts, rng.integers(0, c - 2, 300), rng.integers(0, k - 1, 300)).astype(np.uint8)
    counts = rng.integers(1, 9, (c, 5))
    kinds, tokens = np.full(c, 5), counts.sum(axis=1)
    model = attention_lm.WordModel(cls, starts, rng.integers(0, 3, (c + k) * k), rng.integers(0, 9, 300), kinds, tokens, np.array([0, 7, 4]))
    for first in range(c):
        seen = np.exp(model.log_chances(np.full(5, first), np.full(5, -800.0), counts[first])).sum()
        assert abs(seen + model.free[first] - 1) < 1e-9
    assert np.allclose(np.exp(model.chain).sum(axis=1), 1)
    for kind in (True, False):
        for g in np.unique(cls[starts == kind]):
            assert abs(np.exp(model.ids[(starts == kind) & (cls == g)]).sum() - 1) < 1e-9


def test_lm_rounds_see_every_tile():
    rng = np.random.default_rng(4)
    x = rng.integers(0, attention_lm.CLASSES - 1, 1 + 3 * attention_lm.BLOCK).astype(np.uint8).tobytes()
    tiles = pa.RecordBatch.from_arrays([pa.array([1] * 5, pa.int32()), pa.array([x] * 5, pa.binary())], names=["earlier", "classes"])
    weights = attention_lm.first_weights(np.zeros((attention_lm.CLASSES,) * 2))
    out = next(attention_lm._train(SimpleNamespace(value=weights))(iter([tiles])))
    assert out.column(1)[0].as_py() == 5 * 3  # rows trained on
    assert attention_lm.BLOCK >= 32


def test_longest_pieces():
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    sub, words = attention_lm.Subwords.of(path), [b"the", "Straße,".encode(), b"x", b"y" * 63, b"ab" * 500, bytes([0, 255]), b"a" * 64]
    flat, sizes = sub.cut(words)
    back = {i: p for p, i in sub.pieces.items()}
    at = 0
    for w, n in zip(words, sizes.tolist(), strict=True):
        got, rest = [back[i] for i in flat[at : at + n].tolist()], b" " + w
        assert b"".join(got) == rest
        for p in got:
            assert max((q for q in (rest[:k] for k in range(1, sub.widest + 1)) if q in sub.pieces), key=len) == p
            rest = rest[len(p) :]
        at += n
    assert sub.cut([])[0].tolist() == []


def test_lm_trains_on_whole_texts():
    path, rng = queries.tokenizer("byte_bpe_50k.tiktoken"), np.random.default_rng(2)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 5000, n)) for n in (0, 3, 41, 330, 5000)]
    sub = attention_lm.Subwords.of(path)
    cls = rng.integers(0, attention_lm.CLASSES - 1, sub.size + 1).astype(np.uint8)
    cls[-1] = end = attention_lm.CLASSES - 1
    first = lambda w: int(cls[sub.cut([w.encode()])[0][0]])
    want = [[end, *map(first, t.split()), end] for t in texts]
    tiles = list(attention_lm._tiles(path, SimpleNamespace(value=cls), SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0))), "test")(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    rows = [(e, np.frombuffer(x, np.uint8).tolist()) for b in tiles for e, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert [i for e, x in rows for i in x[e:]] == [i for x in want for i in x[1:]]
    long, block = want[-1], attention_lm.BLOCK
    later = [r for r in rows if r[0] > 1 and r[1][-1] == end][-1]
    assert later[0] == block + 1 and later[1] == long[-len(later[1]) :]
    pairs = next(attention_lm._bigrams(iter(tiles)))
    count = Counter(a * attention_lm.CLASSES + b for x in want for a, b in zip(x, x[1:]))
    assert dict(zip(*(c.to_pylist() for c in pairs.columns), strict=True)) == count
    # rows of tiles are those of whole texts
    inputs, targets, owner = attention_lm.layout([np.array(x[1:]) for x in want])
    whole = np.concatenate([inputs[np.flatnonzero(owner >= 0) - 1], inputs[owner >= 0], targets[owner >= 0]], axis=1)
    parts = [t for b in tiles for t in attention_lm._rows(b)]
    inputs, targets, owner = attention_lm.layout([c for _, c in parts], [e for e, _ in parts])
    assert np.array_equal(whole, np.concatenate([inputs[np.flatnonzero(owner >= 0) - 1], inputs[owner >= 0], targets[owner >= 0]], axis=1))


def test_lm_context_helps(spark):
    """Words that follow one of two kinds of company are foretold by it, in texts held out."""
    rng = np.random.default_rng(8)
    kinds = [[f"{c}{k}{c}" for k in range(40)] for c in "bk"]
    rows = [(i, " ".join(kinds[i % 2][k] for k in rng.integers(0, 40, 60))) for i in range(400)]
    got = attention_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer("byte_bpe_50k.tiktoken")).where("held_out").collect()
    ours, base, n = sum(r.score for r in got), sum(r.base_score for r in got), sum(r.n_tokens for r in got)
    assert len(got) > 20 and ours / n > base / n + 0.2  # all of log10(2) were 0.301


def test_lm(spark, docs, monkeypatch):
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    got = attention_lm.score(docs, path)
    rows, texts = got.collect(), docs.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in texts)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    counts = Counter(w for r in texts if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    better = []
    for r in texts:
        x, w = by[r.doc_id], tokens(r.text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(r.doc_id), len(w), sum(counts[t] > 0 for t in w), n)
        assert abs(x.base_score - base) < 1e-6 * max(1, abs(base))
        assert x.score < 0
        if held(r.doc_id) and len(w) < 10_000 and all(counts[t] for t in w):
            better.append((x.score, x.base_score))
    ours, base = map(sum, zip(*better, strict=True))
    assert len(better) >= 3 and ours > base  # texts held out whose words are all known: the base model gives every other word the chance of one
    again = {r.doc_id: r.score for r in attention_lm.score(docs.where("doc_id is not null"), path).collect()}
    assert len(again) == len(by) - 1
    # words looked up by a join instead of the list of frequent ones give the same scores
    monkeypatch.setattr(attention_lm, "FREQUENT", 50)
    rare = {r.doc_id: r for r in attention_lm.score(docs, path).collect()}
    for k, x in by.items():
        if k is not None:
            assert abs(rare[k].score - x.score) < 1e-3 * abs(x.score) and rare[k].n_known == x.n_known
    assert attention_lm.score(cases.empty(spark), path).count() == 0


def test_lm_hears_all_ids(monkeypatch):
    path, rng = queries.tokenizer("byte_bpe_50k.tiktoken"), np.random.default_rng(3)
    sub, c, block = attention_lm.Subwords.of(path), attention_lm.CLASSES, attention_lm.BLOCK
    cls = rng.integers(0, attention_lm.INNER - 1, sub.size + 1).astype(np.uint8)
    cls[-1] = end = c - 1
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 90_000, n)) for n in (0, 3, 70)] + ["ab " + "xyzq" * 200 + " cd"]
    texts.append(" ".join(f"w{k}" for k in range(3000)))  # several tiles
    inner = [[[], *([int(i) for i in cls[sub.cut([w.encode()])[0][1:]]] for w in t.split()), []] for t in texts]
    shared, none = SimpleNamespace(value=cls), SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint8), np.zeros(0, np.int64)))
    tiles = list(attention_lm._tiles(path, shared, none, "heard", inner=True)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    rows = [(e, x, np.frombuffer(y, np.uint8)) for b in tiles for (e, x), y in zip(attention_lm._rows(b), b.column(2).to_pylist(), strict=True)]
    assert all((y == attention_lm.STOP).sum() == len(e) + len(x) for e, x, y in rows)
    inputs, targets, owner = attention_lm.layout([x for _, x, _ in rows], [e for e, _, _ in rows])
    sizes = np.array([(len(e), len(x)) for e, x, _ in rows]).T
    inside = attention_lm.Inside([y for _, _, y in rows], *sizes)
    # each row hears every id of its words and of the row before, once for each time that it stands there
    row, at = 0, {}
    for text, k in [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1)]:
        first = k * attention_lm.TILE
        for b in range(0, min(attention_lm.TILE, len(inner[text]) - 1 - first), block):
            row = np.flatnonzero(owner >= 0)[len(at)]
            want = Counter()
            for place in range(max(0, first + b - block), min(first + b + block, len(inner[text]) - 1)):
                want.update((place - first - b + block, i + c + 1) for i in inner[text][place])
            at[row] = want
    assert len(at) == (owner >= 0).sum()
    use = np.array(list(at))
    keys, word, times = inside.of(use)
    for r, ks, ws, ts in zip(use, keys, word, np.exp(times), strict=True):
        got = Counter()
        for i, j, n in zip(ks.tolist(), ws.tolist(), ts.tolist(), strict=True):
            if i != c:
                got[(j, i)] += round(n)
        assert got == at[r]
    # equal ids as one key are heard as they are one by one, and gradients are those of the scores
    w = {k: x.astype(np.float64) for k, x in attention_lm.first_weights(rng.integers(0, 50, (c, c)).astype(float)).items()}
    w["o"] *= 10
    scores = attention_lm.log_scores(w, inputs, targets, owner, inside)
    monkeypatch.setattr(attention_lm, "MANY", 10**9)
    single = attention_lm.Inside([y for _, _, y in rows], *sizes)
    assert single.times is None and np.allclose(scores, attention_lm.log_scores(w, inputs, targets, owner, single), atol=1e-5)
    assert np.abs(scores - attention_lm.log_scores(w, inputs, targets, owner)).max() > 1e-3
    use = use[1:6]
    mine = np.where(np.isin(np.arange(len(owner)), use), owner, -1)
    for x in (inside, single):
        keys, *more = attention_lm.heard(inputs, use, x)
        g = attention_lm.gradient(w, keys, inputs[use], targets[use], *more)
        n = (targets[use] != c).sum()
        for name in ("q", "k", "v", "o", "far"):
            place = np.unravel_index(np.argmax(np.abs(g[name][c + 1 :] if name in "kv" else g[name])), (g[name][c + 1 :] if name in "kv" else g[name]).shape)
            place = (place[0] + c + 1, place[1]) if name in "kv" else place
            old, both = w[name][place], []
            for eps in (1e-4, -1e-4):
                w[name][place] = old + eps
                both.append(-attention_lm.log_scores(w, inputs, targets, mine, x).sum() / n)
            w[name][place] = old
            assert abs((both[0] - both[1]) / 2e-4 - g[name][place]) < 1e-3 * abs(g[name][place]) + 1e-6, name
