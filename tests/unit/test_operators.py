"""Hand-derived values of single operators."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import chunk, embed, hybrid, lexical, parse, pipeline, prompt, rewrite, vector
from lectern.sources import files
from lectern.sources.store import ChunkStore
from lectern.sources.synonyms import SynonymTable
from lectern.streaming import ingest


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_text(spark):
    assert values(spark, ["abcd", "世运电子", "", None], T.token_count) == [1, 2, 0, 0]
    assert values(spark, ["12\nPage 3\n3 / 10\n第 2 页\n----------\nx\nok"], lambda c: T.clean_lines(c)) == ["ok"]
    key = "www."
    assert values(spark, ["see www.a.b", key + "x" * 62, key + "x" * 63, "***", ""], lambda c: T.is_noise(c)) == [True, True, False, True, True]
    assert values(spark, ["ＡＢ１２　x"], T.normalize_unicode) == ["AB12 x"]
    assert values(spark, ["增长12.5%。"], lambda c: T.remove_special(c)) == ["增长12.5"]
    assert values(spark, ["增长12.5%。"], lambda c: T.remove_special(c, "%。")) == ["增长12.5%。"]
    assert values(spark, ["abcdefghijkl", "abc"], lambda c: T.truncate(c, 10)) == ["abcdefg...", "abc"]
    assert values(spark, ["a\x00b\x7f"], T.remove_control) == ["ab"]
    assert values(spark, ["mail a.b@c.org now", "https://x.y/z?q=1 end www.a-b.c/d"], lambda c: T.mask_urls(T.mask_emails(c))) == ["mail [EMAIL] now", "[URL] end [URL]"]
    assert values(spark, ["a1 12 3.5 b2"], T.remove_numbers) == ["a1   b2"]
    assert values(spark, ["世运电子 The the a 12 é"], T.tokens) == [["世运电子", "the", "12"]]
    assert values(spark, ["x"], T.xxh64_hex) == [__import__("xxhash").xxh64(b"x").hexdigest()]


def test_tables(spark):
    df = spark.createDataFrame([([["h1", "h2"], ["1", "2"]],), ([["h1"]],)], "t array<array<string>>")
    assert [r[0] for r in df.select(T.table_markdown(F.col("t"))).collect()] == ["| h1 | h2 |\n| --- | --- |\n| 1 | 2 |", ""]
    df = spark.createDataFrame([(1, 1, 0, [["h"], ["1"]]), (1, 2, 0, [["h "], ["2"]]), (1, 3, 0, [["h"], ["3"]]), (1, 5, 0, [["h"], ["5"]])], "doc_id int, page_num int, pos int, data array<array<string>>")
    got = {r.page_num: (r.data, r.pages) for r in parse.connect_tables(df).collect()}
    assert got == {1: ([["h"], ["1"], ["2"], ["3"]], 3), 5: ([["h"], ["5"]], 1)}
    df = spark.createDataFrame([(["A", "B"], ["0", "x"])], "h array<string>, r array<string>")
    assert df.select(T.row_fields(F.col("h"), F.col("r"))).first()[0] == "B：x"


def test_layout(spark):
    chars = spark.createDataFrame([(1, 1, x, 600.0) for x in (50.0, 52.0, 300.0, 310.0)], "doc_id int, page_num int, x0 double, page_width double")
    assert [(r.left, r.right) for r in parse.column_intervals(chars).orderBy("column_no").collect()] == [(20, 80), (270, 330)]
    blocks = spark.createDataFrame([(1, 1, 0, "Alpha beta"), (1, 2, 0, "gamma."), (1, 2, 1, "Delta")], "doc_id int, page_num int, block_no int, content string")
    got = [(r.page_num, r.content, r.pages) for r in parse.connect_paragraphs(blocks).orderBy("para_no").collect()]
    assert got == [(1, "Alpha beta gamma.", 2), (2, "Delta", 1)]


def test_markdown(spark):
    md = "intro *one*\nline two\n\n## Head **x**\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n<table><tr><td>p</td></tr>\n</table>\n| alone |\nend"
    sections, tables = parse.markdown_sections(spark.createDataFrame([(1, md)], "doc_id int, text string"))
    assert [(r.text, r.kind) for r in sections.orderBy("line_no").collect()][:2] == [("intro one line two", "paragraph"), ("Head x", "heading_2")]
    assert [r.data for r in tables.orderBy("line_no").collect()] == [[["a", "b"], ["1", "2"]], [["p"]]]


def test_html():
    assert parse.html_to_text("<html><script>x</script><nav>n</nav><p>a &amp; b</p><!-- c --><p>d</p></html>") == "a & b\nd"


def test_chunks(spark):
    assert "".join(values(spark, ["x" * 1300], lambda c: chunk.fixed(c, overlap=0))[0]) == "x" * 1300
    assert [len(c) for c in values(spark, ["x" * 1300], chunk.fixed)[0]] == [512, 512, 436]
    assert values(spark, ["a. b. c. d. e. f."], chunk.sentence) == [["a.b.c.d.e.", "f."]]
    none = chunk.chunk(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id int, text string"))
    assert none.count() == 0 and chunk.statistics(none).first().asDict() == {"total_chunks": 0, "avg_tokens": 0, "min_tokens": 0, "max_tokens": 0, "total_tokens": 0}


def test_rewrite(spark):
    q = rewrite.QueryRewriter()
    out = q.rewrite("世运电子的主要业务是什么？")
    assert out == "世运电子的主要(业务 OR 业务范围 OR 主营业务 OR 经营范围)是什么？"
    assert set(lexical.parse_or_query(out)) == {"业务", "业务范围", "主营业务", "经营范围", "世运电子的主要是什么"}
    assert q.keywords("世运电子的主要业务是什么？") == ["世运电子的主要业务是什么"] and q.sub_queries("世运") == ["世运"]
    assert q.rewrite("营收增长").count("(") == 1  # groups don't nest
    assert q.rewrite("x", "simplify") == "x" and q.rewrite(None) == ""
    q.add_synonyms("新词", ["别名"])
    assert "(新词 OR 别名)" in q.rewrite("新词")
    assert values(spark, ["营收增长和公司"], rewrite.rewrite_column) == [rewrite.QueryRewriter().rewrite("营收增长和公司")]


def test_scores(spark):
    v = spark.createDataFrame([("A", 0.9), ("B", 0.5)], "doc_id string, score double")
    k = spark.createDataFrame([("B", 0.9), ("C", 0.5)], "doc_id string, keyword_score double")
    got = {r.doc_id: round(r.final_score, 6) for r in hybrid.fuse(v, k, 0.7, 0.3).collect()}
    assert got == {"A": 0.72, "C": 0.4, "B": 0.34}
    one = spark.createDataFrame([("A", 0.9)], "doc_id string, score double")
    assert {r.doc_id: round(r.final_score, 6) for r in hybrid.fuse(one, k.where("doc_id = 'C'"), 0.7, 0.3).collect()} == {"A": 0.08, "C": 0.4}
    assert {r.doc_id: round(r.final_score, 6) for r in hybrid.fuse(v.where("false"), k).collect()} == {"B": 0.72, "C": 0.4}
    n = lexical.normalize(spark.createDataFrame([(4.0,), (2.0,)], "score double"))
    assert sorted(round(r.keyword_score, 6) for r in n.collect()) == [0.5, 0.9]
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"], ["a", "b"], ["b", "c"])], "q array<string>, d array<string>, x array<string>, y array<string>")
    r = df.select(V.token_similarity(F.col("q"), F.col("d")), V.jaccard(F.col("x"), F.col("y")), V.jaccard(F.array().cast("array<string>"), F.col("x"))).first()
    assert abs(r[0] - 2 / 3) < 1e-6 and abs(r[1] - 1 / 3) < 1e-9 and r[2] == 0
    with pytest.raises(ValueError):
        lexical.bm25(lexical.postings(spark.createDataFrame([(1, "ab")], "doc_id int, text string")), ["ab"], "other")
    assert lexical.bm25(lexical.postings(spark.createDataFrame([], "doc_id int, text string")), ["ab"]).count() == 0


def test_prompt(spark):
    hits = spark.createDataFrame([("q", 1, "a" * 20, "d", 0.5), ("q", 2, "b" * 20, "d", 0.5)], "question string, rank int, content string, document_name string, score double")
    got = prompt.format_documents(hits, 10).first().context
    assert got == "[文档1] (来源...." or (len(got) == 13 and got.endswith("..."))
    assert prompt.template("nope") == prompt.TEMPLATES["simple"]
    assert prompt.extractive_answer(hits).first().answer == "a" * 20
    assert spark.range(1).select(prompt.fill("conversation", F.lit("C"), F.lit("Q"))).first()[0].count(prompt.NO_HISTORY) == 1


def test_config(monkeypatch):
    assert Config(vector_weight=3.0, keyword_weight=1.0).weights() == (0.75, 0.25)
    assert Config(vector_weight=0.6, keyword_weight=0.405).weights() == (0.6, 0.405)
    assert Config(top_k=0, recall_k=0).sizes() == (1, 1) and Config(top_k=7, recall_k=3).sizes() == (7, 7)


def test_vectors(spark):
    rows = [(i, [float(i), 1.0, 0.0], "a" if i % 2 else "b") for i in range(10)] + [(10, None, "a"), (11, [1.0], "a"), (12, [0.0, 0.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, kb_id string")
    got = [r.vec_id for r in vector.knn(df, [1.0, 0.0, 0.0], 3).orderBy("rank").collect()]
    assert got == [9, 8, 7]
    assert [r.vec_id for r in vector.knn(df, [1.0, 0.0, 0.0], 2, condition=vector.request_filters(kb_ids=["a"])).orderBy("rank").collect()] == [9, 7]
    assert vector.knn(df, [1.0, 0.0, 0.0], 5, threshold=0.99).count() == 2
    near = {r.vec_id for r in vector.knn(df, [0.0, 1.0, 0.0], 4).collect()}
    assert near < {r.vec_id for r in vector.knn(df, [0.0, 1.0, 0.0], 5).collect()}


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vector.CoarseIndex(lists=16, probes=8).fit(df)
    table = index.index(df).cache()
    assert table.count() == df.count()
    hit = 0
    for q in df.where("vec_id % 50 = 0").collect():
        v = [float(x) for x in q.embedding]
        hit += len({r.vec_id for r in index.search(table, v, 10).collect()} & {r.vec_id for r in vector.knn(df, v, 10).collect()})
    assert hit / (10 * df.where("vec_id % 50 = 0").count()) >= 0.9


def test_embed_and_search(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "dogs chase cats daily"), (3, None), (4, "the cat sat on the mat")], "doc_id int, text string")
    rows = pipeline.ingest(docs)
    assert rows.count() == 3 and embed.usable(rows).count() == 3
    stats = pipeline.statistics(parse.simple_blocks(docs), rows).first()
    assert (stats.blocks, stats.chunks, stats.vectors) == (3, 3, 3)
    keyed = rows.withColumn("chunk_key", F.concat_ws("-", "doc_id", "chunk_index"))
    found = pipeline.search(keyed, "cat mat", embed.HashingEmbedder()).collect()
    assert found and found[0].doc_id == 1
    broken = type("Broken", (), {"encode": lambda self, t: 1 / 0})
    assert embed.usable(embed.vectorise(rows.drop("vector"), broken)).count() == 0
    hits = rows.select("doc_id", "content", F.col("vector").alias("embedding"), F.lit(0.5).alias("final_score"))
    assert hybrid.Reranker(remote=lambda q, t: [len(x) for x in t]).rerank(hits, "q").first().rerank_score > 20
    assert hybrid.Reranker().available_method() == "vector_similarity"


def docx(parts):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{parts}</w:body></w:document>")
    return out.getvalue()


def xlsx(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else f"<c><v>{x}</v></c>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="s" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(f'<row>{"".join(map(cell, r))}</row>' for r in rows)}</sheetData></worksheet>")
    return out.getvalue()


def test_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (tmp_path / "a.docx").write_bytes(docx(p("One ") + p(" ") + f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>"))
    (tmp_path / "b.xlsx").write_bytes(xlsx([["A", "B"], [0, "x"], [2, ""]]))
    (tmp_path / "c.txt").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "d.unknown").write_bytes("é".encode())
    (tmp_path / "e.xlsx").write_bytes(b"no zip")
    got = {r.file_name: r for r in files.load(files.read(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "One" and got["a.docx"].tables == ["0 | 1\n--- | ---\nx | y"]
    assert got["b.xlsx"].text == "B：x\nA：2" and got["c.txt"].text == "中文内容" and got["d.unknown"].text == "é"
    assert got["e.xlsx"].text is None and got["e.xlsx"].error
    texts = {r.file_name: r[1] for r in files.read(spark, str(tmp_path)).select("file_name", files.text(F.col("content"))).collect()}
    assert texts["c.txt"] == "中文内容" and texts["d.unknown"] == "é"
    assert files.quick(files.load(files.read(spark, str(tmp_path)))).count() == 5


def test_store_and_stream(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    assert not store.exists() and store.count() == 0
    store.upsert(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, chunk_index int, content string"))
    store.upsert(spark.createDataFrame([(1, 0, "new"), (3, 0, "d")], "doc_id int, chunk_index int, content string"))
    assert store.count() == 4 and store.read().where("doc_id = 1 and chunk_index = 0").first().content == "new"
    store.delete({"doc_id": [2, 3]})
    assert {(r.doc_id, r.chunks) for r in store.documents().collect()} == {(1, 2)}
    store.delete_document(1)
    assert store.exists() and store.count() == 0
    store.drop()
    assert not store.exists()

    incoming = tmp_path / "in"
    incoming.mkdir()
    (incoming / "a.txt").write_text("A first file that has some words to keep.")
    live = ChunkStore(spark, str(tmp_path / "live"))
    for _ in range(2):
        ingest.ingest_stream(spark, str(incoming), live, str(tmp_path / "cp"), embed.HashingEmbedder, status=str(tmp_path / "status"), events=str(tmp_path / "events")).awaitTermination()
        (incoming / "b.txt").write_text("And a second file came later on.")
    paths = {f"file:{incoming}/{n}.txt" for n in "ab"}  # whole paths: files of one name in two folders are two documents
    assert {r.doc_id for r in live.read().collect()} == paths
    assert {(r.doc_id, r.state) for r in spark.read.parquet(str(tmp_path / "status")).collect()} == {(p, "done") for p in paths}
    assert {(r.doc_id, r.event) for r in spark.read.parquet(str(tmp_path / "events")).collect()} == {(p, e) for p in paths for e in ("started", "done")}


def test_synonyms(spark, tmp_path):
    (tmp_path / "a.yml").write_text("业务:\n  - 主营业务\n  - 经营范围\n", encoding="utf-8")
    (tmp_path / "b.yml").write_text("业务: [经营范围, 新]\n公司: 企业\n", encoding="utf-8")
    t = SynonymTable.load(str(tmp_path))
    assert t.get("业务") == ["主营业务", "经营范围", "新"] and t.get("公司") == ["企业"] and t.get("x") == []
    t.save(str(tmp_path / "c.yml"))
    assert SynonymTable.load(str(tmp_path)).entries == t.entries
    out = lexical.expand_synonyms(spark.createDataFrame([("主营业务",), ("无",)], "term string"), t.frame(spark))
    assert {r.expanded for r in out.where("term = '主营业务'").collect()} == {"主营业务", "业务", "经营范围", "新"}
