"""DuckDB queries with the rows of the catalogue's queries, written apart from them; word lists and noise patterns, which are given, are shared."""

from __future__ import annotations

from lectern.functions.text import NOISE_LINES as NOISE_PATTERNS
from lectern.functions.text import NOISE_WORDS
from lectern.operators.rewrite import STOP_WORDS, SYNONYMS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CJK = r"[\x{4e00}-\x{9fff}]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL = r"https?://(?:[-\p{L}\p{N}_.]|(?:%[\da-fA-F]{2}))+[^\s]*|www\.[-\p{L}\p{N}_.]+[^\s]*"
NUMBER = r"\b\d+(?:\.\d+)?\b"
KEPT = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\p{L}\p{N}_\s.,!?;:''\"()\[\]{}<>/\\|\-=+*&^$#@~`"


def tok(c: str) -> str:
    n = f"len(regexp_extract_all({c}, '{CJK}'))"
    return f"CAST(floor({n} / 1.5 + (length({c}) - {n}) / 4.0) AS INT)"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def noise_pattern(c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in NOISE_PATTERNS) + ")"


def noise(c: str) -> str:
    hits = " + ".join(f"contains(lower({c}), {quoted(w.lower())})::INT" for w in NOISE_WORDS)
    return rf"({c} = '' OR ({hits}) / greatest(length({c}) / 20.0, 1.0) > 0.3 OR regexp_full_match({c}, '[^\p{{L}}\p{{N}}]+'))"


def cleaned(c: str) -> str:
    c = f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    c = f"regexp_replace({c}, '[ \\t]+', ' ', 'g')"
    c = f"array_to_string(list_transform(string_split({c}, chr(10)), lambda x: {strip('x')}), chr(10))"
    c = f"regexp_replace({c}, '[^{KEPT}]', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: {strip('x')}), lambda x: length(x) >= 2 AND NOT {noise_pattern('x')}), chr(10))"


TOKEN_COUNT = f"SELECT doc_id, {tok('text')} AS tokens FROM documents"
CLEAN_LINES = f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, {cleaned('text')} AS c FROM documents)"
NOISE_LINES = f"SELECT doc_id, len(list_filter(l, lambda x: {noise('x')})) AS noise, len(list_filter(l, lambda x: {noise_pattern('x')})) AS patterns FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def masked(pattern: str, by: str, table: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    return f"SELECT {key}, md5(regexp_replace({column}, '{pattern}', '{by}', 'g')) AS digest FROM {table}"


SPECIAL_CHARS = f"SELECT doc_id, md5(regexp_replace(text, '[^{KEPT}]', '', 'g')) AS digest, md5(regexp_replace(text, '[^{KEPT}%]', '', 'g')) AS kept_percent FROM documents"
TRUNCATE = "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS short FROM documents"
TEXT_IDS = "SELECT doc_id, 'vec_' || substr(md5(substr(text, 1, 100)), 1, 16) AS text_id, 'chunk_0_' || substr(md5('0_' || substr(text, 1, 100)), 1, 16) AS chunk_id FROM documents"
MARKDOWN_INLINE = "SELECT * FROM (VALUES (1, 'A bold move'), (2, 'see this and code'), (3, 'tag two blanks'), (4, 'x y plain')) t(id, clean)"
TABLE_MARKDOWN = "SELECT n_nationkey, '| name | region |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_name || ' | ' || n_regionkey || ' |' AS markdown FROM nation"
HTML_LINKS = r"""
SELECT page_id, array_to_string(list_concat(['item'], list_filter(list_transform(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1),
  lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\*\*([^*]+)\*\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '_([^_]+)_', '\1', 'g'), '\$[^$]+\$', '', 'g'), '\', ''), '*', ''), '_', ''), '\s+', ' ', 'g'))), lambda x: x <> '')), '|') AS cells
FROM pages"""
PIPE_TABLE = "SELECT n_nationkey, 'name,key;' || replace(n_name, '_', '') || ',' || n_nationkey || ';lone,' AS grid FROM nation"
ROW_FIELDS = "SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN '' ELSE 'key：' || s_suppkey || '; ' END || CASE WHEN s_suppkey % 3 > 0 THEN 'acctbal：5; ' ELSE '' END || s_name AS line FROM supplier"

BLOCKS = r"WITH b AS (SELECT doc_id, i - 1 AS block_no, l[i] AS content, CAST(floor((i - 1) / 4) AS INT) + 1 AS page_num FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(l[i], '[^\s\p{Z}]'))"
PARAGRAPHS = (
    BLOCKS
    + r""", m AS (SELECT *, CASE WHEN coalesce(lag(regexp_matches(content, '[。！？.!?]$')) OVER w, true) OR regexp_matches(content, '^(\s+|[A-Z]|\d+\.|[一二三四五六七八九十]、|第[一二三四五六七八九十]+章)') THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, block_no)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page_num, block_no) AS para_no FROM m)
SELECT doc_id, para_no::INT AS para_no, min(page_num) AS page_num, count(*)::INT AS members, count(DISTINCT page_num)::INT AS pages, md5(string_agg(content, ' ' ORDER BY page_num, block_no)) AS digest FROM g GROUP BY doc_id, para_no"""
)
PAGE_TEXT = BLOCKS + ", p AS (SELECT doc_id, page_num, string_agg(content, chr(10) ORDER BY block_no) AS t FROM b GROUP BY doc_id, page_num) SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY page_num)) AS digest FROM p GROUP BY doc_id"
CHARS = "WITH c AS (SELECT doc_id, i, ((doc_id * 31 + i * i * 17) % 600)::DOUBLE AS x0, ((i * 7) % 23)::DOUBLE AS y0 FROM documents, range(0, 20) r(i))"
COLUMNS = """, u AS (SELECT DISTINCT doc_id, round_even(x0 / 50, 0) * 50 AS x FROM c),
k AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY x) AS n FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) > 100 THEN 1 ELSE 0 END AS gap FROM u)),
s AS (SELECT doc_id, n::INT AS column_no, min(x) AS lo, max(x) AS hi, count(*) OVER (PARTITION BY doc_id) AS many FROM k GROUP BY doc_id, n),
cols AS (SELECT doc_id, column_no, CASE WHEN many > 1 THEN greatest(0.0::DOUBLE, lo - 30) ELSE 0.0::DOUBLE END AS x_left, CASE WHEN many > 1 THEN least(600.0::DOUBLE, hi + 30) ELSE 600.0::DOUBLE END AS x_right FROM s)"""
LAYOUT_COLUMNS = CHARS + COLUMNS + " SELECT * FROM cols"
LAYOUT_LINES = (
    CHARS
    + COLUMNS
    + """, lines AS (SELECT doc_id, round_even(y0 / 5, 0) * 5 AS y0, arg_min(x0, (x0, i)) AS x0, arg_max(x0 + 5, (x0, i)) AS x1, string_agg(i::VARCHAR, '' ORDER BY x0, i::VARCHAR) AS content FROM c GROUP BY 1, 2)
SELECT l.doc_id, y0, l.x0, x1, content, coalesce(min(column_no), 0) AS column_no FROM lines l LEFT JOIN cols k ON l.doc_id = k.doc_id AND l.x0 BETWEEN x_left AND x_right GROUP BY ALL"""
)
CROSS_PAGE_TABLES = """
WITH r AS (SELECT n_regionkey AS doc_id, n_nationkey % 7 AS page_num, min({'h': 'h' || (n_nationkey % 2), 'n': n_name}) AS t FROM nation GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN lag(page_num) OVER w = page_num - 1 AND lag(t.h) OVER w = t.h THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page_num) AS c FROM m)
SELECT doc_id, min(page_num) AS page_num, count(*)::INT AS pages, any_value(t.h) || ',' || string_agg(t.n, ',' ORDER BY page_num) AS cells FROM g GROUP BY doc_id, c"""
MARKDOWN_SECTIONS = r"""
WITH d AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '[|#*_`<>\[\]]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l FROM documents),
b AS (SELECT doc_id, i, l[i] AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
g AS (SELECT *, sum((x = '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM b),
s AS (SELECT doc_id, p, string_agg(x, ' ' ORDER BY i) AS t FROM g WHERE x <> '' GROUP BY doc_id, p)
SELECT doc_id, 'heading_1' AS kind, 1 AS n, md5('head ' || doc_id) AS digest FROM documents
UNION ALL SELECT doc_id, 'paragraph', count(*), md5(string_agg(t, chr(10) ORDER BY t)) FROM s GROUP BY doc_id"""
PARSE_DOCUMENTS = (
    BLOCKS
    + f""", p AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY block_no) AS t FROM b GROUP BY doc_id),
c AS (SELECT doc_id, array_to_string(list_filter(string_split({cleaned('t')}, chr(10)), lambda x: NOT {noise('x')}), chr(10)) AS t FROM p)
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM c"""
)
FILE_KINDS = r"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'excel' ELSE 'text' END AS kind FROM pages"

FIXED = r"""WITH c AS (SELECT doc_id, lang, i::INT AS chunk_index, substr(text, i * 432 + 1, 512) AS content
FROM (SELECT *, unnest(range(0, greatest(0, ceil((length(text) - 512) / 432.0))::BIGINT + 1)) AS i FROM documents WHERE text <> ''))"""
CHUNK_OUT = f" SELECT doc_id, chunk_index, 'chunk_' || chunk_index || '_' || substr(md5(chunk_index || '_' || substr(content, 1, 100)), 1, 16) AS chunk_id, {tok('content')} AS token_count, md5(content) AS digest FROM c WHERE regexp_matches(content, '[^\\s\\p{{Z}}]')"
CHUNK_FIXED = FIXED + CHUNK_OUT
CHUNK_SENTENCE = (
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE text <> ''),
c AS (SELECT doc_id, i::INT AS chunk_index, array_to_string(l[i * 5 + 1 : i * 5 + 5], '') AS content FROM (SELECT *, unnest(range(0, ((len(l) - 1) // 5) + 1)) AS i FROM s))"""
    + CHUNK_OUT
)
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", "，", ", ", " "]


def _cut_up(source: str) -> str:
    """CTE r(doc_id, k, pos, p, leaf): rows (doc_id, k, p) of a source cut until every leaf has at most 256 tokens."""
    places = "list_filter(list_transform([" + ", ".join(quoted(x).replace("\n", "' || chr(10) || '") for x in SEPARATORS) + f"], lambda x: {{'a': strpos(p, x), 'w': length(x)}}), lambda y: y.a > 0 AND {tok('substr(p, 1, y.a - 1)')} >= 20)[1]"
    return f"""r AS (SELECT doc_id, k, 1::BIGINT AS pos, p, {tok('p')} <= 256 AS leaf FROM {source} UNION ALL
SELECT doc_id, k, pos2, p2, {tok('p2')} <= 256 FROM (SELECT doc_id, k, unnest([pos, pos + coalesce(y.a + y.w - 1, length(p) // 2)]) AS pos2, unnest([substr(p, 1, coalesce(y.a - 1, length(p) // 2)), substr(p, coalesce(y.a + y.w, length(p) // 2 + 1))]) AS p2 FROM (SELECT *, {places} AS y FROM r WHERE NOT leaf))),
c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, pos) - 1)::INT AS chunk_index, p AS content FROM r WHERE leaf)"""


def _folded(items: str, step: str, source: str = "documents") -> str:
    """CTEs l(doc_id, l) and g: a fold over a list, with the state (i, held, n, k); u has every k's last state."""
    return f"""WITH RECURSIVE l AS (SELECT doc_id, {items} AS l FROM {source}),
g AS (SELECT doc_id, 0::BIGINT AS i, '' AS held, 0 AS n, 0 AS k, false AS big FROM l UNION ALL SELECT {step} FROM g JOIN l USING (doc_id) WHERE i < len(l)),
u AS (SELECT doc_id, k, arg_max(held, i) AS p FROM g GROUP BY doc_id, k HAVING arg_max(held, i) <> '')"""


_INDEXED = "c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, p AS content FROM u)"
CHUNK_RECURSIVE = "WITH RECURSIVE d AS (SELECT doc_id, 0 AS k, text AS p FROM documents WHERE text <> ''), " + _cut_up("d") + CHUNK_OUT
CHUNK_PROCESS = (
    f"WITH RECURSIVE d AS (SELECT doc_id, 0 AS k, {cleaned('text')} AS p FROM documents), e AS (SELECT * FROM d WHERE p <> ''), " + _cut_up("e")
    + CHUNK_OUT.replace("md5(content) AS digest", "content") + f" AND NOT {noise('content')}"
)
CHUNK_NAIVE = _folded("string_split(text, chr(10))", f"doc_id, i + 1, CASE WHEN n > 128 THEN l[i + 1] ELSE held || l[i + 1] END, CASE WHEN n > 128 THEN 0 ELSE n END + {tok('l[i + 1]')}, k + (n > 128)::INT, false") + ", " + _INDEXED + CHUNK_OUT
CHUNK_DELIMITED = (
    _folded("regexp_extract_all(text, '[^\\n!?;。；！？]+|[\\n!?;。；！？]')", "doc_id, i + 1, CASE WHEN w THEN x ELSE held || x END, CASE WHEN w THEN 0 ELSE n END + length(x) // 2, k + w::INT, false")
    .replace("FROM g JOIN l USING (doc_id) WHERE i < len(l))", "FROM (SELECT *, l[i + 1] AS x, n + length(l[i + 1]) // 2 > 128 AND held <> '' AS w FROM g JOIN l USING (doc_id) WHERE i < len(l)))")
    + ", " + _INDEXED + CHUNK_OUT
)
_PARAGRAPHS = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n', chr(10) || ' ' || chr(10), 'g'), '\n[\s\p{{Z}}]*\n', chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
CHUNK_PARAGRAPH = (
    _folded(_PARAGRAPHS, "doc_id, i + 1, CASE WHEN w OR held = '' THEN x ELSE held || chr(10) || x END, 0, k + w::INT, now")
    .replace("FROM g JOIN l USING (doc_id) WHERE i < len(l))", f"FROM (SELECT *, now OR (held <> '' AND (big OR {tok('held || chr(10) || x')} > 256)) AS w FROM (SELECT *, l[i + 1] AS x, {tok('l[i + 1]')} > 256 AS now FROM g JOIN l USING (doc_id) WHERE i < len(l))))")
    + ", " + _cut_up("u") + CHUNK_OUT
)
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"


def _semantic(near: str, threshold: float) -> str:
    """Chunks of sentences; near: likeness of sentences x and y."""
    fold = _folded(_SENTENCES, "doc_id, i + 1, CASE WHEN w THEN y ELSE held || y END, 0, k + w::INT, false")
    return fold.replace("FROM g JOIN l USING (doc_id) WHERE i < len(l))", f"FROM (SELECT *, i > 0 AND {near} < {threshold} AND {tok('held')} >= 20 AS w FROM (SELECT *, l[i] AS x, l[i + 1] AS y FROM g JOIN l USING (doc_id) WHERE i < len(l))))") + ", " + _INDEXED + CHUNK_OUT


_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_LETTERS = "[" + ", ".join(f"(length({{0}}) - length(replace(lower({{0}}), '{c}', '')))::DOUBLE" for c in "aeiou") + "]"
CHUNK_SEMANTIC = _semantic(f"CASE WHEN len({_WORDS.format('x')}) = 0 OR len({_WORDS.format('y')}) = 0 THEN 0.0 ELSE len(list_intersect({_WORDS.format('x')}, {_WORDS.format('y')})) / len(list_distinct(list_concat({_WORDS.format('x')}, {_WORDS.format('y')})))::DOUBLE END", 0.7)
CHUNK_SEMANTIC_VECTORS = _semantic(f"CASE WHEN list_sum({_LETTERS.format('x')}) = 0 OR list_sum({_LETTERS.format('y')}) = 0 THEN 0.0 ELSE list_cosine_similarity({_LETTERS.format("coalesce(x, 'a')")}, {_LETTERS.format('y')}) END", 0.95)
CHUNK_SECTIONS = (
    _folded("list({'t': coalesce(text, ''), 'g': '@' || role} ORDER BY turn)", "doc_id, i + 1, CASE WHEN w THEN '' ELSE held END || x.t || CASE WHEN m >= 8 AND NOT contains(CASE WHEN w THEN x.t ELSE held END, x.g) THEN x.g ELSE '' END, CASE WHEN w THEN 0 ELSE n END + m, k + w::INT, false", "(SELECT conv_id AS doc_id, text, role, turn FROM conversations) GROUP BY doc_id")
    .replace("FROM g JOIN l USING (doc_id) WHERE i < len(l))", f"FROM (SELECT *, n > 128 AS w, {tok('x.t')} AS m FROM (SELECT *, l[i + 1] AS x FROM g JOIN l USING (doc_id) WHERE i < len(l))))")
    + ", " + _INDEXED + " SELECT doc_id, chunk_index, md5(content) AS digest FROM c"
)
CHUNK_STATS = FIXED + f", k AS (SELECT lang, {tok('content')} AS t FROM c WHERE regexp_matches(content, '[^\\s\\p{{Z}}]')) SELECT lang, count(*) AS total_chunks, round(avg(t), 6) AS avg_tokens, min(t) AS min_tokens, max(t) AS max_tokens, sum(t)::BIGINT AS total_tokens FROM k GROUP BY lang"

JSON_SECTIONS = """WITH e AS (SELECT event_id, event_id::VARCHAR AS i, props AS p, '{"item_0": "' || event_type || '", "item_1": {"item_0": ' || user_id || ', "item_1": {"v": ' || (event_id % 7) || '}}, "item_2": {}}' AS t FROM events),
f AS (SELECT *, length(i) + length(p) > 50 AS a FROM e), g AS (SELECT *, CASE WHEN a THEN 0 ELSE length(i) END + length(p) + length(t) > 50 AS b FROM f)
SELECT event_id, '{"id": ' || i || CASE WHEN a THEN '};{' ELSE ', ' END || '"props": ' || p || CASE WHEN b THEN '};{' ELSE ', ' END || '"tags": ' || t || '}' AS sections FROM g"""
NAME_PAIRS = """WITH w AS (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM part UNION SELECT substr(lower(p_name), 2, 4) FROM part), n AS (SELECT DISTINCT lower(p_name) AS name FROM part)
SELECT name, word FROM n, w WHERE contains(name, word) OR contains(word, name)"""
_SPANS = "s AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY l_orderkey)"
IN_TRANSIT = f"WITH {_SPANS}, d AS (SELECT DISTINCT o_orderdate AS day FROM orders) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, min(l_orderkey) AS least FROM d JOIN s ON day BETWEEN a AND b GROUP BY day"
FIRST_IN_TRANSIT = f"WITH {_SPANS} SELECT o.o_orderkey, min(s.l_orderkey) AS l_orderkey FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey JOIN s ON s.l_orderkey = p.o_orderkey AND o.o_orderdate BETWEEN a AND b GROUP BY o.o_orderkey"

POSTS = r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x{4e00}-\x{9fff}A-Za-z0-9\s]', ' ', 'g') AS k FROM documents),
l AS (SELECT doc_id, list_distinct(list_concat(list_concat(regexp_extract_all(k, '[\x{4e00}-\x{9fff}]{2,}'), regexp_extract_all(lower(k), '[a-z]{2,}')), regexp_extract_all(k, '[0-9]+'))) AS terms FROM t),
p AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM l WHERE len(terms) > 0),
d AS (SELECT doc_id, len(terms) AS length FROM l WHERE len(terms) > 0),
s AS (SELECT count(*)::DOUBLE AS n, avg(length) AS a FROM d),
f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term)"""
TOKENIZE = POSTS + " SELECT doc_id, len(terms)::INT AS n, md5(array_to_string(list_sort(terms), ' ')) AS digest FROM l"
DOC_FREQ = POSTS + " SELECT term, df::BIGINT AS df FROM f"
POSTINGS_LEN = POSTS + " SELECT doc_id, length::INT AS length FROM d"


def scores(variant: str, terms: list[str], combine: str = "sum", more: list[str] | None = None) -> str:
    """CTEs that end in r(doc_id, score)."""
    q = ", ".join(f"({quoted(t)}, 1.0::DOUBLE)" for t in sorted(set(terms))) + "".join(f", ({quoted(t)}, 0.8::DOUBLE)" for t in more or [])
    idf = {
        "okapi": "CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) FROM f, s) ELSE ln(n - df + 0.5) - ln(df + 0.5) END",
        "plus": "ln((n + 1) / df)",
        "l": "ln(n + 1) - ln(df + 0.5)",
    }[variant]
    ratio = "(0.25 + 0.75 * d.length / a)"
    part = {
        "okapi": f"CASE WHEN p.term IS NULL THEN 0 ELSE 2.5 / (1.5 * {ratio} + 1) END",
        "plus": f"1 + CASE WHEN p.term IS NULL THEN 0 ELSE 2.5 / (1.5 * {ratio} + 1) END",
        "l": f"2.5 * (CASE WHEN p.term IS NULL THEN 0 ELSE 1 / {ratio} END + 0.5) / (1.5 + CASE WHEN p.term IS NULL THEN 0 ELSE 1 / {ratio} END + 0.5)",
    }[variant]
    return POSTS + f""", q(term, weight) AS (VALUES {q}), i AS (SELECT f.term, ({idf}) * weight AS idf FROM f JOIN q USING (term), s),
r AS (SELECT d.doc_id, {combine}(idf * ({part})) AS score FROM d CROSS JOIN i CROSS JOIN s LEFT JOIN p ON p.doc_id = d.doc_id AND p.term = i.term GROUP BY d.doc_id HAVING {combine}(idf * ({part})) > 0)"""


def bm25(variant: str, terms: list[str], combine: str = "sum", more: list[str] | None = None) -> str:
    return scores(variant, terms, combine, more) + " SELECT doc_id, round(score, 6) AS score FROM r"


def normalized(variant: str, terms: list[str]) -> str:
    return scores(variant, terms) + ", e AS (SELECT min(score) AS lo, max(score) AS hi FROM r) SELECT doc_id, round(greatest(0.05, least(0.95, 0.1 + 0.8 * score / hi)), 6) AS keyword_score, round(CASE WHEN hi > lo THEN 0.1 + 0.8 * (score - lo) / (hi - lo) ELSE 0.5 END, 6) AS normalized FROM r, e"


def top_bm25(variant: str, terms: list[str], k: int) -> str:
    return scores(variant, terms, "max") + f", e AS (SELECT max(score) AS hi FROM r) SELECT doc_id, round(score, 6) AS score, round(greatest(0.05, least(0.95, 0.1 + 0.8 * score / hi)), 6) AS keyword_score FROM r, e ORDER BY r.score DESC, doc_id LIMIT {k}"


SYNONYM_EXPAND = """
WITH t AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS term FROM part),
y(word, synonyms) AS (VALUES ('part', ['piece', 'item']), ('small', ['tiny', 'little']), ('brass', ['metal', 'copper']), ('economy', ['standard'])),
h AS (SELECT term, word, synonyms, contains(term, word) OR contains(word, term) AS byword, len(list_filter(synonyms, lambda s: contains(term, s) OR contains(s, term))) > 0 AS bysyn FROM t, y)
SELECT DISTINCT term, expanded FROM (SELECT term, term AS expanded FROM t UNION ALL SELECT term, unnest(CASE WHEN bysyn THEN list_concat([word], synonyms) ELSE synonyms END) FROM h WHERE byword OR bysyn)"""


def _rewrites() -> str:
    rows, words = [(1, "公司的主要业务是什么"), (2, "毛利率和营收增长"), (3, "plain words"), (4, "产品与市场，以及客户群体")], sorted(SYNONYMS, key=lambda w: (-len(w), w))
    c = "q"
    for i, w in enumerate(words):
        c = f"replace({c}, {quoted(w)}, chr(1) || '{i}' || chr(2))"
    for i, w in enumerate(words):
        c = f"replace({c}, chr(1) || '{i}' || chr(2), {quoted('(' + ' OR '.join([w, *SYNONYMS[w]]) + ')')})"
    values = ", ".join(f"({i}, {quoted(q)})" for i, q in rows)
    stops = ", ".join(map(quoted, STOP_WORDS))
    return f"SELECT id, {c} AS rewritten, array_to_string(list_filter(regexp_extract_all(q, '{CJK}{{2,}}'), lambda w: w NOT IN ({stops}))[1:5], '|') AS keywords FROM (VALUES {values}) t(id, q)"


REWRITES = _rewrites()
KEYWORD_OVERLAP = "SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'des')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), '2.0')::INT) / 4.0::DOUBLE, 6) AS overlap FROM documents"
JACCARD = POSTS + " SELECT a.doc_id, round(CASE WHEN len(a.terms) = 0 OR b.terms IS NULL OR len(b.terms) = 0 THEN 0.0 ELSE len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms)))::DOUBLE END, 6) AS jaccard FROM l a JOIN l b ON b.doc_id = a.doc_id + 1"


def share(terms: list[str], column: str = "terms") -> str:
    hits = " + ".join(f"list_contains({column}, {quoted(t)})::INT" for t in terms)
    return f"(({hits}) + 1e-9::DOUBLE) / ({len(terms)} + 1e-9::DOUBLE)"


TOKEN_SIMILARITY = POSTS + f" SELECT doc_id, round({share(['the', 'the', 'les', 'tion', 'zzz'])}, 6) AS similarity FROM l"

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def knn(k: int, where: str = "true", threshold: float | None = None) -> str:
    cut = f" WHERE score >= {threshold}" if threshold is not None else ""
    return f"SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {where.replace('label', 'e.label')}){cut} ORDER BY rank LIMIT {k}"


KNN_BATCH = f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5"
VECTOR_NORMS = "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(embedding)::INT AS dim FROM embeddings"

_TOKENS = r"list_distinct(list_concat(list_concat(regexp_extract_all({c}, '[\x{{4e00}}-\x{{9fff}}]{{2,}}'), regexp_extract_all(lower({c}), '[a-z]{{2,}}')), regexp_extract_all({c}, '[0-9]+')))"


def _question_terms(text: str, source: str = "benchmark", key: str = "item_id") -> str:
    """CTE qt(question, term) of the rows of a table with the text `text`."""
    rest = r"regexp_replace(regexp_replace(x, '\([^()]+\)', '', 'g'), '[^\x{4e00}-\x{9fff}A-Za-z0-9\s]', ' ', 'g')"
    return rf"""qx AS (SELECT {key} AS question, {text} AS x FROM {source}),
ql AS (SELECT question, list_distinct(list_concat(flatten(list_transform(regexp_extract_all(x, '\(([^()]+)\)', 1), lambda g: list_transform(string_split(g, ' OR '), lambda y: trim(y)))), {_TOKENS.format(c='z')})) AS terms FROM (SELECT question, x, {rest} AS z FROM qx)),
qt AS (SELECT question, unnest(terms) AS term FROM ql)"""


BATCH_TERMS = "WITH " + _question_terms("'(' || string_split(text, ' ')[1] || ' OR ' || string_split(text, ' ')[2] || ') ' || text") + " SELECT question, count(*) AS n, md5(string_agg(term, ' ' ORDER BY term)) AS digest FROM qt GROUP BY question"


def _batch(combine: str, k: int, asked: str = "") -> str:
    """CTEs that end in kw(question, doc_id, score, rank): the k best documents of every item, or of what `asked` defines as qt."""
    return POSTS + ", " + (asked or _question_terms("text")) + f""", raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS v FROM f, s), qi AS (SELECT question, term, CASE WHEN v < 0 THEN 0.25 * (SELECT avg(v) FROM raw) ELSE v END AS idf FROM qt JOIN raw USING (term)),
sc AS (SELECT question, doc_id, {combine}(idf * 2.5 / (1.5 * (0.25 + 0.75 * length / a) + 1)) AS score FROM qi JOIN p USING (term), s GROUP BY question, doc_id),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


_NORMAL = "greatest(0.05, least(0.95, 0.1 + 0.8 * score / max(score) OVER (PARTITION BY question)))"
BATCH_BM25 = _batch("sum", 20) + f" SELECT question, doc_id, round(score, 6) AS score, round({_NORMAL}, 6) AS keyword_score, rank FROM kw"
BATCH_HYBRID = _batch("max", 10) + f""", kn AS (SELECT question, doc_id, {_NORMAL} AS ks FROM kw),
v AS (SELECT * FROM (SELECT item_id AS question, e.vec_id AS doc_id, {COS} AS score, row_number() OVER (PARTITION BY item_id ORDER BY {COS} DESC, e.vec_id) AS r FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings e) WHERE r <= 10),
vr AS (SELECT question, min(score) FILTER (WHERE score > 0) AS lo, max(score) FILTER (WHERE score > 0) AS hi FROM v GROUP BY question),
vn AS (SELECT question, doc_id, CASE WHEN score > 0 THEN greatest(0.05, least(0.95, 0.1 + (score - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * 0.8)) ELSE 0.05 END AS vs FROM v JOIN vr USING (question)),
j AS (SELECT question, doc_id, coalesce(vs, 0.0) AS vs, coalesce(ks, 0.0) AS ks FROM vn FULL JOIN kn USING (question, doc_id)),
fu AS (SELECT *, greatest(0.05, least(0.95, CASE WHEN vs > 0.05 AND ks > 0.05 THEN vs * 0.6 + ks * 0.4 WHEN vs > 0.05 THEN vs * 0.8 WHEN ks > 0.05 THEN ks * 0.8 ELSE greatest(vs, ks) * 0.5 END)) AS fs FROM j)
SELECT * FROM (SELECT question, doc_id, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, round(fs, 6) AS final_score, row_number() OVER (PARTITION BY question ORDER BY round(fs, 9) DESC, doc_id)::INT AS rank FROM fu WHERE round(fs, 9) >= 0.3) WHERE rank <= 5"""
_SHARE = "(len(list_intersect(asked, held)) + 1e-9::DOUBLE) / (len(asked) + 1e-9::DOUBLE)"
DEALER = POSTS + f""", qa AS (SELECT item_id AS question, {_TOKENS.format(c='z')} AS asked FROM (SELECT item_id, regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9\\s]', ' ', 'g') AS z FROM benchmark)),
near AS (SELECT item_id AS question, e.vec_id AS doc_id, {COS} AS vector_score FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings e WHERE e.label IN (1, 3, 5)),
first AS (SELECT *, false AS fell_back FROM near WHERE vector_score >= 0.3),
second AS (SELECT *, true AS fell_back FROM near WHERE vector_score >= 0.17 AND question NOT IN (SELECT question FROM first)),
told AS (SELECT h.*, asked, coalesce(terms, []) AS held FROM (SELECT * FROM first UNION ALL SELECT * FROM second) h JOIN qa USING (question) LEFT JOIN l USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM (SELECT *, {_SHARE} AS term_score, 0.05 * {_SHARE} + 0.95 * vector_score AS score FROM told))"""
RETRIEVAL = f""", w AS (SELECT question, doc_id, vector_score, asked, list_concat(held, {_TOKENS.format(c="coalesce(source, '')")}) AS held FROM ranked LEFT JOIN documents USING (doc_id) WHERE rank <= 128),
x AS (SELECT question, doc_id, {_SHARE} AS term_similarity, 0.7 * {_SHARE} + 0.3 * vector_score AS similarity FROM w)
SELECT * FROM (SELECT question, doc_id, round(term_similarity, 6) AS term_similarity, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY question ORDER BY round(similarity, 9) DESC, doc_id)::INT AS rank FROM x) WHERE rank BETWEEN 4 AND 6 AND similarity >= 0.1"""

_TERMS = ["the", "tion", "les", "der", "que", "license", "zzz"]
FUSE = (
    scores("okapi", _TERMS)
    + f""", v AS (SELECT doc_id, score FROM (SELECT e.vec_id AS doc_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE score >= 0.0 ORDER BY score DESC, doc_id LIMIT 200),
vr AS (SELECT min(score) AS lo, max(score) AS hi FROM v WHERE score > 0),
vn AS (SELECT doc_id, CASE WHEN score > 0 THEN greatest(0.05, least(0.95, 0.1 + (score - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * 0.8)) ELSE 0.05 END AS vs FROM v, vr),
kn AS (SELECT doc_id, greatest(0.05, least(0.95, 0.1 + 0.8 * score / (SELECT max(score) FROM r))) AS ks FROM r ORDER BY round(score, 9) DESC, doc_id LIMIT 200),
j AS (SELECT doc_id, coalesce(vs, 0.0) AS vs, coalesce(ks, 0.0) AS ks FROM vn FULL JOIN kn USING (doc_id)),
fused AS (SELECT *, greatest(0.05, least(0.95, CASE WHEN vs > 0.05 AND ks > 0.05 THEN vs * 0.6 + ks * 0.4 WHEN vs > 0.05 THEN vs * 0.8 WHEN ks > 0.05 THEN ks * 0.8 ELSE greatest(vs, ks) * 0.5 END)) AS fs FROM j)
"""
)
RERANK = """SELECT doc_id, round(rs, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (ORDER BY rs DESC, doc_id)::INT AS rank FROM (
  SELECT fused.doc_id, CASE WHEN e.embedding IS NOT NULL THEN list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-8) ELSE round(fs, 9) END AS rs
  FROM fused LEFT JOIN embeddings e ON e.vec_id = fused.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round(fs, 9) >= 0.3)) WHERE rank <= 20"""
LINEAR = POSTS + f" SELECT l.doc_id, round(0.3 * ({share(['the', 'les', 'tion'])}) + 0.7 * coalesce({COS}, 0.0), 6) AS similarity FROM l LEFT JOIN embeddings e ON e.vec_id = l.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
IN_ROW = f"SELECT doc_id, round(score, 6) AS score FROM (SELECT d.doc_id, 0.7 * coalesce({COS}, 0.0) + 0.3 * ((contains(lower(text), 'the')::INT + contains(lower(text), 'les')::INT + contains(lower(text), 'tion')::INT) / 3.0::DOUBLE) AS score FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"


def _compare() -> str:
    a = scores("okapi", _TERMS)
    b = scores("plus", _TERMS)[len(POSTS) :].replace("q(term", "q2(term").replace("JOIN q ", "JOIN q2 ").replace(" i AS (", " i2 AS (").replace("CROSS JOIN i ", "CROSS JOIN i2 i ").replace("\nr AS (", "\nr2 AS (")
    return a + b + """, x AS (SELECT lang AS question, count(*) AS n, avg(score) AS m FROM r JOIN documents USING (doc_id) GROUP BY lang), y AS (SELECT lang AS question, count(*) AS n, avg(score) AS m FROM r2 JOIN documents USING (doc_id) GROUP BY lang)
SELECT question, coalesce(x.n, 0) AS n_first, coalesce(y.n, 0) AS n_second, coalesce(y.n, 0) - coalesce(x.n, 0) AS n_diff, round(coalesce(x.m, 0), 6) AS mean_first, round(coalesce(y.m, 0), 6) AS mean_second, round(coalesce(y.m, 0) - coalesce(x.m, 0), 6) AS mean_diff FROM x FULL JOIN y USING (question)"""


COMPARE = _compare()
READING_ORDER = "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3, floor(l_quantity / 10), l_shipdate DESC, l_linenumber)::INT AS place FROM lineitem"

LAST = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS back FROM conversations"
HISTORY = f"SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS history FROM ({LAST}) WHERE back <= 6 AND coalesce(text, '') <> '' GROUP BY conv_id"
LAST_TURNS = f"SELECT conv_id, turn, role, back FROM ({LAST}) WHERE back <= 10"
HITS = FUSE + ", h AS (SELECT 'q' AS question, t.rank, d.text AS content, d.lang AS document_name, t.fs AS score, count(*) OVER () AS n FROM (SELECT *, row_number() OVER (ORDER BY fs DESC, doc_id)::INT AS rank FROM (SELECT doc_id, round(fs, 9) AS fs FROM fused) WHERE fs >= 0.1) t JOIN documents d USING (doc_id) WHERE t.rank <= 10)"
CONTEXT_END = " SELECT question, CASE WHEN length(c) > 900 THEN substr(c, 1, 900) || '...' ELSE c END AS context FROM c"
CONTEXT = HITS + """, pp AS (SELECT question, rank, printf('[文档%d] (来源: %s, 相关度: %.3f)', rank, document_name, score) || chr(10) || CASE WHEN length(content) > 900 // n THEN substr(content, 1, (900 // n)::INT) || '...' ELSE content END || chr(10) AS part FROM h WHERE content <> ''),
c AS (SELECT question, string_agg(part, chr(10) ORDER BY rank) AS c FROM pp GROUP BY question)""" + CONTEXT_END
CONTEXT_META = HITS + " SELECT question, string_agg('[文档' || rank || '] (document_name: ' || document_name || ', rank: ' || rank || ')' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS context FROM h WHERE content <> '' GROUP BY question"
KNN_THRESHOLD = f"SELECT vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) WHERE score >= 0.2"
PLAIN_AND_HYBRID = FUSE + f", pl AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS plain_rank FROM (SELECT e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY plain_rank LIMIT 10), b AS (SELECT doc_id, row_number() OVER (ORDER BY fs DESC, doc_id)::INT AS hybrid_rank FROM (SELECT doc_id, round(fs, 9) AS fs FROM fused) WHERE fs >= 0.1 ORDER BY hybrid_rank LIMIT 10) SELECT doc_id, plain_rank, hybrid_rank FROM pl FULL JOIN b USING (doc_id)"
ANSWERS = _batch("sum", 3, "qu AS (SELECT conv_id, arg_max(text, turn) AS asked FROM conversations WHERE role = 'user' GROUP BY conv_id), " + _question_terms("coalesce(asked, '')", "qu", "conv_id")) + f""",
h AS (SELECT question, rank, d.text AS content, d.lang AS document_name, round({_NORMAL}, 9) AS score, count(*) OVER (PARTITION BY question) AS n FROM kw JOIN documents d USING (doc_id)),
pp AS (SELECT question, rank, printf('[文档%d] (来源: %s, 相关度: %.3f)', rank, document_name, score) || chr(10) || CASE WHEN length(content) > 900 // n THEN substr(content, 1, (900 // n)::INT) || '...' ELSE content END || chr(10) AS part FROM h WHERE content <> ''),
c AS (SELECT question, string_agg(part, chr(10) ORDER BY rank) AS c FROM pp GROUP BY question),
x AS (SELECT question AS conv_id, CASE WHEN length(c) > 900 THEN substr(c, 1, 900) || '...' ELSE c END AS context FROM c),
tt AS (SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 AND coalesce(text, '') <> ''),
y AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS history FROM tt GROUP BY conv_id),
z AS (SELECT conv_id, 'Documents' || chr(10) || coalesce(context, '（未找到相关文档内容）') || chr(10) || chr(10) || 'So far' || chr(10) || coalesce(history, '（无历史记录）') || chr(10) || chr(10) || 'Question' || chr(10) || coalesce(asked, '') || chr(10) || chr(10) || 'Answer:' AS p FROM qu LEFT JOIN x USING (conv_id) LEFT JOIN y USING (conv_id))
SELECT conv_id, length(p)::INT AS n, md5(p) AS digest FROM z"""
MESSAGES = """SELECT conv_id, (count(*) FILTER (WHERE role IN ('user', 'assistant')) + 2)::INT AS n, 'system:s' || chr(10) || coalesce(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn) FILTER (WHERE role IN ('user', 'assistant')) || chr(10), '') || 'user:c' || chr(10) || chr(10) || 'q' || max(turn) || chr(10) || chr(10) || 'Answer:' AS said FROM conversations GROUP BY conv_id"""

UPSERT = """WITH o AS (SELECT doc_id, 0 AS chunk_index, lang, 1 AS version FROM documents), n AS (SELECT doc_id * 2 AS doc_id, 0 AS chunk_index, lang, 2 AS version FROM documents WHERE doc_id % 3 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)"""
TUMBLING = "SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w + INTERVAL 30 MINUTE >= ts THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS largest FROM c GROUP BY user_id"""
