"""Query rewriting: synonyms as OR groups, keywords, sub-queries.

A query is one string, so rewriting runs on the driver; `rewrite_column` does it for a column of
queries. Replacement is done in one pass over the original query, longest entry first, so that groups
never nest and every group can be parsed again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dictionary of the rewriter.
SYNONYMS = {
    "业务": ["业务范围", "主营业务", "经营范围"],
    "营收": ["收入", "营业收入", "销售额"],
    "利润": ["净利润", "盈利", "收益"],
    "客户": ["客户群体", "主要客户", "客户结构"],
    "竞争优势": ["核心竞争力", "优势", "竞争壁垒"],
    "发展": ["发展态势", "发展趋势", "发展前景"],
    "风险": ["风险因素", "经营风险", "潜在风险"],
    "中报": ["半年报", "中期报告", "半年度报告"],
    "年报": ["年度报告", "年报披露"],
    "营收增长": ["收入增长", "收入增速", "营收增速"],
    "毛利率": ["毛利水平", "毛利率水平"],
    "公司": ["企业", "上市公司"],
    "产品": ["产品线", "产品结构"],
    "市场": ["市场地位", "市场份额"],
}
# Words that are no keywords.
STOP_WORDS = ["的", "了", "是", "在", "和", "与", "或", "有", "为", "对", "从", "到"]


class QueryRewriter:
    """Rewrites queries with a dictionary word -> synonyms."""

    def __init__(self, synonyms: dict[str, list[str]] | None = None):
        self.synonyms = {k: list(v) for k, v in (SYNONYMS if synonyms is None else synonyms).items()}

    def add_synonyms(self, word: str, synonyms: list[str]) -> None:
        self.synonyms.setdefault(word, []).extend(synonyms)

    def rewrite(self, query: str | None, strategy: str = "synonym") -> str:
        """By strategy synonym, expand or simplify; any other leaves the query as it is."""
        query = query or ""
        return {"synonym": self._groups, "expand": self._expand, "simplify": self._simplify}.get(strategy, str)(query)

    def _groups(self, query: str) -> str:
        if not self.synonyms:
            return query
        entries = "|".join(re.escape(w) for w in sorted(self.synonyms, key=lambda w: (-len(w), w)))
        return re.sub(entries, lambda m: f"({' OR '.join([m[0], *self.synonyms[m[0]]])})", query)

    def keywords(self, query: str, n: int = 5) -> list[str]:
        return [w for w in re.findall(r"[一-鿿]{2,}", query or "") if w not in STOP_WORDS][:n]

    def sub_queries(self, query: str, n: int = 3) -> list[str]:
        """The query, its first two keywords and, of three or more, the first one; no repeats."""
        words = self.keywords(query, 3)
        out = [query] + [" ".join(words[:2])] * (len(words) > 1) + words[:1] * (len(words) > 2)
        return list(dict.fromkeys(out))[:n]

    def _expand(self, query: str) -> str:
        parts = []
        for word in self.keywords(query):
            near = [s for w, syns in self.synonyms.items() if w in word or word in w for s in syns]
            parts.append(" OR ".join([word, *near[:2]]))
        return " ".join(parts) or query

    def _simplify(self, query: str) -> str:
        return " ".join(self.keywords(query, 3)) or query


def keywords_column(query: Column, n: int = 5) -> Column:
    words = F.regexp_extract_all(query, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), 1, n)


def rewrite_column(query: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Synonym groups for a column of queries: each entry is marked by its number, longest first, then spelled out."""
    entries = sorted((SYNONYMS if synonyms is None else synonyms).items(), key=lambda e: (-len(e[0]), e[0]))
    out = query
    for i, (word, _) in enumerate(entries):
        out = F.replace(out, F.lit(word), F.lit(f"\u0001{i}\u0002"))
    for i, (word, syns) in enumerate(entries):
        out = F.replace(out, F.lit(f"\u0001{i}\u0002"), F.lit(f"({' OR '.join([word, *syns])})"))
    return out
