"""Personal data by a skip-chain conditional random field over the base rules' spans.

Base rules find emails, addresses of machines, card and phone numbers. The field adds what they miss but the document
tells: its nodes are the tokens with a digit, `@` or `+` (all others hold no personal data and count as such), its
labels the four kinds or none. Neighbouring tokens share a potential, and so does each token with the next similar one
of its document, however far: with the same text, the same name before an `@`, or the same last seven digits. Occurrences are
linked one to the next, so links grow with the tokens. Loopy message passing, a fixed number of rounds for a batch of
documents at once, makes labels of linked tokens agree; tokens of base spans are given. A token that isn't and gets a
kind with a chance of LEAST or more is a span, neighbours of one kind together.

The field is trained by pseudo-likelihood on the base rules' labels of all documents. What a token shows (form, digits, check
digits, context) and the labels of its neighbours and similar tokens take a bounded number of combinations; tasks count them, the counts are
summed, and the gradient is taken on the sums, so that the model depends on the counts alone, not on tasks or samples. Kinds share the
weights of links, so that a kind that never recurs in the corpus learns from the others. Each combination is heard once more without what the token itself shows, so that the weights of links are not starved by those of form.

Defined cases: null and empty texts have no spans; a null id stays null; rows that repeat are scanned alike; very long
texts are scanned whole, in time linear in their length; other columns are ignored; an empty table gives an empty
result; where the base rules find nothing in any document, the field adds nothing.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import words as W

KINDS = ["email", "ip", "card", "phone"]
LABELS = 1 + len(KINDS)
#: Least chance of an added span, rounds of messages, steps and penalty of training.
LEAST, ROUNDS, STEPS, PENALTY = 0.9, 12, 1500, 1e-5
#: Bytes of text looked at together.
BYTES = 4_000_000
#: Number of values of each thing a token shows: form, digits, digit run, phone run, context.
SHOWS = (8, 7, 4, 2, 2)
#: A similar token that isn't there.
NONE = LABELS


def _ties() -> np.ndarray:
    """Which weight a pair of labels has, the same for all kinds: 0 none and none, 1 none and a kind, 2 a kind and none, 3 one kind twice, 4 two kinds."""
    out = np.full((LABELS, LABELS), 4)
    out[0], out[:, 0] = 1, 2
    out[0, 0] = 0
    out[range(1, LABELS), range(1, LABELS)] = 3
    return out


TIES = _ties()

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What a token may be wrapped in; a plus sign belongs to its number.
_MARKS = "!\"#$%&'()*,-./:;<=>?@[\\]^_`{|}~"
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(0x30, 0x3A), 0x40, 0x2B]] = True


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def runs(text: str) -> tuple[list, list]:
    """Runs of digits (start, end, number of digits, whether 14 to 19 pass the check) and of phone characters (start, end, digits)."""
    digits, phones = [], []
    for m in _DIGITS.finditer(text):
        d = _digits(m[0])
        digits.append((m.start(), m.end(), len(d), 14 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text):
        phones.append((m.start(), m.end(), len(_digits(m[0]))))
    return digits, phones


def base_spans(text: str, digits: list, phones: list) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, in order. Each rule is followed from its rarest mark, in linear time."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            after = domain.end()
        at = text.find("@", domain.end() if domain else at + 1)
    for m in _DOTTED.finditer(text) if "." in text else ():
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, 1, end))
            at = end + 1
    out += [(a, 2, b) for a, b, _, good in digits if good]
    out += [(a, 3, b) for a, b, n in phones if 10 <= n <= 15]
    return sorted(out)


def key(core: str) -> str | None:
    """What similar tokens share; None for tokens too short to tell."""
    if "@" in core:
        core = core.partition("@")[0]
    else:
        d = _digits(core)
        if len(d) >= 7 and core.count(".") < 3 and not any(c.isalpha() for c in core):
            return "#" + d[-7:]
    return core.lower() if len(core) >= 4 else None


def _inside(at: int, spans: list, k: int) -> tuple[tuple | None, int]:
    """The span that holds the place `at`, seeking from the k-th on (places and spans ascend), and where to seek next."""
    while k < len(spans) and spans[k][1] <= at:
        k += 1
    return (spans[k] if k < len(spans) and spans[k][0] <= at else None), k


def _form(core: str, digits: str) -> int:
    if "@" in core.strip("@"):
        return 1
    parts = core.split(".")
    if len(parts) == 4 and all(p and len(p) <= 3 and p.isascii() and p.isdigit() and int(p) <= 255 for p in parts):
        return 2
    if core.isascii() and core.isdigit():
        return 6
    if any(c.isalpha() for c in core):
        return 7
    return 5 if digits and "-" in core else 0


class Graphs:
    """Tokens of documents as nodes with what they show, their given labels, neighbours and similar tokens."""

    def __init__(self):
        self.doc, self.start, self.end, self.shows, self.given, self.touch, self.linked = [], [], [], [], [], [], []
        self.base: dict[int, list] = {}

    def add(self, doc: int, text: str, tokens: list[tuple[int, int, int]]) -> None:
        """tokens: (number among the text's words, start, end) of those with a digit, @ or +."""
        digits, phones = runs(text)
        spans = base_spans(text, digits, phones)
        self.base[doc] = spans
        last, before, d, p, s = {}, None, 0, 0, 0
        for number, a, b in tokens:
            raw = text[a:b]
            core = raw.strip(_MARKS)
            lead = len(raw) - len(raw.lstrip(_MARKS)) if core else 0
            own = _digits(core)
            first = next((a + i for i, c in enumerate(raw) if "0" <= c <= "9"), a)
            run, d = _inside(first, digits, d)
            phone, p = _inside(first, phones, p)
            form = _form(core, own)
            form = 3 if raw.lstrip("(\"'[").startswith("+") and own else 4 if raw.startswith("(") and own and form == 6 else form
            context = raw[:1] in "\"'=" or (a > 1 and text[a - 2 : a - 1] in ("=", ":"))
            self.shows.append((form, sum(len(own) >= x for x in (1, 4, 7, 10, 14, 20)), 0 if run is None or run[2] < 14 else 3 if run[2] > 19 else 1 if run[3] else 2, int(phone is not None), int(context)))
            # the base span that touches the token, if any
            while s < len(spans) and spans[s][2] <= a:
                s += 1
            over = [x for x in spans[s : s + len(KINDS) + 1] if x[0] < b and x[2] > a]
            self.given.append(1 + over[0][1] if over else 0)
            node = len(self.doc)
            self.touch.append(node - 1 if before == number - 1 else -1)
            k = key(core)
            self.linked.append(last.get(k, -1) if k else -1)
            if k:
                last[k] = node
            self.doc.append(doc)
            self.start.append(a + lead)
            self.end.append(a + lead + len(core))
            before = number

    def arrays(self):
        shows = np.array(self.shows, np.int64).reshape(-1, len(SHOWS))
        return shows, *(np.array(x, np.int64) for x in (self.given, self.touch, self.linked))


def graphs(texts) -> tuple[Graphs, int]:
    """The graphs of an Arrow column of texts."""
    buf, offs = W.text_buffer(texts)
    starts, ends, per = W.spans(buf, offs, W.BLANK_WORDS)
    trigger = np.append(0, np.cumsum(_TRIGGER[buf], dtype=np.int32))
    found = np.flatnonzero(trigger[ends] > trigger[starts])
    points = np.append(0, np.cumsum((buf & 0xC0) != 0x80, dtype=np.int32))
    doc = np.searchsorted(per, found, side="right") - 1
    base = points[offs[doc]]
    number, a, b = found - per[doc], points[starts[found]] - base, points[ends[found]] - base
    out = Graphs()
    some, at = np.unique(doc, return_index=True)
    at = np.append(at, len(found))
    for i, d in enumerate(some.tolist()):
        part = slice(at[i], at[i + 1])
        out.add(d, texts[d].as_py(), list(zip(number[part].tolist(), a[part].tolist(), b[part].tolist(), strict=True)))
    return out


def _pieces(batches):
    """(ids, texts) of bounded size, texts as Arrow columns."""
    for batch in batches:
        _, offs = W.text_buffer(batch.column(1))
        for i, j in W.cuts(offs, BYTES):
            yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)


def _combine(shows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(shows), np.int64)
    for k, size in enumerate(SHOWS):
        out = out * size + shows[:, k]
    return out


def _count(batches):
    """(combination, c): how often tokens show what, with which label and labels around them."""
    import pyarrow as pa

    W.settle()
    held: dict[int, int] = {}
    for _, texts in _pieces(batches):
        shows, given, touch, linked = graphs(texts).arrays()
        if not len(given):
            continue
        around = np.zeros((4, len(given)), np.int64)  # left, right, similar before, similar after
        around[2:] = NONE
        for k, other in ((0, touch), (2, linked)):
            at = np.flatnonzero(other >= 0)
            around[k, at] = given[other[at]]
            around[k + 1, other[at]] = given[at]
        code = _combine(shows)
        for x in (*around, given):
            code = code * (LABELS + 1) + x
        for c, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True):
            held[c] = held.get(c, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["combination", "c"])


class Field:
    """Weights of what tokens show (by label), of neighbours and of similar tokens (label by label)."""

    def __init__(self, shows: np.ndarray, bias: np.ndarray, near: np.ndarray, similar: np.ndarray):
        self.shows, self.bias, self.near, self.similar = shows, bias, near, similar

    @classmethod
    def fit(cls, counts: list[tuple[int, int]]) -> Field:
        """counts: (combination, number) over all tokens of all documents."""
        rows = sorted(counts)
        code, c = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
        parts = []
        for _ in range(5):
            parts.append(code % (LABELS + 1))
            code = code // (LABELS + 1)
        y, after, before, right, left = parts
        values = []
        for size in reversed(SHOWS):
            values.append(code % size)
            code = code // size
        at = np.stack(values[::-1], 1) + np.concatenate([[0], np.cumsum(SHOWS)[:-1]])
        seen = np.zeros((len(y), sum(SHOWS)))
        seen[np.arange(len(y))[:, None], at] = 1
        seen, y, c = np.concatenate([seen, 0 * seen]), np.tile(y, 2), np.tile(c / max(c.sum(), 1) / 2, 2)
        one = np.eye(LABELS + 1)[:, :LABELS]
        sides = [np.tile(one[x], (2, 1)) for x in (left, right, before, after)]
        target = one[y]
        w = [np.zeros((sum(SHOWS), LABELS)), np.zeros(LABELS), np.zeros(5), np.zeros(5)]
        m1, m2 = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for step in range(1, STEPS + 1):
            near, similar = cls.links(w)
            score = seen @ w[0] + w[1] + sides[0] @ near + sides[1] @ near.T + (sides[2] + sides[3]) @ similar
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            off = (p / p.sum(1, keepdims=True) - target) * c[:, None]
            link = (sides[2] + sides[3]).T @ off
            tied = [np.bincount(TIES.ravel(), x.ravel(), 5) for x in (sides[0].T @ off + off.T @ sides[1], (link + link.T) / 2)]
            g = [seen.T @ off, off.sum(0), *tied]
            for k in range(len(w)):
                g[k] = g[k] + PENALTY * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                w[k] = w[k] - 0.05 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return cls(w[0], w[1], *cls.links(w))

    @staticmethod
    def links(w: list) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of neighbours and of similar tokens, the latter the same both ways."""
        similar = w[3][TIES]
        return w[2][TIES], (similar + similar.T) / 2

    def own(self, shows: np.ndarray, touch: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Log potentials of the nodes alone; a neighbour that is no node has the label none, and base spans leave one label."""
        at = shows + np.concatenate([[0], np.cumsum(SHOWS)[:-1]])
        out = self.shows[at].sum(1) + self.bias
        followed = np.zeros(len(touch), bool)
        followed[touch[touch >= 0]] = True
        out[touch < 0] += self.near[0]
        out[~followed] += self.near[:, 0]
        fixed = np.flatnonzero(given)
        out[fixed] = -1e4
        out[fixed, given[fixed]] = 0
        return out

    def chances(self, own: np.ndarray, touch: np.ndarray, linked: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """The nodes' chances of each label, by message passing along both kinds of edges at once."""
        ends, potentials = [], []
        for other, weights in ((touch, self.near), (linked, self.similar)):
            at = np.flatnonzero(other >= 0)
            for a, b, w in ((other[at], at, weights), (at, other[at], weights.T)):
                ends.append((a, b))
                potentials.append(np.broadcast_to(w, (len(at), LABELS, LABELS)))
        source, target = np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends])
        sizes = [len(a) for a, _ in ends]
        back = np.concatenate([np.arange(sizes[0]) + sizes[0], np.arange(sizes[0]), np.arange(sizes[2]) + 2 * sizes[0] + sizes[2], np.arange(sizes[2]) + 2 * sizes[0]])
        pair, sent = np.concatenate(potentials), np.zeros((len(source), LABELS))

        def heard() -> np.ndarray:
            total = own.copy()
            np.add.at(total, target, sent)
            return total

        for _ in range(rounds if len(source) else 0):
            score = (heard()[source] - sent[back])[:, :, None] + pair
            top = score.max(1, keepdims=True)
            new = np.log(np.exp(score - top).sum(1)) + top[:, 0]
            sent = new - new.max(1, keepdims=True)
        total = heard()
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _scan(field: Field | None, batches):
    """(id, spans) of each document: (kind, start, end, whether a base rule has it), by start and kind."""
    import pyarrow as pa

    W.settle()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
    for ids, texts in _pieces(batches):
        g = graphs(texts)
        spans = {d: [(a, k, b, True) for a, k, b in found] for d, found in g.base.items()}
        if field is not None and g.doc:
            shows, given, touch, linked = g.arrays()
            p = field.chances(field.own(shows, touch, given), touch, linked)
            label = p.argmax(1)
            label[(p.max(1) < LEAST) | (given > 0)] = 0
            open_node, open_span = -2, None
            for i in np.flatnonzero(label).tolist():
                d, k = g.doc[i], int(label[i]) - 1
                if g.start[i] == g.end[i]:
                    continue
                if touch[i] == open_node and label[open_node] == label[i]:
                    open_span[2] = g.end[i]
                else:
                    open_span = [g.start[i], k, g.end[i], False]
                    spans[d].append(open_span)
                open_node = i
        rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in sorted(spans.get(d, []), key=lambda s: (s[0], s[1]))] for d in range(len(ids))]
        yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])


def train(docs: DataFrame, text_col: str = "text") -> Field | None:
    """The field of the base rules' labels in all documents; None if they find nothing."""
    texts = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_count, "combination long, c long").groupBy("combination").agg(F.sum("c").alias("c")).collect()
    return Field.fit([(r["combination"], r["c"]) for r in counts]) if any(r["combination"] % (LABELS + 1) for r in counts) else None


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for each row its spans (kind, start, end, base), in code points, by start and kind; trained on docs if no field is given."""
    field = field or train(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan(field, it), f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def mask(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of each span; of spans that overlap the first one tells the kind."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        more = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] >= a["at"], more).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.greatest(F.length(text) - a["at"], F.lit(0)))))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of the result of `find`."""
    base = F.filter("spans", lambda s: s["base"])
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k)))
    counts = [count(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
