"""Plain Python forms of the chunkers, one text at a time, for comparison with the library's plans."""

import bisect
import re
from collections.abc import Callable

from lectern.operators.chunk import LEAST, LIMIT, SEPARATORS


def estimate(text: str) -> int:
    cjk = len(re.findall("[一-鿿]", text))
    return int(cjk / 1.5 + (len(text) - cjk) / 4)


def split_recursive(text: str | None, limit: int = LIMIT, least: int = LEAST) -> list[str]:
    """Pieces of at most `limit` tokens: cut at the first place of the first separator that leaves `least` before it, else in half."""
    if not text:
        return []
    cjk = [m.start() for m in re.finditer("[一-鿿]", text)]

    def size(a: int, b: int) -> int:
        n = bisect.bisect_left(cjk, b) - bisect.bisect_left(cjk, a)
        return int(n / 1.5 + (b - a - n) / 4)

    upcoming = {}  # the next place of each separator; pieces are cut from left to right

    def find(sep: str, a: int, b: int) -> int:
        at = upcoming.get(sep, -1)
        if at < a:
            at = text.find(sep, a)
            at = upcoming[sep] = len(text) if at < 0 else at
        return at if at + len(sep) <= b else -1

    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if size(a, b) <= limit:
            out.append(text[a:b])
            continue
        for sep in SEPARATORS:
            at = find(sep, a, b)
            if at >= 0 and size(a, at) >= least:
                todo += [(at + len(sep), b), (a, at)]
                break
        else:
            mid = a + (b - a) // 2
            todo += [(mid, b), (a, mid)]
    return out


def split_sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[。！？.!?])\s+", text) if s.strip()]


def split_semantic(text: str | None, threshold: float = 0.7, least: int = LEAST, embed: Callable | None = None) -> list[str]:
    """Sentences joined until a neighbour is unlike the one before and the chunk holds `least` tokens."""
    out, held, before = [], "", None
    for s in split_sentences(text or ""):
        if embed:
            mark = embed(s)
        else:
            mark = set(re.findall(r"\w+", s.lower()))
        if before is not None and _alike(before, mark, bool(embed)) < threshold and estimate(held) >= least:
            out.append(held)
            held = ""
        held, before = held + s, mark
    return out + [held] * bool(held)


def _alike(a, b, vectors: bool) -> float:
    if vectors:
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0
    return len(a & b) / len(a | b) if a and b else 0.0


def split_paragraphs(text: str | None, limit: int = LIMIT, least: int = LEAST) -> list[str]:
    """Paragraphs packed up to `limit` tokens; a longer one is cut recursively."""
    out, held = [], ""
    for p in (p.strip() for p in re.split(r"\n\s*\n", text or "")):
        joined = f"{held}\n{p}" if held else p
        if not p:
            continue
        if estimate(p) > limit:
            out += [held] * bool(held) + split_recursive(p, limit, least)
            held = ""
        elif estimate(joined) > limit:
            out.append(held)
            held = p
        else:
            held = joined
    return out + [held] * bool(held)


def merge_sections(sections: list[tuple[str, str | None]], limit: int = 128) -> list[str]:
    """Sections appended until a chunk exceeds `limit` tokens (it may overshoot); a section of 8 tokens
    or more carries its position tag unless the chunk has it already."""
    chunks, sizes = [""], [0]
    for text, tag in sections:
        n = estimate(text)
        tag = (tag or "") if n >= 8 else ""
        if sizes[-1] > limit:
            chunks.append("")
            sizes.append(0)
            host = text
        else:
            host = chunks[-1]
        chunks[-1] += text + (tag if tag not in host else "")
        sizes[-1] += n
    return [c for c in chunks if c]


def merge_with_images(sections: list[tuple[str, object]], limit: int = 128) -> list[tuple[str, object]]:
    """The same without tags; a chunk keeps the image of the section that opened it."""
    out: list[list] = [["", None, 0]]
    for text, image in sections:
        if out[-1][2] > limit:
            out.append(["", image, 0])
        out[-1][0] += text
        out[-1][2] += estimate(text)
    return [(t, i) for t, i, _ in out if t]


def split_delimited(text: str | None, limit: int = 128, delimiters: str = "\n!?;。；！？") -> list[str]:
    """Cut behind no delimiter but keep them, packed to at most `limit` half-characters where that can be."""
    out, size = [""], 0
    for part in re.split("([" + re.escape(delimiters) + "])", text or ""):
        n = len(part) // 2
        if size + n > limit and out[-1]:
            out.append("")
            size = 0
        out[-1] += part
        size += n
    return [c for c in out if c]
