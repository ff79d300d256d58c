"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection.

A text's set is its distinct w-word shingles (fewer words: the whole sequence as one), as 64-bit
hashes. Two texts link when percent_den * |A & B| >= percent * |A | B|, tested on whole sets.

1. One pass over the texts gives each batch of documents its shingle fingerprints, dealt by
   fingerprint; the receiving tasks count in how many documents each occurs and send back, to the
   batch, those seen twice or more. A shingle common within a batch is sent once with its count.
2. Shingles are ordered from rare to frequent. By the pigeonhole principle linked sets share one of
   their first |A| - ceil(t |A|) + 1 shingles, so only those, if seen twice, can propose links.
   Documents with equal sets are one class and proposed once.
3. Classes that share such a shingle and lie in the same or the next size band are proposed together;
   connected proposals make a group. A group of more than BLOCK classes is cut into blocks by size band.
4. In a tile, parity bitmaps of the sets bound each intersection from above by bit counts; pairs that
   may link and aren't yet joined by other links are verified by intersecting the sorted arrays.
   A tile returns a spanning forest of its links, so groups never expand into all their pairs.
5. Tiles come in three turns. First each block by itself: every text is sent once. Then, in groups of several
   blocks, the heads of the parts found so far, one for each. What is joined by then is contracted: blocks of one
   part need no tile with each other. Last, tiles of two blocks (of the same or near bands) for what is still apart,
   which in a group of near copies is next to nothing. What has to go to many tiles for that goes as a bitmap of some eight
   bits a shingle, and only sets whose bitmaps allow a link go on as texts. So a text is sent about twice, not once for each block.

Nothing is capped or sampled. The step that grows fastest is the last turn: bitmaps of parts of one
group that stay apart are compared block by block, in tiles of their own. Memory per task: a batch of texts, or two blocks of them.

Defined cases: a null text is an empty one; texts without words have no shingles and link with
nothing; rows with one id and different texts take the component of their own text, and are one where
both ids stand for their texts; a null id is never linked (component null); columns other
than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import words as W
from lectern.llm.shared import components, cut, partitions, sized

#: Texts handled together in one numpy pass.
BATCH_BYTES = 4 << 20
#: A shingle in this many documents of a batch is sent once for the batch.
COMMON = 16
#: Classes in one block of a tile.
BLOCK = 64
#: Rows (id, tile) that are sent to all tasks rather than joined by a shuffle of all texts.
SENT = 50_000


def _sets(texts: pa.Array, w: int):
    """Yields (row, sorted distinct shingle hashes) for each text."""
    buf, offs = W.text_buffer(texts)
    for i, j in W.cuts(offs, BATCH_BYTES):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, at = W.spans(b, o, W.BLANK_WORDS)
        h = W.hashes(b, s, e)
        for k in range(j - i):
            yield i + k, np.unique(W.windows(h[at[k] : at[k + 1]], w))


def _packed(doc: np.ndarray, n: int) -> bytes:
    """Ascending numbers under n: how often each occurs, or, where that is shorter (as with many buckets), the numbers; the last byte says which."""
    own = np.uint16 if n <= 1 << 16 else np.uint32
    if n <= len(doc) * np.dtype(own).itemsize:
        per = np.bincount(doc, minlength=n)
        wide = np.uint8 if per.max() < 256 else np.uint32
        if n * np.dtype(wide).itemsize <= len(doc) * np.dtype(own).itemsize:
            return per.astype(wide).tobytes() + (b"c" if wide is np.uint8 else b"C")
    return doc.astype(own).tobytes() + (b"d" if own is np.uint16 else b"D")


def _unpacked(data: bytes) -> np.ndarray:
    """The numbers of `_packed`."""
    kind = {b"c": np.uint8, b"C": np.uint32, b"d": np.uint16, b"D": np.uint32}[data[-1:]]
    x = np.frombuffer(data, kind, (len(data) - 1) // np.dtype(kind).itemsize)
    return np.repeat(np.arange(len(x), dtype=np.uint32), x) if data[-1:] in b"cC" else x.astype(np.uint32)


def _fits(inter, a, b, percent: int, den: int):
    return (den + percent) * inter >= percent * (a + b)


_REQUEST = "home long, bucket int, part binary, counts binary, hot_fp binary, hot_n binary, ids binary, sizes binary, classes binary"


def _requests(w: int, buckets: int):
    def one(batch: pa.RecordBatch, home: int):
        ids, known = batch.column(0), np.array(batch.column(0).is_valid())
        rows, sets = zip(*_sets(batch.column(1), w), strict=True)
        n = np.array([len(x) for x in sets], dtype=np.int64)
        h = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), n)
        # a class: two sums over mixed hashes of the set
        edges = np.concatenate([[0], np.cumsum(n)])
        sums = np.stack([np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[edges]) for x in (W.mix(h), W.mix(h * np.uint64(0xA0761D6478BD642F) + np.uint64(1)))], axis=1)
        where = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        fp = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        token = where.astype(np.uint64) << np.uint64(32) | fp
        order = np.argsort(token, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(token[order]) != 0])) if len(h) else np.zeros(0, int)
        times = np.diff(np.append(new, len(h)))
        common = np.zeros(len(h), bool)
        common[order] = np.repeat(times >= COMMON, times)
        first = order[new[times >= COMMON]]
        hot_where, hot_fp, hot_n = where[first], fp[first], times[times >= COMMON].astype(np.uint32)
        # entries by (bucket, document); the common ones stay at home as (document, token)
        keep = np.flatnonzero(~common)
        by = keep[np.argsort(where[keep], kind="stable")]
        some, first_entry = np.unique(where[by], return_index=True)
        ends = dict(zip(some.tolist(), zip(first_entry.tolist(), [*first_entry[1:].tolist(), len(by)], strict=True), strict=True))
        for k in sorted(ends.keys() | set(hot_where.tolist())):
            hot, mine = hot_where == k, by[slice(*ends.get(k, (0, 0)))]
            yield home, k, fp[mine].tobytes(), _packed(doc[mine], len(sets)), hot_fp[hot].tobytes(), hot_n[hot].tobytes(), None, None, None
        at = np.flatnonzero(common)
        own = np.where(known, n, -1 - n)  # a null id is marked by a negative size
        yield home, home % buckets, token[at].tobytes(), doc[at].astype(np.uint32).tobytes(), None, None, np.stack([np.asarray(x.fill_null(0).to_numpy(zero_copy_only=False), np.int64) for x in (ids, batch.column(2))], axis=1).tobytes(), own.tobytes(), np.ascontiguousarray(sums).tobytes()

    @W.tidy
    def run(batches):
        from pyspark import TaskContext

        home = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offs = W.text_buffer(batch.column(1))
            for i, j in W.cuts(offs, BATCH_BYTES):
                rows = list(one(batch.slice(i, j - i), home))
                home += 1
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64]), [pa.int64(), pa.int32(), *[pa.binary()] * 7])], names=["home", "bucket", "part", "counts", "hot_fp", "hot_n", "ids", "sizes", "classes"])

    return run


_ANSWER = "home long, docs binary, tokens binary, times binary, hot_tokens binary, hot_times binary, own_tokens binary, own_docs binary, ids binary, sizes binary, classes binary"
_ANSWER_NAMES = [x.split()[0] for x in _ANSWER.split(", ")]


def _answers(batches):
    """Counts the fingerprints of each bucket dealt to this task; homes get back those seen twice or more.

    Rows come sorted by bucket: one bucket at a time is held, as the bytes it came in (4.5 to 6 for a shingle).
    """

    def rows(items):
        return pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in items], pa.int64() if c == "home" else pa.binary()) for c in _ANSWER_NAMES], names=_ANSWER_NAMES)

    waiting, now = [], None
    for batch in batches:
        for r in range(batch.num_rows):
            x = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
            if x["ids"] is not None:
                yield rows([{"home": x["home"], "own_tokens": x["part"], "own_docs": x["counts"], **{c: x[c] for c in ("ids", "sizes", "classes")}}])
                continue
            if x["bucket"] != now:
                yield from map(rows, _sixty(_count(now, waiting)))
                waiting, now = [], x["bucket"]
            waiting.append(x)
    yield from map(rows, _sixty(_count(now, waiting)))


def _sixty(items):
    """Lists of at most 64 of the items."""
    from itertools import islice

    items = iter(items)
    while some := list(islice(items, 64)):
        yield some


def _count(bucket: int, sent: list[dict]):
    """What one bucket answers to each home."""
    if not sent:
        return
    get = np.frombuffer
    fps = [get(x["part"], np.uint32) for x in sent]
    hot_fps = [get(x["hot_fp"], np.uint32) for x in sent]
    n = sum(map(len, fps))
    both = np.concatenate([*fps, *hot_fps])
    by = np.argsort(both)
    new = np.flatnonzero(np.concatenate([[True], np.diff(both[by]) != 0]))
    weight = np.ones(len(both), np.int64)
    weight[n:] = np.concatenate([get(x["hot_n"], np.uint32) for x in sent])
    total = np.minimum(np.add.reduceat(weight[by], new), 0xFFFFFFFF)
    times = np.empty(len(both), np.uint32)
    times[by] = np.repeat(total, np.diff(np.append(new, len(both))))
    del by, weight, new, total
    high, at, hot_at = np.uint64(bucket) << np.uint64(32), 0, n
    for x, fp, hot in zip(sent, fps, hot_fps, strict=True):
        mine = times[at : at + len(fp)]
        again = np.flatnonzero(mine > 1)
        if len(again) or len(hot):
            yield {"home": x["home"], "docs": _unpacked(x["counts"])[again].tobytes(), "tokens": (high | fp[again]).tobytes(), "times": mine[again].tobytes(), "hot_tokens": (high | hot).tobytes(), "hot_times": times[hot_at : hot_at + len(hot)].tobytes()}
        at, hot_at = at + len(fp), hot_at + len(hot)


def _prefixes(percent: int, den: int):
    """For each document: size, class and the shingles that can propose links."""

    def run(batches):
        held, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["home"] != now:
                    yield one(held)
                    held = []
                now = r["home"]
                held.append(r)
        if held:
            yield one(held)

    def one(rows):
        own = next(r for r in rows if r["ids"] is not None)
        get = lambda r, c, t: np.frombuffer(r[c], t)
        (ids, keys), sizes, classes = get(own, "ids", np.int64).reshape(-1, 2).T, get(own, "sizes", np.int64), get(own, "classes", np.int64).reshape(-1, 2)
        rest = [r for r in rows if r["ids"] is None]
        cat = lambda c, t: np.concatenate([np.zeros(0, t), *(get(r, c, t) for r in rest)])
        hot_t, hot_n = cat("hot_tokens", np.uint64), cat("hot_times", np.uint32)
        by = np.argsort(hot_t)
        hot_t, hot_n = hot_t[by], hot_n[by]
        home_t, home_d = get(own, "own_tokens", np.uint64), get(own, "own_docs", np.uint32)
        token = np.concatenate([cat("tokens", np.uint64), home_t])
        doc = np.concatenate([cat("docs", np.uint32), home_d])
        times = np.concatenate([cat("times", np.uint32), hot_n[np.searchsorted(hot_t, home_t)] if len(home_t) else np.zeros(0, np.uint32)])
        by = np.lexsort((token, times, doc))
        token, doc = token[by], doc[by]
        n = np.where(sizes < 0, -1 - sizes, sizes)
        at = np.searchsorted(doc, np.arange(len(ids) + 1))
        head = n - -(-percent * n // den) + 1
        lists = [token[at[k] : at[k] + max(0, head[k] - (n[k] - (at[k + 1] - at[k])))].astype(np.int64) if n[k] else np.zeros(0, np.int64) for k in range(len(ids))]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=sizes < 0), pa.array(keys), pa.array(n), pa.array(classes[:, 0]), pa.array(classes[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], names=["id", "key", "n", "c1", "c2", "tokens"])

    return run


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity bitmaps: differing bits of two never outnumber the elements in just one of the sets."""
    out = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    for k, x in enumerate(sets):
        odd = np.bincount((x >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
        out[k] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def tile_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets, ids = [sets[k] for k in order], ids[order]
    n = np.array([len(x) for x in sets], dtype=np.int64)
    root = np.arange(len(sets))
    bits = 1 << max(8, math.ceil(math.log2(max(1, 2 * int(np.median(n))))))
    maps, links = _bitmaps(sets, bits), []
    for k in range(1, len(sets)):
        low = np.searchsorted(n[:k] * den, percent * n[k])  # smaller sets can't reach the share
        y = np.flatnonzero(root[low:k] != root[k]) + low
        if not len(y):
            continue
        apart = np.bitwise_count(maps[y] ^ maps[k]).sum(axis=1, dtype=np.int64)
        bound = np.minimum((n[y] + n[k] - apart) // 2, np.minimum(n[y], n[k]))
        good = _fits(bound, n[y], n[k], percent, den)
        y, bound = y[good], bound[good]
        for j in y[np.argsort(-bound, kind="stable")].tolist():
            if root[j] == root[k]:
                continue
            a, b = sets[j], sets[k]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            if _fits(int((b[at] == a).sum()), len(a), len(b), percent, den):
                links.append((int(ids[j]), int(ids[k])))
                root[root == root[j]] = root[k]
    return links


def _verify(w: int, percent: int, den: int):
    @W.tidy
    def run(batches):
        held_ids, held_sets, now = [], [], None

        def flush():
            links = tile_links(np.array(held_ids), held_sets, percent, den) if len(held_ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r, s in _sets(batch.column(2), w):
                if keys[r] != now:
                    if now is not None:
                        yield flush()
                    held_ids, held_sets, now = [], [], keys[r]
                held_ids.append(ids[r])
                held_sets.append(s)
        if now is not None:
            yield flush()

    return run


def _maps(w: int):
    """(id, n, map) of texts with words: size and parity bitmap of each one's set, in eight times as many bits as it has shingles, or more."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for r, s in _sets(batch.column(1), w):
                if len(s):
                    out.append((ids[r], len(s), _bitmaps([s], 1 << max(8, math.ceil(math.log2(8 * len(s)))))[0].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["id", "n", "map"])

    return run


def may_link(parts: np.ndarray, n: np.ndarray, maps: list[bytes], percent: int, den: int) -> np.ndarray:
    """Whether each set may link with one of another part, by sizes and bitmaps; no set that does is told that it may not."""
    maps = [np.frombuffer(x, np.uint64) for x in maps]
    width = min(map(len, maps))
    # halves of a bitmap folded together are the bitmap of half the width
    maps = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in maps])
    may = np.zeros(len(n), bool)
    for k in range(1, len(n)):
        y = np.flatnonzero((parts[:k] != parts[k]) & _fits(np.minimum(n[:k], n[k]), n[:k], n[k], percent, den))
        apart = np.bitwise_count(maps[y] ^ maps[k]).sum(axis=1, dtype=np.int64)
        y = y[_fits((n[y] + n[k] - apart) // 2, n[y], n[k], percent, den)]
        may[y] = True
        may[k] |= len(y) > 0
    return may


def _worth(percent: int, den: int):
    """(id, tile) of rows (tile, id, part, n, map), sorted by tile, that may link in their tile."""

    def run(batches):
        held, now = [], None

        def flush():
            ids, parts, n, maps = zip(*held, strict=True)
            good = np.flatnonzero(may_link(np.array(parts), np.array(n, np.int64), maps, percent, den))
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in good], pa.int64()), pa.array([now] * len(good), pa.string())], names=["id", "tile"])

        for batch in batches:
            for tile, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != now:
                    if held:
                        yield flush()
                    held, now = [], tile
                held.append(row)
        if held:
            yield flush()

    return run


def _spread(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins to rows (with an id) the one row of facts for their keys, without sending a large group to one task.

    Every fact is copied BLOCK times and each row meets one copy, by its id. Facts are given for groups of BLOCK rows
    and more only, so that there are never more copies than rows.
    """
    copies = facts.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))))
    return rows.withColumn("__copy", F.pmod(F.xxhash64("id"), F.lit(BLOCK)).cast("int")).join(copies, [*keys, "__copy"], how).drop("__copy")


def jaccard_components(docs: DataFrame, w: int = 5, percent: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, text_key) for each row of docs.

    class_id: smallest id with the very same set; component_id: smallest id reachable by links; text_key:
    xxhash64 of the text, which tells rows with one id and different texts apart.
    Shuffles 4.5 to 6 bytes a shingle (the more buckets, the more), then only what is seen twice.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = 4 * partitions(spark)
    asked = texts.withColumn("key", F.xxhash64("text")).mapInArrow(_requests(w, buckets), _REQUEST)
    told = asked.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_answers, _ANSWER)
    told = told.repartition("home").sortWithinPartitions("home")
    table = cut(told.mapInArrow(_prefixes(percent, den), "id long, key long, n long, c1 long, c2 long, tokens array<long>"))

    # One class for each set; its smallest id stands for it.
    classes = cut(table.where("n > 0 and id is not null").groupBy("c1", "c2", "n").agg(F.min("id").alias("rep")))
    reps = table.where("size(tokens) > 0").join(classes.select("rep", F.col("n").alias("rn"), F.col("c1").alias("r1"), F.col("c2").alias("r2")), F.expr("id = rep and n = rn and c1 = r1 and c2 = r2"), "left_semi")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / percent)).cast("int")
    reps, _ = sized(reps.select("id", "n", band.alias("band"), "tokens"))
    seen = reps.select("id", "n", "band", F.explode("tokens").alias("token"))
    heads, _ = sized(seen.groupBy("token", "band").agg(F.min("id").alias("head"), F.max("id").alias("last")))
    stars = seen.join(heads.where("head < last"), ["token", "band"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
    # the floor of a logarithm may err by one at a band's edge: two bands on are proposed too
    up = heads.select("token", F.explode(F.array(F.col("band") + 1, F.col("band") + 2)).alias("band"), F.col("head").alias("a"))
    steps = heads.join(up, ["token", "band"]).select("a", F.col("head").alias("b"))
    groups = components(stars.unionByName(steps))
    placed = groups.join(reps.select("id", "band").distinct(), "id")
    total = groups.groupBy("component").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > BLOCK)
    placed, _ = sized(_spread(placed, sized(total)[0], ["component"]))  # id, component, band, total: null up to BLOCK

    def with_text(rows: DataFrame) -> DataFrame:
        """Rows with an id, and the texts of it. Few rows go to the texts, else all texts would be shuffled for them."""
        rows, n = sized(rows)
        return texts.join(F.broadcast(rows), "id") if n <= SENT else rows.join(texts, "id")

    def verified(tiled: DataFrame) -> DataFrame:
        """Links (a, b) found in tiles: rows (id, tile)."""
        dealt = with_text(tiled)
        sent = dealt.repartition(partitions(spark), "tile").sortWithinPartitions("tile")
        return sent.select("tile", "id", "text").mapInArrow(_verify(w, percent, den), "a long, b long")

    def block(count) -> Column:
        return F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(count / BLOCK)), F.lit(0)).cast("int")

    # first turn: every block by itself, a small group as one
    large = placed.where("total is not null")
    blocks, _ = sized(large.groupBy("component", "band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK))
    own = _spread(placed, blocks, ["component", "band"])
    tile = F.when(F.col("total").isNull(), F.concat_ws(",", "component")).otherwise(F.concat_ws(",", "component", "band", block(F.col("size"))))
    links, _ = sized(verified(own.select("id", tile.alias("tile"))))
    if not large.isEmpty():
        # second turn: the heads of the parts
        def parts(links: DataFrame) -> DataFrame:
            found = components(links).select("id", F.col("component").alias("part"))
            return sized(large.join(found, "id", "left").withColumn("part", F.coalesce("part", "id")))[0]

        parted = parts(links)
        first = parted.select("component", F.col("part").alias("id")).distinct()
        many = first.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        first = _spread(first, sized(many.where("size > 1"))[0], ["component"], "inner")
        more, _ = sized(verified(first.select("id", F.concat_ws(",", "component", block(F.col("size"))).alias("tile"))))
        links = links.unionByName(more)
        # third turn: blocks of what is still apart; a part that fills blocks of its own has them
        parted = parts(links)
        apart = parted.groupBy("component").agg((F.min("part") < F.max("part")).alias("apart")).where("apart").select("component")
        parted = _spread(parted, sized(apart)[0], ["component"], "inner")
        filled = parted.groupBy("component", "band", "part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= BLOCK)
        filled, _ = sized(filled.select("component", "band", "part", F.col("part").cast("string").alias("kind")))
        parted, _ = sized(_spread(parted, filled, ["component", "band", "part"]).fillna({"kind": "mixed"}))
        kinds, _ = sized(parted.groupBy("component", "band", "kind").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
        mine = _spread(parted, kinds.where("blocks > 1"), ["component", "band", "kind"])
        mine = mine.select("id", "component", "band", "kind", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int").alias("mine"), "part")
        # the other blocks of the group in the same and the next two bands, but for those of the same part
        other = kinds.select(F.col("component").alias("oc"), F.col("band").alias("ob"), F.col("kind").alias("ok"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("oi"))
        near = mine.join(other, F.expr("component = oc and ob between band - 2 and band + 2 and (kind = 'mixed' or ok = 'mixed' or kind <> ok)"))
        name = lambda b, k, i: F.struct(F.col(b).alias("b"), F.col(k).alias("k"), F.col(i).alias("i"))
        one, two = name("band", "kind", "mine"), name("ob", "ok", "oi")
        tile = F.concat_ws(",", "component", F.to_json(F.least(one, two)), F.to_json(F.greatest(one, two)))
        # every id goes to many tiles: as a bitmap, and as its text to those alone where it may link
        maps = cut(with_text(parted.select("id").distinct()).select("id", "text").mapInArrow(_maps(w), "id long, n long, map binary"))
        sent = near.select("id", "part", tile.alias("tile")).join(maps, "id").repartition(partitions(spark), "tile").sortWithinPartitions("tile")
        worth = sent.select("tile", "id", "part", "n", "map").mapInArrow(_worth(percent, den), "id long, tile string")
        links = links.unionByName(verified(worth.distinct()))
    found = components(links)

    out = table.select("id", "key", "n", "c1", "c2").join(classes, ["c1", "c2", "n"], "left")
    out = out.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("class_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"),
        F.col("key").alias("text_key"),
    )
