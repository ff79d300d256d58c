"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every node has a weight of its own. At each level a key draws -ln(u) / weight for each child of the node it has
come to, u a uniform hash of (key, child's path), and descends to the child with the least draw, so to each with
a chance in proportion to its weight among its siblings. Only the draws on the key's way are made: regions, racks of
one region, shards of one rack. A changed weight or an added child alters that child's draw alone, and only among
its siblings: keys move between the changed child and its siblings' subtrees, never elsewhere, and never between
two unchanged siblings; a child that is added only receives. One shard more is a region of its own, whose
siblings keep their weights, so it takes its share from all shards.

All draws are DataFrame expressions. Numbers inside shards come from counts of small hash buckets, never from
sorting a shard in one task.

Defined cases: a null text has no bytes and CRC-32 0; a null key draws as one fixed key; repeated rows
stay together, in slots of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import ranks

#: Hash buckets in which the rows of one shard are counted and numbered.
BUCKETS = 512


@dataclass(frozen=True)
class Node:
    """A node of the tree: its name among its siblings, its weight, and its children or its shard."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int = -1


def even_tree(n: int, regions: int = 2, racks: int = 3) -> tuple[Node, ...]:
    """n shards of equal share, dealt in turn to regions and then racks; every node weighs as many shards as it has."""
    out = []
    for region in range(min(n, regions)):
        mine = range(region, n, regions)
        kinds = [tuple(Node(f"s{i}", 1.0, shard=i) for k, i in enumerate(mine) if k % racks == rack) for rack in range(racks)]
        inside = tuple(Node(f"k{rack}", float(len(x)), x) for rack, x in enumerate(kinds) if x)
        out.append(Node(f"r{region}", float(len(mine)), inside))
    return tuple(out)


def grown(tree: tuple[Node, ...], shard: int, weight: float = 1.0) -> tuple[Node, ...]:
    """The tree with one shard more, in a region and rack of its own."""
    return (*tree, Node(f"r+{shard}", weight, (Node("k0", 1.0, (Node(f"s{shard}", 1.0, shard=shard),)),)))


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _chosen(key: Column, nodes: tuple[Node, ...], at: str) -> Column:
    """The number of the node with the least draw. Nodes of weight 0 or less get nothing."""
    draws = [F.struct(_draw(key, f"{at}/{n.name}", n.weight).alias("draw"), F.lit(i).alias("i")) for i, n in enumerate(nodes) if n.weight > 0]
    return F.least(*draws)["i"] if len(draws) > 1 else F.lit(next(i for i, n in enumerate(nodes) if n.weight > 0))


def _by_branch(c: Column, values: list) -> Column:
    """values[c]; only the branch taken is computed."""
    out = None
    for i, v in enumerate(values):
        out = F.when(c == i, v) if out is None else out.when(c == i, v)
    return out


def assign(df: DataFrame, key: Column, trees: dict[str, tuple[Node, ...]]) -> DataFrame:
    """Adds a column for each named tree: the shard of the key in it."""
    names = list(trees)
    step = df.select("*", key.alias("__key"))
    k = F.col("__key")
    step = step.select("*", *[_chosen(k, trees[t], "").alias(f"__{t}_region") for t in names])
    step = step.select("*", *[_by_branch(F.col(f"__{t}_region"), [_chosen(k, r.children, f"/{r.name}") if r.weight > 0 else F.lit(None) for r in trees[t]]).alias(f"__{t}_rack") for t in names])

    def shard_of(t: str) -> Column:
        def leaf(region: Node, rack: Node) -> Column:
            numbers = F.array(*[F.lit(s.shard) for s in rack.children])
            return F.get(numbers, _chosen(k, rack.children, f"/{region.name}/{rack.name}"))

        return _by_branch(F.col(f"__{t}_region"), [_by_branch(F.col(f"__{t}_rack"), [leaf(r, x) if x.weight > 0 else F.lit(None) for x in r.children]) for r in trees[t]])

    return step.select(*df.columns, *[shard_of(t).cast("int").alias(t) for t in names])


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row; grown_shard: with one shard more."""
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tree = even_tree(shards)
    rows = assign(rows, F.col("doc_id"), {"shard": tree, "grown_shard": grown(tree, shards)})
    rows = ranks(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32")], F.xxhash64("doc_id", F.lit("slot")), BUCKETS, "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
