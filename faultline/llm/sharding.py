"""Sharding by a k-d tree over document metadata.

Documents with equal texts form one atom and stay together. Atoms have three metadata
dimensions, scaled to [0, 1): the ranks of source and language among all their values, in order,
and log size, each followed by the text's hash so that ties can be cut anywhere. The tree splits
a node at the weighted (byte) median along its widest dimension until a leaf holds the target
bytes; medians come from distributed histograms that are refined bin by bin until the cut is
exact, for all nodes of a level at once, so only ``nodes x BINS`` sums reach the driver. An atom that alone exceeds the target bytes gets a
shard of its own first, at most one per shard.

Law: ``bytes`` (sizes near equal, up to the largest atom). Slots count from 0 without gaps.

Defined cases: a null text is like an empty one in crc and atom, its size is 1; null source,
language or id are values; repeated rows take a slot each; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, ranked, text_or_empty, with_facts

SHARDS = 16
BINS = 1024
DIMENSIONS = ("_d0", "_d1", "_d2")
#: Keys are integers below 2**KEY_BITS: 24 bits of the value, then bits of the text's hash.
VALUE_BITS, KEY_BITS = 24, 60


@dataclass
class Node:
    """A node of the tree: its shards, its box of keys and, once split, where."""

    first: int
    shards: int
    box: list[tuple[int, int]] = field(default_factory=lambda: [(0, 1 << KEY_BITS)] * len(DIMENSIONS))
    dimension: int | None = None
    cut: int = 0
    low: Node | None = None
    high: Node | None = None
    #: The root's widths: a node's widths count relative to them.
    root: list[int] = field(default_factory=list)


def _key(value: Column) -> Column:
    scaled = F.least(F.floor(value * (1 << VALUE_BITS)), F.lit((1 << VALUE_BITS) - 1)).cast("long")
    return F.shiftleft(scaled, KEY_BITS - VALUE_BITS) + F.col("_tie")


def _tie(text: Column) -> Column:
    """The bits of the text's hash that end a key."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, (KEY_BITS - VALUE_BITS) // 4), 16, 10).cast("long")


def _node_of(tree: Node, wanted: list[Node]) -> Column:
    """The number in ``wanted`` of the node that a row falls into, by nested tests."""
    at = {id(n): i for i, n in enumerate(wanted)}

    def walk(node: Node) -> Column:
        if node.low is None:
            return F.lit(at.get(id(node), -1))
        return F.when(F.col(DIMENSIONS[node.dimension]) < F.lit(node.cut), walk(node.low)).otherwise(walk(node.high))

    return walk(tree)


def _widest(atoms: DataFrame, tree: Node, nodes: list[Node]) -> None:
    ends = [f(d).alias(f"{n}{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
    found = {r["_node"]: r for r in atoms.withColumn("_node", _node_of(tree, nodes)).where("_node >= 0").groupBy("_node").agg(*ends).collect()}
    for i, node in enumerate(nodes):
        if i in found:
            node.box = [(found[i][f"lo{d}"], found[i][f"hi{d}"] + 1) for d in DIMENSIONS]
        if node is tree:
            tree.root = [hi - lo for lo, hi in node.box]
        node.dimension = max(range(len(DIMENSIONS)), key=lambda k: ((node.box[k][1] - node.box[k][0]) / tree.root[k], -k))


def _split(atoms: DataFrame, tree: Node, nodes: list[Node]) -> None:
    """Find the weighted quantile of each node along its dimension."""
    of = _node_of(tree, nodes)
    _widest(atoms, tree, nodes)
    span = {i: n.box[n.dimension] for i, n in enumerate(nodes)}
    before, whole, cut = dict.fromkeys(span, 0), {}, {}
    while span:
        value = F.col(DIMENSIONS[0])
        low, width = F.lit(0), F.lit(1)
        for i, (lo, hi) in span.items():
            here = F.col("_node") == i
            value = F.when(here, F.col(DIMENSIONS[nodes[i].dimension])).otherwise(value)
            low, width = F.when(here, F.lit(lo)).otherwise(low), F.when(here, F.lit(max(1, -(-(hi - lo) // BINS)))).otherwise(width)
        rows = atoms.withColumn("_node", of).where(F.col("_node").isin(list(span))).withColumn("_value", value)
        rows = rows.withColumn("_bin", F.floor((F.col("_value") - low) / width)).where(f"_bin >= 0 and _bin < {BINS}")
        sums: dict[int, dict[int, int]] = {i: {} for i in span}
        ends: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in span}
        found = rows.groupBy("_node", "_bin").agg(F.sum("_weight").alias("w"), F.min("_value").alias("least"), F.max("_value").alias("most"))
        for r in found.collect():  # BINS rows a node at most
            sums[r["_node"]][r["_bin"]] = r["w"]
            ends[r["_node"]][r["_bin"]] = (r["least"], r["most"])
        for i, (lo, hi) in list(span.items()):
            node = nodes[i]
            whole.setdefault(i, sum(sums[i].values()))
            goal, run = whole[i] * (node.shards // 2) / node.shards, before[i]
            for b in sorted(sums[i]):
                if run + sums[i][b] >= goal:
                    break
                run += sums[i][b]
            else:
                cut[i] = hi
                del span[i]
                continue
            least, most = ends[i][b]
            if least == most:  # one value, whose side is the nearer one
                cut[i] = least if abs(run - goal) <= abs(run + sums[i][b] - goal) else least + 1
                del span[i]
            else:
                span[i], before[i] = (least, most + 1), run
    for i, node in enumerate(nodes):
        node.cut, half = cut[i], node.shards // 2
        node.low, node.high = Node(node.first, half), Node(node.first + half, node.shards - half)


def atoms_of(rows: DataFrame) -> DataFrame:
    """One row per distinct text (by hash): its bytes with all copies, the keys of its dimensions, its rows."""
    out = rows.groupBy("_atom").agg(F.sum("_size").alias("_weight"), F.min("_source").alias("_source"), F.min("_lang").alias("_lang"), F.max("_size").alias("_bytes"), F.min("_tie").alias("_tie"), F.count(F.lit(1)).alias("_n"))
    for c in ("_source", "_lang"):  # one row per distinct value; null ranks with the least
        out = out.join(ranked(rows, c, f"{c}_rank"), c, "left").withColumn(f"{c}_rank", F.coalesce(f"{c}_rank", F.lit(0.0)))
    values = (F.col("_source_rank"), F.col("_lang_rank"), F.least(F.round(F.log2(F.col("_bytes") + 1) / 40, 9), F.lit(0.9999999)))
    return out.select("_atom", "_weight", "_n", *[_key(v).alias(d) for d, v in zip(DIMENSIONS, values, strict=True)])


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_or_empty("_t")
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(source_col).alias("_source"), F.col(lang_col).alias("_lang"))
    rows = rows.select("_id", "_source", "_lang", (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text).alias("_atom"), _tie(text).alias("_tie"))
    rows = materialize(rows, "shard-rows")
    atoms = materialize(atoms_of(rows), "shard-atoms")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    own: dict[int, int] = {}  # atoms larger than an even share, at most one a shard
    while len(own) < shards - 1:
        share = (total - sum(own.values())) / (shards - len(own))
        big = atoms.where((F.col("_weight") > share) & ~F.col("_atom").isin(list(own))).orderBy(F.desc("_weight"), "_atom").limit(shards - 1 - len(own)).collect()
        if not big:
            break
        own |= {r["_atom"]: r["_weight"] for r in big}
    small = atoms.where(~F.col("_atom").isin(list(own)))
    tree = Node(0, shards - len(own))
    level = [tree]
    while level := [n for n in level if n.shards > 1]:
        _split(small, tree, level)
        level = [x for n in level for x in (n.low, n.high)]

    leaves: list[Node] = []

    def collect(node: Node) -> None:
        leaves.append(node) if node.low is None else (collect(node.low), collect(node.high))

    collect(tree)
    to = F.element_at(F.array(*[F.lit(n.first) for n in leaves]), _node_of(tree, leaves) + 1)
    for k, atom in enumerate(own):
        to = F.when(F.col("_atom") == F.lit(atom), F.lit(shards - len(own) + k)).otherwise(to)
    placed = with_facts(rows, atoms.select("_atom", "_n", to.cast("int").alias("shard")), "_atom", "_n", count)
    out = numbered(placed.drop("_n"), "shard", ["_id", "_atom"], count, "slot")
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
