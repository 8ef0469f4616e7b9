"""Merkle manifest of a dataset, with proofs and recomputed roots of tampered leaves.

Every document is a leaf. Per source, leaves ascend by doc_id; ``FAN_OUT`` consecutive nodes become
their digest until one, the subroot, is left; subroots, ordered by source, likewise give the root.

The tree is built in aligned blocks of ``FAN_OUT ** BLOCK_LEVELS`` nodes. A block's subtree is an
array of nodes a level, made once; a tampered leaf is a *version* of it, which copies only the
ancestors of that leaf inside the block and shares every other node with the original. A version's
new block root is one node of the next, smaller table of nodes, where it goes on along the stored
path of its block. Rows are joined with paths by (tree, block), so a join's key never has more rows
than a block has leaves, whatever share of the documents one source holds.

Defined results: nulls in any column hash as ``-``, and a null doc_id comes first in its source;
repeated rows are leaves of their own, ordered by leaf; a lone leaf is its own subroot, a lone
subroot the root; a leaf without siblings has the proof of the empty text; an empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

FAN_OUT = 3
#: Levels of a block: 3 ** 6 = 729 nodes.
BLOCK_LEVELS = 6


def _sha(data: Column) -> Column:
    return F.sha2(data, 256)


def _field(c: Column, kind: str = "string") -> Column:
    text = c.cast(kind)
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest of a document with this text."""
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return _sha(F.concat(*fields, _field(text)))


def tree_of_source(source: Column) -> Column:
    """A name of the tree without nulls: null first, then sources by their bytes."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos``, the place of a row in its ``tree`` from 0 in the given order, and ``n``, the tree's rows.

    The order comes from a range-partitioned sort. What is summed up are counts of (tree, partition), of
    which there are at most as many as trees and partitions together.
    """
    ordered = cut(nodes.orderBy("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    rows = ordered.join(runs, ["tree", "part"])
    return rows.select(*nodes.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")


def levels(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN_OUT), out + 1
    return out


def grown(leaves: list[str], height: int) -> list[list[str]]:
    """All nodes of a block, level by level from the leaves."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + FAN_OUT]).encode()).hexdigest() for i in range(0, len(below), FAN_OUT)])
    return out


def version(nodes: list[list[str]], at: int, leaf: str) -> dict[tuple[int, int], str]:
    """The copied nodes of the version in which leaf ``at`` is another: (level, place) -> digest.

    All others are read from the original, so a version costs as many nodes as the block has levels.
    """
    copied = {(0, at): leaf}
    for level, below in enumerate(nodes[:-1]):
        first = at // FAN_OUT * FAN_OUT
        run = "".join(copied.get((level, i), below[i]) for i in range(first, min(first + FAN_OUT, len(below))))
        at //= FAN_OUT
        copied[level + 1, at] = hashlib.sha256(run.encode()).hexdigest()
    return copied


def _block(rows: pa.Table, block_levels: int) -> pa.Table:
    rows = rows.sort_by("pos")
    height = min(block_levels, levels(rows["n"][0].as_py()))
    nodes = grown(rows["node"].to_pylist(), height)
    changed, lefts, rights = [], [], []
    for at, other in enumerate(rows["other"].to_pylist()):
        copied = version(nodes, at, other) if other not in (None, nodes[0][at]) else {}
        changed.append(copied.get((height, 0), nodes[-1][0]))
        left, right = [], []
        for below in nodes[:-1]:
            first = at // FAN_OUT * FAN_OUT
            left.append("".join(below[first:at]))
            right.append("".join(below[at + 1 : first + FAN_OUT]))
            at //= FAN_OUT
        lefts.append(left)
        rights.append(right)
    many = pa.list_(pa.string())
    out = rows.drop_columns(["n", "other"]).append_column("block_root", pa.array([nodes[-1][0]] * len(rows), pa.string()))
    return out.append_column("changed", pa.array(changed, pa.string())).append_column("lefts", pa.array(lefts, many)).append_column("rights", pa.array(rights, many))


def in_blocks(nodes: DataFrame, block_levels: int) -> DataFrame:
    """The nodes of a level (tree, pos, n, node, other, further columns) with what their block makes of them.

    Adds ``block``, its root ``block_root``, the root ``changed`` of the version in which ``other`` stands for
    the node, and for each level of the block the siblings on the left and on the right.
    """
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN_OUT**block_levels)).cast("long"))
    kinds = [f"`{c}` {kind}" for c, kind in nodes.dtypes if c not in ("n", "other")]
    schema = ", ".join([*kinds, "block_root string", "changed string", "lefts array<string>", "rights array<string>"])
    return nodes.groupBy("tree", "block").applyInArrow(lambda rows: _block(rows, block_levels), schema)


def built(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """The blocks of all trees, a table for every ``block_levels`` levels; in the last each tree is one block."""
    out = []
    while True:
        done = cut(in_blocks(nodes, block_levels))
        out.append(done)
        if not done.where("block > 0").take(1):
            return out
        blocks = done.groupBy("tree", "block").agg(F.first("block_root").alias("node"))
        sizes = blocks.groupBy("tree").agg(F.count("*").alias("n"))
        nodes = blocks.join(sizes, "tree").select("tree", F.col("block").alias("pos"), "n", "node", F.lit(None).cast("string").alias("other"))


def _ways(tables: list[DataFrame], ends: DataFrame) -> DataFrame:
    """For each block of the first table the way from its root up: (tree, block, up_lefts, up_rights, further columns of ``ends``).

    ``ends`` has that for block 0 of the last table.
    """
    ways = ends
    rest = [c for c in ends.columns if c not in ("tree", "block", "up_lefts", "up_rights")]
    for table in reversed(tables[1:]):
        joined = table.join(ways, ["tree", "block"])
        ways = joined.select("tree", F.col("pos").alias("block"), F.concat("lefts", "up_lefts").alias("up_lefts"), F.concat("rights", "up_rights").alias("up_rights"), *rest)
    return ways


def folded(node: Column, lefts: Column, rights: Column) -> Column:
    """The root that a node and its siblings, level by level, give."""
    runs = F.zip_with(lefts, rights, lambda left, right: F.struct(left.alias("l"), right.alias("r")))
    return F.aggregate(runs, node, lambda acc, x: _sha(F.concat(x["l"], acc, x["r"])))


def manifest(docs: DataFrame, tampered: Column, when: Column, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, source, leaf, lefts, rights, subroot, root and folded_root of every document.

    ``lefts`` and ``rights`` are its siblings from the leaf to the root. Where ``when`` is true the document
    is held to have had the text ``tampered`` instead; ``folded_root`` is the root of that version.
    """
    rows = docs.select(
        "doc_id", "source", tree_of_source(F.col("source")).alias("tree"), leaf_digest(F.col("text")).alias("node"), F.when(when, leaf_digest(tampered)).alias("other")
    )
    tables = built(placed(rows, "doc_id", "node"), block_levels)
    subroots = tables[-1].where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("block_root").alias("node"))
    upper = built(placed(subroots, "name").withColumn("other", F.lit(None).cast("string")), block_levels)
    nothing = F.array().cast("array<string>")
    root = upper[-1].where("pos = 0").select("tree", "block", nothing.alias("up_lefts"), nothing.alias("up_rights"), F.col("block_root").alias("root"))
    ends = upper[0].join(_ways(upper, root), ["tree", "block"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.concat("lefts", "up_lefts").alias("up_lefts"), F.concat("rights", "up_rights").alias("up_rights"), F.col("node").alias("subroot"), "root"
    )
    return tables[0].join(_ways(tables, ends), ["tree", "block"]).select(
        "doc_id",
        "source",
        F.col("node").alias("leaf"),
        F.concat("lefts", "up_lefts").alias("lefts"),
        F.concat("rights", "up_rights").alias("rights"),
        "subroot",
        "root",
        folded(F.col("changed"), F.col("up_lefts"), F.col("up_rights")).alias("folded_root"),
    )


def proof(lefts: Column, rights: Column) -> Column:
    """All siblings of a leaf, level by level, as one text."""
    return F.array_join(F.zip_with(lefts, rights, lambda left, right: F.concat(left, right)), "")
