"""Merkle manifest of a table: a binary hash tree for each group of rows, one over the groups, and a proof for each row.

``H`` is the sha256 of its inputs' hex digests written one after the other, as hex digits.  While a tree has several nodes,
each two neighbours become their ``H``; a last one without a partner becomes the ``H`` of itself.  The nodes that remain, one a
group, are the leaves of the root tree.

A group of any size is cut into superblocks of ``1 << HEIGHT`` neighbouring nodes.  Going up, each superblock is reduced to its
top node, and these are the nodes of the next tier, until each group has one.  Going down, the nodes of a superblock and the
outer nodes that its proofs need (a few digests) are cogrouped, which gives the outer nodes of the superblocks below.  At the
leaves the cogrouped task reduces its superblock, joins the proofs and folds the presented leaves.  So no task holds more than
one superblock, and a group that is most of the table is as parallel as any other.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.steps import numbered, written

HEIGHT = 12
#: First character of a step of a proof: the sibling stands left or right of the node, or there is none.
LEFT, RIGHT, ALONE = "L", "R", "="
_PATH = "path array<string>, subroot string, root string"


def leaf_digest(*fields: Column) -> Column:
    """sha256 of a row: each field as its UTF-8 byte count, a colon and its value, or ``-`` if it is null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def join_nodes(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def reduce_levels(nodes: list[str], steps: int) -> list[list[str]]:
    """The nodes, and those of each of the next ``steps`` levels."""
    levels = [nodes]
    for _ in range(steps):
        nodes = [join_nodes(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def steps_up(levels: list[list[str]], at: int) -> list[str]:
    """Proof of the node ``at`` of the lowest level up to the last one."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(ALONE if other >= len(level) else (LEFT if other < at else RIGHT) + level[other])
        at >>= 1
    return out


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its proof give."""
    for step in path:
        sibling = step[1:]
        node = join_nodes(sibling, node) if step[0] == LEFT else join_nodes(node, sibling) if step[0] == RIGHT else join_nodes(node)
    return node


def siblings(path: Column) -> Column:
    """The siblings of a proof, without their sides, one after the other."""
    return F.array_join(F.transform(F.filter(path, lambda s: s != ALONE), lambda s: F.substring(s, 2, 64)), "")


def _nodes(rows: DataFrame) -> DataFrame:
    """Numbered rows as nodes: ``block`` is their superblock, ``left`` the levels between them and the top of their tree."""
    left = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0).cast("int")
    return rows.withColumn("left", left).withColumn("block", F.shiftright("pos", HEIGHT)).drop("size")


def _top(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("pos", kind="stable")
    left = int(nodes["left"].iloc[0])
    steps, pos = min(left, HEIGHT), int(nodes["block"].iloc[0])
    top = reduce_levels(nodes["node"].tolist(), steps)[-1][0]
    return pd.DataFrame({"tree": [nodes["tree"].iloc[0]], "pos": [pos], "node": [top], "left": [left - steps], "block": [pos >> HEIGHT]})


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and the tops of their superblocks, tier by tier, until each tree has one node."""
    tiers = [nodes]
    most = nodes.agg(F.max("left")).first()[0] or 0
    for _ in range(-(-most // HEIGHT)):
        below = tiers[-1].select("tree", "pos", "node", "left", "block")
        tiers.append(written(below.groupBy("tree", "block").applyInPandas(_top, "tree string, pos long, node string, left int, block long")))
    return tiers


def _spread(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the nodes of one superblock, from those of the superblock."""
    nodes = nodes.sort_values("pos", kind="stable")
    above = outer.iloc[0]
    levels = reduce_levels(nodes["node"].tolist(), min(int(nodes["left"].iloc[0]), HEIGHT))
    paths = [steps_up(levels, i) + list(above["path"]) for i in range(len(nodes))]
    return pd.DataFrame({"tree": nodes["tree"], "block": nodes["pos"], "path": paths, "subroot": above["subroot"], "root": above["root"]})


def _outer(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, block, path, subroot, root): proofs of the superblocks of the lowest tier, from those of the trees."""
    outer = tops.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(tiers[1:-1]):
        both = nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        outer = written(both.applyInPandas(_spread, f"tree string, block long, {_PATH}"))
    return outer


def _fold_block(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Local reduction of a superblock, its leaves' proofs, and the roots that the presented leaves fold to."""
    leaves = leaves.sort_values("pos", kind="stable")
    above, known = outer.iloc[0], {}
    beyond = list(above["path"])
    levels = reduce_levels(leaves["node"].tolist(), min(int(leaves["left"].iloc[0]), HEIGHT))
    paths, roots = [], []
    for i, leaf in enumerate(leaves["presented"]):
        path = steps_up(levels, i)
        top = fold(leaf, path)
        if top not in known:
            known[top] = fold(top, beyond)
        paths.append(path + beyond)
        roots.append(known[top])
    out = leaves.drop(columns=["block", "left"]).rename(columns={"node": "leaf"})
    return out.assign(path=paths, subroot=above["subroot"], root=above["root"], folded_root=roots)


def manifest(rows: DataFrame, group: Column, order: Column, leaf: Column, presented: Column | None = None) -> DataFrame:
    """``tree``, ``id``, ``pos``, ``leaf``, ``presented``, ``path``, ``subroot``, ``root`` and ``folded_root`` of every row.

    Rows of a group are the leaves of its tree, ascending by ``order`` (nulls first) and then by their digest; ``tree`` is
    empty for a null group and else ``=`` and the group, so that trees are in order of their groups, nulls first, bytewise.
    ``presented`` are the leaves that are checked (by default the leaves themselves): a row is verified if ``folded_root``,
    which its presented leaf and the proof ``path`` give, is ``root``.  Repeated rows are leaves of their own, in any order; an
    empty table gives no rows; columns of ``rows`` are not carried over, so their names are of no account.
    """
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    own = rows.select(tree.alias("tree"), order.alias("id"), leaf.alias("node"), (leaf if presented is None else presented).alias("presented"))
    kind = own.schema["id"].dataType.simpleString()
    leaves = written(_nodes(numbered(own, "tree", ["id", "node"])))
    tiers = _tiers(leaves)

    # the same over the groups: their subroots are the leaves of one tree
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    subroots = written(_nodes(numbered(subroots, "tree", ["name"])))
    upper = _tiers(subroots)
    whole = upper[-1].select("tree", F.array().cast("array<string>").alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    outer = _outer(upper, whole)
    both = subroots.select("tree", "pos", "node", "left", "block").groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    proofs = both.applyInPandas(_spread, f"tree string, block long, {_PATH}").select(F.col("block").alias("pos"), "path", "root")
    tops = subroots.join(proofs, "pos").select(F.col("name").alias("tree"), "path", F.col("node").alias("subroot"), "root")

    outer = _outer(tiers, written(tops))
    both = leaves.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    schema = f"tree string, id {kind}, leaf string, presented string, pos long, {_PATH}, folded_root string"
    return both.applyInPandas(_fold_block, schema)
