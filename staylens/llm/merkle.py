"""Merkle manifest of a dataset by cogrouped subtree exchange (operator 11).

Rows are leaves of one tree per group, and the roots of these trees are the
leaves of a tree above them. A tree is cut into superblocks of consecutive
nodes. Going up, each superblock is reduced to one node, which is a node of the
next, much smaller level. Going down, the nodes of a superblock are cogrouped
with the one row that says what lies above it (the outer siblings and the
roots); that task reduces the superblock again, joins inner and outer siblings to
a proof, and folds the proof with the row as it is presented now.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from staylens.llm.common import positions, written

#: Nodes of a superblock, a power of the arity 2; a task holds one at a time.
SUPERBLOCK = 1 << 10


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def _levels(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of a superblock of a tree with ``n`` nodes: until one node is left, of the tree or of the block."""
    out, span = [nodes], SUPERBLOCK
    while n > 1 and span > 1:
        below = out[-1]
        out.append([_h("".join(below[i: i + 2])) for i in range(0, len(below), 2)])
        n, span = -(-n // 2), span // 2
    return out


def _inner(levels: list[list[str]], at: int) -> list[str]:
    """Sibling per level of a node of a superblock: its side and digest, or nothing."""
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append(("L" if other < at else "R") + level[other] if other < len(level) else "")
        at >>= 1
    return steps


def fold(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in steps:
        leaf = _h(step[1:] + leaf if step.startswith("L") else leaf + step[1:])
    return leaf


def _reduced(nodes: DataFrame) -> DataFrame:
    """One node per superblock: tree, pos, n, hash of the next level."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        n = int(part["n"].iloc[0])
        return pd.DataFrame({
            "tree": part["tree"].iloc[:1], "pos": part["block"].iloc[:1], "n": -(-n // SUPERBLOCK),
            "hash": _levels(part["hash"].tolist(), n)[-1][0]})

    return _blocked(nodes.select("tree", "pos", "n", "hash")).groupBy("tree", "block").applyInPandas(
        run, "tree long, pos long, n long, hash string")


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / SUPERBLOCK).cast("long"))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Levels of superblocks from the given nodes up to one node per tree; a level has a 1024th of the one below."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(written(_reduced(out[-1]), "merkle-level"))
    return out


def _paths(nodes: DataFrame, above: DataFrame, presented: bool = False) -> DataFrame:
    """Cogroups nodes with what lies above their superblock (tree, block, steps, subroot, root).

    Gives pos, steps, subroot and root of each node, or, of presented rows, all
    of their columns, the siblings and the folded root.
    """
    extra = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name not in ("pos", "tree")]
    schema = (f"tree long, pos long, {', '.join(extra)}, subroot string, root string, "
              "proof array<string>, folded_root string" if presented
              else "tree long, pos long, steps array<string>, subroot string, root string")

    def run(part: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos").reset_index(drop=True)
        if part.empty:
            return part.reindex(columns=[c.split()[0].strip("`") for c in schema.split(", ")])
        levels = _levels(part["hash"].tolist(), int(part["n"].iloc[0]))
        outer_steps = list(outer["steps"].iloc[0])
        steps = [_inner(levels, i) + outer_steps for i in range(len(part))]
        part["subroot"], part["root"] = outer["subroot"].iloc[0], outer["root"].iloc[0]
        if not presented:
            return part.assign(steps=steps)[["tree", "pos", "steps", "subroot", "root"]]
        shown = part["presented"].where(part["presented"].notna(), part["hash"])
        part["proof"] = [[s[1:] for s in own if s] for own in steps]
        part["folded_root"] = [fold(leaf, own) for leaf, own in zip(shown, steps, strict=True)]
        return part.drop(columns=["block"])

    return _blocked(nodes).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(run, schema)


def _descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """What lies above each superblock of the lowest level."""
    for nodes in reversed(levels[1:]):
        above = _paths(nodes, above).withColumnRenamed("pos", "block")
    return above


def manifest(
    df: DataFrame, fields: list[str], group_col: str, id_col: str = "doc_id",
    presented: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: id, group, pos, n, leaf, subroot, root, proof, folded_root, verified.

    A leaf digests ``fields`` in order. Leaves of a group ascend by id, repeated
    ids by their digest; groups ascend with null first. While several nodes
    remain, every two consecutive ones (or the last alone) become one. ``pos``
    and ``n`` are the place and the number of leaves in the group; ``proof``
    lists the siblings from leaf to root, none where a node was alone.
    ``presented`` replaces fields for verification: the folded root comes from
    the row as presented and the siblings of the manifest, and is verified if it equals
    the root. Null values, ids and groups are allowed (a null id sorts first);
    an empty table gives an empty result; texts of any length are digested
    before anything is shuffled; other columns are ignored.
    """
    given = [F.col(c) for c in fields]
    shown = [presented.get(c, F.col(c)) if presented else F.col(c) for c in fields]
    changed = F.lit(False)
    for old, new in zip(given, shown, strict=True):
        changed = changed | ~old.eqNullSafe(new)
    leaves = written(df.select(
        F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), leaf_digest(given).alias("hash"),
        F.when(changed, leaf_digest(shown)).alias("presented")), "merkle-leaves")
    one = F.lit(0).cast("long")
    # Trees are numbered in the order of their groups; these numbers are the places of their roots.
    groups = positions(leaves.select("grp", one.alias("tree")).distinct(), "tree", "grp", label="merkle-groups")
    trees = written(groups.select(F.col("grp").alias("of"), F.col("pos").alias("tree"), F.col("n").alias("trees")),
                    "merkle-trees")
    placed = positions(leaves, "grp", "id", "hash", label="merkle-placed")
    # As text, ids keep their value where some are null.
    nodes = written(
        placed.join(trees, F.col("grp").eqNullSafe(F.col("of"))).drop("of", "trees")
        .withColumn("id", F.col("id").cast("string")), "merkle-nodes")
    levels = _climb(nodes)
    subroots = levels[-1].select(F.col("tree").alias("pos"), "hash", one.alias("tree")).join(
        trees.select(F.col("tree").alias("pos"), F.col("trees").alias("n")), "pos")
    top = _climb(written(subroots.select("tree", "pos", "n", "hash"), "merkle-subroots"))
    root = top[-1].select(
        "tree", one.alias("block"), F.array().cast("array<string>").alias("steps"), F.col("hash").alias("subroot"),
        F.col("hash").alias("root"))
    # Above a tree: the path of its root, and that root as subroot.
    over = _paths(top[0], _descend(top, root)).drop("tree", "subroot").join(
        subroots.select("pos", F.col("hash").alias("subroot")), "pos").select(
        F.col("pos").alias("tree"), one.alias("block"), "steps", "subroot", "root")
    over = written(over, "merkle-over")
    done = _paths(nodes, written(_descend(levels, over), "merkle-above"), presented=True)
    return done.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("grp").alias(group_col), "pos", "n", F.col("hash").alias("leaf"), "subroot",
        "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
