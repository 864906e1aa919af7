"""Merkle manifest of a table by time-forward processing.

Nodes are labelled (level, index). A priority queue ordered by label delivers the digests of children to
their parent; a second sweep in reverse order delivers proof suffixes from the root to the leaves. The part of
the queue between levels 0 and ``LEVELS``, ``LEVELS`` and ``2 * LEVELS``, ... of one aligned block is held in a
task; messages that leave a block are rows of a written relation, which Spark's shuffle brings to the
block of their label. So a tree of n leaves takes log(n) / LEVELS rounds.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residuum.session import stage

#: Levels that one sweep of a block climbs; a block has at most 2 to that power nodes.
LEVELS = 12
#: Leaves whose checksum of the id is divisible by this are tampered with.
TAMPER = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[_field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): ``tree`` orders like lang with null first; ``tampered`` is null where nothing changes."""
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPER)) == 0, _leaf(F.expr("try_add(n_chars, 1)")))
    return docs.select(F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("tree"), "doc_id", _leaf(F.col("n_chars")).alias("leaf"), changed.alias("tampered"))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0, nulls first) in its tree and ``n``, the rows of the tree.

    Rows are dealt by range and sorted per partition; a rank is the place in the partition plus what earlier
    partitions hold of the tree, so neither a tree nor the table passes through one task.
    """
    placed = stage(df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.selectExpr("tree", "_part", "_first", "coalesce(sum(_n) OVER (PARTITION BY tree ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
                             "sum(_n) OVER (PARTITION BY tree) AS n")
    return placed.join(parts, ["tree", "_part"]).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"), "n")


def steps(n: int, levels: int) -> int:
    """Levels that a block of a tree with n nodes on its level climbs."""
    return min(levels, (n - 1).bit_length())


def forward(digests: list[str], first: int, climb: int) -> tuple[str, list]:
    """The digest that leaves a block, and the nodes in the order of their labels, each with its children's messages."""
    if not climb:
        return digests[0], []
    queue, nodes = [(1, (first + k) >> 1, first + k, d) for k, d in enumerate(digests)], []
    while True:
        level, index = queue[0][:2]
        got = [heapq.heappop(queue)[2:]]
        if queue and queue[0][:2] == (level, index):
            got.append(heapq.heappop(queue)[2:])
        nodes.append((level, index, got))
        own = digest("".join(d for _, d in got))
        if level == climb:
            return own, nodes
        heapq.heappush(queue, (level + 1, index >> 1, index, own))


def backward(nodes: list, first: int, count: int, suffix: str) -> list[str]:
    """Proof suffixes of the nodes below: a step is L or R and the sibling on that side, or N without one; lowest level first."""
    if not nodes:
        return [suffix]
    queue, out = [(-nodes[-1][0], -nodes[-1][1], suffix)], [""] * count
    for level, index, got in reversed(nodes):
        own = heapq.heappop(queue)[2]
        for k, (child, _) in enumerate(got):
            step = ("L" if k else "R") + got[1 - k][1] if len(got) == 2 else "N"
            if level == 1:
                out[child - first] = step + own
            else:
                heapq.heappush(queue, (1 - level, -child, step + own))
    return out


def siblings(suffix: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(suffix):
        wide = suffix[at] != "N"
        out.append((suffix[at], suffix[at + 1:at + 65] if wide else ""))
        at += 65 if wide else 1
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for side, other in path:
        leaf = digest(other + leaf if side == "L" else leaf + other)
    return leaf


NODE = "tree string, rank long, digest string, n long"
PATH = "tree string, rank long, suffix string, subroot string, root string"


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("rank")


def _upward(levels: int):
    def up(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        n, first = table["n"][0].as_py(), table["rank"][0].as_py()
        climb = steps(n, levels)
        top, _ = forward(table["digest"].to_pylist(), first, climb)
        return pa.table({"tree": [table["tree"][0].as_py()], "rank": pa.array([first >> levels], pa.int64()), "digest": [top], "n": pa.array([-(-n // (1 << climb))], pa.int64())})
    return up


def _paths(table: pa.Table, above: pa.Table, levels: int) -> tuple[pa.Table, list[str], str, str]:
    table, above = _in_order(table), above.to_pylist()[0]
    digests, first = table["digest"].to_pylist(), table["rank"][0].as_py()
    _, nodes = forward(digests, first, steps(table["n"][0].as_py(), levels))
    return table, backward(nodes, first, len(digests), above["suffix"]), above["subroot"], above["root"]


def _to_nodes(levels: int):
    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        table, paths, subroot, root = _paths(table, above, levels)
        text = lambda v: pa.array([v] * len(paths), pa.string())
        return pa.table({"tree": table["tree"], "rank": table["rank"], "suffix": pa.array(paths, pa.string()), "subroot": text(subroot), "root": text(root)})
    return down


def _to_leaves(levels: int):
    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        table, paths, subroot, root = _paths(table, above, levels)
        proofs = [siblings(p) for p in paths]
        folded = [fold(changed or own, p) for own, changed, p in zip(table["digest"].to_pylist(), table["tampered"].to_pylist(), proofs)]
        return pa.table({"doc_id": table["doc_id"], "leaf": table["digest"], "subroot": [subroot] * len(paths), "root": [root] * len(paths),
                         "proof_sha256": [digest("".join(d for _, d in p)) for p in proofs], "folded_root": folded, "verified": [f == root for f in folded]})
    return down


def climbed(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The written relations of the forward sweep, from the given nodes to one node a tree."""
    tiers = [nodes]
    while not tiers[-1].where("n > 1").isEmpty():
        tiers.append(stage(_blocks(tiers[-1], levels).applyInArrow(_upward(levels), NODE)))
    return tiers


def _blocks(nodes: DataFrame, levels: int):
    return nodes.groupBy("tree", F.shiftright("rank", levels).alias("block"))


def _met(nodes: DataFrame, paths: DataFrame, levels: int):
    return _blocks(nodes, levels).cogroup(paths.groupBy("tree", F.col("rank").alias("block")))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls are hashed as ``-``; a null lang is a tree of its own, the first; rows of a tree are ordered by doc_id
    (null first), equal ids by leaf, and repeated rows are leaves of their own. A tree of one leaf is that leaf. A null
    doc_id is never tampered with; a tampered null n_chars stays null, so its row still verifies. An empty table
    gives no rows; further columns are ignored. A task holds the digests of one block, at most 2 ** ``levels``, never a text.
    """
    own = ranked(stage(leaves(docs)), ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest")
    own = stage(own)
    below = climbed(own, levels)
    subroots = below[-1].select("tree", "digest")
    tops = stage(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest"), ["lang_tree"]))
    above = climbed(tops, levels)
    paths = above[-1].selectExpr("tree", "rank", "'' AS suffix", "CAST(NULL AS STRING) AS subroot", "digest AS root")
    for tier in reversed(above[:-1]):
        paths = stage(_met(tier.select("tree", "rank", "digest", "n"), paths, levels).applyInArrow(_to_nodes(levels), PATH))
    paths = tops.join(paths.select("rank", "suffix", "root"), "rank").selectExpr("lang_tree AS tree", "0L AS rank", "suffix", "digest AS subroot", "root")
    for tier in reversed(below[1:-1]):
        paths = stage(_met(tier, paths, levels).applyInArrow(_to_nodes(levels), PATH))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _met(own, paths, levels).applyInArrow(_to_leaves(levels), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
