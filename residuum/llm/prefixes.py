"""Conversation prefix trie by whole-sequence collapse.

Conversations are rebuilt turn by turn as rows. Every prefix gets a digest; identical whole
conversations collapse into one weighted sequence, sequences that are proper prefixes of others are
dropped by an anti-join, and what remains are the leaves. All node figures are then aggregates of weighted
prefixes of the distinct sequences, not of the conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from residuum.operators.sequence import numbered
from residuum.session import stage

#: A conversation borrows fewer turns than BORROWED from the first of its GROUP.
GROUP, BORROWED = 5, 9
#: Turns whose digests meet in one row; longer conversations are digested block by block, blocks likewise.
BLOCK = 64
#: Conversation ids packed into one row before the list of a node is digested.
PACK = 1024
#: Digest of the prefix without turns.
ROOT = "root"


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, i, digest, bytes) per rebuilt turn, i from 0, and (conv_id, n) per conversation, n turns or 0."""
    clean = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = numbered(clean, ["conv_id"], ["turn", "role", "text"], f"coalesce(turn div {BLOCK}, {-(1 << 62)})", "place")
    # The length of the role keeps role and text apart.
    own = stage(placed.select("conv_id", "place", F.octet_length("text").cast("long").alias("bytes"),
                              F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest")))
    sizes = own.groupBy("conv_id").agg((F.max("place") + 1).alias("size"))
    plans = sizes.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first"),
                         F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(BORROWED)).alias("h"))
    plans = plans.join(sizes.select(F.col("conv_id").alias("first"), F.col("size").alias("there")), "first", "left")
    plans = stage(plans.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = own.where(F.col("place") < BORROWED).withColumnRenamed("conv_id", "first")
    borrowed = plans.join(heads, "first").where("place < h").select("conv_id", F.col("place").alias("i"), "digest", "bytes")
    kept = own.join(plans, "conv_id").where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("i"), "digest", "bytes")
    return stage(borrowed.unionByName(kept)), plans.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("size") - F.col("h"))).alias("n"))


def digested(items: DataFrame) -> DataFrame:
    """``items`` (conv_id, i, digest) with ``id``, the digest of everything up to i, and ``parent``, that of everything before.

    Digests meet in blocks of ``BLOCK``. Full blocks are items of a shorter sequence whose prefixes are
    digested the same way, so no row or task ever holds a long conversation. Equal prefixes have equal ids, wherever they end.
    """
    blocks = stage(items.withColumn("b", F.expr(f"i div {BLOCK}")).groupBy("conv_id", "b").agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("own")))
    whole = lambda c: F.array_join(F.transform(c, lambda x: x["digest"]), "")
    full = blocks.where(F.size("own") == BLOCK).select("conv_id", F.col("b").alias("i"), F.sha2(whole(F.col("own")), 256).alias("digest"))
    if full.isEmpty():
        blocks = blocks.withColumn("start", F.lit(ROOT)).withColumn("end", F.lit(None).cast("string"))
    else:
        outer = stage(digested(full))
        starts, ends = outer.select("conv_id", (F.col("i") + 1).alias("b"), F.col("id").alias("start")), outer.select("conv_id", F.col("i").alias("b"), F.col("id").alias("end"))
        blocks = blocks.join(starts, ["conv_id", "b"], "left").join(ends, ["conv_id", "b"], "left").withColumn("start", F.coalesce("start", F.lit(ROOT)))

    def upto(x: Column, k: Column) -> Column:
        part = F.sha2(F.concat("start", whole(F.slice("own", 1, k + 1))), 256)
        return F.when(k + 1 == BLOCK, F.col("end")).otherwise(part)

    ids = blocks.select("conv_id", "start", F.transform("own", lambda x: x["i"]).alias("places"), F.transform("own", upto).alias("ids"))
    rows = ids.select("conv_id", "start", "places", "ids", F.posexplode("ids").alias("k", "id"))
    return rows.select("conv_id", F.element_at("places", F.col("k") + 1).alias("i"), "id", F.when(F.col("k") == 0, F.col("start")).otherwise(F.get("ids", F.col("k") - 1)).alias("parent"))


def running(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``df`` (key, at, value) with ``before``, the sum of ``value`` over smaller ``at`` of the key, in blocks of ``at``."""
    blocked = df.withColumn("_b", F.expr(f"{at} div {PACK}"))
    local = blocked.withColumn("_in", F.expr(f"coalesce(sum({value}) OVER (PARTITION BY {key}, _b ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    sums = stage(blocked.groupBy(key, "_b").agg(F.sum(value).alias("_sum")))
    if sums.where("_b > 0").isEmpty():
        return local.withColumn("before", F.col("_in")).drop("_b", "_in")
    offsets = running(sums.withColumnRenamed("_b", "_at"), key, "_at", "_sum").select(key, F.col("_at").alias("_b"), F.col("before").alias("_offset"))
    return local.join(offsets, [key, "_b"]).withColumn("before", F.col("_in") + F.col("_offset")).drop("_b", "_in", "_offset")


def _list_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One SHA-256 per id over its packs, which come in order; only the state of one digest is held."""
    current, state = None, None
    for batch in batches:
        done = []
        for key, text in zip(batch["id"], batch["pack"]):
            if key == current:
                state.update(b"," + text.encode())
            else:
                if current is not None:
                    done.append((current, state.hexdigest()))
                current, state = key, hashlib.sha256(text.encode())
        yield pd.DataFrame(done, columns=["id", "ends_sha256"])
    if current is not None:
        yield pd.DataFrame([(current, state.hexdigest())], columns=["id", "ends_sha256"])


def list_digests(members: DataFrame) -> DataFrame:
    """(id, ends_sha256) of (id, conv_id): the ids ascending, comma-joined.

    A digest of one list is sequential, so a list passes through one task, as a stream of packed rows that
    is never held.
    """
    packs = members.withColumn("b", F.expr(f"conv_id div {PACK}")).groupBy("id", "b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("pack"))
    return packs.repartition("id").sortWithinPartitions("id", "b").select("id", "pack").mapInPandas(_list_digests, "id string, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text, nulls of which count as empty; repeated rows
    are repeated turns. Rows without a conv_id belong to no conversation and are left out. An empty table has no
    node, not even a root. Very long conversations, a first turn that all share, and thousands of equal
    conversations are spread over tasks (only the member list of a node is a stream in one). Further columns are ignored.
    """
    rows, sizes = rebuilt(turns)
    ids = digested(rows.select("conv_id", "i", "digest")).withColumn("depth", F.col("i") + 1)
    ids = stage(ids.join(rows.select("conv_id", "i", "bytes"), ["conv_id", "i"]).drop("i"))
    # Whole conversations collapse: one weighted sequence for each id that a conversation ends in.
    last = sizes.join(ids.select("conv_id", F.col("depth").alias("n"), "id"), ["conv_id", "n"], "left").withColumn("id", F.coalesce("id", F.lit(ROOT)))
    last = stage(last)
    sequences = last.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"))
    sequences = stage(sequences)
    weighted = ids.join(sequences.select("conv_id", "weight", "n"), "conv_id").select("conv_id", "depth", "id", "parent", "bytes", "weight", "n")
    roots = sequences.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("bytes"), "weight", "n")
    weighted = stage(weighted.unionByName(roots))
    proper = weighted.where("depth < n").select("id").distinct()
    leaves = sequences.join(proper, "id", "left_anti").select("conv_id", F.lit(True).alias("leaf"))
    weighted = stage(weighted.join(leaves, "conv_id", "left"))
    owner = F.min(F.when(F.col("leaf"), F.col("conv_id")))
    nodes = stage(weighted.groupBy("id").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
                                             F.count("leaf").alias("n_leaves"), owner.alias("owner"), (F.first("bytes") * (F.sum("weight") - 1)).alias("saved")))
    # A node belongs to the smallest leaf below it; what a leaf owns is the lower end of its path. The sum over a
    # subtree is the owner's part from the node down, and everything that the other leaves below own.
    owned = nodes.groupBy("owner").agg(F.sum("saved").alias("total"), F.min("depth").alias("top"))
    others = weighted.where("leaf").select("conv_id", "depth", "id").join(owned.withColumnRenamed("owner", "conv_id"), "conv_id").where("depth < top")
    others = others.groupBy("id").agg(F.sum("total").alias("others"))
    below = running(nodes.select("id", "owner", "depth", "saved"), "owner", "depth", "saved").join(owned, "owner").select("id", (F.col("total") - F.col("before")).alias("below"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, "id").join(others, "id", "left").join(children, "id", "left").join(list_digests(last), "id", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
                      (F.col("below") + F.coalesce("others", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
