"""Near duplicates: an LSH forest over min-hash signatures, links confirmed on full shingle sets.

A forest of ``TREES`` sorted orders: tree t sorts documents by its own ``DEPTH`` min-hashes. In each
order the ``NEIGHBOURS`` documents before a document, those with the longest common prefixes, are its
candidates. The depth adapts by itself: where few documents share a prefix the neighbours reach down
to ``MIN_DEPTH`` common hashes; in a crowded region, where more than ``NEAR`` documents lie closer, a
candidate must share ``CROWDED_DEPTH``, and the nearest agree on all of them. Sorting is a
range partitioning of (key, document), so a crowded region, even one of equal keys, is cut into even
parts, and the pairs across a cut are formed from the rows at its two sides.

Documents of equal sets are one node. Candidates are confirmed in blocks: connected candidates meet in
one task, cut into a grid of chunks if there are many, so a text is sent once per block instead of once per
pair, and pairs that a block has already connected are not compared again.

Neighbours are capped and signatures are random, so the forest alone may miss a link. What it left apart is
searched exactly: two linked sets share an element among the rarest of each (a prefix under any common
order), so documents of different components that share one there, and could still overlap enough after
it, are confirmed as well. Components that the forest has already joined form no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from residuum.llm.components import components
from residuum.session import stage

SHINGLE = 5
TREES, DEPTH, MIN_DEPTH, NEIGHBOURS = 20, 8, 3, 16
NEAR, CROWDED_DEPTH = 4, 7
#: Edge-disjoint spanning forests of a sorted part whose pairs are confirmed.
FORESTS = 3
#: Bytes of further hashes that go with each entry: a pair must agree on as many as a linked pair does (less 4.5 standard deviations).
SKETCH = 32
#: Documents of a chunk of the grid, and forest entries of a partition.
CHUNK, ENTRIES = 256, 100_000

#: Shingles are ordered by how full their bin is, so that common passages come last; 2 ** BIN_BITS counts are held, in blocks of BIN_BLOCK.
BIN_BITS, BIN_BLOCK = 18, 256

_HASHES = TREES * DEPTH + SKETCH
_MUL = np.random.default_rng(20).integers(0, 2**31, _HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), ">u8").astype(np.uint64)
    width = min(SHINGLE, len(codes))
    out = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        out = _stirred((out + codes[k:len(codes) - width + 1 + k]) * _MIX)
    return np.unique(out)


def set_key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def signature(hashes: np.ndarray) -> bytes:
    """Two bytes per hash of every tree, then one per hash of the sketch."""
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        block = low[at:at + 512, None] * _MUL[None, :]
        block ^= block >> np.uint32(15)
        np.minimum(least, block.min(axis=0), out=least)
    return least[:TREES * DEPTH].astype(">u2").tobytes() + least[TREES * DEPTH:].astype(np.uint8).tobytes()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known of each row, and after the last one how many shingles of the task lie in each bin, a row per block of bins."""
    names, counts, ids = ["doc_id", "n_shingles", "set_key", "signature", "block", "bins"], np.zeros(1 << BIN_BITS, np.int32), None
    for batch in batches:
        ids, sets = batch.column(0).type, [shingles(t.as_py()) for t in batch.column(1)]
        if sets:
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=1 << BIN_BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()),
            pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.list_(pa.int32()))], names)
    blocks = np.flatnonzero(counts.reshape(-1, BIN_BLOCK).any(axis=1)).astype(np.int32)
    if len(blocks):
        n, held = len(blocks), counts.reshape(-1, BIN_BLOCK)[blocks].ravel()
        yield pa.RecordBatch.from_arrays([
            pa.nulls(n, ids), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(blocks),
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(held) + 1, BIN_BLOCK, dtype=np.int32)), pa.array(held))], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, n) of the blocks of a task, added up as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[block] = total.get(block, 0) + counts.values.to_numpy().astype(np.int64)
    for block, counts in total.items():
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((full + block * BIN_BLOCK).astype(np.int32)), pa.array(counts[full])], ["bin", "n"])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _neighbours(keys, sketches, ids, fresh: int, agree: int) -> list[tuple[int, bytes, bytes]]:
    """Pairs whose later row is among the last ``fresh`` rows, those first whose sketches agree most."""
    out, n = set(), len(keys)
    for step in range(1, min(NEIGHBOURS, n - 1) + 1):
        first, prefix = max(step, n - fresh), 1 + 2 * (MIN_DEPTH if step <= NEAR else CROWDED_DEPTH)
        later = np.arange(first, n)
        same = (keys[later, :prefix] == keys[later - step, :prefix]).all(axis=1)
        later = later[same]
        same = (sketches[later] == sketches[later - step]).sum(axis=1)
        for i, k in zip(later[same >= agree], same[same >= agree]):
            x, y = ids[i - step], ids[i]
            if x != y:
                out.add((-int(k), min(x, y), max(x, y)))
    return sorted(out)


def _joins(root: dict[bytes, bytes], a: bytes, b: bytes) -> bool:
    """Whether the edge connects two trees of the union-find ``root``; they are joined."""
    ends = []
    for x in (a, b):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        ends.append(x)
    root[ends[0]] = ends[1]
    return ends[0] != ends[1]


_FOUND = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("cut", pa.int32()), ("key", pa.binary()), ("sketch", pa.binary())])
_WIDTH = 1 + 2 * DEPTH


def _walker(agree: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of one sorted part, then its first and last rows, marked with the cuts they lie at."""
        part, head, tail, forests = TaskContext.get().partitionId(), [], None, [{} for _ in range(FORESTS)]
        for batch in batches:
            if not len(batch):
                continue
            rows = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()]
            joined = [old + new for old, new in zip(tail, rows)] if tail else rows
            keys = np.frombuffer(b"".join(joined[0]), np.uint8).reshape(-1, _WIDTH)
            sketches = np.frombuffer(b"".join(joined[1]), np.uint8).reshape(-1, SKETCH)
            # Pairs that connect something in one of a few forests, the most similar first; what these leave apart is searched exactly later.
            kept = [p[1:] for p in _neighbours(keys, sketches, joined[2], len(rows[2]), agree) if any(_joins(f, *p[1:]) for f in forests)]
            if kept:
                none = [None] * len(kept)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in kept], pa.binary()), pa.array([p[1] for p in kept], pa.binary()), pa.array(none, pa.int32()),
                                                  pa.array(none, pa.binary()), pa.array(none, pa.binary())], schema=_FOUND)
            if len(head) < NEIGHBOURS:
                head += list(zip(*[x[:NEIGHBOURS - len(head)] for x in rows]))
            tail = [x[-NEIGHBOURS:] for x in joined]
        if tail:
            edge = [(part - 1, *r) for r in head if part] + [(part, *r) for r in zip(*tail)]
            yield pa.RecordBatch.from_arrays([pa.array([r[3] for r in edge], pa.binary()), pa.array([None] * len(edge), pa.binary()),
                                              pa.array([r[0] for r in edge], pa.int32()), pa.array([r[1] for r in edge], pa.binary()),
                                              pa.array([r[2] for r in edge], pa.binary())], schema=_FOUND)
    return walk


def _across(agree: int):
    def cross(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(a=rows["a"].map(bytes), key=rows["key"].map(bytes)).sort_values(["key", "a"])
        keys = np.frombuffer(b"".join(rows["key"]), np.uint8).reshape(-1, _WIDTH)
        sketches = np.frombuffer(b"".join(map(bytes, rows["sketch"])), np.uint8).reshape(-1, SKETCH)
        return pd.DataFrame([p[1:] for p in _neighbours(keys, sketches, list(rows["a"]), len(rows), agree)], columns=["a", "b"])
    return cross


def _confirmer(percent: int):
    def confirm(key, pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """The links among the pairs of a block that connect what is not yet connected in it."""
        sets = {}
        for node, text in zip(members["node"].map(bytes), members["text"]):
            if node not in sets:
                found = shingles(text)
                if set_key(found) == node:  # another row may bear the same id
                    sets[node] = found
        root, out = {n: n for n in sets}, []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in sorted(zip(pairs["a"].map(bytes), pairs["b"].map(bytes))):
            if find(a) == find(b):
                continue
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[find(a)] = find(b)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])
    return confirm


def describe(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_key, signature) of every row, the last two null for texts without a word; and (bin, n), the
    shingles of all rows by their leading ``BIN_BITS`` bits. Each text is cut once for both."""
    both = stage(docs.select("doc_id", "text").mapInArrow(_described, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                                                          "n_shingles long, set_key binary, signature binary, block int, bins array<int>"))
    # Counts of all tasks are added block by block: rows of single bins are made once, not once a task.
    bins = both.where("block IS NOT NULL").select("block", "bins").repartition("block").mapInArrow(_summed, "bin int, n long")
    return both.where("block IS NULL").drop("block", "bins"), bins


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """Nodes ``a`` with the greater nodes that are their neighbours in a tree, as ``near`` array<binary>; ``nodes`` has (node, signature).

    Of each sorted part ``FORESTS`` edge-disjoint spanning forests are kept, of pairs with the most equal sketches. A node has at
    most 2 * ``NEIGHBOURS`` * ``TREES`` neighbours, so the array is bounded.
    """
    share = percent / 100
    agree = int(SKETCH * share - 4.5 * (SKETCH * share * (1 - share)) ** 0.5)
    entries = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "signature").select(
        F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.substring("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))).alias("key"),
        F.substring("signature", F.lit(TREES * 2 * DEPTH + 1), F.lit(SKETCH)).alias("sketch"), "node")
    parts = max(1, -(-nodes.count() * TREES // ENTRIES))
    ordered = entries.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
    found = stage(ordered.mapInArrow(_walker(agree), "a binary, b binary, cut int, key binary, sketch binary"))
    across = found.where("cut IS NOT NULL").groupBy("cut").applyInPandas(_across(agree), "a binary, b binary")
    return found.where("cut IS NULL").select("a", "b").unionByName(across).groupBy("a").agg(F.collect_set("b").alias("near"))


def links(docs: DataFrame, nodes: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) among the candidates of ``near`` (a, near); inside a block only those that connect something new."""
    comp = components(near.select("a", F.explode("near").alias("b")))
    grid = comp.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).alias("grid"))
    comp = stage(comp.join(grid, "root").select(F.col("node").alias("a"), "root", "grid"))
    # Both ends lie in one component, so only one is looked up, once for all its neighbours.
    chunk = lambda c: F.pmod(F.xxhash64(c), F.col("grid"))
    placed = stage(near.join(comp, "a").select("a", "root", "grid", F.explode("near").alias("b")).select(
        "a", "b", "root", F.least(chunk("a"), chunk("b")).alias("i"), F.greatest(chunk("a"), chunk("b")).alias("j")))
    block = ["root", "i", "j"]
    members = placed.select(*block, F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node")
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    # Texts are shuffled at every size, so that a run costs in proportion to its input.
    members = members.join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        *[F.col(c).alias(f"_{c}") for c in block], "node", "text")
    return placed.groupBy(*block).cogroup(members.groupBy(*[f"_{c}" for c in block])).applyInPandas(_confirmer(percent), "a binary, b binary")


def _prefixer(ranks: np.ndarray, percent: int):
    low = np.uint64((1 << (64 - BIN_BITS)) - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Key, size and rarest elements of each set, in the common order."""
        for batch in batches:
            rows = []
            for text in batch.column(0):
                found = shingles(text.as_py())
                if len(found):
                    ordered = (ranks[(found >> np.uint64(64 - BIN_BITS)).astype(np.int64)] << np.uint64(64 - BIN_BITS)) | (found & low)
                    take = len(found) - -(-percent * len(found) // 100) + 1
                    rows.append((set_key(found), len(found), np.sort(np.partition(ordered, take - 1)[:take]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["node", "n", "rarest"])
    return cut


def unjoined(docs: DataFrame, bins: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, near), one pair a row, of nodes in different components of ``roots``; no linked pair is missing.

    The order of elements comes from ``bins``, counts in 2 ** BIN_BITS bins, all that is brought to the driver. It only decides how
    few pairs there are: any order gives a superset of the links.
    """
    texts = docs.select("text")
    known = bins.toPandas()
    counts = np.zeros(1 << BIN_BITS, np.int64)
    counts[known["bin"].to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
    ranks = np.empty(1 << BIN_BITS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << BIN_BITS, dtype=np.uint64)
    sets = texts.mapInArrow(_prefixer(ranks, percent), "node binary, n long, rarest array<long>").groupBy("node").agg(
        F.max("n").alias("n"), F.max("rarest").alias("rarest"))
    entries = stage(sets.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", F.posexplode("rarest").alias("at", "element")))
    shared = entries.groupBy("element").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("element")
    live = stage(entries.join(shared, "element", "left_semi"))
    side = lambda p: live.select("element", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "root", "n", "at")])
    # What both can still have in common from this element on must reach the least overlap of a link.
    reach = f"{100 + percent} * least(a_n - a_at, b_n - b_at) >= {percent} * (a_n + b_n)"
    return side("a").hint("merge").join(side("b"), "element").where(f"a_node < b_node AND a_root <> b_root AND {reach}").select(
        F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct().select("a", F.array("b").alias("near"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, and set_key.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of five-word shingles
    (A-Z lower-cased; with fewer words the whole sequence is the one shingle). ``component_id`` is the
    smallest id reachable. Null and blank texts have no shingle and are linked with nothing. Repeated rows
    are in one component; rows that share an id but not a text are judged apart; null ids are never a
    component_id unless a component has no other; an empty table gives no rows; further columns are ignored.
    """
    described, bins = describe(docs)
    nodes = described.where("set_key IS NOT NULL").groupBy(F.col("set_key").alias("node")).agg(
        F.min("doc_id").alias("doc_id"), F.max("signature").alias("signature"))
    found = stage(links(docs, nodes, stage(candidates(nodes, percent)), percent))
    missed = stage(unjoined(docs, bins, stage(components(found)), percent))
    roots = stage(components(found.unionByName(links(docs, nodes, missed, percent))))
    rooted = described.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    # Minima per component combine before the shuffle; the join back splits a crowded component.
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "set_key")


def _keyed(schema):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([set_key(shingles(t["text"].as_py())) for t in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["_doc", "_key"])
    return add


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component, with the columns of ``docs``; rows without a word all stay.

    A row stays by its id. Only where an id occurs more than once its text decides, and equal rows become one.
    """
    judged = stage(near_duplicates(docs, percent))
    ids = judged.groupBy("doc_id").agg((F.count("*") > 1).alias("_many"), F.max("kept").alias("_any")).where("_any").withColumnRenamed("doc_id", "_id")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    met = own.hint("merge").join(ids, F.col("_doc.doc_id").eqNullSafe(F.col("_id")))
    many = met.where("_many").select("_doc")
    keyed = many.mapInArrow(_keyed(None), many.withColumn("_key", F.lit(None).cast("binary")).schema)
    right = judged.where("kept").select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_right")).distinct()
    chosen = keyed.join(right, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_right"))).select("_doc", "_key")
    one = chosen.where("_key IS NOT NULL").withColumn("_id", F.col("_doc.doc_id")).dropDuplicates(["_id", "_key"]).select("_doc")
    return met.where("NOT _many").select("_doc").unionByName(one).unionByName(chosen.where("_key IS NULL").select("_doc")).select("_doc.*")
