"""The residue contact graph and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import merged, stage
from . import contacts as c


def contact_graph(atoms: DataFrame, include_ligands: bool = True, include_metals: bool = True) -> DataFrame:
    """Undirected edges ``i < j`` over residues, ligands and coordinated metals, with the least distance."""
    def edge(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
        return df.selectExpr("structure_id", f"least({a}, {b}) AS i", f"greatest({a}, {b}) AS j", "distance", f"'{kind}' AS kind")

    edges = edge(c.residue_contacts(atoms), "residue_idx_i", "residue_idx_j", "residue")
    if include_ligands:
        edges = edges.unionByName(edge(c.ligand_contacts(atoms), "residue_idx", "ligand_idx", "ligand"))
    if include_metals:
        donors = c.metal_coordination(atoms).filter("is_donor")
        edges = edges.unionByName(edge(donors, "residue_idx", "metal_idx", "metal"))
    return edges.groupBy("structure_id", "i", "j").agg(F.expr("min(distance) AS distance"), F.expr("min(kind) AS kind"))


def both_ways(edges: DataFrame) -> DataFrame:
    turned = "explode(array(struct(i AS a, j AS b), struct(j AS a, i AS b))) AS e"
    return edges.selectExpr("structure_id", "distance", turned).selectExpr(
        "structure_id", "e.a AS node", "e.b AS neighbour", "distance")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("structure_id", "node").agg(
        F.expr("count(*) AS degree"), F.expr("min(distance) AS closest"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """Pairs of nodes that share a neighbour and do not touch, with how many they share.

    Pairs are reached through the shared node by an equi-join. Only the count and
    the least bridge are kept per pair, and both combine map-side.
    """
    edges = stage(edges)
    arms = both_ways(edges)
    left = arms.selectExpr("structure_id", "node", "neighbour AS a", "distance AS d_a")
    right = arms.selectExpr("structure_id", "node", "neighbour AS b", "distance AS d_b")
    pairs = left.join(merged(right), ["structure_id", "node"]).filter("a < b").groupBy("structure_id", "a", "b").agg(
        F.expr("count(*) AS n_bridges"), F.expr("min(struct(node, d_a, d_b)) AS bridge"))
    touching = edges.selectExpr("structure_id", "i AS a", "j AS b")
    return pairs.join(merged(touching), ["structure_id", "a", "b"], "left_anti").selectExpr(
        "structure_id", "a", "b", "n_bridges", "bridge.node AS bridge", "bridge.d_a AS bridge_to_a", "bridge.d_b AS bridge_to_b")


def bridging_residues(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Residues touching both anchors of each listed pair ``(structure_id, a, b)``."""
    arms = both_ways(stage(edges))
    to_a = arms.selectExpr("structure_id", "neighbour AS a", "node AS bridge")
    to_b = arms.selectExpr("structure_id", "neighbour AS b", "node AS bridge")
    return anchors.join(merged(to_a), ["structure_id", "a"]).join(merged(to_b), ["structure_id", "b", "bridge"]).filter(
        "bridge <> a AND bridge <> b")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_edges: int = 3) -> DataFrame:
    """All shortest paths of at most ``max_edges`` edges between listed ``(structure_id, source, target)``.

    Each level extends paths by one edge for pairs that are not connected yet, so
    work stops growing for a pair as soon as it is answered.
    """
    keys = ["structure_id", "source", "target"]
    step = merged(both_ways(stage(edges)).selectExpr("structure_id", "node AS tail", "neighbour"))
    open_paths = pairs.selectExpr(*keys, "array(source) AS path")
    done = open_paths.filter("source = target")
    open_paths = open_paths.filter("source <> target")
    for level in range(max_edges):
        grown = open_paths.selectExpr("*", "element_at(path, -1) AS tail").join(step, ["structure_id", "tail"]).filter(
            "NOT array_contains(path, neighbour)").selectExpr(*keys, "array_append(path, neighbour) AS path")
        if level == max_edges - 1:
            return done.unionByName(grown.filter("element_at(path, -1) = target"))
        grown = stage(grown)
        hit = grown.filter("element_at(path, -1) = target")
        done = done.unionByName(hit)
        open_paths = grown.join(hit.select(*keys).distinct(), keys, "left_anti")
    return done


def near_miss(atoms: DataFrame, pairs: DataFrame, search: float) -> DataFrame:
    """Per pair with a unique bridge, how close the best other residue comes to bridging it.

    Only residues within ``search`` of both anchors compete; the measure is the
    larger of the two distances.
    """
    minima = c.residue_pair_minima(c.protein_atoms(atoms), search).selectExpr(
        "structure_id", "residue_idx_i AS i", "residue_idx_j AS j", "distance")
    arms = both_ways(stage(minima))
    to_a = arms.selectExpr("structure_id", "neighbour AS a", "node", "distance AS d_a")
    to_b = arms.selectExpr("structure_id", "neighbour AS b", "node", "distance AS d_b")
    worst = pairs.select("structure_id", "a", "b", "bridge").join(merged(to_a), ["structure_id", "a"]).join(
        merged(to_b), ["structure_id", "b", "node"]).filter("node <> bridge")
    return worst.groupBy("structure_id", "a", "b").agg(F.expr("min(greatest(d_a, d_b)) AS near_miss"))
