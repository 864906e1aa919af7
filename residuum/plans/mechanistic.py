"""Fields of two-state episodes as joins over the two states.

``first`` and ``second`` are atoms of the two states in one frame; both call the episode
``structure_id``. Claims come in as rows ``structure_id, label`` (or label pairs): which residues an
episode is about is configuration, what happens to them is computed here. Every function
returns one row per claim with a ``reason`` where the structures do not support it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import circular_difference, contact_change
from ..functions.numeric import distance
from ..operators import contacts, torsions
from ..operators.keyed import argmax_by, argmin_by, first_per_key, two_smallest
from ..operators.spatial import radius_join
from ..session import merged, stage

SEARCH, MIN_CHI1_CHANGE, MIN_PACKING_CHANGE = 8.0, 60.0, 0.5  # fixed values


def chi1_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Chi1 difference of every residue that has the same label and a chi1 in both states."""
    a = torsions.chi1(first).selectExpr("structure_id", "label", "chi1 AS chi1_1")
    b = torsions.chi1(second).selectExpr("structure_id", "label", "chi1 AS chi1_2")
    return a.join(b, ["structure_id", "label"]).selectExpr("*", f"{circular_difference('chi1_1', 'chi1_2')} AS difference")


def changed_residue(claims: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The claimed rotamer change and whether another residue changes more."""
    changes = stage(chi1_changes(first, second))
    largest = argmax_by(changes, ["structure_id"], ["difference", "label"]).selectExpr("structure_id", "label AS largest", "difference AS largest_difference")
    reason = (f"CASE WHEN difference IS NULL THEN 'chi1_not_computable' WHEN difference < {MIN_CHI1_CHANGE}D THEN 'claimed_rotamer_change_not_supported' END")
    return claims.select("structure_id", "label").join(changes, ["structure_id", "label"], "left").join(largest, "structure_id", "left").selectExpr(
        "structure_id", "label AS value", "difference", "largest <=> label AS is_largest", f"{reason} AS reason")


def changed_residues(claims: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    rows = claims.select("structure_id", "label").join(chi1_changes(first, second), ["structure_id", "label"], "left")
    return rows.groupBy("structure_id").agg(
        F.expr("array_sort(collect_list(label)) AS value"), F.expr("IF(bool_or(difference IS NULL), 'chi1_not_computable', NULL) AS reason"))


def _labelled_pairs(pairs: DataFrame, atoms: DataFrame, out: str) -> DataFrame:
    """Distance of listed label pairs ``structure_id, l1, l2`` in one state, NULL where a residue is absent."""
    names = stage(atoms.select("structure_id", "label", "residue_idx").distinct())
    located = pairs.select("structure_id", "l1", "l2").distinct()
    for n in (1, 2):
        located = located.join(merged(names.selectExpr("structure_id", f"label AS l{n}", f"residue_idx AS r{n}")), ["structure_id", f"l{n}"])
    located = stage(located.selectExpr("*", "least(r1, r2) AS residue_idx_i", "greatest(r1, r2) AS residue_idx_j"))
    measured = contacts.listed_pair_distances(located, atoms).selectExpr("structure_id", "residue_idx_i", "residue_idx_j", f"distance AS {out}")
    return located.join(merged(measured), ["structure_id", "residue_idx_i", "residue_idx_j"]).select("structure_id", "l1", "l2", out)


def gained_interactions(anchors: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Partners the anchor touches in the second state only. A partner missing from the first state was infinitely far."""
    cols = ["structure_id", "label", "x", "y", "z"]
    anchor_atoms = second.join(merged(anchors.select("structure_id", "label").distinct()), ["structure_id", "label"], "left_semi").select(*cols)
    near = radius_join(second.select(*cols), anchor_atoms, SEARCH, extra="a_label <> b_label").groupBy("structure_id", "b_label", "a_label").agg(
        F.min("distance").alias("d2")).selectExpr("structure_id", "b_label AS l1", "a_label AS l2", "d2")
    near = stage(near)
    joined = near.join(merged(_labelled_pairs(near, first, "d1")), ["structure_id", "l1", "l2"], "left").selectExpr(
        "structure_id", "l1", "l2", "d2", "coalesce(d1, CAST('Infinity' AS DOUBLE)) AS d1")
    return joined.filter(f"({contact_change('d1', 'd2')}) = 'gained'").groupBy("structure_id", F.col("l1").alias("label")).agg(
        F.expr("array_sort(collect_set(array_join(array_sort(array(l1, l2)), '--'))) AS value"))


def packing_change(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two residues come closer or move apart, by at least half an Angstrom, with ring distances as evidence."""
    rows = pairs.select("structure_id", "l1", "l2")
    for s, atoms in ((1, first), (2, second)):
        rows = rows.join(_labelled_pairs(pairs, atoms, f"d{s}"), ["structure_id", "l1", "l2"], "left")
        rings = contacts.ring_centroids(atoms).drop("residue_idx")
        for n in (1, 2):
            rows = rows.join(rings.selectExpr("structure_id", f"label AS l{n}", *[f"{c} AS r{s}{n}_{c}" for c in "xyz"]), ["structure_id", f"l{n}"], "left")
    reason = f"CASE WHEN d1 IS NULL OR d2 IS NULL THEN 'packing_residues_missing' WHEN abs(d1 - d2) < {MIN_PACKING_CHANGE}D THEN 'packing_change_below_margin' END"
    return rows.selectExpr("structure_id", "l1", "l2", "d1", "d2", *[f"{distance(f'r{s}1_', f'r{s}2_')} AS centroid_distance_{s}" for s in (1, 2)],
                           "IF(d2 < d1, 'closer', 'farther') AS value", f"{reason} AS reason")


def region_displacement(regions: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Largest C-alpha shift inside listed regions ``structure_id, chain, first, last``."""
    ca1 = first.filter("atom_name = 'CA'").join(regions, ["structure_id", "chain"]).filter("seq_id BETWEEN first AND last").selectExpr(
        "structure_id", "label", "x AS a_x", "y AS a_y", "z AS a_z")
    ca2 = second.filter("atom_name = 'CA'").selectExpr("structure_id", "label", "x AS b_x", "y AS b_y", "z AS b_z")
    shifts = ca1.join(ca2, ["structure_id", "label"]).selectExpr("structure_id", "label", f"{distance('a_', 'b_')} AS shift")
    return argmax_by(shifts, ["structure_id"], ["shift", "label"]).selectExpr("structure_id", "label", "shift", "round(shift, 1) AS value")


def pair_claim(pairs: DataFrame, answer_state: DataFrame, other_state: DataFrame, must_be_gained: bool = False, cutoff: float = 4.0) -> DataFrame:
    """A claimed contact that must exist in the answer state and, for a gained pair, not in the other one."""
    rows = pairs.select("structure_id", "l1", "l2").join(_labelled_pairs(pairs, answer_state, "d"), ["structure_id", "l1", "l2"], "left").join(
        _labelled_pairs(pairs, other_state, "d_other"), ["structure_id", "l1", "l2"], "left").selectExpr(
        "*", f"IF(d_other IS NULL, 'unknown', {contact_change('d_other', 'd')}) AS verdict")
    late = "WHEN verdict <> 'gained' THEN 'claimed_pair_is_not_gained'" if must_be_gained else ""
    return rows.selectExpr("structure_id", "array_join(array_sort(array(l1, l2)), '--') AS value", "d AS distance", "d_other AS distance_other", "verdict",
                           f"CASE WHEN d IS NULL OR d > {cutoff}D THEN 'claimed_contact_not_present' {late} END AS reason",
                           "split(l1, ':')[0] = split(l2, ':')[0] AS within_protomer")


def interface_claim(claims: DataFrame, atoms: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """Claimed interface residues and their closest residue in a chain the claim does not name."""
    own = claims.selectExpr("structure_id", "split(label, ':')[0] AS chain").distinct()
    cols = ["structure_id", "label", "x", "y", "z"]
    protein = contacts.protein_atoms(atoms)
    others = protein.join(own, ["structure_id", "chain"], "left_anti").select(*cols)
    mine = protein.join(claims.select("structure_id", "label"), ["structure_id", "label"], "left_semi").select(*cols)
    best = argmin_by(radius_join(others, mine, cutoff).selectExpr("structure_id", "b_label AS label", "distance", "a_label AS partner"),
                     ["structure_id", "label"], ["distance", "partner"])
    return claims.select("structure_id", "label").join(best, ["structure_id", "label"], "left").selectExpr(
        "*", "IF(partner IS NULL, 'claimed_interface_contact_absent', NULL) AS reason")


def displaced_entity(anchors: DataFrame, first: DataFrame, second: DataFrame, margin: float) -> DataFrame:
    """The first state's ligand sitting where the second state's ligand nearest the anchor is, if one clearly does."""
    def centres(df: DataFrame) -> DataFrame:
        return df.groupBy("structure_id", "label").agg(*[F.expr(f"avg({c}) AS {c}") for c in "xyz"])
    at = centres(first.join(anchors.select("structure_id", "label"), ["structure_id", "label"], "left_semi")).selectExpr(
        "structure_id", "x AS a_x", "y AS a_y", "z AS a_z")
    target = argmin_by(centres(second.filter("entity = 'ligand'")).selectExpr("structure_id", "label AS target", "x AS b_x", "y AS b_y", "z AS b_z").join(
        at, "structure_id").selectExpr("structure_id", "target", f"{distance('a_', 'b_')} AS d"), ["structure_id"], ["d", "target"]).drop("d")
    # Ligands of one structure are few; pairs are only formed with the one target of the structure.
    names = first.filter("entity = 'ligand'").select("structure_id", F.col("label").alias("l1")).distinct().join(target, "structure_id")
    left = first.selectExpr("structure_id", "label AS l1", "x AS a_x", "y AS a_y", "z AS a_z")
    right = second.selectExpr("structure_id", "label AS target", "x AS b_x", "y AS b_y", "z AS b_z")
    gaps = names.join(left, ["structure_id", "l1"]).join(right, ["structure_id", "target"]).groupBy("structure_id", "target", "l1").agg(
        F.expr(f"min({distance('a_', 'b_')}) AS d"))
    ranked = two_smallest(gaps, ["structure_id", "target"], ["d", "l1"])
    return ranked.selectExpr("structure_id", "target", "best.l1 AS value", "best.d AS distance",
                             f"IF(second.d - best.d < {margin}D, 'displaced_entity_ambiguous', NULL) AS reason")


def ligand_contact_gained(anchors: DataFrame, second: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """The ligand in contact with the anchor in the second state."""
    found = contacts.ligand_contacts(second, cutoff)
    best = argmin_by(found, ["structure_id", "label"], ["distance", "ligand"])
    return anchors.select("structure_id", "label").join(best, ["structure_id", "label"], "left").selectExpr(
        "structure_id", "array_join(array_sort(array(label, ligand)), '--') AS value", "distance",
        "IF(ligand IS NULL, 'no_gained_residue_ligand_contact', NULL) AS reason")


def reversed_order(text: str) -> str:
    """Swap the words for the two states in a text; a placeholder keeps the second pass from undoing the first."""
    return f"replace(replace(replace({text}, 'Structure 1', 'Structure \\\\u0001'), 'Structure 2', 'Structure 1'), 'Structure \\\\u0001', 'Structure 2')"


def reversed_gold(value: str) -> str:
    return f"CASE {value} WHEN 'closer' THEN 'farther' WHEN 'farther' THEN 'closer' ELSE {value} END"


def top_chi1_changes(first: DataFrame, second: DataFrame, k: int = 8) -> DataFrame:
    return first_per_key(chi1_changes(first, second), ["structure_id"], ["difference DESC", "label"], k)
