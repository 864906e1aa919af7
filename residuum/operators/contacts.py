"""Contacts, salt bridges, disulfides, metal coordination and clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions.numeric import distance
from ..session import merged, stage
from .keyed import argmin_by, two_smallest
from .spatial import nearest_target, radius_join, radius_pairs, residue_pair_minima

RESIDUE_PAIR = ["residue_idx_i", "residue_idx_j"]


def protein_atoms(atoms: DataFrame) -> DataFrame:
    return atoms.filter("entity = 'protein'")


def _sided(pairs: DataFrame, first: str, fields: list[str], *extra: str) -> DataFrame:
    """Rename ``a_``/``b_`` columns to ``_i``/``_j``; ``a`` becomes ``i`` where ``first`` holds."""
    columns = [c for n in fields for c in (
        f"IF({first}, a_{n}, b_{n}) AS {n}_i", f"IF({first}, b_{n}, a_{n}) AS {n}_j")]
    return pairs.selectExpr("structure_id", "distance", *columns, *extra)


def residue_contacts(atoms: DataFrame, cutoff: float = 4.0, min_separation: int = 3,
                     sequence_exclusion: bool = True, probe: bool = False) -> DataFrame:
    """Protein residue pairs within ``cutoff``, neighbours along a chain left out."""
    extra = None
    if sequence_exclusion:
        extra = f"NOT coalesce(a_chain = b_chain AND abs(a_poly_index - b_poly_index) < {min_separation}, false)"
    found = residue_pair_minima(protein_atoms(atoms), cutoff, ["chain", "poly_index", "label"],
                                probe=probe, extra=extra)
    return found.select("structure_id", *RESIDUE_PAIR, "distance", "atom_name_i", "atom_name_j",
                        "label_i", "label_j", "chain_i", "chain_j")


def interface_contacts(atoms: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """Cross-chain contacts, once per orientation, so that ``chain_i`` is the asking chain."""
    found = residue_pair_minima(protein_atoms(atoms), cutoff, ["chain", "label"], extra="a_chain <> b_chain")
    fields = ("residue_idx", "atom_name", "chain", "label")
    columns = [f"IF(turned, {n}_{s}, {n}_{o}) AS {n}_{o}" for n in fields for s, o in ("ij", "ji")]
    return found.selectExpr("*", "explode(array(false, true)) AS turned").selectExpr("structure_id", "distance", *columns)


def ligand_contacts(atoms: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """Closest protein atom of every residue within ``cutoff`` of each ligand."""
    cols = ["structure_id", "residue_idx", "atom_idx", "atom_name", "label", "x", "y", "z"]
    pairs = radius_join(protein_atoms(atoms).select(*cols), atoms.filter("entity = 'ligand'").select(*cols), cutoff)
    return argmin_by(
        pairs.selectExpr(
            "structure_id", "b_residue_idx AS ligand_idx", "a_residue_idx AS residue_idx", "distance", "a_atom_idx",
            "b_atom_idx", "a_atom_name AS atom_name", "b_atom_name AS ligand_atom", "a_label AS label", "b_label AS ligand"),
        ["structure_id", "ligand_idx", "residue_idx"], ["distance", "a_atom_idx", "b_atom_idx"],
        ["atom_name", "ligand_atom", "label", "ligand"]).drop("a_atom_idx", "b_atom_idx")


def nearest_excluded(per_residue: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """Closest residue that lies outside ``cutoff``, from per-residue minima over a wider search."""
    return per_residue.filter(f"distance > {cutoff}D").groupBy(*keys).agg(F.expr("min(distance) AS nearest_excluded"))


def charged_pairs(atoms: DataFrame, search: float = 4.0) -> DataFrame:
    """Closest opposite-charge atoms of every (positive, negative) residue pair within ``search``."""
    charged = protein_atoms(atoms).selectExpr("*", f"{chem.charge_sign('parent', 'atom_name')} AS charge").filter(
        "charge IS NOT NULL")
    pairs = radius_pairs(charged, search, ["residue_idx", "atom_name", "label", "chain", "charge"],
                         extra="a_charge * b_charge < 0 AND a_residue_idx <> b_residue_idx")
    sided = _sided(pairs, "a_charge > 0", ["residue_idx", "atom_idx", "atom_name", "label", "chain"])
    return argmin_by(sided, ["structure_id", *RESIDUE_PAIR], ["distance", "atom_idx_i", "atom_idx_j"],
                     ["atom_name_i", "atom_name_j", "label_i", "label_j", "chain_i", "chain_j"])


def salt_bridges(atoms: DataFrame, cutoff: float = 4.0) -> DataFrame:
    """``i`` is the positive residue, ``j`` the negative one."""
    return charged_pairs(atoms, cutoff)


def cysteine_sulfurs(atoms: DataFrame) -> DataFrame:
    return atoms.filter("entity = 'protein' AND parent = 'CYS' AND atom_name = 'SG'")


def disulfide_candidates(atoms: DataFrame, cutoff: float = 2.30) -> DataFrame:
    pairs = radius_pairs(cysteine_sulfurs(atoms), cutoff, ["residue_idx", "label", "chain"],
                         extra="a_residue_idx <> b_residue_idx")
    return pairs.selectExpr(
        "structure_id", "a_residue_idx AS residue_idx_i", "b_residue_idx AS residue_idx_j", "distance",
        "a_atom_idx AS atom_i", "b_atom_idx AS atom_j", "a_label AS label_i", "b_label AS label_j",
        "a_chain <> b_chain AS interchain")


def greedy_matching(edges: DataFrame, group: list[str], a: str, b: str, order: list[str]) -> DataFrame:
    """The matching that taking edges in ``order`` and skipping used ends would give.

    An edge that comes first at both of its ends is in that matching whatever else
    happens, so each round accepts all such edges at once and drops every edge that
    touches them. Rounds are bounded by the longest chain of competing edges, and
    the remaining edges shrink every round; no component is gathered anywhere.
    """
    remaining, accepted = stage(edges), None
    rank = f"struct({', '.join(order)})"
    while True:
        ends = remaining.selectExpr(*group, f"explode(array({a}, {b})) AS node", f"{rank} AS edge")
        first = ends.groupBy(*group, "node").agg(F.min("edge").alias("first"))
        at = {n: first.selectExpr(*group, f"node AS {n}", f"first AS first_{n}") for n in (a, b)}
        chosen = stage(
            remaining.join(at[a], [*group, a]).join(at[b], [*group, b])
            .filter(f"{rank} = first_{a} AND {rank} = first_{b}").select(*edges.columns))
        accepted = chosen if accepted is None else accepted.unionByName(chosen)
        used = chosen.selectExpr(*group, f"explode(array({a}, {b})) AS node")
        remaining = stage(
            remaining.join(used.withColumnRenamed("node", a), [*group, a], "left_anti")
            .join(used.withColumnRenamed("node", b), [*group, b], "left_anti").select(*edges.columns))
        if remaining.isEmpty():
            return accepted


def disulfides(atoms: DataFrame, cutoff: float = 2.30) -> DataFrame:
    """SG-SG pairs within ``cutoff``, shortest first, at most one per cysteine."""
    return greedy_matching(disulfide_candidates(atoms, cutoff), ["structure_id"], "residue_idx_i",
                           "residue_idx_j", ["distance", "residue_idx_i", "residue_idx_j"])


def _ends(pairs: DataFrame, *columns: str) -> DataFrame:
    both = "explode(array(struct(residue_idx_i AS r, residue_idx_j AS o), struct(residue_idx_j AS r, residue_idx_i AS o))) AS e"
    return pairs.selectExpr("structure_id", both, *columns).selectExpr(
        "structure_id", "e.r AS residue_idx", "e.o AS other", *columns)


def closest_other_sulfur(atoms: DataFrame, bonded: DataFrame, search: float) -> DataFrame:
    """Per cysteine, the closest SG within ``search`` that is not its disulfide partner's."""
    return _ends(disulfide_candidates(atoms, search), "distance").join(
        _ends(bonded), ["structure_id", "residue_idx", "other"], "left_anti").groupBy(
        "structure_id", "residue_idx").agg(F.expr("min(distance) AS closest_other_sg"))


def metal_coordination(atoms: DataFrame, beyond: float = 1.5) -> DataFrame:
    """Protein N/O/S atoms around each eligible metal: donors, and rejected atoms up to ``beyond`` further out."""
    metals = atoms.filter("entity = 'metal'").selectExpr(
        "structure_id", "residue_idx", "label", "x", "y", "z", f"{chem.metal_cutoff('name')} AS cutoff",
        f"{chem.metal_element('name')} AS element").filter("cutoff IS NOT NULL")
    donors = protein_atoms(atoms).filter("upper(element) IN ('N', 'O', 'S')").select(
        "structure_id", "residue_idx", "atom_name", "label", "x", "y", "z")
    pairs = radius_join(donors, metals, max(chem.METAL_CUTOFF.values()) + beyond)
    return pairs.filter(f"distance <= b_cutoff + {beyond}D").selectExpr(
        "structure_id", "b_residue_idx AS metal_idx", "b_label AS metal", "b_element AS element", "b_cutoff AS cutoff",
        "a_residue_idx AS residue_idx", "a_label AS label", "a_atom_name AS atom_name", "distance",
        "distance <= b_cutoff AS is_donor")


#: Radius that nearly all atoms stay below, Angstrom.
USUAL_RADIUS = 2.10


def clashes(atoms: DataFrame, separations: DataFrame, tolerance: float = 0.40,
            exclude_metals: bool = True) -> DataFrame:
    """Worst overlap of every residue pair: ``r1 + r2 - tolerance - d > 0`` beyond two bonds."""
    candidates = atoms.filter("entity <> 'metal'") if exclude_metals else atoms
    # Few elements are wider than the usual ones; only their atoms are searched further out.
    usual, widest = USUAL_RADIUS, max(chem.VDW_RADIUS.values())
    pts = candidates.selectExpr("*", f"{chem.vdw_radius('element')} AS radius")
    overlap = f"a_radius + b_radius - {tolerance}D - {distance('a_', 'b_')}"
    test = (f"a_residue_idx <> b_residue_idx AND {overlap} > 0 AND NOT "
            "(a_atom_name = 'SG' AND b_atom_name = 'SG' AND a_element = 'S' AND b_element = 'S')")
    carried = ["residue_idx", "atom_name", "element", "radius", "label"]
    pairs = radius_pairs(pts.filter(f"radius <= {usual}D"), 2 * usual - tolerance, carried, extra=test)
    side = pts.select("structure_id", "atom_idx", "x", "y", "z", *carried)
    wide = radius_join(side, side.filter(f"radius > {usual}D"), 2 * widest - tolerance,
                       extra=f"{test} AND (a_radius <= {usual}D OR a_atom_idx < b_atom_idx)")
    flip = "a_atom_idx > b_atom_idx"
    pairs = pairs.unionByName(wide.selectExpr("structure_id", "distance", *[c for n in ("atom_idx", "x", "y", "z", *carried) for c in (
        f"IF({flip}, b_{n}, a_{n}) AS a_{n}", f"IF({flip}, a_{n}, b_{n}) AS b_{n}")]))
    near = separations.selectExpr("structure_id", "atom_a AS a_atom_idx", "atom_b AS b_atom_idx")
    kept = pairs.join(merged(near), ["structure_id", "a_atom_idx", "b_atom_idx"], "left_anti")
    sided = _sided(kept, "a_residue_idx < b_residue_idx", ["residue_idx", "atom_idx", "atom_name", "label"],
                   f"-(a_radius + b_radius - {tolerance}D - distance) AS neg_overlap")
    return argmin_by(sided, ["structure_id", *RESIDUE_PAIR], ["neg_overlap", "atom_idx_i", "atom_idx_j"],
                     ["distance", "atom_name_i", "atom_name_j", "label_i", "label_j"]).selectExpr(
        "*", "-neg_overlap AS overlap").drop("neg_overlap")


def nearest_nonbonded(atoms: DataFrame, separations: DataFrame, queries: DataFrame | None = None,
                      search: float = 8.0) -> DataFrame:
    """Non-bonded protein atoms around each query atom: the two nearest, as ``best`` and ``second``.

    ``queries`` restricts the asking atoms (``structure_id, atom_idx``); ranking is
    by distance, then residue, then atom name.
    """
    cols = ["structure_id", "residue_idx", "atom_idx", "atom_name", "label", "name", "x", "y", "z"]
    base = protein_atoms(atoms).select(*cols)
    asking = base if queries is None else base.join(queries, ["structure_id", "atom_idx"], "left_semi")
    pairs = radius_join(base, asking, search, extra="a_atom_idx <> b_atom_idx")
    near = separations.selectExpr("structure_id", "atom_a AS a_atom_idx", "atom_b AS b_atom_idx")
    ranked = pairs.join(merged(near), ["structure_id", "a_atom_idx", "b_atom_idx"], "left_anti").selectExpr(
        "structure_id", "b_atom_idx AS atom_idx", "b_residue_idx AS residue_idx", "b_label AS label",
        "b_atom_name AS atom_name", "b_name AS name", "distance", "a_residue_idx AS near_idx",
        "a_atom_name AS near_atom", "a_label AS near_label", "a_name AS near_name")
    return two_smallest(ranked, ["structure_id", "atom_idx", "residue_idx", "label", "atom_name", "name"],
                        ["distance", "near_idx", "near_atom"], ["near_label", "near_name"])


def listed_pair_distances(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Minimum heavy-atom distance of listed residue pairs at any range.

    ``pairs`` holds ``structure_id, residue_idx_i, residue_idx_j``. Atoms reach the pair
    through its two residues, so only listed pairs are ever compared.
    """
    def side(s: str) -> DataFrame:
        return atoms.selectExpr("structure_id", f"residue_idx AS residue_idx_{s}", f"atom_idx AS atom_idx_{s}",
                                f"atom_name AS atom_name_{s}", f"x AS {s}_x", f"y AS {s}_y", f"z AS {s}_z")
    rows = pairs.select("structure_id", *RESIDUE_PAIR).distinct() \
        .join(merged(side("i")), ["structure_id", "residue_idx_i"]).join(merged(side("j")), ["structure_id", "residue_idx_j"]) \
        .selectExpr("*", f"{distance('i_', 'j_')} AS distance")
    return argmin_by(rows, ["structure_id", *RESIDUE_PAIR], ["distance", "atom_idx_i", "atom_idx_j"],
                     ["atom_name_i", "atom_name_j"])


def min_distance_to(sources: DataFrame, targets: DataFrame, first_radius: float = 8.0) -> DataFrame:
    """Per source residue, the distance to the nearest target atom of its structure."""
    return nearest_target(sources.select("structure_id", "residue_idx", "x", "y", "z"),
                          targets.select("structure_id", "x", "y", "z"),
                          group=["structure_id"], source_key=["residue_idx"], first_radius=first_radius)


def ring_centroids(atoms: DataFrame) -> DataFrame:
    """Centre of the first aromatic ring of each residue with at least four ring atoms present."""
    return atoms.filter(chem.in_ring("parent", "atom_name")).groupBy("structure_id", "residue_idx", "label").agg(
        F.expr("count(*) AS n"), F.expr("avg(x) AS x"), F.expr("avg(y) AS y"), F.expr("avg(z) AS z")).filter("n >= 4").drop("n")
