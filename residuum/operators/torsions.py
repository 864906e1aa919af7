"""Chi1 rotamers, proline omega and side-chain deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions.geometry import chi1_bin, chi1_change_reasons, chi1_edge_distance, dihedral, omega_class, vec
from ..functions.numeric import squared_distance

RESIDUE = ["structure_id", "residue_idx"]


def _pivoted(atoms: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per residue with the coordinates of named atoms; ``names`` maps a prefix to an SQL test."""
    values = [F.expr(f"max(IF({test}, {c}, NULL)) AS {p}_{c}") for p, test in names.items() for c in "xyz"]
    return atoms.groupBy(*RESIDUE, *keep).agg(*values)


def chi1(atoms: DataFrame, margin: float = 15.0) -> DataFrame:
    """Chi1 angle, bin, and the rotamer where the angle keeps ``margin`` degrees from every bin edge."""
    fourth = atoms.filter("entity = 'protein'").selectExpr("*", f"{chem.chi1_fourth_atom('parent')} AS atom4").filter(
        "atom4 IS NOT NULL AND (atom_name IN ('N', 'CA', 'CB') OR atom_name = atom4)")
    rows = _pivoted(fourth, {"p1": "atom_name = 'N'", "p2": "atom_name = 'CA'", "p3": "atom_name = 'CB'",
                             "p4": "atom_name = atom4"}, ["chain", "label", "name", "parent", "atom4"])
    complete = rows.filter("p1_x IS NOT NULL AND p2_x IS NOT NULL AND p3_x IS NOT NULL AND p4_x IS NOT NULL")
    angle = dihedral(*(vec(f"p{i}_") for i in range(1, 5)))
    kept = [*RESIDUE, "chain", "label", "name", "parent", "atom4"]
    measured = complete.selectExpr(*kept, f"{angle} AS chi1").filter("chi1 IS NOT NULL")
    return measured.selectExpr("*", f"{chi1_edge_distance('chi1')} AS edge_distance").selectExpr(
        "*", f"{chi1_bin('chi1')} AS bin", f"IF(edge_distance >= {margin}D, {chi1_bin('chi1')}, '') AS rotamer")


def chi1_changes(first: DataFrame, second: DataFrame, displacement: DataFrame | None = None) -> DataFrame:
    """Chi1 states of residues with the same label in two structures, and why a change does not count.

    Inputs carry ``pair_id, label, chi1``; ``displacement`` adds ``pair_id, label, shift``.
    """
    both = first.selectExpr("pair_id", "label", "chi1 AS chi1_1").join(
        second.selectExpr("pair_id", "label", "chi1 AS chi1_2"), ["pair_id", "label"])
    shift = "CAST(NULL AS DOUBLE)"
    if displacement is not None:
        both, shift = both.join(displacement.select("pair_id", "label", "shift"), ["pair_id", "label"], "left"), "shift"
    return both.selectExpr("*", f"{chi1_change_reasons('chi1_1', 'chi1_2', shift)} AS reasons").selectExpr(
        "*", "size(reasons) = 0 AS changed")


def proline_omega(atoms: DataFrame) -> DataFrame:
    """Omega of every proline from the residue before it in polymer order."""
    protein = atoms.filter("entity = 'protein' AND poly_index IS NOT NULL AND atom_name IN ('N', 'CA', 'C')")
    rows = _pivoted(protein, {"n": "atom_name = 'N'", "ca": "atom_name = 'CA'", "c": "atom_name = 'C'"},
                    ["chain", "poly_index", "label", "parent"])
    before = rows.selectExpr("structure_id", "chain", "poly_index + 1 AS poly_index",
                             *[f"{a}_{x} AS before_{a}_{x}" for a in ("ca", "c") for x in "xyz"])
    omega = dihedral(vec("before_ca_"), vec("before_c_"), vec("n_"), vec("ca_"))
    return rows.filter("parent = 'PRO'").join(before, ["structure_id", "chain", "poly_index"]).selectExpr(
        *RESIDUE, "label", f"{omega} AS omega").filter("omega IS NOT NULL").selectExpr(
        "*", f"{omega_class('omega')} AS state")


def side_chain_rmsd(first: DataFrame, second: DataFrame) -> DataFrame:
    """RMSD over side-chain atoms two states of a residue share; needs at least two.

    Inputs carry ``pair_id, label, atom_name, x, y, z`` in one common frame.
    """
    side = f"NOT {chem.in_list('atom_name', (*chem.BACKBONE, 'OXT'))}"
    a = first.filter(side).selectExpr("pair_id", "label", "atom_name", "x AS a_x", "y AS a_y", "z AS a_z")
    b = second.filter(side).selectExpr("pair_id", "label", "atom_name", "x AS b_x", "y AS b_y", "z AS b_z")
    return a.join(b, ["pair_id", "label", "atom_name"]).groupBy("pair_id", "label").agg(
        F.expr("count(*) AS n_shared"), F.expr(f"sqrt(avg({squared_distance('a_', 'b_')})) AS rmsd")).filter("n_shared >= 2")
