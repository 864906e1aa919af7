"""Covalent bonds as an edge relation over atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions.numeric import distance
from ..session import merged, stage

PEPTIDE_MAX, NUCLEIC_MAX = 2.0, 2.2


def _dictionary() -> dict[str, list[str]]:
    """``residue:atom`` -> partner atoms, each bond listed once."""
    partners: dict[str, list[str]] = {}
    for residue in chem.AMINO_ACIDS:
        for a, b in chem.residue_bonds(residue):
            partners.setdefault(f"{residue}:{a}", []).append(b)
    return partners


def dictionary_bonds(atoms: DataFrame) -> DataFrame:
    """Bonds inside residues, found by atom name. Unknown components contribute none."""
    partner = chem.lookup(_dictionary(), "concat_ws(':', name, atom_name)")
    keys = ["structure_id", "residue_idx", "atom_name"]
    protein = atoms.filter("entity = 'protein'")
    left = protein.selectExpr("structure_id", "residue_idx", "atom_idx AS atom_a", f"explode({partner}) AS atom_name")
    right = protein.selectExpr(*keys, "atom_idx AS atom_b")
    return left.join(merged(right), keys).select("structure_id", "atom_a", "atom_b")


def polymer_links(atoms: DataFrame) -> DataFrame:
    """Peptide and nucleotide links between neighbours in polymer order, checked by length."""
    polymer = atoms.filter("poly_index IS NOT NULL")
    keys = ["structure_id", "chain", "polymer_kind", "poly_index"]
    first = polymer.filter("atom_name = IF(polymer_kind = 'protein', 'C', \"O3'\")").selectExpr(
        *keys[:3], "poly_index + 1 AS poly_index", "atom_idx AS atom_a", "x AS a_x", "y AS a_y", "z AS a_z")
    second = polymer.filter("atom_name = IF(polymer_kind = 'protein', 'N', 'P')").selectExpr(
        *keys, "atom_idx AS atom_b", "x AS b_x", "y AS b_y", "z AS b_z")
    limit = f"IF(polymer_kind = 'protein', {PEPTIDE_MAX}D, {NUCLEIC_MAX}D)"
    return first.join(merged(second), keys).filter(f"{distance('a_', 'b_')} <= {limit}").select(
        "structure_id", "atom_a", "atom_b")


def disulfide_bonds(disulfides: DataFrame) -> DataFrame:
    return disulfides.selectExpr("structure_id", "atom_i AS atom_a", "atom_j AS atom_b")


def bonds(atoms: DataFrame, disulfides: DataFrame | None = None) -> DataFrame:
    """All covalent edges, stored in both directions."""
    edges = dictionary_bonds(atoms).unionByName(polymer_links(atoms))
    if disulfides is not None:
        edges = edges.unionByName(disulfide_bonds(disulfides))
    both = "explode(array(struct(atom_a AS a, atom_b AS b), struct(atom_b AS a, atom_a AS b))) AS e"
    return edges.selectExpr("structure_id", both).selectExpr("structure_id", "e.a AS atom_a", "e.b AS atom_b").distinct()


def separations(edges: DataFrame, depth: int = 2) -> DataFrame:
    """Fewest bonds between atoms up to ``depth`` apart: ``(structure_id, atom_a, atom_b, separation)``."""
    edges = stage(edges)
    reached = edges.selectExpr("structure_id", "atom_a", "atom_b", "1 AS separation")
    frontier = edges
    step = merged(edges.selectExpr("structure_id", "atom_a AS via", "atom_b AS next"))
    for hop in range(2, depth + 1):
        frontier = frontier.selectExpr("structure_id", "atom_a", "atom_b AS via").join(
            step, ["structure_id", "via"]).filter("atom_a <> next").selectExpr(
            "structure_id", "atom_a", "next AS atom_b")
        reached = reached.unionByName(frontier.selectExpr("*", f"{hop} AS separation"))
    return reached.groupBy("structure_id", "atom_a", "atom_b").agg(F.min("separation").alias("separation"))


def unknown_components(atoms: DataFrame) -> DataFrame:
    """Components without a bond dictionary, per structure."""
    return atoms.filter(f"NOT {chem.is_amino_acid('name')} AND entity IN ('protein', 'ligand')").select(
        "structure_id", "name").distinct()
