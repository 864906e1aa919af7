"""Parquet tables, and the structure relation derived from the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import chemistry as chem
from ..functions.numeric import round3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Residues per derived structure, and per chain within it.
STRUCTURE_RESIDUES, CHAIN_RESIDUES, SEGMENT = 160, 80, 16
NAMES = list(chem.ONE_LETTER)
# Backbone of an ideal alpha helix as radius, angle, height per atom.
HELIX = {"N": (1.53, -27.3, -0.88), "CA": (2.29, 0.0, 0.0), "C": (1.66, 26.3, 1.07), "O": (1.90, 20.0, 2.27)}
LIGAND_NAMES, METAL_NAMES = ("LIG", "NAG"), ("ZN", "MG", "CA")
LIGAND_ATOMS = ("C1", "C2", "C3", "C4", "O5", "N6", "O7")


def element_of(name: str) -> str:
    return name[0]


def atom_template() -> list[tuple[str, int, str, str]]:
    """(residue name, ordinal, atom name, element) for every derived residue."""
    rows = []
    for residue in [*NAMES, "SEP"]:
        parent = chem.MODIFIED_PARENT.get(residue, residue)
        atoms = list(chem.BACKBONE)
        if parent != "GLY":
            atoms += ["CB", *chem.SIDE_CHAIN[parent]]
        if residue == "SEP":
            atoms += ["P", "O1P", "O2P", "O3P"]
        rows += [(residue, i, a, element_of(a)) for i, a in enumerate(atoms)]
    for ligand in LIGAND_NAMES:
        rows += [(ligand, i, a, element_of(a)) for i, a in enumerate(LIGAND_ATOMS)]
    rows += [(metal, 0, metal, metal) for metal in METAL_NAMES]
    return rows


def residues_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """One residue per vector: helices of fifteen residues, one ligand or metal after each."""
    n, c, s = STRUCTURE_RESIDUES, CHAIN_RESIDUES, SEGMENT

    def pick(values, key: str) -> str:
        return f"element_at({chem.sql_literal(list(values))}, CAST({key} % {len(values)} + 1 AS INT))"

    placed = embeddings.selectExpr(
        "vec_id", "embedding", f"vec_id % {n} AS residue_idx", f"vec_id % {s} AS place", f"vec_id % {n} div {s} AS segment")
    typed = placed.selectExpr(
        "*", f"CASE WHEN place < {s - 1} THEN 'protein' WHEN segment % 2 = 0 THEN 'metal' ELSE 'ligand' END AS entity",
        f"concat('S', vec_id div {n}) AS structure_id", f"IF(residue_idx < {c}, 'A', 'B') AS chain",
        f"CAST(residue_idx % {c} + 1 AS INT) AS seq_id")
    named = typed.selectExpr(
        "*", f"CASE entity WHEN 'metal' THEN {pick(METAL_NAMES, f'vec_id div {s}')} "
        f"WHEN 'ligand' THEN {pick(LIGAND_NAMES, 'vec_id div 32')} "
        f"ELSE IF(vec_id % 97 = 50, 'SEP', {pick(NAMES, 'vec_id * 7')}) END AS name")
    return named.selectExpr(
        "structure_id", "residue_idx", "chain", "seq_id", "name", "entity", "segment", "place", "embedding",
        f"{chem.parent_of('name')} AS parent", "IF(entity = 'protein', 'protein', NULL) AS polymer_kind",
        # Position among the polymer residues of the chain: one residue in sixteen is not polymer.
        f"IF(entity = 'protein', CAST(residue_idx % {c} - residue_idx % {c} div {s} AS INT), NULL) AS poly_index",
        f"{chem.residue_label('chain', 'name', 'seq_id', 'entity')} AS label")


def atoms_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """The atom relation over the vectors, rounded to three decimals like a displayed structure.

    Side chains point away from the helix axis; the vector supplies the scatter.
    """
    by_name: dict[str, list[str]] = {}
    for residue, ordinal, atom, element in atom_template():
        by_name.setdefault(residue, []).append(f"{ordinal}:{atom}:{element}")
    template = chem.lookup({k: " ".join(v) for k, v in by_name.items()}, "name")
    rows = residues_from_embeddings(embeddings).selectExpr("*", f"explode(split({template}, ' ')) AS t").selectExpr(
        "*", "CAST(split(t, ':')[0] AS BIGINT) AS ordinal", "split(t, ':')[1] AS atom_name", "split(t, ':')[2] AS element")

    def helix(axis: int, first: float, slope: float) -> str:
        backbone = chem.lookup({k: v[axis] for k, v in HELIX.items()}, "atom_name")
        return f"coalesce({backbone}, {first}D + {slope}D * (ordinal - 4))"

    # Each step is its own projection, so that no value is spelled out twice.
    shaped = rows.selectExpr(
        "*", f"{helix(0, 3.3, 1.1)} AS radius", f"radians(place * 100D + {helix(1, -17.0, 14.0)}) AS angle",
        f"{helix(2, -0.6, -0.4)} AS height",
        f"CASE WHEN entity = 'protein' AND {chem.in_list('atom_name', chem.BACKBONE)} THEN 0.5D "
        "WHEN entity = 'ligand' THEN 14D ELSE 6D END AS spread",
        "CAST(slice(embedding, CAST(ordinal * 3 % 60 + 1 AS INT), 3) AS array<double>) AS noise")
    # A ligand or metal sits in the groove next to its helix.
    placed = shaped.selectExpr(
        "*", "residue_idx * 32 + ordinal AS atom_idx",
        "segment % 4 * 9.5D + IF(entity = 'protein', radius * cos(angle), 4.5D) + noise[0] * spread AS raw_x",
        "segment div 4 * 9.5D + IF(entity = 'protein', radius * sin(angle), 4.5D) + noise[1] * spread AS raw_y",
        "IF(entity = 'protein', place * 1.5D + height, 11D) + noise[2] * spread AS raw_z")
    return placed.selectExpr(
        "structure_id", "residue_idx", "atom_idx", "atom_name", "element",
        *[f"coalesce({round3(f'raw_{c}')}, 0D) AS {c}" for c in "xyz"],
        "chain", "seq_id", "name", "parent", "entity", "polymer_kind", "poly_index", "label")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atoms_from_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
