"""From raw coordinate records to the atom relation: filters, conformers, identity, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..session import merged, stage
from .keyed import argmin_by
from .sequence import BLOCK_ROWS, numbered

KEY = ["structure_id", "chain", "seq_id", "icode", "name"]
WATERS = ("DOD", "HOH")  # fixed values
CHAIN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"  # fixed value
# Crystallisation additives dropped unless a configuration keeps them.
ADDITIVES = (
    "HOH", "DOD", "SO4", "PO4", "GOL", "EDO", "PEG", "PGE", "PG4", "1PE", "2PE", "P6G", "MPD", "TRS", "MES", "EPE",
    "ACT", "ACY", "FMT", "CIT", "TLA", "MLA", "IMD", "DMS", "IPA", "BME", "DTT", "NH4", "CL", "BR", "IOD", "NA", "K",
    "CS", "RB", "LI", "BOG", "LDA", "C8E", "OLC", "OLA", "MYR", "PLM", "STE", "D10", "D12", "DD9", "UNX", "UNL", "PE4",
    "PEE", "LMT", "DMU", "HEZ", "BU3", "SIN", "MRD", "XPE", "SGM", "TAM", "TAR", "FLC", "MPO", "POP", "PPV", "AZI",
    "NO3", "SCN", "BCT", "CO3", "OXL", "BEN", "BTB", "CAC", "PDO",
)
EXCLUDED_METHODS = ("SOLUTION NMR", "SOLID-STATE NMR")  # fixed values


def polymer(name: str = "name") -> str:
    return f"({chem.is_amino_acid(name)} OR {chem.in_list(name, chem.DNA + chem.RNA)})"


def excluded_methods(structures: DataFrame) -> DataFrame:
    """Structures solved by a method that is not accepted."""
    hit = " OR ".join(f"contains(upper(method), '{m}')" for m in EXCLUDED_METHODS)
    return structures.filter(hit).selectExpr("structure_id", "'excluded_experimental_method' AS reason", "method AS detail")


def drop_hydrogens_and_waters(raw: DataFrame) -> DataFrame:
    return raw.filter(f"NOT {chem.in_list('name', WATERS)} AND upper(element) NOT IN ('H', 'D')")


def resolve_altlocs(raw: DataFrame) -> DataFrame:
    """One conformer per residue: the one with the highest summed side-chain occupancy, then by letter.

    A conformer without side-chain atoms is judged by all of its atoms. Shared atoms
    stay and come first; of two atoms with one name the first stays.
    """
    present = raw.filter("occupancy <> 0").selectExpr("*", "trim(coalesce(altloc, '')) AS alt")
    side = f"NOT {chem.in_list('atom_name', (*chem.BACKBONE, 'OXT'))}"
    weight = present.filter("alt <> ''").groupBy(*KEY, "alt").agg(
        F.expr(f"coalesce(sum(occupancy) FILTER (WHERE {side}), sum(occupancy)) AS weight"))
    chosen = argmin_by(weight.selectExpr(*KEY, "-weight AS rank", "alt AS chosen"), KEY, ["rank", "chosen"]).drop("rank")
    kept = present.join(chosen, KEY, "left").filter("alt = '' OR alt = chosen").selectExpr(*raw.columns, "IF(alt = '', 0, 1) AS alt_order")
    rest = [c for c in kept.columns if c not in (*KEY, "atom_name", "alt_order", "ord")]
    return argmin_by(kept, [*KEY, "atom_name"], ["alt_order", "ord"], rest)


def filter_components(atoms: DataFrame, keep: tuple[str, ...] = (), discard: tuple[str, ...] = ADDITIVES) -> DataFrame:
    """Polymers stay. With a selection only selected components stay, else everything not discarded."""
    dropped = [d for d in discard if d not in keep]
    other = chem.in_list("name", keep) if keep else f"NOT {chem.in_list('name', dropped)}"
    return atoms.filter(f"{polymer()} OR {other}")


def filter_chains(atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` lists ``structure_id, chain``; structures it does not mention keep every chain."""
    listed = wanted.select("structure_id").distinct().withColumn("listed", F.lit(True))
    hit = wanted.select("structure_id", "chain").distinct().withColumn("hit", F.lit(True))
    return atoms.join(listed, "structure_id", "left").join(hit, ["structure_id", "chain"], "left").filter(
        "listed IS NULL OR hit").select(*atoms.columns)


def missing_chains(atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(atoms.select("structure_id", "chain").distinct(), ["structure_id", "chain"], "left_anti").selectExpr(
        "structure_id", "'requested_chain_absent' AS reason", "chain AS detail")


def filter_ranges(atoms: DataFrame, ranges: DataFrame) -> DataFrame:
    """Keep listed inclusive ``(structure_id, chain, first, last)`` ranges; chains without a range pass."""
    grouped = ranges.groupBy("structure_id", "chain").agg(F.expr("collect_list(struct(first, last)) AS spans"))
    return atoms.join(grouped, ["structure_id", "chain"], "left").filter(
        "spans IS NULL OR exists(spans, s -> seq_id BETWEEN s.first AND s.last)").select(*atoms.columns)


def split_chains(atoms: DataFrame, splits: DataFrame) -> DataFrame:
    """Move numbered ranges into chains of their own; the first matching range (by ``priority``) wins."""
    grouped = splits.groupBy("structure_id", "chain").agg(
        F.expr("array_sort(collect_list(struct(priority, first, last, new_chain))) AS spans"))
    hit = "try_element_at(filter(spans, s -> seq_id BETWEEN s.first AND s.last), 1).new_chain"
    return atoms.join(grouped, ["structure_id", "chain"], "left").selectExpr(
        *[f"coalesce({hit}, chain) AS chain" if c == "chain" else c for c in atoms.columns])


def insertion_codes(atoms: DataFrame) -> DataFrame:
    return atoms.filter(f"trim(icode) <> '' AND {polymer()}").selectExpr(
        "structure_id", "'insertion_code_present' AS reason", "concat(chain, ':', seq_id, icode) AS detail").distinct()


def emptied(before: DataFrame, after: DataFrame, reason: str) -> DataFrame:
    """Structures of ``before`` of which nothing is left in ``after``."""
    return before.select("structure_id").distinct().join(after.select("structure_id").distinct(), "structure_id", "left_anti").selectExpr(
        "structure_id", f"'{reason}' AS reason", "structure_id AS detail")


def remap_chains(atoms: DataFrame) -> DataFrame:
    """Chain names longer than one character get unused single characters, in order of appearance."""
    seen = atoms.groupBy("structure_id", "chain").agg(F.min("ord").alias("o")).groupBy("structure_id").agg(
        F.expr("transform(array_sort(collect_list(struct(o, chain))), s -> s.chain) AS names"))
    alphabet = chem.sql_literal(list(CHAIN_ALPHABET))
    maps = seen.selectExpr("structure_id", "filter(names, n -> length(n) > 1) AS long", "filter(names, n -> length(n) = 1) AS short").filter(
        "size(long) > 0").selectExpr("structure_id", "long", f"array_except({alphabet}, short) AS free").selectExpr(
        "structure_id", "IF(size(long) > size(free), raise_error('too many chains'), map_from_arrays(long, slice(free, 1, size(long)))) AS renames")
    return atoms.join(maps, "structure_id", "left").selectExpr(
        *["coalesce(try_element_at(renames, chain), chain) AS chain" if c == "chain" else c for c in atoms.columns])


def build_residues(atoms: DataFrame) -> DataFrame:
    """One row per residue in file order, chains together: entity, polymer kind and ``residue_idx``."""
    found = atoms.groupBy(*KEY).agg(F.expr("min(ord) AS first_ord"), F.expr("count(*) AS n_atoms"), F.expr("avg(bfactor) AS confidence"))
    opened = found.groupBy("structure_id", "chain").agg(F.expr("min(first_ord) AS chain_ord"))
    placed = numbered(found.join(opened, ["structure_id", "chain"]), ["structure_id"], ["chain_ord", "first_ord"],
                      f"struct(chain_ord, first_ord div {BLOCK_ROWS})", "residue_idx")
    return placed.selectExpr("*", f"{chem.entity_of('name', 'n_atoms')} AS entity", f"{chem.polymer_kind('name')} AS polymer_kind",
                             f"{chem.parent_of('name')} AS parent", f"{chem.one_letter('name')} AS one_letter")


def assign_poly_index(df: DataFrame) -> DataFrame:
    """0-based position per chain among polymer residues, by ``residue_idx``. Works on residues or atoms."""
    residues = df.filter("polymer_kind IS NOT NULL").select("structure_id", "chain", "residue_idx").distinct()
    placed = numbered(residues, ["structure_id", "chain"], ["residue_idx"], f"residue_idx div {BLOCK_ROWS}", "poly_index")
    return df.join(placed, ["structure_id", "chain", "residue_idx"], "left")


def anonymise_ligands(residues: DataFrame) -> DataFrame:
    """Ligand components become L1, L2, ... by first appearance; every copy of a component gets the same name."""
    first = residues.filter("entity = 'ligand'").groupBy("structure_id", "name").agg(F.min("residue_idx").alias("f"))
    names = first.selectExpr("structure_id", "name", "concat('L', row_number() OVER (PARTITION BY structure_id ORDER BY f)) AS alias")
    return residues.join(names, ["structure_id", "name"], "left").selectExpr(
        *[c for c in residues.columns if c != "name"], "name AS orig_name", "IF(entity = 'ligand', alias, name) AS name")


def relabel_ligands(residues: DataFrame, pinned: DataFrame) -> DataFrame:
    """Override ligand names from ``structure_id, orig_name, pinned``."""
    return residues.join(pinned, ["structure_id", "orig_name"], "left").selectExpr(
        *["coalesce(pinned, name) AS name" if c == "name" else c for c in residues.columns])


def label_collisions(residues: DataFrame) -> DataFrame:
    return residues.groupBy("structure_id", "label").count().filter("count > 1").selectExpr(
        "structure_id", "'ambiguous_residue_label' AS reason", "label AS detail")


def clean(raw: DataFrame, *, keep: tuple[str, ...] = (), chains: DataFrame | None = None, ranges: DataFrame | None = None,
          splits: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(atoms, residues, rejections)`` from raw records of model 0.

    Records: ``structure_id, ord, is_hetatm, atom_name, altloc, name, chain, seq_id, icode, x, y, z, occupancy,
    bfactor, element``. Occupancy and B-factor are read for the choices above and then levelled.
    """
    atoms = raw if chains is None else filter_chains(raw, chains)
    # Conformers are chosen with all atoms present; hydrogens go after the choice.
    atoms = drop_hydrogens_and_waters(resolve_altlocs(filter_components(atoms, keep)))
    # A code rejects a structure even where a range would leave its residue out.
    rejections = insertion_codes(atoms).unionByName(emptied(raw, atoms, "no_retained_residues"))
    if ranges is not None:
        before = atoms = stage(atoms)
        atoms = filter_ranges(atoms, ranges)
        rejections = rejections.unionByName(emptied(before, atoms, "residue_ranges_retained_nothing"))
    if splits is not None:
        atoms = split_chains(atoms, splits)
    atoms = stage(remap_chains(stage(atoms)))
    residues = stage(anonymise_ligands(assign_poly_index(stage(build_residues(atoms)))).selectExpr(
        "*", f"{chem.residue_label('chain', 'orig_name', 'seq_id', 'entity')} AS raw_label").selectExpr(
        "* EXCEPT (raw_label)", "IF(entity = 'protein', raw_label, concat(chain, ':', name, seq_id)) AS label"))
    rejections = stage(rejections.unionByName(label_collisions(residues)))
    if chains is not None:
        rejections = rejections.unionByName(missing_chains(atoms, chains))
    carried = ["structure_id", "chain", "seq_id", "icode", "orig_name", "residue_idx", "name", "entity", "polymer_kind", "parent",
               "one_letter", "poly_index", "label"]
    joined = atoms.withColumnRenamed("name", "orig_name").join(residues.select(*carried), carried[:5])
    placed = numbered(joined, ["structure_id"], ["residue_idx", "alt_order", "ord"], f"residue_idx div {BLOCK_ROWS}", "atom_idx")
    out = placed.join(rejections.select("structure_id").distinct(), "structure_id", "left_anti").selectExpr(
        *carried, "atom_idx", "atom_name", "upper(element) AS element", "x", "y", "z", "atom_idx + 1 AS serial",
        "1D AS occupancy", "0D AS bfactor", "is_hetatm")
    return out, residues, rejections


def low_confidence(atoms: DataFrame, residues: DataFrame, queried: DataFrame, radius: float = 8.0, minimum: float = 80.0) -> DataFrame:
    """Queried residues with a residue of low confidence within ``radius``; a missing value counts as 100."""
    from .spatial import radius_join
    pts = atoms.select("structure_id", "residue_idx", "x", "y", "z")
    asked = pts.join(merged(queried.select("structure_id", "residue_idx").distinct()), ["structure_id", "residue_idx"], "left_semi")
    near = radius_join(pts, asked, radius).selectExpr("structure_id", "a_residue_idx AS residue_idx", "b_residue_idx AS queried_idx").distinct()
    return near.join(merged(residues.select("structure_id", "residue_idx", "confidence", "label")), ["structure_id", "residue_idx"]).filter(
        f"coalesce(confidence, 100D) < {minimum}D").select("structure_id", "queried_idx", "residue_idx", "label", "confidence")


def summary(residues: DataFrame) -> DataFrame:
    return residues.groupBy("structure_id").agg(
        F.expr("count(*) AS residues"), F.expr("count_if(entity = 'protein') AS protein_residues"), F.expr("sum(n_atoms) AS atoms"),
        F.expr("count(DISTINCT chain) AS chains"), F.expr("count_if(entity = 'ligand') AS ligands"), F.expr("count_if(entity = 'metal') AS metals"))


def lookups(residues: DataFrame, wanted: DataFrame) -> DataFrame:
    """Residue by author number: a blank insertion code is preferred, then the first in file order.

    ``wanted`` lists ``structure_id, chain, seq_id``.
    """
    hits = wanted.join(residues, ["structure_id", "chain", "seq_id"]).selectExpr("*", "IF(trim(icode) = '', 0, 1) AS coded")
    return argmin_by(hits, ["structure_id", "chain", "seq_id"], ["coded", "residue_idx"], ["label"]).drop("coded")
