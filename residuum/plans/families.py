"""Question families: candidate questions with their margins, and answers, from the structure relations.

Every family is two plans over a displayed ``atoms`` relation. ``propose`` returns tagged rows
``structure_id, family, accepted, parameters, reason, rank, tag, required``: accepted candidates and the
reasons others failed. ``answer`` recomputes the value of accepted candidates from the relations alone, so it
can be run on any displayed structure. Whole-structure families reject structures above the size limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions.numeric import distance, linspace_index, round_decimals
from ..operators import backbone, contacts, covalent, network, surface, torsions
from ..operators.keyed import argmin_by, first_per_key
from ..operators.sequence import BLOCK_ROWS, numbered
from ..session import merged, stage

#: Fixed values.
MAX_WHOLE_ATOMS, NEGATIVE_MARGIN, SET_MARGIN, NEAREST_MARGIN = 1560, 0.20, 0.05, 0.25
CONTEXT_ONLY = ("P01", "P02", "S03", "S04", "S05", "S08", "S09")
NOT_FOR_PREDICTED = ("S06", "S07", "S02", "I01", "G04", "T01")
ORDER = ("P01", "P02", "P03", "G01", "G02", "G03", "G04", "S01", "S02", "S03", "S04", "S05", "S06", "S07", "S08", "S09", "I01", "N01", "T01")
TOO_LARGE = "structure_too_large_for_uncroppable_family"
#: Atom preferred for a distance question, most telling first.
INFORMATIVE = ("NZ", "NE2", "OD1", "OE1", "SG", "OG", "OH", "CZ", "CG", "CB", "CA")
CHARGED = ("ASP", "GLU", "LYS", "ARG", "HIS")
HYDROPHOBIC = ("LEU", "ILE", "VAL", "PHE", "MET", "TRP", "ALA")
COLUMNS = ["structure_id", "family", "accepted", "parameters", "reason", "rank", "tag", "required"]


class Analysis:
    """The derived relations of one set of displayed atoms, each computed once and staged."""

    def __init__(self, atoms: DataFrame):
        self.atoms = stage(atoms)
        self._known: dict[str, DataFrame] = {}

    def _get(self, name: str, make) -> DataFrame:
        if name not in self._known:
            self._known[name] = stage(make())
        return self._known[name]

    @property
    def residues(self) -> DataFrame:
        return self._get("residues", lambda: self.atoms.groupBy(
            "structure_id", "residue_idx", "chain", "seq_id", "name", "parent", "entity", "poly_index", "label").agg(
            F.expr("count(*) AS n_atoms")))

    @property
    def sizes(self) -> DataFrame:
        """Structures and whether they are too large to be shown whole."""
        return self._get("sizes", lambda: self.atoms.groupBy("structure_id").agg(F.expr(f"count(*) > {MAX_WHOLE_ATOMS} AS large")))

    @property
    def small(self) -> DataFrame:
        return self.sizes.filter("NOT large").select("structure_id")

    @property
    def disulfides(self) -> DataFrame:
        return self._get("disulfides", lambda: contacts.disulfides(self.atoms))

    @property
    def separations(self) -> DataFrame:
        return self._get("separations", lambda: covalent.separations(covalent.bonds(self.atoms, self.disulfides)))

    @property
    def graph(self) -> DataFrame:
        return self._get("graph", lambda: network.contact_graph(self.atoms))

    @property
    def bridges(self) -> DataFrame:
        return self._get("bridges", lambda: contacts.salt_bridges(self.atoms))

    @property
    def clashes(self) -> DataFrame:
        return self._get("clashes", lambda: contacts.clashes(self.atoms, self.separations))

    @property
    def structure(self) -> DataFrame:
        return self._get("structure", lambda: backbone.secondary_structure(self.atoms))

    @property
    def areas(self) -> DataFrame:
        return self._get("areas", lambda: surface.residue_areas(surface.atom_areas(self.atoms)))


def _rows(df: DataFrame, family: str, parameters: str, verdict: str = "CAST(NULL AS STRING)", rank: str = "0D",
          tag: str = "''", required: str = "CAST(array() AS array<string>)") -> DataFrame:
    """Tagged rows: a NULL verdict accepts. ``parameters`` is a JSON text."""
    return df.selectExpr("structure_id", f"'{family}' AS family", f"({verdict}) IS NULL AS accepted", f"{parameters} AS parameters",
                         f"{verdict} AS reason", f"CAST({rank} AS DOUBLE) AS rank", f"{tag} AS tag", f"{required} AS required")


def _json(**fields: str) -> str:
    return "to_json(struct(" + ", ".join(f"{v} AS {k}" for k, v in fields.items()) + "))"


def _whole(a: Analysis, df: DataFrame) -> DataFrame:
    return df.join(a.small, "structure_id", "left_semi")


def _with_large(a: Analysis, rows: DataFrame, family: str) -> DataFrame:
    """``rows`` and one rejection per structure that is too large."""
    return rows.unionByName(_rows(a.sizes.filter("large"), family, "'{}'", f"'{TOO_LARGE}'"))


# -- parsing -----------------------------------------------------------------------

def p01(a: Analysis) -> DataFrame:
    """Chain list: identifiers must differ by more than case."""
    rows = a.residues.groupBy("structure_id").agg(
        F.expr("collect_set(chain) AS chains"), F.expr("count(DISTINCT upper(chain)) AS folded")).join(a.sizes, "structure_id")
    verdict = f"CASE WHEN folded < size(chains) THEN 'chain_ids_differ_only_by_case' WHEN large THEN '{TOO_LARGE}' END"
    return _rows(rows, "P01", "'{}'", verdict, "-size(chains)")


def p01_answer(a: Analysis) -> DataFrame:
    return a.residues.groupBy("structure_id").agg(F.expr("array_sort(collect_set(chain)) AS items"))


def p02(a: Analysis) -> DataFrame:
    rows = _whole(a, a.residues).filter("entity = 'protein'").groupBy("structure_id", "chain").count()
    return _with_large(a, _rows(rows, "P02", _json(chain="chain"), "IF(count < 20, 'chain_too_short', NULL)", "-count"), "P02")


def p02_answer(a: Analysis) -> DataFrame:
    return a.residues.filter("entity = 'protein'").groupBy("structure_id", "chain").agg(F.expr("count(*) AS number"))


def p03(a: Analysis) -> DataFrame:
    """Side-chain atoms in the middle of the file, the 24 nearest to the middle."""
    totals = a.residues.groupBy("structure_id").agg(F.expr("count(*) AS total"))
    side = _whole(a, a.atoms).filter(f"entity = 'protein' AND NOT {chem.in_list('atom_name', (*chem.BACKBONE, 'OXT', 'CB'))}")
    placed = side.join(totals, "structure_id").selectExpr("*", "residue_idx / greatest(total - 1, 1) AS place").filter(
        "place BETWEEN 0.15D AND 0.85D").selectExpr("*", "abs(place - 0.5D) AS off")
    best = first_per_key(placed, ["structure_id"], ["off", "label", "atom_name"], 24)
    return _with_large(a, _rows(best, "P03", _json(residue="label", atom="atom_name"), rank="rank - 1", required="array(label)"), "P03")


def p03_answer(a: Analysis) -> DataFrame:
    return a.atoms.selectExpr("structure_id", "label AS residue", "atom_name AS atom", "array(x, y, z) AS numbers")


# -- geometry ----------------------------------------------------------------------

def _sampled(a: Analysis, residues: DataFrame, k: int) -> DataFrame:
    """Evenly spaced residues of each structure: ``k`` of them, or all if fewer. Adds ``pick``."""
    placed = numbered(residues, ["structure_id"], ["residue_idx"], f"residue_idx div {BLOCK_ROWS}", "place")
    sizes = residues.groupBy("structure_id").agg(F.expr("count(*) AS n"))
    wanted = sizes.selectExpr("structure_id", "n", f"least({k}, n) AS k").selectExpr(
        "structure_id", "n", "k", "explode(sequence(0L, k - 1)) AS pick").selectExpr(
        "structure_id", "pick", f"{linspace_index('n', 'k', 'pick')} AS place")
    return placed.join(wanted, ["structure_id", "place"])


def g01(a: Analysis) -> DataFrame:
    """Distances of 3 to 25 Angstrom between telling atoms of twelve spread residues."""
    listed = chem.sql_literal(list(INFORMATIVE))
    ranked = a.atoms.filter(f"entity = 'protein' AND {chem.in_list('atom_name', INFORMATIVE)}")
    has_ca = ranked.filter("atom_name = 'CA'").select("structure_id", "residue_idx")
    telling = argmin_by(ranked.selectExpr("structure_id", "residue_idx", f"array_position({listed}, atom_name) AS o", "atom_name", "label", "x", "y", "z"),
                        ["structure_id", "residue_idx"], ["o"], ["atom_name", "label", "x", "y", "z"])
    eligible = telling.join(has_ca, ["structure_id", "residue_idx"], "left_semi")
    enough = eligible.groupBy("structure_id").count().filter("count >= 8")
    picked = stage(_sampled(a, stage(eligible.join(enough, "structure_id", "left_semi")), 12))
    first = picked.selectExpr("structure_id", "pick AS i", "concat(label, ':', atom_name) AS atom1", "label AS l1", "x AS a_x", "y AS a_y", "z AS a_z")
    second = picked.selectExpr("structure_id", "pick AS j", "concat(label, ':', atom_name) AS atom2", "label AS l2", "x AS b_x", "y AS b_y", "z AS b_z")
    # Twelve picks per structure at most, whatever its size: at most 66 pairs.
    pairs = first.join(second, "structure_id").filter("i < j").selectExpr("*", f"{distance('a_', 'b_')} AS d").filter("d BETWEEN 3D AND 25D")
    return _rows(pairs, "G01", _json(atom1="atom1", atom2="atom2"), rank="i * 12 + j", required="array(l1, l2)")


def _atom_of(a: Analysis, prefix: str) -> DataFrame:
    return a.atoms.selectExpr("structure_id", f"concat(label, ':', atom_name) AS {prefix}", *[f"{c} AS {prefix}_{c}" for c in "xyz"])


def g01_answer(a: Analysis, asked: DataFrame) -> DataFrame:
    """``asked`` holds ``structure_id, atom1, atom2``."""
    joined = asked.join(_atom_of(a, "atom1"), ["structure_id", "atom1"]).join(_atom_of(a, "atom2"), ["structure_id", "atom2"])
    return joined.selectExpr("structure_id", "atom1", "atom2", f"{round_decimals(distance('atom1_', 'atom2_'))} AS number")


def g02(a: Analysis) -> DataFrame:
    """Nearest non-bonded atom of side-chain atoms of sixty spread residues, with a clear winner."""
    protein = a.residues.filter("entity = 'protein'")
    picked = _sampled(a, protein, 60).filter(chem.is_standard("name"))
    queries = a.atoms.filter(f"NOT {chem.in_list('atom_name', (*chem.BACKBONE, 'OXT'))}").join(
        picked.select("structure_id", "residue_idx"), ["structure_id", "residue_idx"], "left_semi").select("structure_id", "atom_idx")
    ranked = contacts.nearest_nonbonded(a.atoms, a.separations, queries).filter(
        f"second IS NOT NULL AND best.distance <= 5D AND {chem.is_standard('best.near_name')}").selectExpr(
        "*", "second.distance - best.distance AS gap").filter(f"gap >= {NEAREST_MARGIN / 2}D")
    return _rows(ranked, "G02", _json(residue="label", atom="atom_name"), f"IF(gap < {NEAREST_MARGIN}D, 'nearest_atom_margin', NULL)", "-gap",
                 required="array(label, best.near_label)")


def g02_answer(a: Analysis) -> DataFrame:
    ranked = contacts.nearest_nonbonded(a.atoms, a.separations)
    return ranked.selectExpr("structure_id", "label AS residue", "atom_name AS atom", "concat(best.near_label, ':', best.near_atom) AS text")


def g03(a: Analysis) -> DataFrame:
    """Closest of five candidates to a target: a clear winner among all residues of the structure, decoys spread by rank."""
    protein = a.residues.filter("entity = 'protein'")
    # The reference asks for two residues more than there are candidates.
    counted = stage(a.residues.groupBy("structure_id").agg(F.expr("count_if(entity = 'protein') AS n_protein")))
    enough = protein.join(counted.filter("n_protein >= 7"), "structure_id", "left_semi")
    targets = stage(_sampled(a, enough, 20).selectExpr("structure_id", "residue_idx AS residue_idx_i", "label", "chain", "poly_index"))
    others = protein.selectExpr("structure_id", "residue_idx AS residue_idx_j", "label AS other_label", "chain AS other_chain", "poly_index AS other_index")
    # Twenty targets per structure at most, whatever its size.
    pairs = stage(targets.join(merged(others), "structure_id").filter(
        "residue_idx_i <> residue_idx_j AND NOT coalesce(chain = other_chain AND abs(poly_index - other_index) <= 2, false)"))
    measured = contacts.listed_pair_distances(pairs, a.atoms).select("structure_id", "residue_idx_i", "residue_idx_j", "distance")
    around = stage(pairs.join(merged(measured), ["structure_id", "residue_idx_i", "residue_idx_j"]).selectExpr(
        "structure_id", "residue_idx_i AS residue_idx", "label", "residue_idx_j AS other", "other_label", "distance"))
    placed = numbered(around, ["structure_id", "residue_idx"], ["distance", "other"], "CAST(floor(distance / 8) AS BIGINT)", "place")
    sizes = around.groupBy("structure_id", "residue_idx").agg(F.expr("count(*) AS n")).filter("n >= 5").selectExpr("*", "greatest(1, (n - 1) div 4) AS step")
    chosen = placed.join(merged(sizes), ["structure_id", "residue_idx"]).filter(
        "place <= 1 OR ((place - 1) % step = 0 AND (place - 1) div step < 4)")
    rows = chosen.groupBy("structure_id", "residue_idx", "label").agg(
        F.expr("min(distance) FILTER (WHERE place = 0) AS d0"), F.expr("min(distance) FILTER (WHERE place = 1) AS d1"),
        F.expr("array_sort(collect_list(IF(place = 0 OR ((place - 1) % step = 0 AND (place - 1) div step < 4), other_label, NULL))) AS candidates"))
    found = _rows(rows, "G03", _json(target="label", candidates="candidates"),
                  f"IF(d1 - d0 < {NEAREST_MARGIN}D, 'closest_candidate_margin', NULL)", "-(d1 - d0)", required="concat(array(label), candidates)")
    return found.unionByName(_rows(counted.filter("n_protein < 7"), "G03", "'{}'", "'too_few_residues'"))


def g03_answer(a: Analysis, asked: DataFrame) -> DataFrame:
    """``asked`` holds ``structure_id, target, candidates``; the nearest candidate, ties by label."""
    names = a.residues.select("structure_id", "label", "residue_idx")
    flat = asked.selectExpr("structure_id", "target", "explode(candidates) AS candidate")
    pairs = flat.join(names.selectExpr("structure_id", "label AS target", "residue_idx AS residue_idx_i"), ["structure_id", "target"]).join(
        names.selectExpr("structure_id", "label AS candidate", "residue_idx AS residue_idx_j"), ["structure_id", "candidate"])
    measured = pairs.join(contacts.listed_pair_distances(pairs, a.atoms), ["structure_id", "residue_idx_i", "residue_idx_j"])
    return argmin_by(measured, ["structure_id", "target"], ["distance", "candidate"]).selectExpr("structure_id", "target", "candidate AS text")


def g04(a: Analysis) -> DataFrame:
    """The worst clash of a structure when it stands out from the next."""
    top = first_per_key(a.clashes, ["structure_id"], ["overlap DESC", "residue_idx_i", "residue_idx_j"], 2)
    rows = top.groupBy("structure_id").agg(
        F.expr("max(struct(-rank AS r, overlap, label_i, label_j)) AS best"), F.expr("coalesce(max(overlap) FILTER (WHERE rank = 2), 0D) AS next"))
    sized = a.residues.filter("entity = 'protein'").groupBy("structure_id").count()
    gap = "best.overlap - next"
    verdict = f"CASE WHEN count > 600 THEN 'structure_too_large_for_uncroppable_family' WHEN {gap} < 0.20D THEN 'clash_uniqueness_margin' END"
    pair = "array_join(array_sort(array(best.label_i, best.label_j)), '--')"
    return _rows(rows.join(sized, "structure_id"), "G04", _json(pair=pair), verdict, f"-({gap})", required="array(best.label_i, best.label_j)")


def g04_answer(a: Analysis) -> DataFrame:
    top = first_per_key(a.clashes, ["structure_id"], ["overlap DESC", "residue_idx_i", "residue_idx_j"], 1)
    return top.selectExpr("structure_id", "array_join(array_sort(array(label_i, label_j)), '--') AS text")


# -- local -------------------------------------------------------------------------

def _partner_rows(pairs: DataFrame) -> DataFrame:
    sides = ("explode(array(struct(residue_idx_i AS r, label_i AS l, residue_idx_j AS o, label_j AS m), "
             "struct(residue_idx_j AS r, label_j AS l, residue_idx_i AS o, label_i AS m))) AS e")
    return pairs.selectExpr("structure_id", "distance", sides).selectExpr(
        "structure_id", "e.r AS residue_idx", "e.l AS label", "e.o AS other", "e.m AS other_label", "distance")


def s01(a: Analysis) -> DataFrame:
    """Salt-bridge partner: exactly one, and the next opposite charge clearly outside the cutoff."""
    found = _partner_rows(a.bridges).groupBy("structure_id", "residue_idx", "label").agg(
        F.expr("count(*) AS n"), F.expr("min(struct(distance, other, other_label)) AS best"))
    wide = _partner_rows(contacts.charged_pairs(a.atoms, 4.0 + NEGATIVE_MARGIN))
    runner = wide.join(merged(found.selectExpr("structure_id", "residue_idx", "best.other AS partner")), ["structure_id", "residue_idx"]).filter(
        "other <> partner").groupBy("structure_id", "residue_idx").agg(F.expr("min(distance) AS runner_up"))
    rows = found.join(merged(runner), ["structure_id", "residue_idx"], "left")
    verdict = (f"CASE WHEN n <> 1 THEN 'multiple_salt_bridge_partners' WHEN runner_up < {4.0 + NEGATIVE_MARGIN}D THEN 'salt_bridge_negative_margin' END")
    tag = "IF(split(label, ':')[0] <> split(best.other_label, ':')[0], 'interchain', 'intrachain')"
    return _rows(rows, "S01", _json(residue="label"), verdict, "best.distance", tag, "array(label, best.other_label)")


def s01_answer(a: Analysis) -> DataFrame:
    return _partner_rows(a.bridges).groupBy("structure_id", "label").agg(
        F.expr("count(*) AS n"), F.expr("min(other_label) AS text")).filter("n = 1").selectExpr("structure_id", "label AS residue", "text")


def s02(a: Analysis) -> DataFrame:
    """The only phosphorylated residue of a structure."""
    sites = a.atoms.filter(f"entity = 'protein' AND {chem.in_list('name', chem.PHOSPHO)}").groupBy("structure_id").agg(
        F.expr("count(DISTINCT residue_idx) AS n"), F.expr("min(label) AS label"), F.expr("bool_or(atom_name = 'P') AS has_p")).join(a.sizes, "structure_id")
    verdict = f"CASE WHEN n > 1 THEN 'multiple_phosphorylated_residues' WHEN large THEN '{TOO_LARGE}' WHEN NOT has_p THEN 'phosphate_atom_missing' END"
    return _rows(sites, "S02", "'{}'", verdict, required="array(label)")


def s02_answer(a: Analysis) -> DataFrame:
    sites = a.residues.filter(f"entity = 'protein' AND {chem.in_list('name', chem.PHOSPHO)}")
    return sites.groupBy("structure_id").agg(F.expr("count(*) AS n"), F.expr("min(label) AS text")).filter("n = 1").drop("n")


def s03(a: Analysis) -> DataFrame:
    """Buried or exposed, outside the band between."""
    rows = _whole(a, a.areas).filter(f"rasa IS NOT NULL AND {chem.is_standard('name')}")
    off = "CASE burial WHEN 'buried' THEN 0.2D - rasa WHEN 'solvent-exposed' THEN rasa - 0.4D END"
    kind = f"CASE WHEN {chem.in_list('parent', CHARGED)} THEN 'charged' WHEN {chem.in_list('parent', HYDROPHOBIC)} THEN 'hydrophobic' ELSE 'polar' END"
    return _with_large(a, _rows(rows, "S03", _json(residue="label"), "IF(burial = 'intermediate', 'intermediate_burial', NULL)", f"-({off})",
                                f"concat(burial, ':', {kind})", "array(label)"), "S03")


def s03_answer(a: Analysis) -> DataFrame:
    return a.areas.filter("burial <> 'intermediate'").selectExpr("structure_id", "label AS residue", "burial AS text")


def s04(a: Analysis) -> DataFrame:
    """Secondary structure well inside a stable run."""
    rows = _whole(a, backbone.class_runs(a.atoms, a.structure))
    verdict = "CASE WHEN class IS NULL THEN 'dssp_missing_backbone' WHEN run_length < 5 OR edge_distance < 2 THEN 'unstable_secondary_structure_run' END"
    return _with_large(a, _rows(rows, "S04", _json(residue="label"), verdict, "-(run_length + edge_distance)", "coalesce(class, '')", "array(label)"), "S04")


def s04_answer(a: Analysis) -> DataFrame:
    return a.structure.selectExpr("structure_id", "label AS residue", "class AS text")


def s05(a: Analysis) -> DataFrame:
    """Fold class of chains with at least forty assigned residues."""
    rows = _whole(a, backbone.chain_fractions(a.structure))
    verdict = "CASE WHEN n_assigned < 40 THEN 'chain_too_short_for_fold_class' WHEN fold IS NULL THEN 'fold_class_undefined' END"
    return _with_large(a, _rows(rows, "S05", _json(chain="chain"), verdict, tag="coalesce(fold, '')"), "S05")


def s05_answer(a: Analysis) -> DataFrame:
    return backbone.chain_fractions(a.structure).filter("fold IS NOT NULL").selectExpr("structure_id", "chain", "fold AS text")


def s06(a: Analysis) -> DataFrame:
    """Residues around a ligand of at least six atoms, 3 to 35 of them, with a clear edge."""
    wide = stage(contacts.ligand_contacts(a.atoms, 6.0))
    sizes = a.residues.filter("entity = 'ligand'").selectExpr("structure_id", "label AS ligand", "n_atoms")
    inside = wide.filter("distance <= 4D").groupBy("structure_id", "ligand").agg(
        F.expr("count(*) AS n"), F.expr("collect_list(label) AS labels"))
    edge = contacts.nearest_excluded(wide, ["structure_id", "ligand"], 4.0)
    rows = sizes.join(merged(inside), ["structure_id", "ligand"], "left").join(merged(edge), ["structure_id", "ligand"], "left")
    verdict = ("CASE WHEN n_atoms < 6 THEN 'ligand_too_small' WHEN coalesce(n, 0) NOT BETWEEN 3 AND 35 THEN 'ligand_contact_count_out_of_range' "
               f"WHEN nearest_excluded < {4.0 + SET_MARGIN}D THEN 'ligand_contact_negative_margin' END")
    return _rows(rows, "S06", _json(ligand="ligand"), verdict, "n", required="concat(array(ligand), coalesce(labels, CAST(array() AS array<string>)))")


def s06_answer(a: Analysis) -> DataFrame:
    return contacts.ligand_contacts(a.atoms).groupBy("structure_id", "ligand").agg(F.expr("array_sort(collect_set(label)) AS items"))


def s07(a: Analysis) -> DataFrame:
    """Residues coordinating a metal, with donors well inside and other atoms well outside the cutoff."""
    metals = a.residues.filter("entity = 'metal'").selectExpr("structure_id", "label AS metal", f"{chem.metal_cutoff('name')} AS limit",
                                                               f"{chem.metal_element('name')} AS element")
    around = contacts.metal_coordination(a.atoms).groupBy("structure_id", "metal").agg(
        F.expr("max(distance) FILTER (WHERE is_donor) AS worst"), F.expr("min(distance) FILTER (WHERE NOT is_donor) AS nearest_other"),
        F.expr("count_if(is_donor) AS n"), F.expr("collect_set(IF(is_donor, label, NULL)) AS labels"))
    rows = metals.join(merged(around), ["structure_id", "metal"], "left")
    verdict = ("CASE WHEN limit IS NULL THEN 'metal_not_eligible' WHEN coalesce(n, 0) = 0 THEN 'metal_without_protein_donors' "
               "WHEN worst > limit - 0.15D THEN 'metal_donor_inside_margin' WHEN nearest_other < limit + 0.25D THEN 'metal_nondonor_inside_margin' END")
    return _rows(rows, "S07", _json(metal="metal", element="element", cutoff="limit"), verdict, "-n", "element",
                 "concat(array(metal), coalesce(labels, CAST(array() AS array<string>)))")


def s07_answer(a: Analysis) -> DataFrame:
    return contacts.metal_coordination(a.atoms).filter("is_donor").groupBy("structure_id", "metal").agg(F.expr("array_sort(collect_set(label)) AS items"))


def s08(a: Analysis) -> DataFrame:
    """Disulfide partner when no third sulfur is near."""
    rows = _partner_rows(a.disulfides).join(contacts.closest_other_sulfur(a.atoms, a.disulfides, 3.0), ["structure_id", "residue_idx"], "left")
    tag = "IF(split(label, ':')[0] <> split(other_label, ':')[0], 'interchain', 'intrachain')"
    return _rows(rows, "S08", _json(residue="label"), "IF(closest_other_sg < 3D, 'disulfide_third_cysteine_too_close', NULL)", "distance", tag,
                 "array(label, other_label)")


def s08_answer(a: Analysis) -> DataFrame:
    return _partner_rows(a.disulfides).selectExpr("structure_id", "label AS residue", "other_label AS text")


def s09(a: Analysis) -> DataFrame:
    rows = torsions.chi1(a.atoms).filter(chem.is_standard("name"))
    return _rows(rows, "S09", _json(residue="label", atom4="atom4"), "IF(rotamer = '', 'chi1_within_boundary_margin', NULL)", "-edge_distance", "rotamer", "array(label)")


def s09_answer(a: Analysis) -> DataFrame:
    return torsions.chi1(a.atoms).filter("rotamer <> ''").selectExpr("structure_id", "label AS residue", "rotamer AS text")


# -- interfaces and the network -----------------------------------------------------

def i01(a: Analysis) -> DataFrame:
    """Residues of one chain at its interface with another: 4 to 40 contacts and a clear edge."""
    wide = stage(_whole(a, contacts.interface_contacts(a.atoms, 4.0 + SET_MARGIN)))
    per_pair = wide.groupBy("structure_id", "chain_i", "chain_j").agg(
        F.expr("count_if(distance <= 4D) AS n"), F.expr("array_sort(collect_set(IF(distance <= 4D, label_i, NULL))) AS labels"))
    edge = wide.groupBy("structure_id", "chain_i", "chain_j", "label_i").agg(F.expr("min(distance) AS d")).filter("d > 4D").groupBy(
        "structure_id", "chain_i", "chain_j").agg(F.expr("min(d) AS nearest_excluded"))
    rows = per_pair.join(edge, ["structure_id", "chain_i", "chain_j"], "left")
    verdict = (f"CASE WHEN n NOT BETWEEN 4 AND 40 THEN 'interface_size_out_of_range' WHEN nearest_excluded < {4.0 + SET_MARGIN}D THEN 'interface_negative_margin' END")
    return _with_large(a, _rows(rows, "I01", _json(chain_a="chain_i", chain_b="chain_j"), verdict, "-size(labels)", "concat(chain_i, chain_j)", "labels"), "I01")


def i01_answer(a: Analysis) -> DataFrame:
    return contacts.interface_contacts(a.atoms).groupBy("structure_id", "chain_i", "chain_j").agg(
        F.expr("array_sort(collect_set(label_i)) AS items")).withColumnsRenamed({"chain_i": "chain_a", "chain_j": "chain_b"})


def n01(a: Analysis) -> DataFrame:
    """The only residue touching two that do not touch each other, with no near miss."""
    protein = a.residues.filter("entity = 'protein'").select("structure_id", "residue_idx", "label")
    keep = protein.select("structure_id", F.col("residue_idx").alias("i"))
    edges = a.graph.join(keep, ["structure_id", "i"], "left_semi").join(keep.withColumnRenamed("i", "j"), ["structure_id", "j"], "left_semi")
    shared = stage(network.common_neighbours(stage(edges.select("structure_id", "i", "j", "distance"))))
    limit = 4.0 + NEGATIVE_MARGIN
    single = shared.filter("n_bridges = 1")
    close = contacts.residue_pair_minima(contacts.protein_atoms(a.atoms), limit).selectExpr(
        "structure_id", "residue_idx_i AS a", "residue_idx_j AS b", "distance AS anchor_distance")
    missed = network.near_miss(a.atoms, single, limit)
    rows = shared.join(close, ["structure_id", "a", "b"], "left").join(missed, ["structure_id", "a", "b"], "left")
    for column in ("a", "b", "bridge"):
        rows = rows.join(protein.selectExpr("structure_id", f"residue_idx AS {column}", f"label AS {column}_label"), ["structure_id", column])
    verdict = ("CASE WHEN n_bridges > 1 THEN 'multiple_bridging_residues' WHEN anchor_distance IS NOT NULL AND anchor_distance < "
               f"{limit}D THEN 'anchors_too_close' WHEN near_miss < {limit}D THEN 'near_miss_bridging_residue' END")
    tag = "IF(split(a_label, ':')[0] <> split(b_label, ':')[0], 'interchain', 'intrachain')"
    return _rows(rows, "N01", _json(anchor_a="a_label", anchor_b="b_label"), verdict, "greatest(bridge_to_a, bridge_to_b)", tag,
                 "array(a_label, b_label, bridge_label)")


def n01_answer(a: Analysis, asked: DataFrame) -> DataFrame:
    """``asked`` holds ``structure_id, anchor_a, anchor_b``; answers only where the bridge is unique."""
    names = a.residues.filter("entity = 'protein'").select("structure_id", "residue_idx", "label")
    anchors = asked.join(names.selectExpr("structure_id", "residue_idx AS a", "label AS anchor_a"), ["structure_id", "anchor_a"]).join(
        names.selectExpr("structure_id", "residue_idx AS b", "label AS anchor_b"), ["structure_id", "anchor_b"])
    found = network.bridging_residues(a.graph, anchors).join(
        names.selectExpr("structure_id", "residue_idx AS bridge", "label AS bridge_label"), ["structure_id", "bridge"])
    return found.groupBy("structure_id", "anchor_a", "anchor_b").agg(F.expr("count(*) AS n"), F.expr("min(bridge_label) AS text")).filter("n = 1").drop("n")


# -- two states ---------------------------------------------------------------------

def contact_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Residue pairs in contact in at least one state, measured in both, with the five-way verdict.

    Both inputs are atoms of paired states in one frame, sharing ``structure_id`` per pair.
    Only residues with the same label and letter in both states take part.
    """
    from ..functions.geometry import contact_change
    first, second = stage(first), stage(second)

    def names(df: DataFrame, s: int) -> DataFrame:
        return df.filter("entity = 'protein'").selectExpr("structure_id", "label", "parent", f"residue_idx AS r{s}").distinct()

    shared = stage(names(first, 1).join(names(second, 2), ["structure_id", "label", "parent"]).drop("parent"))

    def labelled(df: DataFrame) -> DataFrame:
        return contacts.residue_contacts(df).selectExpr("structure_id", "least(label_i, label_j) AS l1", "greatest(label_i, label_j) AS l2")

    pairs = labelled(first).unionByName(labelled(second)).distinct()
    for n in (1, 2):
        pairs = pairs.join(shared.selectExpr("structure_id", f"label AS l{n}", f"r1 AS s1_{n}", f"r2 AS s2_{n}"), ["structure_id", f"l{n}"])
    pairs = stage(pairs)
    out = pairs
    for s, atoms in ((1, first), (2, second)):
        listed = pairs.selectExpr("structure_id", f"least(s{s}_1, s{s}_2) AS residue_idx_i", f"greatest(s{s}_1, s{s}_2) AS residue_idx_j")
        measured = contacts.listed_pair_distances(listed, atoms).selectExpr("structure_id", "residue_idx_i", "residue_idx_j", f"distance AS d{s}")
        out = out.selectExpr("*", f"least(s{s}_1, s{s}_2) AS residue_idx_i", f"greatest(s{s}_1, s{s}_2) AS residue_idx_j").join(
            measured, ["structure_id", "residue_idx_i", "residue_idx_j"]).drop("residue_idx_i", "residue_idx_j")
    return out.selectExpr("structure_id", "l1", "l2", "d1", "d2", f"{contact_change('d1', 'd2')} AS verdict")


def t01(changes: DataFrame, seed: str, shared: DataFrame | None = None) -> DataFrame:
    """Up to eight candidate pairs per state pair, seeded from the fourteen clearest of each direction.

    Four gained and four lost; if that is fewer than six, the first eight of both pools, gained ones first.
    ``shared`` lists ``structure_id, n_shared``, consistently labelled residues; fewer than thirty reject the pair.
    """
    from ..operators.select import pooled_order
    moved = changes.filter("verdict IN ('gained', 'lost')").selectExpr("*", "abs(d1 - d2) AS shift")
    pool = pooled_order(moved, ["structure_id", "verdict"], ["shift DESC", "l1", "l2"], seed, pool=14).filter("pool_rank IS NOT NULL")
    sizes = pool.groupBy("structure_id").agg(F.expr("count_if(verdict = 'gained') AS g"), F.expr("count_if(verdict = 'lost') AS l"))
    chosen = pool.join(sizes, "structure_id").filter(
        "IF(least(g, 4) + least(l, 4) >= 6, pool_rank <= 4, pool_rank + IF(verdict = 'gained', 0, g) <= 8)")
    picked = chosen.groupBy("structure_id").agg(
        F.expr("transform(array_sort(collect_list(struct(l1, l2))), p -> concat(p.l1, '--', p.l2)) AS candidates"),
        F.expr("array_sort(array_distinct(flatten(collect_list(array(l1, l2))))) AS labels"), F.first("g").alias("g"), F.first("l").alias("l"))
    known = changes.select("structure_id").distinct()
    if shared is not None:
        known = shared.join(known, "structure_id", "full")
    else:
        known = known.withColumn("n_shared", F.lit(None).cast("long"))
    rows = known.join(picked, "structure_id", "left").selectExpr(
        "structure_id", "n_shared", "coalesce(g, 0) AS g", "coalesce(l, 0) AS l", "coalesce(candidates, CAST(array() AS array<string>)) AS candidates",
        "coalesce(labels, CAST(array() AS array<string>)) AS labels")
    verdict = ("CASE WHEN n_shared < 30 THEN 'too_few_consistently_labelled_residues' "
               "WHEN g = 0 OR l = 0 THEN 'state_pair_lacks_both_gained_and_lost_contacts' "
               "WHEN size(candidates) < 6 THEN 'too_few_unambiguous_contact_changes' END")
    return _rows(rows, "T01", _json(candidates="candidates"), verdict, "-size(candidates)", required="labels")


def t01_answer(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` holds ``structure_id, candidates``; candidates that are neither gained nor lost are an error."""
    flat = asked.selectExpr("structure_id", "explode(candidates) AS pair")
    known = changes.selectExpr("structure_id", "concat(l1, '--', l2) AS pair", "verdict")
    joined = flat.join(known, ["structure_id", "pair"], "left").filter(
        "verdict IN ('gained', 'lost') OR raise_error(concat('candidate is not a change: ', pair))")
    return joined.groupBy("structure_id").agg(
        F.expr("array_sort(collect_list(IF(verdict = 'gained', pair, NULL))) AS gained"),
        F.expr("array_sort(collect_list(IF(verdict = 'lost', pair, NULL))) AS lost"))


PROPOSERS = {"P01": p01, "P02": p02, "P03": p03, "G01": g01, "G02": g02, "G03": g03, "G04": g04, "S01": s01, "S02": s02, "S03": s03,
             "S04": s04, "S05": s05, "S06": s06, "S07": s07, "S08": s08, "S09": s09, "I01": i01, "N01": n01}


def propose_all(a: Analysis, families: list[str] | None = None) -> DataFrame:
    """Tagged candidates of all single-structure families."""
    out = None
    for name in families or PROPOSERS:
        rows = stage(PROPOSERS[name](a).select(*COLUMNS))
        out = rows if out is None else out.unionByName(rows)
    return out
