"""Secondary structure from backbone hydrogen bonds, as joins and one aggregate.

Positions run along each chain over residues with a complete backbone. All rules
("bonded to the next", "same uninterrupted stretch") are equalities on position or
on the start of a stretch, so no task ever holds a chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions.geometry import angle, fold_class, hbond_energy, vec
from ..functions.numeric import distance
from ..session import merged, stage
from .sequence import BLOCK_ROWS, numbered, runs, with_neighbour
from .spatial import radius_pairs

CHAIN = ["structure_id", "chain"]
#: Peptide bond length limit, CA search radius, energy cutoff, bend angle.
PEPTIDE_MAX, CA_RADIUS, ENERGY_CUTOFF, BEND_ANGLE = 2.0, 9.0, -0.5, 70.0
#: Code precedence, strongest first.
PRECEDENCE = ("H", "E", "B", "G", "I", "T", "S")


def backbone(atoms: DataFrame) -> DataFrame:
    """One row per protein residue with its N, CA, C and O; NULL coordinates where one is missing."""
    wanted = atoms.filter(f"entity = 'protein' AND {chem.in_list('atom_name', chem.BACKBONE)}")
    values = [F.expr(f"max(IF(atom_name = '{a}', {c}, NULL)) AS {a.lower()}_{c}") for a in chem.BACKBONE for c in "xyz"]
    return wanted.groupBy(*CHAIN, "residue_idx", "poly_index", "parent", "label").agg(*values)


def chain_backbone(atoms: DataFrame) -> DataFrame:
    """Complete backbones with ``k``, the position among complete residues of the chain, the start of
    the peptide-bonded stretch it lies in, and the amide hydrogen where the residue can donate."""
    complete = backbone(atoms).filter("n_x IS NOT NULL AND ca_x IS NOT NULL AND c_x IS NOT NULL AND o_x IS NOT NULL")
    placed = numbered(complete, CHAIN, ["poly_index"], f"poly_index div {BLOCK_ROWS}", "k")
    linked = with_neighbour(placed, CHAIN, "k", ["c_x", "c_y", "c_z", "o_x", "o_y", "o_z"], -1, "before_")
    bonded = f"coalesce({distance('before_c_', 'n_')} <= {PEPTIDE_MAX}D, false)"
    # A stretch is a run of one constant that breaks wherever the bond to the residue before is absent.
    stretched = runs(linked.selectExpr("*", f"{bonded} AS bonded_before"), CHAIN, "k", "1", breaks="NOT bonded_before")
    length = distance("before_c_", "before_o_")
    donates = f"bonded_before AND parent <> 'PRO' AND {length} >= 1e-6"
    hydrogens = [f"IF({donates}, n_{c} + (before_c_{c} - before_o_{c}) / {length}, NULL) AS h_{c}" for c in "xyz"]
    # Kept: every rule below reads it, and the hydrogen position is a long expression
    # that must be computed once, not copied into each distance of the bond energy.
    return stage(stretched.selectExpr(
        *CHAIN, "residue_idx", "label", "k", "bonded_before", "run_start AS stretch",
        "run_offset + 1 < run_length AS bonded_after", *hydrogens,
        *[f"{a}_{c}" for a in ("n", "ca", "c", "o") for c in "xyz"]))


def hydrogen_bonds(chains: DataFrame) -> DataFrame:
    """Donor-acceptor pairs below the energy cutoff, with both positions."""
    carried = ["chain", "k", "stretch", "residue_idx", *[f"{a}_{c}" for a in ("n", "h", "c", "o") for c in "xyz"]]
    points = chains.selectExpr("*", "ca_x AS x", "ca_y AS y", "ca_z AS z")
    pairs = radius_pairs(points, CA_RADIUS, carried, ident="residue_idx")
    sides = []
    for d, a in (("a", "b"), ("b", "a")):
        legs = {leg: distance(f"{p}_{u}_", f"{q}_{v}_") for leg, (p, u, q, v) in {
            "on": (a, "o", d, "n"), "ch": (a, "c", d, "h"), "oh": (a, "o", d, "h"), "cn": (a, "c", d, "n")}.items()}
        fields = {f"{s}{f}": f"{p}_{n}" for s, p in (("d", d), ("a", a)) for f, n in (
            ("c", "chain"), ("k", "k"), ("s", "stretch"), ("r", "residue_idx"))} | legs
        sides.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")
    rows = pairs.selectExpr("structure_id", f"explode(array({', '.join(sides)})) AS b").selectExpr("structure_id", "b.*").filter(
        "on IS NOT NULL AND oh IS NOT NULL AND NOT (dc = ac AND abs(dk - ak) < 2)")
    return rows.selectExpr(
        "structure_id", "dr AS donor", "ar AS acceptor", f"{hbond_energy('on', 'ch', 'oh', 'cn')} AS energy", "dc AS donor_chain",
        "dk AS donor_k", "ds AS donor_stretch", "ac AS acceptor_chain", "ak AS acceptor_k", "as AS acceptor_stretch").filter(
        f"energy < {ENERGY_CUTOFF}D")


def turns(hbonds: DataFrame) -> DataFrame:
    """n-turns: N-H of ``k + step`` bonded to C=O of ``k`` along one uninterrupted stretch."""
    return hbonds.filter(
        "donor_chain = acceptor_chain AND donor_stretch = acceptor_stretch AND donor_k - acceptor_k IN (3, 4, 5)"
    ).selectExpr("structure_id", "donor_chain AS chain", "acceptor_k AS k", "donor_k - acceptor_k AS step").distinct()


def bridges(chains: DataFrame, hbonds: DataFrame) -> DataFrame:
    """Parallel (P) and antiparallel (A) bridges between positions ``i`` and ``j``.

    Each hydrogen bond votes for the pairs it could complete; a pair is a bridge
    when the votes of one pattern are all present. One aggregate replaces the four
    self-joins the definition suggests.
    """
    def vote(first: str, second: str, bit: int) -> str:
        return f"named_struct('i', {first}, 'j', {second}, 'bit', {bit})"

    def at(who: str, shift: int) -> str:
        return f"named_struct('chain', {who}_chain, 'k', {who}_k + {shift})"

    votes = [
        # parallel: j -> i-1 together with i+1 -> j
        vote(at("acceptor", 1), at("donor", 0), 1), vote(at("donor", -1), at("acceptor", 0), 2),
        # antiparallel, narrow: j -> i and i -> j
        vote(at("acceptor", 0), at("donor", 0), 4), vote(at("donor", 0), at("acceptor", 0), 8),
        # antiparallel, wide: j+1 -> i-1 and i+1 -> j-1
        vote(at("acceptor", 1), at("donor", -1), 16), vote(at("donor", -1), at("acceptor", 1), 32),
    ]
    counted = hbonds.selectExpr("structure_id", f"explode(array({', '.join(votes)})) AS v").selectExpr(
        "structure_id", "v.i AS i", "v.j AS j", "v.bit AS bit").groupBy("structure_id", "i", "j").agg(
        F.expr("bit_or(bit) AS votes"))
    found = counted.filter("votes & 3 = 3 OR votes & 12 = 12 OR votes & 48 = 48").selectExpr(
        "structure_id", "least(i, j) AS i", "greatest(i, j) AS j", "votes & 3 = 3 AS parallel").groupBy(
        "structure_id", "i", "j").agg(F.expr("IF(bool_or(parallel), 'P', 'A') AS kind"))
    ends = chains.filter("bonded_before AND bonded_after").selectExpr(
        "structure_id", "named_struct('chain', chain, 'k', k) AS p", "residue_idx", "ca_x AS x", "ca_y AS y", "ca_z AS z")
    side = {s: ends.selectExpr("structure_id", f"p AS {s}", f"residue_idx AS residue_{s}",
                               f"x AS {s}_x", f"y AS {s}_y", f"z AS {s}_z") for s in "ij"}
    return (
        found.filter("i.chain <> j.chain OR abs(i.k - j.k) > 2")
        .join(merged(side["i"]), ["structure_id", "i"]).join(merged(side["j"]), ["structure_id", "j"])
        .filter(f"{distance('i_', 'j_')} <= {CA_RADIUS}D")
        .selectExpr("structure_id", "i.chain AS chain_i", "i.k AS k_i", "j.chain AS chain_j", "j.k AS k_j", "kind")
    )


def ladders(found: DataFrame) -> DataFrame:
    """Bridges with the length of the ladder each belongs to.

    Along a ladder ``k_i`` grows by one while ``k_j`` grows (parallel) or shrinks
    (antiparallel), so a ladder is a run over ``k_i`` on one diagonal.
    """
    keyed = found.selectExpr("*", "IF(kind = 'P', k_i - k_j, k_i + k_j) AS diagonal")
    return runs(keyed, ["structure_id", "chain_i", "chain_j", "kind", "diagonal"], "k_i", "1").selectExpr(
        "structure_id", "chain_i", "k_i", "chain_j", "k_j", "kind", "run_length AS ladder")


def _helix_codes(turn_rows: DataFrame, step: int, code: str) -> DataFrame:
    here = turn_rows.filter(f"step = {step}").select(*CHAIN, "k")
    before = here.selectExpr(*CHAIN, "k + 1 AS k")
    return here.join(merged(before), [*CHAIN, "k"]).selectExpr(
        *CHAIN, f"explode(sequence(k, k + {step - 1})) AS k", f"{PRECEDENCE.index(code)} AS rank")


def _sheet_ranks(found: DataFrame) -> DataFrame:
    """E for residues of a bridge with a neighbour on its ladder, B for an isolated bridge."""
    keys = ["structure_id", "chain_i", "chain_j", "kind", "k_i", "k_j"]
    step = "IF(kind = 'P', s, -s)"
    beside = found.selectExpr(*keys, "explode(array(-1, 1)) AS s").selectExpr(
        *keys[:4], "k_i + s AS k_i", f"k_j + {step} AS k_j").distinct().withColumn("extends", F.lit(True))
    ranked = found.join(merged(beside), keys, "left").selectExpr(
        "structure_id", "explode(array(struct(chain_i AS chain, k_i AS k), struct(chain_j AS chain, k_j AS k))) AS e",
        f"IF(extends, {PRECEDENCE.index('E')}, {PRECEDENCE.index('B')}) AS rank")
    return ranked.selectExpr("structure_id", "e.chain AS chain", "e.k AS k", "rank")


def secondary_structure(atoms: DataFrame) -> DataFrame:
    """Eight-state code and three-state class of every residue with a complete backbone."""
    chains = chain_backbone(atoms)
    bonds = stage(hydrogen_bonds(chains))
    turn_rows = stage(turns(bonds))
    sheet = _sheet_ranks(stage(bridges(chains, bonds)))
    plain = turn_rows.selectExpr(*CHAIN, "explode(sequence(k + 1, k + step - 1)) AS k", f"{PRECEDENCE.index('T')} AS rank")
    here = chains.select(*CHAIN, "k", "stretch", "ca_x", "ca_y", "ca_z")
    around = here
    for offset, prefix in ((-2, "p_"), (2, "q_")):
        moved = here.selectExpr(*CHAIN, f"k - ({offset}) AS k", *[f"{n} AS {prefix}{n}" for n in ("stretch", "ca_x", "ca_y", "ca_z")])
        around = around.join(merged(moved), [*CHAIN, "k"])
    bend = angle(vec("p_ca_"), vec("ca_"), vec("q_ca_"))
    bends = around.filter(f"p_stretch = stretch AND q_stretch = stretch AND 180D - ({bend}) > {BEND_ANGLE}D").selectExpr(
        *CHAIN, "k", f"{PRECEDENCE.index('S')} AS rank")
    ranks = _helix_codes(turn_rows, 4, "H").unionByName(sheet).unionByName(_helix_codes(turn_rows, 3, "G")).unionByName(
        _helix_codes(turn_rows, 5, "I")).unionByName(plain).unionByName(bends)
    best = ranks.groupBy(*CHAIN, "k").agg(F.min("rank").alias("rank"))
    # try_element_at: element_at over a literal array is taken to be non-null even for a NULL index.
    code = f"coalesce(try_element_at({chem.sql_literal(list(PRECEDENCE))}, rank + 1), ' ')"
    return chains.select(*CHAIN, "k", "residue_idx", "label").join(merged(best), [*CHAIN, "k"], "left").selectExpr(
        *CHAIN, "residue_idx", "label", "k", f"{code} AS code").selectExpr("*", f"{chem.three_state('code')} AS class")


def failed_residues(atoms: DataFrame) -> DataFrame:
    """Protein residues without a complete backbone."""
    whole = backbone(atoms).filter("n_x IS NOT NULL AND ca_x IS NOT NULL AND c_x IS NOT NULL AND o_x IS NOT NULL")
    return atoms.filter("entity = 'protein'").select("structure_id", "residue_idx").distinct().join(
        whole, ["structure_id", "residue_idx"], "left_anti")


def chain_fractions(assigned: DataFrame) -> DataFrame:
    """Helix and strand fractions per chain over assigned residues, and the fold class they imply."""
    return assigned.groupBy(*CHAIN).agg(
        F.expr("count(*) AS n_assigned"), F.expr("avg(IF(class = 'helix', 1D, 0D)) AS helix_fraction"),
        F.expr("avg(IF(class = 'strand', 1D, 0D)) AS beta_fraction")).selectExpr(
        "*", f"{fold_class('helix_fraction', 'beta_fraction')} AS fold")


def class_runs(atoms: DataFrame, assigned: DataFrame) -> DataFrame:
    """Run length and distance to the run's edge per protein residue; unassigned residues form runs too."""
    residues = atoms.filter("entity = 'protein'").select(*CHAIN, "residue_idx", "poly_index", "label").distinct()
    known = residues.join(assigned.select("structure_id", "residue_idx", "code", "class"), ["structure_id", "residue_idx"], "left")
    return runs(known.withColumn("poly_index", F.col("poly_index").cast("long")), CHAIN, "poly_index", "class")


def three_ten_runs(class_run_rows: DataFrame, min_run: int = 3) -> DataFrame:
    """Contiguous stretches of code G with at least ``min_run`` residues."""
    base = class_run_rows.select(*CHAIN, "residue_idx", "poly_index", "label", "code")
    return runs(base, CHAIN, "poly_index", "code").filter(f"code = 'G' AND run_length >= {min_run}").groupBy(
        *CHAIN, "run_start").agg(F.expr("max(run_length) AS length"), F.expr("min_by(label, poly_index) AS first_label"))
