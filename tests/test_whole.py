"""Structures above the size limit, and candidates ranked over whole structures."""

import math

from pyspark.sql import functions as F

from residuum.plans import families
from residuum.sources import tables


def test_large_structures_are_rejected_with_a_reason(spark, sf, monkeypatch):
    atoms = tables.atoms(spark, sf).filter("structure_id IN ('S0', 'S1')")
    extra = atoms.filter("structure_id = 'S0'")
    top = atoms.agg(F.max("atom_idx")).first()[0]
    # A second copy far away under the same residues makes S0 large.
    both = atoms.unionByName(extra.withColumn("atom_idx", F.col("atom_idx") + top + 1).withColumn("x", F.col("x") + 500))
    assert both.filter("structure_id = 'S0'").count() > families.MAX_WHOLE_ATOMS
    a = families.Analysis(both)
    for name in ("P01", "P02", "P03", "S03", "S04", "S05", "I01"):
        rows = families.PROPOSERS[name](a).filter("structure_id = 'S0'").collect()
        assert [(r.accepted, r.reason) for r in rows] == [(False, "structure_too_large_for_uncroppable_family")], name
    sites = both.filter("name = 'SEP'").groupBy("structure_id").agg(F.countDistinct("residue_idx").alias("n")).collect()
    wanted = {r.structure_id: "multiple_phosphorylated_residues" if r.n > 1 else families.TOO_LARGE for r in sites if r.structure_id == "S0"}
    assert {r.structure_id: r.reason for r in families.s02(a).filter("structure_id = 'S0'").collect()} == wanted


def test_decoys_are_ranked_over_the_whole_structure(spark, sf):
    atoms = tables.atoms(spark, sf).filter("structure_id = 'S0'")
    residues = {}
    for r in atoms.filter("entity = 'protein'").collect():
        residues.setdefault(r.residue_idx, (r.label, r.chain, r.poly_index, []))[3].append((r.x, r.y, r.z))
    order, want = sorted(residues), {}
    for k in range(20):
        t = order[int(k * (len(order) - 1) / 19)]
        label, chain, place, own = residues[t]
        near = sorted((min(math.dist(p, q) for p in own for q in v[3]), o) for o, v in residues.items()
                      if o != t and not (v[1] == chain and None not in (place, v[2]) and abs(place - v[2]) <= 2))
        if len(near) >= 5:
            step = max(1, (len(near) - 1) // 4)
            chosen = [near[0], *near[1:][:step * 4:step][:4]]
            want[label] = (near[1][0] - near[0][0] >= families.NEAREST_MARGIN, sorted(residues[o][0] for _, o in chosen))
    got = families.g03(families.Analysis(atoms)).selectExpr("accepted", "from_json(parameters, 'target string, candidates array<string>') AS p").collect()
    assert {r.p.target: (r.accepted, r.p.candidates) for r in got} == want and len(want) > 10
