"""Two-state queries: every derived structure against a copy of itself with displaced residues."""

from __future__ import annotations

from ..plans import mechanistic
from .contact_queries import W
from .data import atoms
from .registry import query
from .structure_queries import _d

#: Residues move along x by a fixed pattern, so the second state needs no data of its own.
STATES = """two AS (SELECT structure_id, residue_idx, label, entity, atom_name, chain, parent, x + (residue_idx % 5) * 0.4::double AS x, y, z FROM atoms)"""


def states(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return a, a.selectExpr(*["x + (residue_idx % 5) * 0.4D AS x" if c == "x" else c for c in a.columns])


@query("state_gained_interactions", f"""{W}, {STATES},
  n2 AS (SELECT a.structure_id, a.label AS l1, b.label AS l2, min({_d("a.", "b.")}) AS d2 FROM two a JOIN two b ON a.structure_id = b.structure_id AND a.residue_idx <> b.residue_idx WHERE a.entity = 'ligand' GROUP BY ALL HAVING d2 <= 4.0),
  n1 AS (SELECT structure_id, li AS l1, lj AS l2, min(d) AS d1 FROM near WHERE ti = 'ligand' AND ri <> rj GROUP BY ALL)
  SELECT structure_id, l1 AS label, string_agg(least(l1, l2) || '--' || greatest(l1, l2), ',' ORDER BY least(l1, l2) || '--' || greatest(l1, l2)) AS value
  FROM n2 JOIN n1 USING (structure_id, l1, l2) WHERE d1 >= 4.5 GROUP BY structure_id, l1""")
def state_gained_interactions(spark, sf_dir):
    first, second = states(spark, sf_dir)
    anchors = first.filter("entity = 'ligand'").select("structure_id", "label").distinct()
    return mechanistic.gained_interactions(anchors, first, second).selectExpr("structure_id", "label", "array_join(value, ',') AS value")


@query("state_region_displacement", f"""{W}, s AS (SELECT structure_id, label, seq_id, chain, sqrt((x - (x + (residue_idx % 5) * 0.4::double)) * (x - (x + (residue_idx % 5) * 0.4::double))) AS shift FROM atoms WHERE atom_name = 'CA' AND entity = 'protein')
  SELECT structure_id, CAST(floor(max(shift) * 1000 + 0.5) AS BIGINT) AS milli FROM s WHERE chain = 'A' AND seq_id BETWEEN 10 AND 40 GROUP BY ALL""")
def state_region_displacement(spark, sf_dir):
    first, second = states(spark, sf_dir)
    regions = first.select("structure_id").distinct().selectExpr("structure_id", "'A' AS chain", "10 AS first", "40 AS last")
    protein = first.filter("entity = 'protein'")
    return mechanistic.region_displacement(regions, protein, second.filter("entity = 'protein'")).selectExpr(
        "structure_id", "CAST(floor(shift * 1000 + 0.5) AS BIGINT) AS milli")


@query("state_interface_claims")
def state_interface_claims(spark, sf_dir):
    """Which residues of chain A keep an interface contact in the second state."""
    _, second = states(spark, sf_dir)
    claims = second.filter("entity = 'protein' AND chain = 'A'").select("structure_id", "label").distinct()
    return mechanistic.interface_claim(claims, second).select("structure_id", "label", "partner", "reason")
