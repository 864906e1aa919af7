"""Contact, bond and graph queries over the derived structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..operators import contacts as c
from ..operators import covalent, network
from ..operators.spatial import radius_pairs
from .data import atoms
from .oracle_atoms import ATOMS, RADII
from .registry import query

W = f"WITH {ATOMS}"

#: The covalent relation again, from explicit bond pairs.
_BOND_ROWS = ", ".join(
    f"('{r}', '{a}', '{b}')" for r in chem.AMINO_ACIDS for a, b in chem.residue_bonds(r))
BONDS = f"""
dict(name, a, b) AS (VALUES {_BOND_ROWS}),
bond0 AS (
  SELECT x.structure_id, x.atom_idx AS p, y.atom_idx AS q FROM dict JOIN atoms x ON x.name = dict.name AND x.atom_name = dict.a
  JOIN atoms y ON y.structure_id = x.structure_id AND y.residue_idx = x.residue_idx AND y.atom_name = dict.b
  UNION
  SELECT x.structure_id, x.atom_idx, y.atom_idx FROM atoms x JOIN atoms y ON y.structure_id = x.structure_id
    AND y.chain = x.chain AND y.poly_index = x.poly_index + 1 AND x.atom_name = 'C' AND y.atom_name = 'N'
    AND sqrt((x.x-y.x)*(x.x-y.x) + (x.y-y.y)*(x.y-y.y) + (x.z-y.z)*(x.z-y.z)) <= 2.0),
bond AS (SELECT structure_id, p, q FROM bond0 UNION SELECT structure_id, q, p FROM bond0),
hop2 AS (
  SELECT structure_id, p, q, 1 AS s FROM bond
  UNION ALL SELECT a.structure_id, a.p, b.q, 2 FROM bond a JOIN bond b ON a.structure_id = b.structure_id AND a.q = b.p AND a.p <> b.q),
apart AS (SELECT structure_id, p, q, min(s) AS s FROM hop2 GROUP BY ALL)
"""

CONTACTS = """
pairs0 AS (SELECT structure_id, ri, rj, min(d) AS d FROM near WHERE ri < rj AND d <= 4.0 AND ti = 'protein' AND tj = 'protein'
  AND NOT (ci = cj AND abs(pi - pj) < 3) GROUP BY ALL)
"""


@query("atom_scan", f"""{W} SELECT structure_id, chain, entity, count(*) AS n_atoms, count(DISTINCT residue_idx) AS n_residues,
  min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM atoms GROUP BY ALL""")
def atom_scan(spark, sf_dir):
    return atoms(spark, sf_dir).groupBy("structure_id", "chain", "entity").agg(
        F.count(F.lit(1)).alias("n_atoms"), F.countDistinct("residue_idx").alias("n_residues"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


@query("radius_contacts", f"{W} SELECT structure_id, ai, aj, d AS distance FROM near WHERE ai < aj AND d <= 4.0")
def radius_contacts(spark, sf_dir):
    pairs = radius_pairs(atoms(spark, sf_dir), 4.0, [])
    return pairs.selectExpr("structure_id", "a_atom_idx AS ai", "b_atom_idx AS aj", "distance")


@query("residue_pair_minima", f"""{W} SELECT structure_id, ri, rj, min(d) AS distance,
  arg_min(ni, [d, ai, aj]) AS atom_i, arg_min(nj, [d, ai, aj]) AS atom_j
  FROM near WHERE ri < rj AND d <= 4.0 GROUP BY ALL""")
def residue_pair_minima(spark, sf_dir):
    from ..operators.spatial import residue_pair_minima as minima
    return minima(atoms(spark, sf_dir), 4.0).selectExpr(
        "structure_id", "residue_idx_i AS ri", "residue_idx_j AS rj", "distance",
        "atom_name_i AS atom_i", "atom_name_j AS atom_j")


@query("residue_contacts", f"{W}, {CONTACTS} SELECT structure_id, ri, rj, d AS distance FROM pairs0")
def residue_contacts(spark, sf_dir):
    return c.residue_contacts(atoms(spark, sf_dir)).selectExpr(
        "structure_id", "residue_idx_i AS ri", "residue_idx_j AS rj", "distance")


@query("interface_contacts", f"""{W} SELECT structure_id, ci AS chain_a, cj AS chain_b, li AS label_a, lj AS label_b, min(d) AS distance
  FROM near WHERE d <= 4.0 AND ci <> cj AND ti = 'protein' AND tj = 'protein' GROUP BY ALL""")
def interface_contacts(spark, sf_dir):
    return c.interface_contacts(atoms(spark, sf_dir)).selectExpr(
        "structure_id", "chain_i AS chain_a", "chain_j AS chain_b",
        "label_i AS label_a", "label_j AS label_b", "distance")


LIGAND = """lig AS (SELECT structure_id, lj AS ligand, li AS label, min(d) AS d FROM near
  WHERE ti = 'protein' AND tj = 'ligand' AND d <= 6.0 GROUP BY ALL)"""


@query("ligand_contacts", f"{W}, {LIGAND} SELECT structure_id, ligand, label, d AS distance FROM lig WHERE d <= 4.0")
def ligand_contacts(spark, sf_dir):
    return c.ligand_contacts(atoms(spark, sf_dir)).selectExpr("structure_id", "ligand", "label", "distance")


@query("nearest_excluded", f"{W}, {LIGAND} SELECT structure_id, ligand, min(d) AS nearest_excluded FROM lig WHERE d > 4.0 GROUP BY ALL")
def nearest_excluded(spark, sf_dir):
    return c.nearest_excluded(c.ligand_contacts(atoms(spark, sf_dir), 6.0), ["structure_id", "ligand"], 4.0)


@query("salt_bridges", f"""{W} SELECT structure_id, li AS positive, lj AS negative, min(d) AS distance FROM near
  WHERE d <= 4.0 AND ri <> rj AND ti = 'protein' AND tj = 'protein'
  AND ((qi = 'LYS' AND ni = 'NZ') OR (qi = 'ARG' AND ni IN ('NE', 'NH1', 'NH2')))
  AND ((qj = 'ASP' AND nj IN ('OD1', 'OD2')) OR (qj = 'GLU' AND nj IN ('OE1', 'OE2'))) GROUP BY ALL""")
def salt_bridges(spark, sf_dir):
    return c.salt_bridges(atoms(spark, sf_dir)).selectExpr(
        "structure_id", "label_i AS positive", "label_j AS negative", "distance")


@query("metal_donors", f"""{W}, cut(element, cutoff) AS (VALUES ('ZN', 2.6::double), ('MG', 2.5::double), ('CA', 3.1::double))
  SELECT structure_id, lj AS metal, li AS label, ni AS atom_name, d AS distance, d <= cutoff AS is_donor
  FROM near JOIN cut ON cut.element = near.mj WHERE tj = 'metal' AND ti = 'protein' AND ei IN ('N', 'O', 'S') AND d <= cutoff + 1.5""")
def metal_donors(spark, sf_dir):
    return c.metal_coordination(atoms(spark, sf_dir)).selectExpr(
        "structure_id", "metal", "label", "atom_name", "distance", "is_donor")


@query("disulfide_matching", W + """,
  ss AS (SELECT structure_id, ri, rj, d FROM near WHERE ri < rj AND d <= 9.0 AND qi = 'CYS' AND qj = 'CYS' AND ni = 'SG' AND nj = 'SG'),
  o AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY d, ri, rj) AS k FROM ss),
  n AS (SELECT structure_id, max(k) AS n FROM o GROUP BY ALL),
  fold AS (SELECT structure_id, list_reduce(list_prepend({'i': -1::BIGINT, 'j': -1::BIGINT, 'd': 0.0::DOUBLE, 'used': []::BIGINT[], 'taken': []::STRUCT(i BIGINT, j BIGINT, d DOUBLE)[]},
      list({'i': ri, 'j': rj, 'd': d, 'used': []::BIGINT[], 'taken': []::STRUCT(i BIGINT, j BIGINT, d DOUBLE)[]} ORDER BY k)),
      lambda acc, e: CASE WHEN list_contains(acc.used, e.i) OR list_contains(acc.used, e.j) THEN acc
        ELSE {'i': e.i, 'j': e.j, 'd': e.d, 'used': list_concat(acc.used, [e.i, e.j]), 'taken': list_append(acc.taken, {'i': e.i, 'j': e.j, 'd': e.d})} END) AS f
    FROM o GROUP BY structure_id),
  u AS (SELECT structure_id, unnest(f.taken) AS e FROM fold)
  SELECT structure_id, e.i AS ri, e.j AS rj, e.d AS distance FROM u""")
def disulfide_matching(spark, sf_dir):
    """Greedy SG-SG matching; the wide cutoff gives chains of competing pairs."""
    return c.disulfides(atoms(spark, sf_dir), 9.0).selectExpr(
        "structure_id", "residue_idx_i AS ri", "residue_idx_j AS rj", "distance")


@query("covalent_bonds", f"{W}, {BONDS} SELECT structure_id, p AS atom_a, q AS atom_b FROM bond")
def covalent_bonds(spark, sf_dir):
    return covalent.bonds(atoms(spark, sf_dir))


@query("bond_separations", f"{W}, {BONDS} SELECT structure_id, p AS atom_a, q AS atom_b, s AS separation FROM apart")
def bond_separations(spark, sf_dir):
    return covalent.separations(covalent.bonds(atoms(spark, sf_dir)), 2)


CLASH = f"""radii(element, r) AS (VALUES {RADII}),
clash0 AS (SELECT n.*, x.r + y.r - 0.4 - n.d AS overlap FROM near n JOIN radii x ON x.element = n.ei JOIN radii y ON y.element = n.ej
  WHERE n.ri < n.rj AND n.d < 4 AND n.ti <> 'metal' AND n.tj <> 'metal' AND NOT (ni = 'SG' AND nj = 'SG') AND x.r + y.r - 0.4 - n.d > 0),
clash AS (SELECT c.structure_id, ri, rj, li, lj, max(overlap) AS overlap FROM clash0 c LEFT JOIN apart s
  ON s.structure_id = c.structure_id AND s.p = c.ai AND s.q = c.aj WHERE s.p IS NULL GROUP BY ALL)"""


@query("clash_pairs", f"{W}, {BONDS}, {CLASH} SELECT structure_id, ri, rj, overlap FROM clash")
def clash_pairs(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return c.clashes(a, covalent.separations(covalent.bonds(a), 2)).selectExpr(
        "structure_id", "residue_idx_i AS ri", "residue_idx_j AS rj", "overlap")


@query("nearest_nonbonded", f"""{W}, {BONDS}, nb AS (
  SELECT n.structure_id, ai, lj, nj, d, row_number() OVER (PARTITION BY n.structure_id, ai ORDER BY d, rj, nj) AS k
  FROM near n LEFT JOIN apart s ON s.structure_id = n.structure_id AND s.p = n.ai AND s.q = n.aj
  WHERE s.p IS NULL AND ti = 'protein' AND tj = 'protein' AND d <= 8.0)
  SELECT structure_id, ai AS atom_idx, max(CASE WHEN k = 1 THEN lj || ':' || nj END) AS nearest, max(CASE WHEN k = 1 THEN d END) AS nearest_distance,
    max(CASE WHEN k = 2 THEN d END) AS runner_up_distance FROM nb WHERE k <= 2 GROUP BY ALL""")
def nearest_nonbonded(spark, sf_dir):
    a = atoms(spark, sf_dir)
    found = c.nearest_nonbonded(a, covalent.separations(covalent.bonds(a), 2))
    return found.selectExpr("structure_id", "atom_idx",
                        "concat_ws(':', best.near_label, best.near_atom) AS nearest",
                        "best.distance AS nearest_distance",
                        "second.distance AS runner_up_distance")


@query("min_dist_sources_targets", f"""{W} SELECT structure_id, ri AS residue_idx, min(d) AS distance FROM near
  WHERE tj = 'metal' AND ti <> 'metal' GROUP BY ALL""")
def min_dist_sources_targets(spark, sf_dir):
    """Distance of every residue to the nearest metal of its structure, at any range."""
    a = atoms(spark, sf_dir)
    return c.min_distance_to(a.filter("entity <> 'metal'"), a.filter("entity = 'metal'"))


@query("charged_min_distance", f"""{W} SELECT structure_id, li AS positive, lj AS negative, min(d) AS distance FROM near
  WHERE d <= 7.5 AND ri <> rj AND ti = 'protein' AND tj = 'protein'
  AND ((qi = 'LYS' AND ni = 'NZ') OR (qi = 'ARG' AND ni IN ('NE', 'NH1', 'NH2')))
  AND ((qj = 'ASP' AND nj IN ('OD1', 'OD2')) OR (qj = 'GLU' AND nj IN ('OE1', 'OE2'))) GROUP BY ALL""")
def charged_min_distance(spark, sf_dir):
    return c.charged_pairs(atoms(spark, sf_dir), 7.5).selectExpr(
        "structure_id", "label_i AS positive", "label_j AS negative", "distance")


GRAPH = f"""{CONTACTS}, {LIGAND}, graph0 AS (
  SELECT structure_id, ri AS i, rj AS j, d FROM pairs0
  UNION ALL SELECT structure_id, least(ri, rj), greatest(ri, rj), d FROM near WHERE ti = 'protein' AND tj = 'ligand' AND d <= 4.0
  UNION ALL SELECT structure_id, least(ri, rj), greatest(ri, rj), d FROM near WHERE ti = 'protein' AND tj = 'metal' AND ei IN ('N', 'O', 'S')
    AND d <= CASE mj WHEN 'ZN' THEN 2.6::double WHEN 'MG' THEN 2.5::double WHEN 'CA' THEN 3.1::double END),
graph AS (SELECT structure_id, i, j, min(d) AS d FROM graph0 GROUP BY ALL),
arms AS (SELECT structure_id, i AS node, j AS neighbour, d FROM graph UNION ALL SELECT structure_id, j, i, d FROM graph)"""


@query("contact_graph", f"{W}, {GRAPH} SELECT structure_id, i, j, d AS distance FROM graph")
def contact_graph(spark, sf_dir):
    return network.contact_graph(atoms(spark, sf_dir)).selectExpr("structure_id", "i", "j", "distance")


@query("contact_graph_degree", f"{W}, {GRAPH} SELECT structure_id, node, count(*) AS degree, min(d) AS closest FROM arms GROUP BY ALL")
def contact_graph_degree(spark, sf_dir):
    return network.degrees(network.contact_graph(atoms(spark, sf_dir)))


WEDGES = f"""{GRAPH}, wedge AS (SELECT l.structure_id, l.neighbour AS a, r.neighbour AS b, count(*) AS n_bridges, min(l.node) AS bridge
  FROM arms l JOIN arms r ON l.structure_id = r.structure_id AND l.node = r.node AND l.neighbour < r.neighbour
  WHERE NOT EXISTS (SELECT 1 FROM graph g WHERE g.structure_id = l.structure_id AND g.i = l.neighbour AND g.j = r.neighbour) GROUP BY ALL)"""


@query("wedge_bridges", f"{W}, {WEDGES} SELECT structure_id, a, b, n_bridges, bridge FROM wedge")
def wedge_bridges(spark, sf_dir):
    return network.common_neighbours(network.contact_graph(atoms(spark, sf_dir))).selectExpr(
        "structure_id", "a", "b", "n_bridges", "bridge")


@query("unique_bridge_near_miss", f"""{W}, {WEDGES}, mins AS (SELECT structure_id, ri, rj, min(d) AS d FROM near
    WHERE ri <> rj AND ti = 'protein' AND tj = 'protein' AND d <= 4.2 GROUP BY ALL)
  SELECT w.structure_id, w.a, w.b, w.bridge, min(greatest(x.d, y.d)) AS near_miss FROM wedge w
  JOIN mins x ON x.structure_id = w.structure_id AND x.rj = w.a JOIN mins y ON y.structure_id = w.structure_id AND y.rj = w.b AND y.ri = x.ri
  WHERE w.n_bridges = 1 AND x.ri NOT IN (w.a, w.b, w.bridge) GROUP BY ALL""")
def unique_bridge_near_miss(spark, sf_dir):
    a = atoms(spark, sf_dir)
    pairs = network.common_neighbours(network.contact_graph(a)).filter("n_bridges = 1")
    return pairs.selectExpr("structure_id", "a", "b", "bridge").join(
        network.near_miss(a, pairs, 4.2), ["structure_id", "a", "b"])


_NEXT = """next AS (SELECT structure_id, residue_idx AS source, residue_idx + 32 AS target FROM residues WHERE entity = 'protein')"""


@query("shortest_paths", f"""{W}, {GRAPH}, {_NEXT},
  p1 AS (SELECT n.structure_id, source, target, 1 AS len, source || '>' || target AS path FROM next n
    JOIN arms a ON a.structure_id = n.structure_id AND a.node = source AND a.neighbour = target),
  p2 AS (SELECT n.structure_id, source, target, 2 AS len, source || '>' || a.neighbour || '>' || target AS path FROM next n
    JOIN arms a ON a.structure_id = n.structure_id AND a.node = source
    JOIN arms b ON b.structure_id = n.structure_id AND b.node = a.neighbour AND b.neighbour = target),
  p3 AS (SELECT n.structure_id, source, target, 3 AS len, source || '>' || a.neighbour || '>' || b.neighbour || '>' || target AS path FROM next n
    JOIN arms a ON a.structure_id = n.structure_id AND a.node = source
    JOIN arms b ON b.structure_id = n.structure_id AND b.node = a.neighbour AND b.neighbour <> source
    JOIN arms c ON c.structure_id = n.structure_id AND c.node = b.neighbour AND c.neighbour = target WHERE a.neighbour <> target),
  allp AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
  SELECT structure_id, source, target, path FROM allp QUALIFY len = min(len) OVER (PARTITION BY structure_id, source, target)""")
def shortest_paths(spark, sf_dir):
    """All shortest contact paths of at most three edges between residues 32 apart in file order."""
    a = atoms(spark, sf_dir)
    ends = a.filter("entity = 'protein'").selectExpr(
        "structure_id", "residue_idx AS source", "residue_idx + 32 AS target").distinct()
    return network.shortest_paths(network.contact_graph(a), ends).selectExpr(
        "structure_id", "source", "target",
        "array_join(transform(path, n -> CAST(n AS STRING)), '>') AS path")


@query("ring_centroid_distances", f"""{W}, ring AS (SELECT structure_id, residue_idx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atoms
    WHERE (parent = 'HIS' AND atom_name IN ('CG','ND1','CE1','NE2','CD2')) OR (parent IN ('PHE','TYR') AND atom_name IN ('CG','CD1','CD2','CE1','CE2','CZ'))
      OR (parent = 'TRP' AND atom_name IN ('CG','CD1','NE1','CE2','CD2')) GROUP BY ALL HAVING count(*) >= 4)
  SELECT a.structure_id, a.residue_idx AS ri, b.residue_idx AS rj,
    CAST(floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) * 1000) AS BIGINT) AS milli_angstrom
  FROM ring a JOIN ring b ON a.structure_id = b.structure_id AND a.residue_idx < b.residue_idx
  WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 8.0""")
def ring_centroid_distances(spark, sf_dir):
    rings = c.ring_centroids(atoms(spark, sf_dir)).drop("label")
    pairs = radius_pairs(rings, 8.0, [], ident="residue_idx")
    return pairs.selectExpr("structure_id", "a_residue_idx AS ri", "b_residue_idx AS rj",
                        "floor(distance * 1000) AS milli_angstrom")
