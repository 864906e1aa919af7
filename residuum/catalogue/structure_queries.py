"""Secondary structure, surface, torsion, superposition and excerpt queries over the derived structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..functions.geometry import angle, chi1_bin, dihedral, vec
from ..operators import backbone, display, superpose, surface, torsions
from ..operators.sequence import with_neighbour
from ..session import merged
from .data import atoms
from .oracle_atoms import ATOMS, RADII
from .registry import query

W = f"WITH {ATOMS}"

_DIST = "sqrt(({a}x-{b}x)*({a}x-{b}x)+({a}y-{b}y)*({a}y-{b}y)+({a}z-{b}z)*({a}z-{b}z))"


def _d(a: str, b: str) -> str:
    return _DIST.format(a=a, b=b)


_ENERGY = "(0.084*332.0)::double*(1/{on}+1/{ch}-1/{oh}-1/{cn})".format(
    on=_d("a.o_", "d.n_"), ch=_d("a.c_", "d.h_"), oh=_d("a.o_", "d.h_"), cn=_d("a.c_", "d.n_"))
_CLOSEST = "least({}, {}, {}, {})".format(_d("a.o_", "d.n_"), _d("a.c_", "d.h_"), _d("a.o_", "d.h_"), _d("a.c_", "d.n_"))


def _bond(dk: str, dc: str, ak: str, ac: str) -> str:
    return (f"EXISTS (SELECT 1 FROM hb WHERE hb.structure_id = p.structure_id AND hb.dc = {dc} AND hb.dk = {dk} "
            f"AND hb.ac = {ac} AND hb.ak = {ak})")


_J, _I = "p.cj", "p.ci"
DSSP = f"""
bb0 AS (SELECT structure_id, chain, residue_idx, poly_index, parent, label,
  {", ".join(f"max({c}) FILTER (atom_name = '{a}') AS {a.lower()}_{c}" for a in chem.BACKBONE for c in "xyz")}
  FROM atoms WHERE entity = 'protein' GROUP BY ALL),
bb1 AS (SELECT *, row_number() OVER (PARTITION BY structure_id, chain ORDER BY poly_index) - 1 AS k FROM bb0
  WHERE n_x IS NOT NULL AND ca_x IS NOT NULL AND c_x IS NOT NULL AND o_x IS NOT NULL),
bb2 AS (SELECT *, {", ".join(f"lag({a}_{c}) OVER w AS p{a}_{c}" for a in "co" for c in "xyz")} FROM bb1
  WINDOW w AS (PARTITION BY structure_id, chain ORDER BY k)),
bb3 AS (SELECT *, coalesce({_d("pc_", "n_")} <= 2.0, false) AS bonded, {_d("pc_", "po_")} AS co FROM bb2),
bb AS MATERIALIZED (SELECT *, max(CASE WHEN NOT bonded THEN k END) OVER w AS stretch, coalesce(lead(bonded) OVER w, false) AS nextb,
  {", ".join(f"CASE WHEN bonded AND parent <> 'PRO' THEN n_{c} + (pc_{c} - po_{c}) / co END AS h_{c}" for c in "xyz")},
  {", ".join(f"lag(ca_{c}, 2) OVER w AS q_{c}, lead(ca_{c}, 2) OVER w AS r_{c}" for c in "xyz")}
  FROM bb3 WINDOW w AS (PARTITION BY structure_id, chain ORDER BY k)),
hb AS MATERIALIZED (SELECT d.structure_id, d.residue_idx AS donor, a.residue_idx AS acceptor, d.chain AS dc, d.k AS dk, d.stretch AS ds, a.chain AS ac, a.k AS ak, a.stretch AS ast
  FROM bb d JOIN bb a ON d.structure_id = a.structure_id AND d.residue_idx <> a.residue_idx
  WHERE d.h_x IS NOT NULL AND {_d("d.ca_", "a.ca_")} <= 9.0 AND NOT (d.chain = a.chain AND abs(d.k - a.k) < 2)
    AND {_CLOSEST} >= 0.5 AND {_ENERGY} < -0.5),
turn AS (SELECT DISTINCT structure_id, dc AS chain, ak AS k, dk - ak AS step FROM hb WHERE dc = ac AND ds = ast AND dk - ak IN (3, 4, 5)),
pr AS (SELECT i.structure_id, i.chain AS ci, i.k AS ki, j.chain AS cj, j.k AS kj FROM bb i JOIN bb j ON i.structure_id = j.structure_id
  AND i.residue_idx < j.residue_idx WHERE i.bonded AND i.nextb AND j.bonded AND j.nextb AND {_d("i.ca_", "j.ca_")} <= 9.0
  AND NOT (i.chain = j.chain AND abs(i.k - j.k) <= 2)),
bridge0 AS (SELECT *, CASE
  WHEN ({_bond("p.kj", _J, "p.ki - 1", _I)} AND {_bond("p.ki + 1", _I, "p.kj", _J)}) OR ({_bond("p.ki", _I, "p.kj - 1", _J)} AND {_bond("p.kj + 1", _J, "p.ki", _I)}) THEN 'P'
  WHEN ({_bond("p.kj", _J, "p.ki", _I)} AND {_bond("p.ki", _I, "p.kj", _J)}) OR ({_bond("p.kj + 1", _J, "p.ki - 1", _I)} AND {_bond("p.ki + 1", _I, "p.kj - 1", _J)}) THEN 'A' END AS kind FROM pr p),
bridge AS (SELECT * FROM bridge0 WHERE kind IS NOT NULL),
sheet AS (SELECT b.structure_id, ci, ki, cj, kj, EXISTS (SELECT 1 FROM bridge x WHERE x.structure_id = b.structure_id AND x.kind = b.kind AND x.ci = b.ci AND x.cj = b.cj
    AND ((b.kind = 'P' AND x.ki - b.ki = x.kj - b.kj) OR (b.kind = 'A' AND x.ki - b.ki = b.kj - x.kj)) AND abs(x.ki - b.ki) = 1) AS ladder FROM bridge b),
marks AS (
  SELECT a.structure_id, a.chain, unnest([a.k, a.k + 1, a.k + 2, a.k + 3]) AS k, 0 AS r FROM turn a JOIN turn b ON a.structure_id = b.structure_id AND a.chain = b.chain AND a.step = 4 AND b.step = 4 AND b.k = a.k - 1
  UNION ALL SELECT structure_id, ci, ki, CASE WHEN ladder THEN 1 ELSE 2 END FROM sheet
  UNION ALL SELECT structure_id, cj, kj, CASE WHEN ladder THEN 1 ELSE 2 END FROM sheet
  UNION ALL SELECT a.structure_id, a.chain, unnest([a.k, a.k + 1, a.k + 2]), 3 FROM turn a JOIN turn b ON a.structure_id = b.structure_id AND a.chain = b.chain AND a.step = 3 AND b.step = 3 AND b.k = a.k - 1
  UNION ALL SELECT a.structure_id, a.chain, unnest([a.k, a.k + 1, a.k + 2, a.k + 3, a.k + 4]), 4 FROM turn a JOIN turn b ON a.structure_id = b.structure_id AND a.chain = b.chain AND a.step = 5 AND b.step = 5 AND b.k = a.k - 1
  UNION ALL SELECT structure_id, chain, unnest(range(k + 1, k + step)), 5 FROM turn
  UNION ALL SELECT b.structure_id, b.chain, b.k, 6 FROM bb b JOIN bb e ON e.structure_id = b.structure_id AND e.chain = b.chain AND e.k = b.k + 2
    WHERE e.stretch = b.stretch AND b.k - 2 >= b.stretch
      AND 180 - degrees(acos(greatest(-1, least(1, ((b.q_x-b.ca_x)*(b.r_x-b.ca_x)+(b.q_y-b.ca_y)*(b.r_y-b.ca_y)+(b.q_z-b.ca_z)*(b.r_z-b.ca_z)) / ({_d("b.q_", "b.ca_")} * {_d("b.r_", "b.ca_")}))))) > 70),
codes AS (SELECT b.structure_id, b.chain, b.residue_idx, b.label, b.poly_index, b.k, coalesce(['H','E','B','G','I','T','S'][min(m.r) + 1], ' ') AS code
  FROM bb b LEFT JOIN marks m ON m.structure_id = b.structure_id AND m.chain = b.chain AND m.k = b.k GROUP BY ALL),
classes AS (SELECT *, CASE WHEN code IN ('H','G','I') THEN 'helix' WHEN code IN ('E','B') THEN 'strand' ELSE 'coil' END AS class FROM codes)
"""


@query("hydrogen_bonds", f"{W}, {DSSP} SELECT structure_id, donor, acceptor FROM hb")
def hydrogen_bonds(spark, sf_dir):
    return backbone.hydrogen_bonds(backbone.chain_backbone(atoms(spark, sf_dir))).select("structure_id", "donor", "acceptor")


@query("secondary_structure", f"{W}, {DSSP} SELECT structure_id, chain, residue_idx, label, code, class FROM classes")
def secondary_structure(spark, sf_dir):
    return backbone.secondary_structure(atoms(spark, sf_dir)).select(
        "structure_id", "chain", "residue_idx", "label", "code", "class")


@query("secondary_runs", f"""{W}, {DSSP}, g AS (SELECT *, row_number() OVER (PARTITION BY structure_id, chain ORDER BY poly_index)
    - row_number() OVER (PARTITION BY structure_id, chain, class ORDER BY poly_index) AS grp FROM classes)
  SELECT structure_id, label, class, count(*) OVER r AS run_length,
    least(row_number() OVER (PARTITION BY structure_id, chain, class, grp ORDER BY poly_index) - 1,
      count(*) OVER r - row_number() OVER (PARTITION BY structure_id, chain, class, grp ORDER BY poly_index)) AS edge_distance
  FROM g WINDOW r AS (PARTITION BY structure_id, chain, class, grp)""")
def secondary_runs(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return backbone.class_runs(a, backbone.secondary_structure(a)).select(
        "structure_id", "label", "class", "run_length", "edge_distance")


@query("chain_fractions", f"""{W}, {DSSP} SELECT structure_id, chain, count(*) AS n_assigned, count(*) FILTER (class = 'helix') AS n_helix,
  count(*) FILTER (class = 'strand') AS n_strand,
  CASE WHEN avg((class = 'helix')::int) >= 0.35 AND avg((class = 'helix')::int) > 2 * avg((class = 'strand')::int) THEN 'predominantly alpha helical'
       WHEN avg((class = 'strand')::int) >= 0.25 AND avg((class = 'strand')::int) > 2 * avg((class = 'helix')::int) THEN 'predominantly beta sheet'
       WHEN avg((class = 'helix')::int) >= 0.15 AND avg((class = 'strand')::int) >= 0.15
        AND avg((class = 'helix')::int) / avg((class = 'strand')::int) BETWEEN 0.5 AND 2 THEN 'mixed alpha/beta' END AS fold
  FROM classes GROUP BY structure_id, chain""")
def chain_fractions(spark, sf_dir):
    return backbone.chain_fractions(backbone.secondary_structure(atoms(spark, sf_dir))).selectExpr(
        "structure_id", "chain", "n_assigned", "CAST(rint(helix_fraction * n_assigned) AS BIGINT) AS n_helix",
        "CAST(rint(beta_fraction * n_assigned) AS BIGINT) AS n_strand", "fold")


_POINTS = 960
SASA = f"""radii(element, r) AS (VALUES {RADII}),
ball AS MATERIALIZED (SELECT CAST(k AS INT) AS k, cos(k * pi() * (3 - sqrt(5::double))) * sqrt(greatest(0, 1 - z * z)) AS ux, sin(k * pi() * (3 - sqrt(5::double))) * sqrt(greatest(0, 1 - z * z)) AS uy, z AS uz
  FROM (SELECT k::double AS k, k * (2.0::double / {_POINTS}) - 1 + (2.0::double / {_POINTS}) / 2 AS z FROM range({_POINTS}) t(k))),
wide AS MATERIALIZED (SELECT structure_id, atom_idx, x, y, z, r + 1.4 AS r FROM atoms JOIN radii USING (element)),
touch AS MATERIALIZED (SELECT a.structure_id, a.atom_idx AS ai, a.r AS ra, b.r * b.r AS rb2, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz
  FROM wide a JOIN wide b ON a.structure_id = b.structure_id AND a.atom_idx <> b.atom_idx
  WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) < a.r + b.r),
hid AS (SELECT structure_id, ai, k // 60 AS w, bit_count(bit_or(1::BIGINT << CAST(k % 60 AS INT))) AS n FROM touch CROSS JOIN ball
  WHERE (ux * ra - dx) * (ux * ra - dx) + (uy * ra - dy) * (uy * ra - dy) + (uz * ra - dz) * (uz * ra - dz) < rb2 GROUP BY ALL),
hidn AS (SELECT structure_id, ai, CAST(sum(n) AS BIGINT) AS hidden FROM hid GROUP BY ALL),
area AS (SELECT a.*, {_POINTS} - coalesce(hidden, 0) AS open_points FROM atoms a LEFT JOIN hidn h ON h.structure_id = a.structure_id AND h.ai = a.atom_idx)"""


@query("atom_surface", f"{W}, {SASA} SELECT structure_id, atom_idx, open_points FROM area")
def atom_surface(spark, sf_dir):
    return surface.atom_areas(atoms(spark, sf_dir)).select("structure_id", "atom_idx", "open_points")


_ASA = ", ".join(f"('{k}', {v!r}::double)" for k, v in chem.MAX_ASA.items())


@query("residue_burial", f"""{W}, {SASA}, ref(parent, m) AS (VALUES {_ASA}),
  s AS (SELECT a.structure_id, a.label, a.parent, a.entity, sum(4 * pi() * (r + 1.4) * (r + 1.4) * open_points / {_POINTS}) AS area, CAST(sum(open_points) AS BIGINT) AS open_points
    FROM area a JOIN radii USING (element) GROUP BY ALL)
  SELECT structure_id, label, open_points, CASE WHEN entity = 'protein' AND area / m <= 0.2 THEN 'buried'
    WHEN entity = 'protein' AND area / m >= 0.4 THEN 'solvent-exposed' ELSE 'intermediate' END AS burial FROM s LEFT JOIN ref USING (parent)""")
def residue_burial(spark, sf_dir):
    return surface.residue_areas(surface.atom_areas(atoms(spark, sf_dir))).select(
        "structure_id", "label", "open_points", "burial")


_ALONE = SASA.replace("a.structure_id = b.structure_id AND a.atom_idx", "a.structure_id = b.structure_id AND a.chain = b.chain AND a.atom_idx").replace(
    "SELECT structure_id, atom_idx, x, y, z, r", "SELECT structure_id, chain, atom_idx, x, y, z, r")


@query("isolated_chain_surface", f"""{W}, {_ALONE}, ref(parent, m) AS (VALUES {_ASA}),
  s AS (SELECT a.structure_id, a.chain, a.label, a.parent, a.entity, sum(4 * pi() * (r + 1.4) * (r + 1.4) * open_points / {_POINTS}) AS area, CAST(sum(open_points) AS BIGINT) AS open_points
    FROM area a JOIN radii USING (element) GROUP BY ALL)
  SELECT structure_id, chain, label, open_points, CASE WHEN entity = 'protein' AND area / m <= 0.2 THEN 'buried'
    WHEN entity = 'protein' AND area / m >= 0.4 THEN 'solvent-exposed' ELSE 'intermediate' END AS burial FROM s LEFT JOIN ref USING (parent)""")
def isolated_chain_surface(spark, sf_dir):
    return surface.isolated_chain_areas(atoms(spark, sf_dir)).select("structure_id", "chain", "label", "open_points", "burial")


def _sql_dihedral(p: list[str]) -> str:
    def minus(a, b):
        return [f"({a}{c}-{b}{c})" for c in "xyz"]
    b0, b1, b2 = minus(p[1], p[0]), minus(p[2], p[1]), minus(p[3], p[2])

    def crs(a, b):
        return [f"({a[i]}*{b[j]}-{a[j]}*{b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]

    def dt(a, b):
        return "(" + "+".join(f"{x}*{y}" for x, y in zip(a, b)) + ")"
    n1, n2 = crs(b0, b1), crs(b1, b2)
    return f"degrees(atan2(sqrt({dt(b1, b1)})*{dt(b0, n2)}, {dt(n1, n2)}))"


_CHI = f"""chi0 AS (SELECT structure_id, residue_idx, label, parent,
  CASE parent WHEN 'SER' THEN 'OG' WHEN 'THR' THEN 'OG1' WHEN 'CYS' THEN 'SG' WHEN 'VAL' THEN 'CG1' WHEN 'ILE' THEN 'CG1' ELSE 'CG' END AS atom4,
  {", ".join(f"max({c}) FILTER (atom_name = '{a}') AS {p}_{c}" for p, a in (("p1", "N"), ("p2", "CA"), ("p3", "CB")) for c in "xyz")},
  {", ".join(f"max({c}) FILTER (atom_name = CASE parent WHEN 'SER' THEN 'OG' WHEN 'THR' THEN 'OG1' WHEN 'CYS' THEN 'SG' WHEN 'VAL' THEN 'CG1' WHEN 'ILE' THEN 'CG1' ELSE 'CG' END) AS p4_{c}" for c in "xyz")}
  FROM atoms WHERE entity = 'protein' AND parent NOT IN ('GLY', 'ALA', 'PRO') GROUP BY ALL),
chi AS (SELECT structure_id, residue_idx, label, atom4, {_sql_dihedral(["p1_", "p2_", "p3_", "p4_"])} AS chi1 FROM chi0
  WHERE p1_x IS NOT NULL AND p2_x IS NOT NULL AND p3_x IS NOT NULL AND p4_x IS NOT NULL)"""


@query("rotamer_bins", f"""{W}, {_CHI} SELECT structure_id, label, atom4, CAST(floor(chi1) AS BIGINT) AS chi1_degrees,
  CASE WHEN least(abs(chi1), abs(abs(chi1) - 120)) < 15 THEN '' WHEN chi1 >= 0 AND chi1 < 120 THEN 'g+' WHEN abs(chi1) >= 120 THEN 't' ELSE 'g-' END AS rotamer FROM chi""")
def rotamer_bins(spark, sf_dir):
    return torsions.chi1(atoms(spark, sf_dir)).selectExpr(
        "structure_id", "label", "atom4", "floor(chi1) AS chi1_degrees", "rotamer")


_CA = """ca AS (SELECT structure_id, chain, poly_index, label, x, y, z FROM atoms WHERE entity = 'protein' AND atom_name = 'CA'),
seq AS (SELECT c1.structure_id, c1.label, c1.x AS a_x, c1.y AS a_y, c1.z AS a_z, c2.x AS b_x, c2.y AS b_y, c2.z AS b_z, c3.x AS c_x, c3.y AS c_y, c3.z AS c_z, c4.x AS d_x, c4.y AS d_y, c4.z AS d_z
  FROM ca c1 JOIN ca c2 ON c2.structure_id = c1.structure_id AND c2.chain = c1.chain AND c2.poly_index = c1.poly_index + 1
  JOIN ca c3 ON c3.structure_id = c1.structure_id AND c3.chain = c1.chain AND c3.poly_index = c1.poly_index + 2
  JOIN ca c4 ON c4.structure_id = c1.structure_id AND c4.chain = c1.chain AND c4.poly_index = c1.poly_index + 3)"""


@query("trace_torsions", f"""{W}, {_CA} SELECT structure_id, label, CAST(floor({_sql_dihedral(["a_", "b_", "c_", "d_"])}) AS BIGINT) AS torsion,
  CAST(floor(degrees(acos(((a_x-b_x)*(c_x-b_x)+(a_y-b_y)*(c_y-b_y)+(a_z-b_z)*(c_z-b_z)) / ({_d("a_", "b_")} * {_d("c_", "b_")})))) AS BIGINT) AS bend FROM seq""")
def trace_torsions(spark, sf_dir):
    """Torsion and angle of four consecutive C-alpha atoms, in whole degrees."""
    ca = atoms(spark, sf_dir).filter("entity = 'protein' AND atom_name = 'CA'").selectExpr(
        "structure_id", "chain", "poly_index", "label", "x AS a_x", "y AS a_y", "z AS a_z")
    rows = ca
    for step, name in ((1, "b_"), (2, "c_"), (3, "d_")):
        later = ca.selectExpr("structure_id", "chain", f"poly_index - {step} AS poly_index",
                              *[f"a_{c} AS {name}{c}" for c in "xyz"])
        rows = rows.join(later, ["structure_id", "chain", "poly_index"])
    torsion = dihedral(vec("a_"), vec("b_"), vec("c_"), vec("d_"))
    return rows.selectExpr("structure_id", "label", f"floor({torsion}) AS torsion",
                           f"floor({angle(vec('a_'), vec('b_'), vec('c_'))}) AS bend")


@query("proline_omega", f"""{W}, pro AS (SELECT a.structure_id, a.label, {", ".join(f"max(b.{c}) FILTER (b.atom_name = '{n}' AND b.poly_index = a.poly_index - 1) AS {p}_{c}, max(b.{c}) FILTER (b.atom_name = '{m}' AND b.poly_index = a.poly_index) AS {q}_{c}" for p, n, q, m in (("a", "CA", "c", "N"), ("b", "C", "d", "CA")) for c in "xyz")}
  FROM residues a JOIN atoms b ON a.structure_id = b.structure_id AND a.chain = b.chain AND b.poly_index BETWEEN a.poly_index - 1 AND a.poly_index AND b.entity = 'protein'
  WHERE a.parent = 'PRO' AND a.entity = 'protein' GROUP BY ALL HAVING a_x IS NOT NULL AND b_x IS NOT NULL AND c_x IS NOT NULL AND d_x IS NOT NULL),
  om AS (SELECT structure_id, label, {_sql_dihedral(["a_", "b_", "c_", "d_"])} AS w FROM pro)
  SELECT structure_id, label, CASE WHEN abs(w) <= 30 THEN 'cis' WHEN abs(abs(w) - 180) <= 30 THEN 'trans' ELSE '' END AS state FROM om""")
def proline_omega(spark, sf_dir):
    return torsions.proline_omega(atoms(spark, sf_dir)).select("structure_id", "label", "state")


@query("centroid_shift", f"""{W}, m AS (SELECT structure_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM atoms GROUP BY ALL)
  SELECT structure_id, atom_idx, CAST(floor((x - mx) * 1000) AS BIGINT) AS sx, CAST(floor((y - my) * 1000) AS BIGINT) AS sy, CAST(floor((z - mz) * 1000) AS BIGINT) AS sz FROM atoms JOIN m USING (structure_id)""")
def centroid_shift(spark, sf_dir):
    a = atoms(spark, sf_dir)
    centre = a.groupBy("structure_id").agg(*[F.expr(f"avg({c}) AS m{c}") for c in "xyz"])
    return a.join(centre, "structure_id").selectExpr(
        "structure_id", "atom_idx", *[f"floor(({c} - m{c}) * 1000) AS s{c}" for c in "xyz"])


@query("rigid_display")
def rigid_display(spark, sf_dir):
    """Every structure turned by its own seeded rotation about its centroid and rounded."""
    a = atoms(spark, sf_dir)
    seeds = a.select("structure_id").distinct().selectExpr(
        "structure_id", "structure_id AS display_id", "pmod(xxhash64(structure_id), 1000000) AS seed")
    moves = display.transforms(a, seeds)
    return display.displayed(a.selectExpr("*", "structure_id AS display_id"), moves).select(
        "display_id", "atom_idx", "x", "y", "z")


_KEEP = """centre AS (SELECT structure_id, min(residue_idx) FILTER (entity = 'ligand') AS residue_idx FROM residues GROUP BY ALL),
keep AS (SELECT DISTINCT n.structure_id, n.ri AS residue_idx FROM near n JOIN centre c ON c.structure_id = n.structure_id AND c.residue_idx = n.rj
    WHERE n.d <= CASE WHEN n.ti IN ('ligand', 'metal') THEN 15.0 ELSE 10.0 END
  UNION SELECT structure_id, residue_idx FROM centre WHERE residue_idx IS NOT NULL)"""


@query("crop_radius", f"{W}, {_KEEP} SELECT structure_id, residue_idx FROM keep")
def crop_radius(spark, sf_dir):
    return display.crop_around(*_centre(atoms(spark, sf_dir)), 10.0)


def _centre(a):
    return a, a.filter("entity = 'ligand'").groupBy("structure_id").agg(F.expr("min(residue_idx) AS residue_idx"))


@query("crop_boundary", f"""{W}, {_KEEP}, pol AS (SELECT r.*, k.residue_idx IS NOT NULL AS kept FROM residues r LEFT JOIN keep k USING (structure_id, residue_idx) WHERE entity = 'protein')
  SELECT DISTINCT a.structure_id, a.residue_idx, a.label FROM pol a JOIN pol b ON a.structure_id = b.structure_id AND a.chain = b.chain AND abs(a.poly_index - b.poly_index) = 1 WHERE a.kept AND NOT b.kept""")
def crop_boundary(spark, sf_dir):
    a = atoms(spark, sf_dir)
    residues = a.select("structure_id", "chain", "residue_idx", "poly_index", "label").distinct()
    return display.crop_boundary(residues, display.crop_around(*_centre(a), 10.0))


@query("superpose_neighbours")
def superpose_neighbours(spark, sf_dir):
    """Fit of every structure's chain B onto its chain A over residues with the same position."""
    ca = atoms(spark, sf_dir).filter("entity = 'protein' AND atom_name = 'CA'")
    a = ca.filter("chain = 'A'").selectExpr("structure_id", "poly_index AS pair_idx", "x AS t_x", "y AS t_y", "z AS t_z")
    b = ca.filter("chain = 'B'").selectExpr("structure_id", "poly_index AS pair_idx", "x AS m_x", "y AS m_y", "z AS m_z")
    fits, _ = superpose.superpose_states(a.join(b, ["structure_id", "pair_idx"]).withColumn("is_core", F.lit(True)), ["structure_id"])
    return fits.selectExpr("structure_id", "n_core", "n_outliers", "refitted", "floor(rmsd_before * 1000) AS rmsd_before_milli",
                           "floor(rmsd_after * 1000) AS rmsd_after_milli")


@query("align_part_names")
def align_part_names(spark, sf_dir):
    """Global alignment of every part name with the name of the part after it."""
    from ..sources.tables import table
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS pair_id", "p_name AS first")
    after = part.selectExpr("pair_id - 1 AS pair_id", "first AS second")
    return superpose.align_chains(part.join(merged(after), "pair_id")).groupBy("pair_id").agg(
        F.expr("count(*) AS n_aligned"), F.expr("count_if(same_letter) AS n_same"))
