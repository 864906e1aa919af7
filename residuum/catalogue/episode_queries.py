"""Two-state episodes over the derived structures: three chains a state, named and placed differently in the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chemistry as chem
from ..operators import cleaning
from ..plans import episodes
from ..session import stage
from ..sources.records import GOLD_FIELDS
from .contact_queries import W
from .data import atoms
from .dataset_queries import _S63
from .registry import query

SEED, ATOM_BUDGET = 5, 1500
#: Chains of state 1 by segment of 16 residues; in state 2 they are called C, A, B and come in another order.
_CHAIN = "CASE WHEN residue_idx < 32 THEN 'A' WHEN residue_idx < 64 THEN 'B' WHEN residue_idx < 96 THEN 'C' WHEN residue_idx < 112 AND entity = 'protein' THEN 'X' WHEN residue_idx = 127 THEN 'D' END"
_KIND = "CAST(substr(structure_id, 2) AS INT) % 4"


def _first(spark, sf_dir):
    rows = atoms(spark, sf_dir).withColumn("chain", F.expr(_CHAIN)).filter("chain IS NOT NULL AND chain <> 'X'").drop("poly_index")
    named = rows.withColumn("label", F.expr(chem.residue_label("chain", "name", "seq_id", "entity")))
    return stage(cleaning.assign_poly_index(named))


def _second(spark, sf_dir):
    """Turned by a quarter and shifted; structures of kind 0 have one more chain, of kind 2 another shape, of kind 3 another sequence."""
    rows = atoms(spark, sf_dir).withColumn("one", F.expr(_CHAIN)).filter(f"one IN ('A', 'B', 'C') OR (one = 'X' AND {_KIND} = 0)").drop("poly_index", "chain")
    place = "CASE one WHEN 'A' THEN residue_idx + 64 WHEN 'X' THEN residue_idx ELSE residue_idx - 32 END"
    scale = f"IF({_KIND} = 2, 6D, 1D)"
    moved = rows.selectExpr("* EXCEPT (residue_idx, atom_idx, x, y, z, name, parent)", f"{place} AS residue_idx", f"({place}) * 32 + atom_idx % 32 AS atom_idx",
                            f"{scale} * (y + 0.1D * (residue_idx % 3)) AS x", f"{scale} * (7D - x) AS y", f"{scale} * (z + 3D) AS z",
                            f"IF({_KIND} = 3 AND entity = 'protein', 'GLY', name) AS name", f"IF({_KIND} = 3 AND entity = 'protein', 'GLY', parent) AS parent",
                            "CASE one WHEN 'A' THEN 'C' WHEN 'B' THEN 'A' WHEN 'C' THEN 'B' ELSE 'D' END AS chain").drop("one")
    named = moved.withColumn("label", F.expr(chem.residue_label("chain", "name", "seq_id", "entity")))
    return stage(cleaning.assign_poly_index(named))


def _episodes(spark, sf_dir):
    given = f"CASE {_KIND} WHEN 0 THEN map('A', 'C', 'B', 'A', 'C', 'B') WHEN 1 THEN map('A', 'A', 'B', 'B', 'C', 'C') END"
    return stage(atoms(spark, sf_dir).select("structure_id").distinct().selectExpr(
        "structure_id", f"{given} AS chain_map", f"IF({_KIND} < 2, array(named_struct('chain', 'A', 'first', 1, 'last', 5)), NULL) AS exclusions"))


_POINTS = f"""{W.replace("WITH", "WITH RECURSIVE", 1)},
  pts AS MATERIALIZED (SELECT *, {_KIND} AS kind, {_CHAIN} AS one FROM atoms),
  ca AS (SELECT structure_id, kind, one, x AS tx, y AS ty, z AS tz, s * (y + 0.1 * (residue_idx % 3)) AS mx, s * (7 - x) AS my, s * (z + 3) AS mz
    FROM (SELECT *, CASE WHEN kind = 2 THEN 6.0 ELSE 1.0 END::double AS s FROM pts) WHERE atom_name = 'CA' AND entity = 'protein' AND one IN ('A', 'B', 'C') AND kind <> 3 AND NOT (kind < 2 AND one = 'A' AND seq_id BETWEEN 1 AND 5)),
  moments AS (SELECT structure_id, count(*) AS n, covar_pop(mx, tx) AS xx, covar_pop(mx, ty) AS xy, covar_pop(mx, tz) AS xz, covar_pop(my, tx) AS yx, covar_pop(my, ty) AS yy, covar_pop(my, tz) AS yz,
    covar_pop(mz, tx) AS zx, covar_pop(mz, ty) AS zy, covar_pop(mz, tz) AS zz, var_pop(mx) + var_pop(my) + var_pop(mz) + var_pop(tx) + var_pop(ty) + var_pop(tz) AS g FROM ca GROUP BY structure_id),
  -- The largest eigenvalue of the quaternion matrix gives the smallest RMSD.
  matrix AS (SELECT structure_id, n, g, [[xx + yy + zz + g, yz - zy, zx - xz, xy - yx], [yz - zy, xx - yy - zz + g, xy + yx, zx + xz], [zx - xz, xy + yx, yy - xx - zz + g, yz + zy], [xy - yx, zx + xz, yz + zy, zz - xx - yy + g]] AS k FROM moments),
  vectors AS (SELECT *, list_reduce(list_concat([[0.6::double, 0.5, 0.4, 0.3]], list_transform(range(900), lambda i: [0.0::double, 0, 0, 0])), lambda v, o: list_transform(k, lambda r: list_dot_product(r, v) / sqrt(list_dot_product(v, v)))) AS v FROM matrix),
  fit AS (SELECT structure_id, n, sqrt(greatest(0, g - 2 * (list_dot_product(v, list_transform(k, lambda r: list_dot_product(r, v))) / list_dot_product(v, v) - g))) AS rmsd FROM vectors)"""


@query("episode_alignment", f"""{_POINTS}, e AS (SELECT DISTINCT structure_id, kind FROM pts)
  SELECT structure_id, CASE WHEN kind = 3 THEN NULL WHEN kind = 0 THEN 0 ELSE 4 END::INT AS map_no, CASE WHEN kind < 3 THEN 'A=C,B=A,C=B' END AS chain_map, n AS n_core, floor(rmsd * 1000 + 0.5)::BIGINT AS milli_rmsd,
    CASE WHEN kind = 3 THEN 'no_valid_chain_mapping' WHEN rmsd > 5 THEN 'alignment_rmsd_too_high' END AS reason FROM e LEFT JOIN fit USING (structure_id)""")
def episode_alignment(spark, sf_dir):
    out = episodes.align(_episodes(spark, sf_dir), _first(spark, sf_dir), _second(spark, sf_dir))
    return out.selectExpr("structure_id", "map_no", "array_join(transform(array_sort(map_entries(chain_map)), e -> concat(e.key, '=', e.value)), ',') AS chain_map", "n_core",
                          "CAST(floor(rmsd_after * 1000 + 0.5) AS BIGINT) AS milli_rmsd", "reason")


def _claims(spark, sf_dir):
    """The same residue in both states, a wrong letter, a number that does not exist, and a residue of the extra chain."""
    third = atoms(spark, sf_dir).filter("residue_idx = 2").select("structure_id", "name").distinct().selectExpr("structure_id", f"{chem.one_letter('name')} AS own")
    rows = ("explode(array(named_struct('claim', 'site', 'entry_no', 1, 'state', 1, 'chain', 'A', 'seq_id', 3, 'letter', own), named_struct('claim', 'site', 'entry_no', 2, 'state', 2, 'chain', 'C', 'seq_id', 3, 'letter', own), "
            "named_struct('claim', 'partner', 'entry_no', 1, 'state', 2, 'chain', 'A', 'seq_id', 40, 'letter', '-'), named_struct('claim', 'partner', 'entry_no', 2, 'state', 1, 'chain', 'B', 'seq_id', 999, 'letter', CAST(NULL AS STRING)), "
            "named_struct('claim', 'extra', 'entry_no', 1, 'state', 2, 'chain', 'D', 'seq_id', 20, 'letter', CAST(NULL AS STRING)))) AS c")
    return third.selectExpr("structure_id", rows).selectExpr("structure_id", "c.*")


_CLAIMS = """third AS (SELECT structure_id, kind, substr(label, 3, 1) AS own FROM (SELECT DISTINCT structure_id, kind, label FROM pts WHERE residue_idx = 2)),
  claims AS (SELECT structure_id, kind, own, unnest([{'claim': 'site', 'entry_no': 1, 'state': 1}, {'claim': 'site', 'entry_no': 2, 'state': 2}, {'claim': 'partner', 'entry_no': 1, 'state': 2}, {'claim': 'partner', 'entry_no': 2, 'state': 1},
    {'claim': 'extra', 'entry_no': 1, 'state': 2}], recursive := true) FROM third)"""


@query("episode_claims", f"""{_POINTS}, {_CLAIMS},
  twenty AS (SELECT DISTINCT structure_id, substr(label, 3, 1) AS letter FROM pts WHERE one = 'X' AND seq_id = 20),
  told AS (SELECT c.*, CASE WHEN claim = 'site' AND (state = 1 OR kind <> 3 OR own = 'G') THEN 'A:' || own || '3' WHEN claim = 'extra' AND kind = 0 THEN 'E:' || t.letter || '20' END AS label FROM claims c LEFT JOIN twenty t USING (structure_id))
  SELECT structure_id, claim, entry_no::INT AS entry_no, state::INT AS state, label, CASE WHEN label IS NULL THEN 'claim_residue_not_found' END AS reason FROM told WHERE kind <> 3""")
def episode_claims(spark, sf_dir):
    """Claims of the episodes whose chains correspond, under the names that both states share in the end."""
    first, second = _first(spark, sf_dir), _second(spark, sf_dir)
    aligned = stage(episodes.align(_episodes(spark, sf_dir), first, second).filter("chain_map IS NOT NULL"))
    names = stage(episodes.renames(aligned, first, second))
    claims = _claims(spark, sf_dir).join(aligned, "structure_id", "left_semi")
    return episodes.resolve_claims(claims, first, second, names).select("structure_id", "claim", "entry_no", "state", "label", "reason")


_CENTRES = """s1 AS (SELECT structure_id, residue_idx, one || substr(label, 2) AS label, entity, x, y, z FROM pts WHERE one IN ('A', 'B', 'C', 'D') AND kind < 2),
  s2 AS (SELECT structure_id, residue_idx, CASE one WHEN 'X' THEN 'E' ELSE one END || substr(label, 2) AS label, entity, y + 0.1 * (residue_idx % 3) AS x, 7 - x AS y, z + 3 AS z FROM pts WHERE kind < 2 AND (one IN ('A', 'B', 'C') OR (one = 'X' AND kind = 0)))"""


def _kept(s: int) -> str:
    return (f"SELECT DISTINCT a.structure_id, a.label, r FROM s{s} a, unnest([16.0, 13.0, 10.0, 8.0, 6.5]) q(r), s{s} b WHERE a.structure_id = b.structure_id AND (b.entity <> 'protein' OR b.label IN (SELECT label FROM site w WHERE w.structure_id = b.structure_id)) "
            "AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= CASE WHEN a.entity = 'protein' THEN r * r ELSE 2.25 * r * r END")


_ID = "'MECH-' || structure_id || '-' || substr(sha256('[\"' || structure_id || '\",[\"extra 1 2 D 20\",\"partner 1 2 A 40 -\",\"partner 2 1 B 999\",\"site 1 1 A 3 ' || own || '\",\"site 2 2 C 3 ' || own || '\"]]'), 1, 6)"


@query("episode_renders", f"""{_POINTS}, {_CLAIMS}, {_CENTRES},
  twenty AS (SELECT DISTINCT structure_id, substr(label, 3, 1) AS letter FROM pts WHERE one = 'X' AND seq_id = 20),
  site AS (SELECT structure_id, 'A:' || own || '3' AS label FROM third UNION ALL SELECT structure_id, 'E:' || letter || '20' FROM twenty),
  kept AS MATERIALIZED ({_kept(1)} UNION {_kept(2)}),
  everything AS (SELECT structure_id, label, count(*) AS n FROM (SELECT structure_id, label FROM s1 UNION ALL SELECT structure_id, label FROM s2) GROUP BY ALL),
  counted AS (SELECT structure_id, r, sum(n) AS n FROM kept JOIN everything USING (structure_id, label) GROUP BY ALL HAVING sum(n) <= {ATOM_BUDGET}),
  cut AS (SELECT structure_id, max(r) AS r, arg_max(n, r) AS n FROM counted GROUP BY structure_id),
  named AS (SELECT structure_id, own, {_ID} AS id FROM third),
  views(form, k, turned, back) AS (VALUES ('minimal_pdb', 0, false, 0), ('normalized_coordinates', 0, false, 0), ('context_only', 0, false, 0), ('minimal_pdb', 1, true, 0), ('minimal_pdb', 0, false, 1)),
  seeded AS (SELECT *, {_S63.format(seed=SEED, rest="'\"' || id || '\",\"rotation\",' || k")} AS seed FROM named JOIN cut USING (structure_id), views)
  SELECT id || '::' || form || '::' || (seed % 100000000) || CASE back WHEN 1 THEN '::reversed' ELSE '' END AS render_id, id AS semantic_instance_id, form AS representation, turned AS is_rotation_variant, seed::BIGINT AS rotation_seed, back AS state_order,
    n::BIGINT AS atom_count, r::double AS radius, '{{"packing":{{"value":"helix"}},"packing_change":{{"value":"' || CASE back WHEN 1 THEN 'farther' ELSE 'closer' END || '"}},"site":{{"value":"A:' || own || '3"}}}}' AS gold_fields FROM seeded""")
def episode_renders(spark, sf_dir):
    first, second = _first(spark, sf_dir), _second(spark, sf_dir)
    specs, claims = _episodes(spark, sf_dir), stage(_claims(spark, sf_dir))
    aligned = stage(episodes.align(specs, first, second).filter("reason IS NULL"))
    names = stage(episodes.renames(aligned, first, second))
    good = first.join(aligned, "structure_id", "left_semi")
    moved = stage(episodes.harmonised(second, aligned, names))
    resolved = stage(episodes.resolve_claims(claims, first, second, names))
    cut_1, cut_2, report = episodes.crop_pairs(good, moved, episodes.crop_centres(resolved, good), episodes.crop_centres(resolved, moved), ATOM_BUDGET)
    kept = stage(report.filter("reason IS NULL"))
    ids = episodes.episode_ids(specs, claims).join(kept, "structure_id").selectExpr(
        "structure_id", "semantic_instance_id", "'Structure 1 is free, Structure 2 is bound.' AS context", "true AS cropped", "array(named_struct('code', 'A', 'text', 'closing'), named_struct('code', 'B', 'text', 'opening')) AS options")
    site = resolved.filter("claim = 'site' AND entry_no = 1").select("structure_id", "label")
    rows = ("explode(array(named_struct('field_no', 1, 'field', 'site', 'answer_schema', 'residue', 'prompt', 'Which residue moves?', 'gold_text', label), "
            "named_struct('field_no', 2, 'field', 'packing_change', 'answer_schema', 'category', 'prompt', 'Is it closer or farther?', 'gold_text', 'closer'), "
            "named_struct('field_no', 3, 'field', 'packing', 'answer_schema', 'category', 'prompt', 'What packs against it?', 'gold_text', 'helix'))) AS f")
    fields = site.selectExpr("structure_id", rows).selectExpr("structure_id", "f.*", *[f"CAST(NULL AS {g.dataType.simpleString()}) AS {g.name}" for g in GOLD_FIELDS if g.name != "gold_text"])
    shown = episodes.renders(ids, _ready(cut_1), _ready(cut_2), fields, SEED)
    return shown.join(ids.select("semantic_instance_id", "structure_id"), "semantic_instance_id").join(kept.select("structure_id", "radius"), "structure_id").select(
        "render_id", "semantic_instance_id", "representation", "is_rotation_variant", "rotation_seed", "state_order", "atom_count", "radius", "gold_fields")


def _ready(rows):
    return rows.selectExpr("*", "0L AS serial", "' ' AS icode", "1D AS occupancy", "0D AS bfactor", "entity <> 'protein' AS is_hetatm")


