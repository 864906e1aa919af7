"""A whole dataset built from the derived structures: instances, renders and what was turned down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans import assembly, dataset, families as fam
from ..sources import records
from .contact_queries import W
from .data import atoms
from .family_queries import _SQL, analysis
from .registry import query
from .render_queries import _ready

FAMILIES = ("P01", "P02", "S01", "S06", "I01")
TARGETS = {"P01": 2, "P02": 3, "S01": 4, "S06": 4, "I01": 1}
SEED, BUDGET, CAP = 11, 34_600, 4
PREDICTED = "CAST(substr(structure_id, 2) AS INT) % 4 = 1"
PLAN = assembly.Plan(FAMILIES, TARGETS, SEED, BUDGET, CAP, 0.35, 0.25, predicted=PREDICTED)


def proposed(spark, sf_dir) -> DataFrame:
    a = analysis(spark, sf_dir)
    return reduce(DataFrame.unionByName, [fam.PROPOSERS[f](a).select(*fam.COLUMNS) for f in FAMILIES])


def built(spark, sf_dir):
    """Candidates of low confidence are left out, some are published already, some are decided on."""
    base = _ready(spark, sf_dir)
    confidence = atoms(spark, sf_dir).select("structure_id", "label", "residue_idx").distinct().selectExpr("structure_id", "label", "IF(residue_idx % 53 = 7, 60D, NULL) AS confidence")
    good, turned_down = assembly.admissible(proposed(spark, sf_dir), atoms(spark, sf_dir), PLAN, confidence)
    placed = dataset.ordered_candidates(good, list(FAMILIES), TARGETS, SEED)
    names = placed.selectExpr(f"{dataset.instance_id()} AS value").selectExpr("value", "substring_index(value, '-', -1) AS digest")
    decisions = names.filter("substr(digest, 2, 1) < '6'").selectExpr(
        "value AS semantic_instance_id", "1L AS ordinal", "IF(substr(digest, 2, 1) < '2', 'reject', 'accept') AS decision", "'looked at' AS notes", "'checked' AS reason",
        """CASE WHEN substr(digest, 2, 1) <> '5' THEN NULL WHEN value RLIKE '^P02' THEN '{"value":7}' WHEN value RLIKE '^S0[12]' THEN '{"value":"A:X0"}' ELSE '{"value":["A:X0"]}' END AS label_override""")
    instances, renders, failed = assembly.build(placed, base, PLAN, names.filter("substr(digest, 1, 1) < '3'").select("value"), decisions)
    return instances, renders, failed, turned_down


_PROPOSED = " UNION ALL ".join(f"SELECT '{f}' AS family, structure_id, accepted, parameters, reason, tag FROM ({_SQL[f]})" for f in FAMILIES)
_CHOICE = f"""{W}, given AS MATERIALIZED ({_PROPOSED.replace("{{", "{").replace("}}", "}")}),
  seed63 AS (SELECT 1),
  known AS (SELECT *, CAST(substr(structure_id, 2) AS INT) % 4 = 1 AS predicted, substr(sha256('["' || family || '","' || structure_id || '",' || to_json(parameters)::VARCHAR || ']'), 1, 8) AS digest FROM given),
  open_ AS (SELECT * FROM known WHERE NOT (predicted AND family IN ('S06', 'S07', 'S02', 'I01'))),
  bad AS (SELECT structure_id, residue_idx, label FROM residues WHERE residue_idx % 53 = 7),
  doubt AS MATERIALIZED (SELECT DISTINCT structure_id, lj AS label FROM near WHERE d <= 8 AND ri % 53 = 7 UNION SELECT structure_id, label FROM bad),
  -- A salt bridge is asked for by one residue and its partner is required as well.
  bridge AS (SELECT structure_id, li AS l, lj AS o, d FROM near WHERE d <= 4 AND ri <> rj AND ti = 'protein' AND tj = 'protein' AND
    ((((qi = 'LYS' AND ni = 'NZ') OR (qi = 'ARG' AND ni IN ('NE', 'NH1', 'NH2'))) AND ((qj = 'ASP' AND nj IN ('OD1', 'OD2')) OR (qj = 'GLU' AND nj IN ('OE1', 'OE2'))))
    OR (((qj = 'LYS' AND nj = 'NZ') OR (qj = 'ARG' AND nj IN ('NE', 'NH1', 'NH2'))) AND ((qi = 'ASP' AND ni IN ('OD1', 'OD2')) OR (qi = 'GLU' AND ni IN ('OE1', 'OE2')))))),
  partner AS (SELECT structure_id, l, arg_min(o, d) AS o FROM bridge GROUP BY ALL),
  doubtful AS (SELECT DISTINCT k.family, k.digest, k.structure_id FROM open_ k JOIN partner p ON k.family = 'S01' AND p.structure_id = k.structure_id AND p.l = json_extract_string(k.parameters, '$.residue')
    JOIN doubt d ON d.structure_id = k.structure_id AND d.label IN (p.l, p.o) WHERE k.accepted AND k.predicted),
  fine AS (SELECT * FROM open_ k WHERE accepted AND NOT EXISTS (SELECT 1 FROM doubtful d WHERE d.family = k.family AND d.digest = k.digest AND d.structure_id = k.structure_id)),
  drawn AS (SELECT *, family || '-' || structure_id || '-' || digest AS id, ('0x' || substr(sha256('[{SEED},"candidate","' || family || '","' || structure_id || '",' || to_json(parameters)::VARCHAR || ']'), 1, 16))::UBIGINT
    & 9223372036854775807::UBIGINT AS draw, ('0x' || substr(sha256('[{SEED},"protein","' || structure_id || '"]'), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS turn_seed FROM fine),
  tagged AS (SELECT *, row_number() OVER (PARTITION BY family, structure_id, tag ORDER BY draw) AS r FROM drawn QUALIFY r <= 3),
  picked AS (SELECT *, row_number() OVER (PARTITION BY family, structure_id ORDER BY r, tag) AS pick FROM tagged QUALIFY pick <= 6),
  quota(family, target, own) AS (VALUES {", ".join(f"('{f}', {TARGETS[f]}, {i})" for i, f in enumerate(FAMILIES))}),
  placed AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY pick, turn_seed, structure_id) AS place FROM picked JOIN quota USING (family) QUALIFY place <= 4 * target),
  -- Length of a prompt: 79 characters an atom line, 27 a line that ends a chain, 4 for the last.
  counted AS (SELECT structure_id, count(*) AS n_atoms, count(DISTINCT chain) FILTER (entity = 'protein') AS n_chains FROM atoms GROUP BY ALL),
  legend AS (SELECT structure_id, sum(length(line) + 1) - 1 AS n FROM (SELECT structure_id, label || CASE entity WHEN 'ligand' THEN ': non-polymer ligand with ' || count(*) || ' heavy atoms'
    ELSE ': ' || upper(min(element)[1]) || lower(substr(min(element), 2)) || ' ion' END AS line FROM atoms WHERE entity <> 'protein' GROUP BY structure_id, residue_idx, label, entity) GROUP BY ALL),
  ends_ AS (SELECT structure_id, count(*) AS n_ends FROM (SELECT structure_id, residue_idx, chain, entity, lead(chain) OVER (PARTITION BY structure_id ORDER BY residue_idx) AS next FROM residues)
    WHERE entity = 'protein' AND (next IS NULL OR next <> chain) GROUP BY ALL),
  question AS (SELECT *, CASE family WHEN 'P01' THEN {dataset.QUESTIONS["P01"]!r} WHEN 'P02' THEN replace({dataset.QUESTIONS["P02"]!r}, '{{chain}}', json_extract_string(parameters, '$.chain'))
    WHEN 'S01' THEN replace({dataset.QUESTIONS["S01"]!r}, '{{residue}}', json_extract_string(parameters, '$.residue')) WHEN 'S02' THEN {dataset.QUESTIONS["S02"]!r}
    WHEN 'S06' THEN replace({dataset.QUESTIONS["S06"]!r}, '{{ligand}}', json_extract_string(parameters, '$.ligand')) WHEN 'S07' THEN replace({dataset.QUESTIONS["S07"]!r}, '{{metal}}', json_extract_string(parameters, '$.metal'))
    ELSE replace(replace({dataset.QUESTIONS["I01"]!r}, '{{chain_a}}', json_extract_string(parameters, '$.chain_a')), '{{chain_b}}', json_extract_string(parameters, '$.chain_b')) END AS asked FROM placed),
  sized AS (SELECT q.*, n_atoms, floor((length({dataset.SYSTEM_PROMPT!r}) + 1 + {len(dataset.NOTICE["minimal_pdb"]) + 1 + len(dataset.FRAME_NOTICE) + 2 + len("Structure:") + 1} + 79 * n_atoms + 27 * coalesce(n_ends, 0) + 3
      + coalesce({len("Non-polymer entities:") + 3} + l.n, 0) + {2 + len("Question: ")} + length(asked) + {2 + len(dataset.FINISH) + 1}) / 2.9::double)::BIGINT + 1 AS tokens,
    floor((length({dataset.SYSTEM_PROMPT!r}) + 1 + {len(dataset.NOTICE["context_only"]) + 2 + len("Question: ")} + length(asked) + {2 + len(dataset.FINISH) + 1}) / 2.9::double)::BIGINT + 1 AS bare_tokens
    FROM question q JOIN counted c USING (structure_id) LEFT JOIN legend l USING (structure_id) LEFT JOIN ends_ e USING (structure_id)),
  trial AS MATERIALIZED (SELECT *, CASE WHEN digest[1] < '3' THEN 'answer_previously_published' WHEN tokens > {BUDGET} AND family IN ('P01', 'P02', 'S02', 'I01') THEN 'over_token_budget_and_not_croppable' END AS failure,
    row_number() OVER (ORDER BY own, place) AS n FROM sized),
  -- One candidate after the other.
  walk AS (
    SELECT 0::BIGINT AS n, []::STRUCT(id VARCHAR, f VARCHAR, c VARCHAR)[] AS taken, []::VARCHAR[] AS turned
    UNION ALL
    SELECT t.n, CASE WHEN ok AND failure IS NULL THEN list_append(taken, {{'id': id, 'f': family, 'c': structure_id}}) ELSE taken END, CASE WHEN ok AND failure IS NOT NULL THEN list_append(turned, id) ELSE turned END
    FROM (SELECT t.*, w.taken, w.turned, len(list_filter(w.taken, lambda x: x.f = t.family)) < t.target AND len(list_filter(w.taken, lambda x: x.c = t.structure_id)) < {CAP} AS ok FROM walk w JOIN trial t ON t.n = w.n + 1) t),
  final AS (SELECT * FROM walk ORDER BY n DESC LIMIT 1),
  kept AS MATERIALIZED (SELECT t.* FROM trial t, (SELECT unnest(taken).id AS id FROM final) f WHERE f.id = t.id AND t.digest[2] >= '2')"""
_CHOICE = _CHOICE.replace("WITH", "WITH RECURSIVE", 1).replace("  seed63 AS (SELECT 1),\n", "")


@query("dataset_instances", f"""{_CHOICE},
  told AS (
    SELECT id, to_json({{'value': (SELECT list(DISTINCT chain ORDER BY chain) FROM residues r WHERE r.structure_id = k.structure_id)}})::VARCHAR AS gold FROM kept k WHERE family = 'P01'
    UNION ALL SELECT id, '{{"value":' || (SELECT count(*) FROM residues r WHERE r.structure_id = k.structure_id AND r.entity = 'protein' AND r.chain = json_extract_string(parameters, '$.chain')) || '}}' FROM kept k WHERE family = 'P02'
    UNION ALL SELECT id, '{{"value":"' || p.o || '"}}' FROM kept k JOIN partner p ON p.structure_id = k.structure_id AND p.l = json_extract_string(parameters, '$.residue') WHERE family = 'S01'
    UNION ALL SELECT id, '{{"value":"' || (SELECT min(label) FROM residues r WHERE r.structure_id = k.structure_id AND r.name = 'SEP') || '"}}' FROM kept k WHERE family = 'S02'
    UNION ALL SELECT id, to_json({{'value': list(DISTINCT li ORDER BY li)}})::VARCHAR FROM kept k JOIN near m ON m.structure_id = k.structure_id AND m.lj = json_extract_string(parameters, '$.ligand') AND ti = 'protein' AND d <= 4 WHERE family = 'S06' GROUP BY id
    UNION ALL SELECT id, to_json({{'value': list(DISTINCT li ORDER BY li)}})::VARCHAR FROM kept k JOIN near m ON m.structure_id = k.structure_id AND m.lj = json_extract_string(parameters, '$.metal') AND ti = 'protein' AND ei IN ('N', 'O', 'S')
      AND d <= CASE mj WHEN 'ZN' THEN 2.6 WHEN 'MG' THEN 2.5 ELSE 3.1 END WHERE family = 'S07' GROUP BY id
    UNION ALL SELECT id, to_json({{'value': list(DISTINCT li ORDER BY li)}})::VARCHAR FROM kept k JOIN near m ON m.structure_id = k.structure_id AND m.ci = json_extract_string(parameters, '$.chain_a') AND m.cj = json_extract_string(parameters, '$.chain_b')
      AND ti = 'protein' AND tj = 'protein' AND d <= 4 WHERE family = 'I01' GROUP BY id)
  SELECT id AS semantic_instance_id, family AS question_family, structure_id AS protein_group_id, CASE WHEN predicted THEN 'afdb' ELSE 'pdb' END AS source_type, parameters AS question_parameters,
    CASE WHEN digest[2] < '6' THEN 'accepted' ELSE 'proposed' END AS curation_status, CASE WHEN digest[2] < '6' THEN 'looked at' ELSE '' END AS curator_notes,
    sha256(CASE WHEN digest[2] <> '5' THEN gold WHEN family = 'P02' THEN '{{"value":7}}' WHEN family IN ('S01', 'S02') THEN '{{"value":"A:X0"}}' ELSE '{{"value":["A:X0"]}}' END) AS gold_hash
  FROM kept JOIN told USING (id)""")
def dataset_instances(spark, sf_dir):
    instances, *_ = built(spark, sf_dir)
    return instances.select("semantic_instance_id", "question_family", "protein_group_id", "source_type", "question_parameters", "curation_status", "curator_notes", "gold_hash")


_S63 = "(('0x' || substr(sha256('[{seed},' || {rest} || ']'), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)"
_ROT = [_S63.format(seed=SEED, rest=f"""'"' || id || '","rotation",{k}'""") for k in (0, 1)]
_COIN = {name: _S63.format(seed=SEED, rest=f"""'"{name}","' || id || '"'""") for name in ("representation_variant", "rotation_variant")}


@query("dataset_renders", f"""{_CHOICE},
  forms AS (
    SELECT *, 'minimal_pdb' AS form, false AS turned, {_ROT[0]} AS seed FROM kept
    UNION ALL SELECT *, 'normalized_coordinates', false, {_ROT[0]} FROM kept WHERE {_COIN["representation_variant"]} % 1000 < 350
    UNION ALL SELECT *, 'context_only', false, {_ROT[0]} FROM kept WHERE family IN ('P01', 'P02')
    UNION ALL SELECT *, 'minimal_pdb', true, {_ROT[1]} FROM kept WHERE {_COIN["rotation_variant"]} % 1000 < 250)
  SELECT id || '::' || form || '::' || (seed % 100000000) AS render_id, id AS semantic_instance_id, form AS representation, turned AS is_rotation_variant, seed::BIGINT AS rotation_seed,
    CASE WHEN tokens <= {BUDGET} THEN n_atoms END AS atom_count, CASE WHEN tokens > {BUDGET} OR form = 'normalized_coordinates' THEN NULL WHEN form = 'context_only' THEN bare_tokens ELSE tokens END AS input_token_count
  FROM forms""")
def dataset_renders(spark, sf_dir):
    """Lengths are compared where SQL can tell them: of whole structures, and not of the free-width table."""
    _, renders, _, _ = built(spark, sf_dir)
    whole = "user_prompt NOT LIKE '%excerpt%'"
    return renders.selectExpr("render_id", "semantic_instance_id", "representation", "is_rotation_variant", "rotation_seed", f"IF({whole}, atom_count, NULL) AS atom_count",
                              f"IF({whole} AND representation <> 'normalized_coordinates', input_token_count, NULL) AS input_token_count")


@query("dataset_rejections", f"""{_CHOICE},
  turned AS (SELECT unnest(turned) AS id FROM final),
  rows_ AS (
    SELECT family, structure_id, failure AS reason FROM trial JOIN turned USING (id)
    UNION ALL SELECT family, structure_id, reason FROM open_ WHERE NOT accepted
    UNION ALL SELECT family, structure_id, 'afdb_low_plddt_near_query' FROM doubtful
    UNION ALL SELECT DISTINCT family, structure_id, 'afdb_ineligible_for_family' FROM known WHERE predicted AND family IN ('S06', 'S07', 'S02', 'I01'))
  SELECT family, structure_id, reason, count(*) AS n FROM rows_ GROUP BY ALL""")
def dataset_rejections(spark, sf_dir):
    *_, failed, turned_down = built(spark, sf_dir)
    rows = failed.select("family", "structure_id", "reason").unionByName(turned_down.select("family", "structure_id", "reason"))
    return rows.groupBy("family", "structure_id", "reason").agg(F.count(F.lit(1)).alias("n"))
