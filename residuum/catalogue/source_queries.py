"""Files written from the derived structures and read back, assemblies, response checks and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as h
from ..plans import identity, reading, responses, validation
from ..session import stage
from ..sources import provenance as prov, structures
from ..sources.records import GOLD_FIELDS
from .contact_queries import W
from .data import atoms
from .registry import query
from .render_queries import _SERIAL, _ready
from ..sources.tables import table

_OPERATORS = {"1": (1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0), "2": (-1, 0, 0, 0, -1, 0, 0, 0, 1, 5, 0, 0), "3": (0, -1, 0, 1, 0, 0, 0, 0, 1, 0, 7, 0), "4": (0, 0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 9),
              "5": (1, 0, 0, 0, -1, 0, 0, 0, -1, 1, 2, 3), "6": (0, 1, 0, 0, 0, 1, 1, 0, 0, -4, 0, 0), "P": (1, 0, 0, 0, 1, 0, 0, 0, 1, 100, 0, 0)}


def _contents(spark, sf_dir, wanted="true"):
    """Each structure as an mmCIF text with seven operators and two rows of assembly 1."""
    heads = ("group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv auth_seq_id auth_asym_id pdbx_PDB_model_num").split()
    names = [f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"vector[{i}]" for i in (1, 2, 3)]
    operators = "\n".join(["#", "loop_", "_pdbx_struct_oper_list.id", "_pdbx_struct_oper_list.type", *[f"_pdbx_struct_oper_list.{n}" for n in names],
                           *[f"{k} 'point symmetry operation' {' '.join(map(str, v))}" for k, v in _OPERATORS.items()]])
    gen = "\n".join(["#", "loop_", "_pdbx_struct_assembly_gen.assembly_id", "_pdbx_struct_assembly_gen.oper_expression", "_pdbx_struct_assembly_gen.asym_id_list",
                     "1 (1-3)(4-6,P) A", "1 1,(2,P) B", "2 P A,B"])
    head = "data_X\n" + gen + "\n" + operators + "\n#\nloop_\n" + "\n".join(f"_atom_site.{x}" for x in heads) + "\n"
    line = ("concat_ws(' ', IF(is_hetatm, 'HETATM', 'ATOM'), serial, element, atom_name, '.', name, chain, '.', '?', format_string('%.3f', x), format_string('%.3f', y), format_string('%.3f', z), '1.00', '0.00', seq_id, chain, '1')")
    lines = _ready(spark, sf_dir).filter(wanted).selectExpr("structure_id", "serial AS line_no", f"{line} AS line")
    return structures.as_documents(lines).select("structure_id", F.concat(F.lit(head), "text", F.lit("#\n")).alias("content"))


@query("parse_mmcif_roundtrip", f"""{W}, {_SERIAL} SELECT structure_id, serial, atom_name, element, name, chain, seq_id, entity <> 'protein' AS is_hetatm, CAST(floor(x * 1000 + 0.5) AS BIGINT) AS mx, CAST(floor(y * 1000 + 0.5) AS BIGINT) AS my,
  CAST(floor(z * 1000 + 0.5) AS BIGINT) AS mz FROM o""")
def parse_mmcif_roundtrip(spark, sf_dir):
    raw = structures.parse_mmcif(stage(_contents(spark, sf_dir)))
    first = raw.groupBy("structure_id").agg(F.min("ord").alias("first"))
    return raw.join(first, "structure_id").selectExpr("structure_id", "ord - first + 1 AS serial", "atom_name", "element", "name", "chain", "seq_id", "is_hetatm",
                                                      *[f"CAST(floor({c} * 1000 + 0.5D) AS BIGINT) AS m{c}" for c in "xyz"])


@query("parse_pdb_roundtrip", f"""{W}, {_SERIAL} SELECT structure_id, atom_name, element, name, chain, seq_id, entity <> 'protein' AS is_hetatm, CAST(floor(x * 1000 + 0.5) AS BIGINT) AS mx, CAST(floor(y * 1000 + 0.5) AS BIGINT) AS my,
  CAST(floor(z * 1000 + 0.5) AS BIGINT) AS mz FROM o""")
def parse_pdb_roundtrip(spark, sf_dir):
    texts = structures.as_documents(structures.minimal_pdb(_ready(spark, sf_dir))).withColumnRenamed("text", "content")
    return structures.parse_pdb(stage(texts)).selectExpr("structure_id", "atom_name", "element", "name", "chain", "seq_id", "is_hetatm", *[f"CAST(floor({c} * 1000 + 0.5D) AS BIGINT) AS m{c}" for c in "xyz"])


_MATRICES = ", ".join(f"('{k}', {list(map(float, v))!r}::DOUBLE[])" for k, v in _OPERATORS.items())


def _applied(m: str, row: int, p: tuple[str, str, str]) -> str:
    return f"({m}[{3 * row + 1}] * {p[0]} + {m}[{3 * row + 2}] * {p[1]} + {m}[{3 * row + 3}] * {p[2]} + {m}[{10 + row}])"


@query("assembly_copies", f"""{W}, op(id, m) AS (VALUES {_MATRICES}),
  product AS (
    SELECT 'A' AS chain, a.id AS outer_, b.id AS inner_, row_number() OVER (ORDER BY a.id, CASE b.id WHEN 'P' THEN '9' ELSE b.id END) - 1 AS copy FROM op a, op b WHERE a.id IN ('1', '2', '3') AND b.id IN ('4', '5', '6', 'P')
    UNION ALL SELECT 'B', '1', '2', 0 UNION ALL SELECT 'B', '1', 'P', 1),
  inside AS (SELECT p.*, a.structure_id, m.m AS om, {", ".join(f"{_applied('b.m', r, ('x', 'y', 'z'))} AS {c}" for r, c in enumerate("xyz"))} FROM atoms a JOIN product p ON p.chain = a.chain JOIN op b ON b.id = p.inner_ JOIN op m ON m.id = p.outer_),
  moved AS (SELECT structure_id, CASE WHEN copy = 0 THEN chain ELSE chain || (copy + 1) END AS chain, {", ".join(f"{_applied('om', r, ('x', 'y', 'z'))} AS m{c}" for r, c in enumerate("xyz"))} FROM inside)
  SELECT structure_id, chain, count(*) AS n, {", ".join(f"CAST(sum(floor(m{c} * 1000 + 0.5)) AS BIGINT) AS sum_{c}" for c in "xyz")} FROM moved GROUP BY ALL""")
def assembly_copies(spark, sf_dir):
    """Twelve copies of chain A from a product of two lists, two of chain B from an operator and a list."""
    contents = stage(_contents(spark, sf_dir))
    out = structures.expand_assembly(structures.parse_mmcif(contents).withColumn("label_chain", F.col("chain")), contents, "1")
    return out.groupBy("structure_id", "chain").agg(F.expr("count(*) AS n"), *[F.expr(f"CAST(sum(floor({c} * 1000 + 0.5D)) AS BIGINT) AS sum_{c}") for c in "xyz"])


_BODIES = """CASE event_id % 16
  WHEN 0 THEN '{"choices":[{"message":{"content":"ok ' || event_id || '","reasoning":"because"},"finish_reason":"stop"}],"usage":{"n":1}}'
  WHEN 1 THEN '{"choices":[{"message":{"content":"ok"' WHEN 2 THEN '[1,2]' WHEN 3 THEN '{"error":{"message":"quota ' || user_id || '"}}' WHEN 4 THEN '{"error":"busy","choices":[]}'
  WHEN 5 THEN '{"choices":[]}' WHEN 6 THEN '{"choices":[7]}' WHEN 7 THEN '{"choices":[{"message":"text"}]}' WHEN 8 THEN '{"choices":[{"message":{"content":["a"],"refusal":{"x":1}}}],"usage":3}'
  WHEN 9 THEN '{"choices":[{"finish_reason":"error","message":{"content":null}}]}' WHEN 10 THEN '{"choices":[{"error":{"message":"cut"},"message":{"content":"x"}}],"usage":"many"}'
  WHEN 11 THEN '{"choices":"none","error":null}' WHEN 12 THEN '"text"' WHEN 13 THEN NULL WHEN 14 THEN '{"choices":[{"message":{"content":"y","refusal":null}}],"usage":null,"error":false}' ELSE '{}' END"""
_EXPECTED = """[{'k': 1, 'r': 0}, {'k': 2, 'r': 0}, {'k': 2, 'r': 3}, {'k': 3, 'r': 1}, {'k': 3, 'r': 3}, {'k': 4, 'r': 1}, {'k': 4, 'r': 3}, {'k': 5, 'r': 3}, {'k': 6, 'r': 4}, {'k': 7, 'r': 5}, {'k': 8, 'r': 6}, {'k': 8, 'r': 7}, {'k': 8, 'r': 8},
  {'k': 9, 'r': 2}, {'k': 10, 'r': 2}, {'k': 10, 'r': 8}, {'k': 11, 'r': 3}, {'k': 12, 'r': 0}, {'k': 12, 'r': 3}, {'k': 13, 'r': 0}, {'k': 13, 'r': 3}, {'k': 1, 'r': 3}, {'k': 15, 'r': 3}]"""


@query("response_violations", f"""WITH broken AS (SELECT unnest({_EXPECTED}, recursive := true)), rules(r, rule) AS (VALUES {", ".join(f"({i}, '{n}')" for i, (n, _, _) in enumerate(responses.RULES))})
  SELECT event_id, r::INT AS rule_no, rule, CASE WHEN k = 3 AND r = 1 THEN 'quota ' || user_id WHEN k = 4 AND r = 1 THEN 'busy' WHEN k = 9 THEN 'generation failed' WHEN k = 10 AND r = 2 THEN 'cut'
    WHEN r = 0 THEN 'response was not an object' WHEN r = 3 THEN 'response contained no choices' WHEN r = 4 THEN 'response choice was not an object' WHEN r = 5 THEN 'response choice contained no message object'
    WHEN r = 6 THEN 'response message content was not text' WHEN r = 7 THEN 'response message refusal was not text' ELSE 'response usage was not an object' END AS message
  FROM events JOIN broken ON k = event_id % 16 JOIN rules USING (r)""")
def response_violations(spark, sf_dir):
    """Responses of sixteen shapes, broken text and wrong types among them, one for every event."""
    return responses.violations(table(spark, sf_dir, "events").selectExpr("event_id", f"{_BODIES} AS body"), "event_id")


@query("response_errors", f"""WITH broken AS (SELECT k, min(r) AS r FROM (SELECT unnest({_EXPECTED}, recursive := true)) GROUP BY k)
  SELECT event_id, CASE WHEN k = 3 THEN 'quota ' || user_id WHEN k = 4 THEN 'busy' WHEN k = 9 THEN 'generation failed' WHEN k = 10 THEN 'cut' WHEN r = 0 THEN 'response was not an object' WHEN r = 3 THEN 'response contained no choices'
    WHEN r = 4 THEN 'response choice was not an object' WHEN r = 5 THEN 'response choice contained no message object' WHEN r = 6 THEN 'response message content was not text' END AS error,
    CASE WHEN event_id % 16 = 0 THEN 'because' ELSE '' END AS reasoning FROM events LEFT JOIN broken ON k = event_id % 16""")
def response_errors(spark, sf_dir):
    bodies = table(spark, sf_dir, "events").selectExpr("event_id", f"{_BODIES} AS body")
    return responses.errors(bodies, "event_id").join(responses.reasoning(bodies, "event_id"), "event_id")


@query("canonical_json", r"""SELECT event_id, sha256('{"a":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE to_json(props)::VARCHAR END || ',"id":' || event_id || ',"list":["' || event_type || '",' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '"\u00e9\ud83d\ude00"' END || '],"m":{"u":' || user_id || ',"v":true}}') AS digest FROM events""")
def canonical_json(spark, sf_dir):
    """Nested values of every event as canonical JSON: sorted keys, ASCII escapes, nulls written out."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "named_struct('m', named_struct('v', true, 'u', user_id), 'id', event_id, 'list', array(event_type, IF(event_id % 2 = 0, NULL, concat('é', decode(unhex('F09F9880'), 'UTF-8')))), 'a', IF(event_id % 3 = 0, NULL, props)) AS v")
    return rows.selectExpr("event_id", f"sha2({h.canonical('v', rows.schema['v'].dataType)}, 256) AS digest")


@query("relation_fingerprint", """WITH r AS (SELECT sha256('[' || doc_id || ',' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ',' || coalesce(n_chars::VARCHAR, 'null') || ',"' || sha256(text) || '"]') AS d FROM documents),
  b AS (SELECT substr(d, 1, 3) AS k, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS s FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(s, '' ORDER BY k)) AS digest FROM b""")
def relation_fingerprint(spark, sf_dir):
    """One digest of the documents, whatever their order and layout."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "n_chars", "sha2(text, 256) AS text_sha256")
    return identity.digest_of(rows, "doc_id", rows.columns)


@query("prompt_structure", f"""{W}, {_SERIAL}, two AS (SELECT 'Structure 1' AS label, 0.0 AS dx UNION ALL SELECT 'Structure 2', 1.0)
  SELECT structure_id AS render_id, two.label, atom_name, element, name, chain, seq_id, CAST(floor((x + dx) * 1000 + 0.5) AS BIGINT) AS mx, CAST(floor(y * 1000 + 0.5) AS BIGINT) AS my, CAST(floor(z * 1000 + 0.5) AS BIGINT) AS mz FROM o, two""")
def prompt_structure(spark, sf_dir):
    """Two blocks a prompt, with legends and a question between and after them."""
    base = _ready(spark, sf_dir)
    text = lambda rows: structures.as_documents(structures.minimal_pdb(rows))
    both = text(base).join(text(base.withColumn("x", F.expr("x + 1D"))).withColumnRenamed("text", "second"), "structure_id")
    prompts = both.selectExpr("structure_id AS render_id", "concat('The structure follows.\\n\\nStructure 1:\\n', text, '\\nNon-polymer entities in structure 1:\\nA:ZN4: Zn ion\\n\\n  Structure 2:\\nas text\\n', second, "
                              "'\\nATOMS are not records here. Question: which?\\n') AS user_prompt")
    return reading.prompt_atoms(stage(prompts)).selectExpr("render_id", "label", "atom_name", "element", "name", "chain", "seq_id", *[f"CAST(floor({c} * 1000 + 0.5D) AS BIGINT) AS m{c}" for c in "xyz"])


@query("prompt_highlights", f"""{W}, pairs AS (SELECT DISTINCT structure_id, residue_idx, label FROM residues WHERE entity = 'protein' AND residue_idx % 16 < 6),
  named AS (SELECT structure_id || ':' || (residue_idx // 16) AS id, label, CASE residue_idx % 16 // 2 WHEN 0 THEN 'query' WHEN 1 THEN 'gold' ELSE 'evidence' END AS role FROM pairs)
  SELECT id AS semantic_instance_id, label, label[1] AS chain, CAST(regexp_extract(label, '[0-9]+$') AS INT) AS number, role FROM named""")
def prompt_highlights(spark, sf_dir):
    """Six neighbouring residues of a segment, two in the question, two in the answer, and all of them in the evidence."""
    rows = atoms(spark, sf_dir).filter("entity = 'protein' AND residue_idx % 16 < 6").select("structure_id", "residue_idx", "label").distinct()
    listed = lambda low, high: f"array_sort(collect_list(IF(residue_idx % 16 BETWEEN {low} AND {high}, label, NULL)))"
    grouped = rows.groupBy(F.expr("concat(structure_id, ':', residue_idx div 16)").alias("semantic_instance_id")).agg(
        F.expr(f"to_json(named_struct('residues', {listed(0, 1)}, 'note', 'at 4:30 and B:'))").alias("question_parameters"),
        F.expr(f"to_json(named_struct('value', array_join({listed(2, 3)}, '--')))").alias("gold"), F.expr(f"to_json(named_struct('near', {listed(0, 5)}))").alias("evidence"))
    return reading.highlights(grouped)


@query("provenance", """SELECT o_orderkey AS entry, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS release_date, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS deposit_date,
    CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderpriority END AS experimental_method, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN (o_orderkey % 40) / 10.0::double END AS resolution,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'order ' || o_orderkey END AS title, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'pdbx_database_id_DOI:10.1/' || o_orderkey END,
      'pdbx_database_id_PubMed:' || o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'year:' || year(o_orderdate) END], lambda x: x IS NOT NULL), ';') END AS publications,
    CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN '1,' || (o_orderkey % 9) ELSE '' END AS assembly_ids FROM orders""")
def provenance(spark, sf_dir):
    """A metadata document of every order, some broken, some with parts missing or null."""
    year = "date_format(CAST(o_orderdate AS TIMESTAMP), 'yyyy-MM-dd')"
    body = (f"""concat('{{"rcsb_accession_info":{{"initial_release_date":"', {year}, 'T00:00:00Z"', IF(o_orderkey % 2 = 0, concat(',"deposit_date":"', {year}, '"'), ''), '}},',
      '"exptl":', IF(o_orderkey % 3 = 0, 'null', concat('[{{"method":"', o_orderpriority, '"}},{{"method":"other"}}]')), ',"rcsb_entry_info":{{"resolution_combined":', IF(o_orderkey % 5 = 0, '[]', concat('[', (o_orderkey % 40) / 10D, ',9.9]')), ',"unknown":[1]}},',
      '"struct":{{"title":"order ', o_orderkey, '"}},"rcsb_primary_citation":{{"pdbx_database_id_DOI":', IF(o_orderkey % 2 = 0, concat('"10.1/', o_orderkey, '"'), 'null'), ',"pdbx_database_id_PubMed":"', o_custkey, '"', IF(o_orderkey % 3 = 0, concat(',"year":', year(o_orderdate)), ''), '}},',
      '"rcsb_entry_container_identifiers":', IF(o_orderkey % 5 = 0, '{{}}', concat('{{"assembly_ids":["1","', o_orderkey % 9, '"]}}')), '}}')""")
    records = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS entry", f"CASE o_orderkey % 14 WHEN 0 THEN NULL WHEN 7 THEN '{{broken' ELSE {body.replace('{{', '{').replace('}}', '}')} END AS payload")
    out = prov.annotated(records)
    return out.selectExpr("entry", "release_date", "deposit_date", "experimental_method", "resolution", "title", "array_join(publications, ';') AS publications", "array_join(assembly_ids, ',') AS assembly_ids")


_FAULTS = {1: ("unique_instances", "duplicate_id"), 2: ("source_is_named", "missing_source_provenance"), 3: ("sources_have_hashes", "source_entries_and_hashes_differ"), 4: ("margins", "missing_selection_margins"),
           5: ("version", "missing_definition_version"), 6: ("reviewed", "not_accepted"), 7: ("override_notes", "override_without_notes"), 8: ("answers_match_their_hash", "gold_hash_mismatch"), 9: ("records", "unknown_answer_schema"),
           11: ("instances_are_shown", "instance_without_render"), 15: ("one_frame_one_structure", "coordinates_differ")}
_SHOWN_FAULTS = {12: ("renders_belong", "render_without_instance"), 13: ("prompts_match_their_hash", "prompt_hash_mismatch"), 14: ("no_telling_records", "forbidden_record")}
_FAULT_ROWS = ", ".join(f"({k}, '{r}', '{v}', 'i')" for k, (r, v) in _FAULTS.items()) + ", " + ", ".join(f"({k}, '{r}', '{v}', 'r')" for k, (r, v) in _SHOWN_FAULTS.items())


@query("validation_violations", f"""WITH f(k, rule, violation, kind) AS (VALUES {_FAULT_ROWS})
  SELECT rule, CASE rule WHEN 'override_notes' THEN 'warning' ELSE 'error' END AS severity, kind || o_orderkey AS id, violation FROM orders JOIN f ON k = o_orderkey % 40
  UNION ALL SELECT 'sources_have_hashes', 'error', 'i' || o_orderkey, 'source_entries_and_hashes_differ' FROM orders WHERE o_orderkey % 40 = 2
  UNION ALL SELECT 'targets', 'warning', 'F', 'family_below_target' FROM orders WHERE o_orderstatus = 'F' HAVING count(*) < 1000000
  UNION ALL SELECT 'targets', 'warning', 'none', 'family_below_target'
  UNION ALL SELECT 'cap', 'error', 'p' || o_custkey, 'protein_above_cap' FROM (SELECT o_custkey, sum(CASE WHEN o_orderkey % 40 = 1 THEN 2 ELSE 1 END) AS n FROM orders GROUP BY 1) WHERE n > 15
  UNION ALL SELECT 'size', 'error', 'dataset', 'size_out_of_range'""")
def validation_violations(spark, sf_dir):
    """A dataset of one instance per order with one fault of every kind in forty."""
    k = "o_orderkey % 40"
    gold = {"gold_number": "CAST(o_custkey AS DOUBLE)"}
    rows = table(spark, sf_dir, "orders").selectExpr("*", f"explode(IF({k} = 1, array(1, 2), array(1))) AS copy")
    instances = stage(rows.selectExpr(
        "concat('i', o_orderkey) AS semantic_instance_id", "o_orderstatus AS question_family", "concat('p', o_custkey) AS protein_group_id", f"IF({k} = 9, 'guess', 'integer') AS answer_schema",
        f"CASE {k} WHEN 2 THEN array() WHEN 3 THEN array('a', 'b') ELSE array('a') END AS source_entries", "array('h') AS source_file_sha256s", f"IF({k} = 4, NULL, '{{\"gap\":1}}') AS selection_margins",
        f"IF({k} = 5, '', '1') AS definition_version", f"IF({k} = 6, 'proposed', 'accepted') AS curation_status", f"IF({k} = 7, '{{\"value\":1}}', NULL) AS curator_override", "'' AS curator_notes",
        f"sha2(concat('{{\"value\":', IF({k} = 8, 'x', CAST(o_custkey AS STRING)), IF({k} = 9, '.0', ''), '}}'), 256) AS gold_hash",
        *[f"{gold.get(g.name, f'CAST(NULL AS {g.dataType.simpleString()})')} AS {g.name}" for g in GOLD_FIELDS]))
    prompt = f"concat('Question ', o_orderkey, IF({k} = 14, '\\nREMARK 1', ''))"
    renders = stage(table(spark, sf_dir, "orders").filter(f"{k} <> 11").selectExpr("*", f"explode(IF({k} = 15, array(1, 2), array(1))) AS copy").selectExpr(
        f"concat('r', o_orderkey, IF(copy = 2, 'b', '')) AS render_id", "concat('i', o_orderkey) AS semantic_instance_id", "'minimal_pdb' AS representation", "1L AS rotation_seed", f"{prompt} AS user_prompt",
        f"sha2(IF({k} = 13, 'other', {prompt}), 256) AS prompt_sha256", "CAST(copy AS STRING) AS displayed_coordinates_sha256").withColumn(
        "semantic_instance_id", F.expr("IF(substr(render_id, 2) RLIKE '^[0-9]+$' AND CAST(substr(render_id, 2) AS BIGINT) % 40 = 12, concat('z', substr(render_id, 2)), semantic_instance_id)")))
    # The orders whose render went astray are shown by another one.
    more = table(spark, sf_dir, "orders").filter(f"{k} = 12").selectExpr("concat('s', o_orderkey) AS render_id", "concat('i', o_orderkey) AS semantic_instance_id", "'minimal_pdb' AS representation", "1L AS rotation_seed",
                                                                         "'q' AS user_prompt", "sha2('q', 256) AS prompt_sha256", "'1' AS displayed_coordinates_sha256")
    dataset = validation.Dataset(instances, renders.unionByName(more), {"F": 1_000_000, "none": 1, "O": 1}, 15, (1, 10), True)
    return validation.violations(dataset)
