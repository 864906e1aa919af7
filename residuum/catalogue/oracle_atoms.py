"""The derived atom relation again, written as DuckDB SQL for the checks."""

from __future__ import annotations

from ..functions import chemistry as chem
from ..sources import tables as t


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else f"'{v}'" for v in r) + ")" for r in rows)


def _atom_geometry() -> str:
    rows = []
    for residue, ordinal, atom, element in t.atom_template():
        radius, turn, height = t.HELIX.get(atom, (0.0, 0.0, 0.0))
        if atom not in t.HELIX and residue not in t.LIGAND_NAMES and residue not in t.METAL_NAMES:
            step = ordinal - 4
            radius, turn, height = 3.3 + 1.1 * step, -17.0 + 14.0 * step, -0.6 - 0.4 * step
        rows.append((residue, ordinal, atom, element, float(radius), float(turn), float(height)))
    return ", ".join(
        f"('{r}', {o}, '{a}', '{e}', {rad!r}::double, {tu!r}::double, {h!r}::double)"
        for r, o, a, e, rad, tu, h in rows)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PARENTS = _values(chem.MODIFIED_PARENT.items())
LETTERS = _values(chem.ONE_LETTER.items())
RADII = ", ".join(f"('{k}', {v!r}::double)" for k, v in chem.VDW_RADIUS.items())

#: Common table expressions; start an oracle with ``WITH`` + ATOMS + ``, ...``.
ATOMS = f"""
template(name, ordinal, atom_name, element, radius, turn, height) AS (VALUES {_atom_geometry()}),
parents(name, parent) AS (VALUES {PARENTS}),
letters(name, letter) AS (VALUES {LETTERS}),
res0 AS (
  SELECT *, vec_id % 160 AS residue_idx, vec_id % 160 % 16 AS place, vec_id % 160 // 16 AS segment FROM embeddings),
res1 AS (
  SELECT *, 'S' || (vec_id // 160) AS structure_id,
    CASE WHEN residue_idx < 80 THEN 'A' ELSE 'B' END AS chain,
    CAST(residue_idx % 80 + 1 AS INT) AS seq_id,
    CASE WHEN place = 15 AND segment % 2 = 0 THEN 'metal' WHEN place = 15 THEN 'ligand' ELSE 'protein' END AS entity,
    CASE WHEN place = 15 AND segment % 2 = 0 THEN {_list(t.METAL_NAMES)}[vec_id // 16 % 3 + 1]
         WHEN place = 15 THEN {_list(t.LIGAND_NAMES)}[vec_id // 32 % 2 + 1]
         WHEN vec_id % 97 = 50 THEN 'SEP'
         ELSE {_list(t.NAMES)}[vec_id * 7 % 20 + 1] END AS name
  FROM res0),
residues AS (
  SELECT r.structure_id, r.residue_idx, r.chain, r.seq_id, r.name, coalesce(p.parent, r.name) AS parent, r.entity,
    CASE WHEN r.entity = 'protein' THEN CAST(row_number() OVER (
      PARTITION BY r.structure_id, r.chain, r.entity ORDER BY r.residue_idx) - 1 AS INT) END AS poly_index,
    r.chain || ':' || CASE WHEN r.entity = 'protein' THEN l.letter ELSE r.name END || r.seq_id AS label,
    r.place, r.segment, r.embedding
  FROM res1 r LEFT JOIN parents p ON p.name = r.name LEFT JOIN letters l ON l.name = coalesce(p.parent, r.name)),
raw_atoms AS (
  SELECT r.*, t.ordinal, t.atom_name, t.element,
    CASE WHEN entity = 'protein' THEN t.radius * cos(radians(place * 100.0::double + t.turn)) ELSE 4.5 END AS ox,
    CASE WHEN entity = 'protein' THEN t.radius * sin(radians(place * 100.0::double + t.turn)) ELSE 4.5 END AS oy,
    CASE WHEN entity = 'protein' THEN place * 1.5::double + t.height ELSE 11.0::double END AS oz,
    CASE WHEN entity = 'protein' AND t.atom_name IN ('N', 'CA', 'C', 'O') THEN 0.5::double
         WHEN entity = 'ligand' THEN 14.0::double ELSE 6.0::double END AS spread
  FROM residues r JOIN template t ON t.name = r.name),
atoms AS MATERIALIZED (
  SELECT structure_id, residue_idx, residue_idx * 32 + ordinal AS atom_idx, atom_name, element,
    printf('%.3f', (segment % 4) * 9.5::double + ox + embedding[ordinal * 3 % 60 + 1]::double * spread)::double AS x,
    printf('%.3f', (segment // 4) * 9.5::double + oy + embedding[ordinal * 3 % 60 + 2]::double * spread)::double AS y,
    printf('%.3f', oz + embedding[ordinal * 3 % 60 + 3]::double * spread)::double AS z,
    chain, seq_id, name, parent, entity, poly_index, label
  FROM raw_atoms),
near AS (
  SELECT a.structure_id, a.atom_idx AS ai, b.atom_idx AS aj, a.residue_idx AS ri, b.residue_idx AS rj,
    a.atom_name AS ni, b.atom_name AS nj, a.element AS ei, b.element AS ej, a.entity AS ti, b.entity AS tj,
    a.chain AS ci, b.chain AS cj, a.poly_index AS pi, b.poly_index AS pj, a.label AS li, b.label AS lj,
    a.name AS mi, b.name AS mj, a.parent AS qi, b.parent AS qj,
    sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d
  FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_idx <> b.atom_idx)
"""
