"""Text renderings of the derived structures."""

from __future__ import annotations

from ..sources import structures
from .contact_queries import W
from .data import atoms
from .registry import query


def _ready(spark, sf_dir):
    """Atoms with the record fields a text needs. The serial is the place of the atom in its structure."""
    from ..operators.sequence import BLOCK_ROWS, numbered
    placed = numbered(atoms(spark, sf_dir), ["structure_id"], ["atom_idx"], f"atom_idx div {BLOCK_ROWS}", "place")
    return placed.selectExpr("* EXCEPT (place)", "place + 1 AS serial", "' ' AS icode", "1D AS occupancy", "0D AS bfactor", "entity <> 'protein' AS is_hetatm")


_SERIAL = "o AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY atom_idx) AS serial FROM atoms)"


@query("render_table", f"""{W}, {_SERIAL} SELECT structure_id, serial AS line_no, CASE WHEN entity = 'protein' THEN 'ATOM' ELSE 'HETATM' END || ',' || chain || ',' || seq_id || ',' || name || ','
    || atom_name || ',' || element || ',' || printf('%.3f,%.3f,%.3f', x, y, z) AS line FROM o
  UNION ALL SELECT DISTINCT structure_id, 0, 'record,chain,resnum,resname,atom,element,x,y,z' FROM o""")
def render_table(spark, sf_dir):
    return structures.normalized_table(_ready(spark, sf_dir))


@query("render_pdb_atoms", f"""{W}, {_SERIAL} SELECT structure_id, substr(printf('%-6s', CASE WHEN entity = 'protein' THEN 'ATOM' ELSE 'HETATM' END), 1, 6) AS record,
    CASE WHEN length(element) = 1 AND length(atom_name) < 4 THEN ' ' || rpad(atom_name, 3, ' ') ELSE rpad(atom_name, 4, ' ') END || ' ' || lpad(name, 3, ' ') || ' ' || chain || lpad(seq_id::VARCHAR, 4, ' ') AS ident,
    printf('%8.3f%8.3f%8.3f', x, y, z) || '  1.00  0.00          ' || lpad(element, 2, ' ') AS body FROM o""")
def render_pdb_atoms(spark, sf_dir):
    lines = structures.minimal_pdb(_ready(spark, sf_dir)).filter("line LIKE 'ATOM%' OR line LIKE 'HETATM%'")
    return lines.selectExpr("structure_id", "substr(line, 1, 6) AS record", "substr(line, 13, 14) AS ident", "substr(line, 31, 48) AS body")


@query("entity_legend", f"""{W} SELECT structure_id, residue_idx, label || CASE entity WHEN 'ligand' THEN ': non-polymer ligand with ' || count(*) || ' heavy atoms'
    ELSE ': ' || upper(min(element)[1]) || lower(substr(min(element), 2)) || ' ion' END AS line FROM atoms WHERE entity <> 'protein' GROUP BY structure_id, residue_idx, label, entity""")
def entity_legend(spark, sf_dir):
    return structures.entity_legend(atoms(spark, sf_dir)).select("structure_id", "residue_idx", "line")
