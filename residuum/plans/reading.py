"""The inverse of the text sinks: structures and labels read back out of prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import structures

#: The line before a structure, the records of one, and what a residue label looks like.
HEAD = "[ \\\\t]*(Structure(?: [0-9]+)?):[ \\\\t]*"
RECORD = "^(ATOM|HETATM|TER|END)"
LABEL = "\\\\b[A-Za-z0-9]:[A-Za-z][A-Za-z0-9]{0,2}?-?[0-9]+\\\\b"
ROLES = ("query", "gold", "evidence")


def blocks(prompts: DataFrame, key: str = "render_id", column: str = "user_prompt") -> DataFrame:
    """``key, block, label, content``: the coordinate lines after each head, up to the first empty line after them.

    Other lines between the head and the records are passed over; a head without records gives no row.
    """
    section = f"(?ms)^{HEAD}$(.*?)(?=^{HEAD}$|\\\\z)"
    found = prompts.selectExpr(key, f"posexplode(arrays_zip(regexp_extract_all({column}, '{section}', 1), regexp_extract_all({column}, '{section}', 2))) AS (block, b)")
    named = found.selectExpr(key, "block", "b.`0` AS label", "split(b.`1`, '\\\\r?\\\\n') AS lines")
    first = f"array_position(transform(lines, l -> l RLIKE '{RECORD}'), true)"
    tail = named.filter(f"{first} > 0").selectExpr(key, "block", "label", f"slice(lines, CAST({first} AS INT), size(lines)) AS lines")
    end = "array_position(transform(lines, l -> trim(l) = ''), true)"
    kept = f"filter(IF({end} > 0, slice(lines, 1, CAST({end} AS INT) - 1), lines), l -> l RLIKE '{RECORD}')"
    return tail.selectExpr(key, "block", "label", f"array_join({kept}, '\\n') AS content")


def prompt_atoms(prompts: DataFrame, key: str = "render_id", column: str = "user_prompt") -> DataFrame:
    """Atoms of the structures inside prompts, with ``key`` and ``label`` of their block."""
    found = blocks(prompts, key, column).selectExpr(key, "label", f"concat_ws('#', {key}, block) AS structure_id", "content")
    return structures.parse_pdb(found.select("structure_id", "content")).join(found.select("structure_id", key, "label"), "structure_id").drop("structure_id")


def highlights(instances: DataFrame) -> DataFrame:
    """``semantic_instance_id, label, chain, number, role``: labels that an instance names, under the first role that names them.

    ``instances`` holds JSON texts ``question_parameters``, ``gold`` and ``evidence``, any of which may be NULL.
    """
    columns = ("question_parameters", "gold", "evidence")
    scans = ", ".join(f"transform(coalesce(regexp_extract_all({c}, '{LABEL}', 0), array()), l -> named_struct('label', l, 'rank', {i}))" for i, c in enumerate(columns))
    rows = instances.selectExpr("semantic_instance_id", f"explode(concat({scans})) AS h").selectExpr("semantic_instance_id", "h.label AS label", "h.rank AS rank")
    rows = rows.groupBy("semantic_instance_id", "label").agg(F.min("rank").alias("rank"))
    return rows.selectExpr("semantic_instance_id", "label", "split(label, ':')[0] AS chain", "CAST(regexp_extract(label, '(-?[0-9]+)$', 1) AS INT) AS number",
                           f"element_at(array({', '.join(repr(r) for r in ROLES)}), rank + 1) AS role")
