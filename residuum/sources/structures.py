"""Coordinate files as raw atom records: fixed-column PDB and mmCIF, and assembly expansion.

A file is one row of text; its lines become rows at once and are cut up by string
functions, so a large archive is parsed file-parallel inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

RAW = ["structure_id", "ord", "is_hetatm", "atom_name", "altloc", "name", "chain", "seq_id", "icode", "x", "y", "z",
       "occupancy", "bfactor", "element", "model"]
#: One mmCIF token: quoted text or a run of non-blanks.
TOKEN = r"""'[^']*'(?=\\s|$)|"[^"]*"(?=\\s|$)|\\S+"""


def files(spark: SparkSession, path: str) -> DataFrame:
    """``structure_id, content``: the id is the file name without directories and extension."""
    name = "regexp_extract(_metadata.file_path, '([^/]+?)(\\\\.[^./]*)?$', 1)"
    return spark.read.text(path, wholetext=True).selectExpr(f"{name} AS structure_id", "value AS content")


def _lines(contents: DataFrame) -> DataFrame:
    return contents.selectExpr("structure_id", "posexplode(split(content, '\\\\r?\\\\n')) AS (line_no, line)")


def parse_pdb(contents: DataFrame) -> DataFrame:
    """ATOM and HETATM records of the first model, by column position."""
    records = _lines(contents.selectExpr(
        "structure_id", "split(content, '(?m)^ENDMDL')[0] AS content")).filter("line LIKE 'ATOM  %' OR line LIKE 'HETATM%'")

    def cut(start: int, end: int) -> str:
        return f"substr(line, {start}, {end - start + 1})"

    symbol = f"trim({cut(77, 78)})"
    guess = f"regexp_extract(trim({cut(13, 16)}), '[A-Za-z]', 0)"
    return records.selectExpr(
        "structure_id", "CAST(line_no AS BIGINT) AS ord", "line LIKE 'HETATM%' AS is_hetatm", f"trim({cut(13, 16)}) AS atom_name",
        f"trim({cut(17, 17)}) AS altloc", f"upper(trim({cut(18, 20)})) AS name", f"trim({cut(22, 22)}) AS chain",
        f"CAST(trim({cut(23, 26)}) AS INT) AS seq_id", f"{cut(27, 27)} AS icode",
        *[f"CAST(trim({cut(31 + 8 * i, 38 + 8 * i)}) AS DOUBLE) AS {c}" for i, c in enumerate("xyz")],
        f"coalesce(try_cast(trim({cut(55, 60)}) AS DOUBLE), 1D) AS occupancy", f"coalesce(try_cast(trim({cut(61, 66)}) AS DOUBLE), 0D) AS bfactor",
        f"upper(IF({symbol} = '', {guess}, {symbol})) AS element", "0 AS model")


def _loop_header(category: str) -> str:
    return f"regexp_extract_all(content, '(?m)^_{category}\\\\.(\\\\S+)', 1)"


def parse_mmcif(contents: DataFrame) -> DataFrame:
    """The ``_atom_site`` loop of the first model, columns found by their header names."""
    # Quotes only ever wrap tokens, so they are removed after the split.
    rows = _lines(contents.selectExpr("structure_id", "content")).filter("line LIKE 'ATOM %' OR line LIKE 'HETATM %'")
    heads = contents.selectExpr("structure_id", f"{_loop_header('atom_site')} AS head")
    values = rows.join(heads, "structure_id").selectExpr(
        "structure_id", "line_no", f"transform(regexp_extract_all(line, {_sql(TOKEN)}, 0), t -> IF(length(t) > 1 AND substr(t, 1, 1) IN (char(34), char(39)), "
        "substr(t, 2, length(t) - 2), t)) AS v", "head")

    def item(*names: str) -> str:
        found = [f"nullif(nullif(try_element_at(v, CAST(array_position(head, '{n}') AS INT)), '?'), '.')" for n in names]
        safe = [f"IF(array_position(head, '{n}') > 0, {e}, NULL)" for n, e in zip(names, found)]
        return f"coalesce({', '.join(safe)})" if len(safe) > 1 else safe[0]

    parsed = values.selectExpr(
        "structure_id", "CAST(line_no AS BIGINT) AS ord", f"{item('group_PDB')} = 'HETATM' AS is_hetatm",
        f"{item('auth_atom_id', 'label_atom_id')} AS atom_name", f"coalesce({item('label_alt_id')}, '') AS altloc",
        f"upper({item('auth_comp_id', 'label_comp_id')}) AS name", f"{item('auth_asym_id', 'label_asym_id')} AS chain",
        f"CAST({item('auth_seq_id', 'label_seq_id')} AS INT) AS seq_id", f"coalesce({item('pdbx_PDB_ins_code')}, ' ') AS icode",
        *[f"CAST({item(f'Cartn_{c}')} AS DOUBLE) AS {c}" for c in "xyz"], f"coalesce(CAST({item('occupancy')} AS DOUBLE), 1D) AS occupancy",
        f"coalesce(CAST({item('B_iso_or_equiv')} AS DOUBLE), 0D) AS bfactor", f"upper({item('type_symbol')}) AS element",
        f"coalesce(CAST({item('pdbx_PDB_model_num')} AS INT), 1) AS model_num", f"{item('label_asym_id')} AS label_chain")
    first = parsed.groupBy("structure_id").agg(F.min("model_num").alias("model_num"))
    return parsed.join(first, ["structure_id", "model_num"]).selectExpr(*RAW[:-1], "0 AS model", "label_chain")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "\\'") + "'"


def loop_table(contents: DataFrame, category: str) -> DataFrame:
    """Rows of a small mmCIF category as ``structure_id, row, item, value``, written as a loop or as single items.

    Categories are separated by lines starting with ``#``; the rows of a loop are its tokens
    after the header, cut to the header's length.
    """
    section = f"explode(filter(split(content, '(?m)^#'), s -> s RLIKE '(?m)^_{category}\\\\.')) AS content"
    unquote = ("transform({t}, t -> IF(length(t) > 1 AND substr(t, 1, 1) IN (char(34), char(39)), substr(t, 2, length(t) - 2), t))")
    parts = contents.selectExpr("structure_id", section).selectExpr(
        "structure_id", "content RLIKE '(?m)^loop_' AS is_loop", f"{_loop_header(category)} AS head",
        unquote.format(t=f"regexp_extract_all(regexp_replace(content, '(?m)^loop_|^_{category}\\\\.\\\\S+', ''), {_sql(TOKEN)}, 0)") + " AS v")
    return parts.selectExpr("structure_id", "head", "posexplode(v) AS (at, value)").selectExpr(
        "structure_id", "at div size(head) AS row", "element_at(head, CAST(at % size(head) + 1 AS INT)) AS item", "value")


def assembly_operators(contents: DataFrame) -> DataFrame:
    """``structure_id, oper_id, m`` with twelve numbers: a row-major rotation and a shift."""
    names = [f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"vector[{i}]" for i in (1, 2, 3)]
    rows = loop_table(contents, "pdbx_struct_oper_list")
    pivoted = rows.groupBy("structure_id", "row").agg(
        F.expr("max(value) FILTER (WHERE item = 'id') AS oper_id"),
        F.expr("array(" + ", ".join(f"CAST(max(value) FILTER (WHERE item = '{n}') AS DOUBLE)" for n in names) + ") AS m"))
    return pivoted.select("structure_id", "oper_id", "m")


def expanded_operators(expression: str) -> str:
    """SQL for an operator expression as an array of products, each an array of operator ids.

    Factors stand in parentheses, or bare; a factor is a list of ids and ``a-b`` ranges. The last factor runs fastest:
    ``(1-2)(3,P)`` gives 1·3, 1·P, 2·3, 2·P. An expression of one factor gives arrays of one.
    """
    span = ("IF(part RLIKE '^[0-9]+-[0-9]+$', transform(sequence(CAST(split(part, '-')[0] AS INT), CAST(split_part(part, '-', -1) AS INT)), n -> CAST(n AS STRING)), array(part))")
    # A bare list such as 1,2 is one factor; a comma between two parentheses separates nothing.
    factors = f"filter(regexp_extract_all(translate({expression}, ' \"\\'', ''), '[^()]+', 0), f -> trim(BOTH ',' FROM f) <> '')"
    ids = f"transform({factors}, f -> flatten(transform(split(trim(BOTH ',' FROM f), ','), part -> {span})))"
    return (f"aggregate({ids}, array(CAST(array() AS array<string>)), (products, factor) -> "
            "flatten(transform(products, p -> transform(factor, o -> concat(p, array(o))))))")


def composed(first: str, second: str) -> str:
    """The twelve numbers of ``first`` after ``second``."""
    turn = [f"{first}[{3 * i}] * {second}[{j}] + {first}[{3 * i + 1}] * {second}[{3 + j}] + {first}[{3 * i + 2}] * {second}[{6 + j}]" for i in range(3) for j in range(3)]
    shift = [f"{first}[{3 * i}] * {second}[9] + {first}[{3 * i + 1}] * {second}[10] + {first}[{3 * i + 2}] * {second}[11] + {first}[{9 + i}]" for i in range(3)]
    return f"array({', '.join(turn + shift)})"


def assembly_chains(contents: DataFrame, assembly_id: str) -> DataFrame:
    """``structure_id, label_chain, copy, ops``: the products of operators that an assembly applies to a chain, in the order of the file."""
    rows = loop_table(contents, "pdbx_struct_assembly_gen").groupBy("structure_id", "row").agg(
        *[F.expr(f"max(value) FILTER (WHERE item = '{n}') AS {n}") for n in ("assembly_id", "oper_expression", "asym_id_list")])
    flat = rows.filter(f"assembly_id = '{assembly_id}'").selectExpr("structure_id", "row", "explode(split(asym_id_list, ',')) AS label_chain", "oper_expression").selectExpr(
        "structure_id", "row", "trim(label_chain) AS label_chain", f"posexplode({expanded_operators('oper_expression')}) AS (place, ops)")
    return flat.selectExpr("structure_id", "label_chain", "row_number() OVER (PARTITION BY structure_id, label_chain ORDER BY row, place) - 1 AS copy", "ops")


def assembly_moves(contents: DataFrame, assembly_id: str) -> DataFrame:
    """``structure_id, label_chain, copy, m``: one composed move per copy; the last operator of a product acts first. An unknown operator is an error."""
    chains = assembly_chains(contents, assembly_id)
    steps = chains.selectExpr("structure_id", "label_chain", "copy", "posexplode(ops) AS (step, oper_id)").join(
        assembly_operators(contents), ["structure_id", "oper_id"], "left").selectExpr(
        "structure_id", "label_chain", "copy", "step", "IF(m IS NULL, raise_error(concat('unknown operator ', oper_id, ' in ', structure_id)), m) AS m")
    unit = "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D)"
    return steps.groupBy("structure_id", "label_chain", "copy").agg(
        F.expr(f"aggregate(transform(array_sort(collect_list(struct(step, m))), s -> s.m), {unit}, (a, b) -> {composed('a', 'b')}) AS m"))


def expand_assembly(raw: DataFrame, contents: DataFrame, assembly_id: str) -> DataFrame:
    """Atoms of a biological assembly: one copy per chain and operator, later copies in renamed chains.

    A structure without the assembly is an error, not an empty result.
    """
    chains = stage(assembly_moves(contents, assembly_id))
    known = contents.select("structure_id").join(chains.select("structure_id").distinct().withColumn("ok", F.lit(True)), "structure_id", "left")
    checked = known.filter("ok OR raise_error(concat('unknown biological assembly in ', structure_id))").select("structure_id")
    moves = chains.join(checked, "structure_id", "left_semi")
    joined = raw.join(moves, ["structure_id", "label_chain"])
    moved = {c: f"m[{3 * r}] * x + m[{3 * r + 1}] * y + m[{3 * r + 2}] * z + m[{9 + r}]" for r, c in enumerate("xyz")}
    special = {"chain": "IF(copy = 0, chain, concat(chain, copy + 1))", "ord": "copy * 1000000000L + ord", **moved}
    return joined.selectExpr(*[f"{special[c]} AS {c}" if c in special else c for c in RAW])


# -- text sinks -------------------------------------------------------------------

def minimal_pdb(atoms: DataFrame) -> DataFrame:
    """``structure_id, line_no, line``: fixed-column records, TER where a chain ends on a polymer residue, and END.

    Line numbers follow from the atom's place and the number of chains before it, so lines
    of one structure can be written by many tasks and sorted only where a file needs it.
    """
    residues = atoms.groupBy("structure_id", "residue_idx", "chain", "polymer_kind", "name", "seq_id").agg(F.max("serial").alias("last"))
    after = residues.selectExpr("structure_id", "residue_idx - 1 AS residue_idx", "chain AS next_chain", "polymer_kind AS next_kind")
    ends = residues.filter("polymer_kind IS NOT NULL").join(after, ["structure_id", "residue_idx"], "left").filter(
        "next_chain IS NULL OR next_chain <> chain").selectExpr("structure_id", "last", "name", "chain", "seq_id")
    breaks = ends.groupBy("structure_id").agg(F.expr("array_sort(collect_list(last)) AS lasts"))
    counted = atoms.join(breaks, "structure_id", "left").selectExpr(
        "*", "coalesce(size(filter(lasts, l -> l < serial)), 0) + serial AS number")
    # A one-letter element starts in column 14, anything wider in column 13.
    narrow = "length(atom_name) < 4 AND length(element) = 1 AND NOT atom_name RLIKE '^[0-9]'"
    name = f"IF({narrow}, concat(' ', rpad(atom_name, 3, ' ')), rpad(atom_name, 4, ' '))"
    record = (f"concat(IF(polymer_kind IS NULL, 'HETATM', 'ATOM  '), lpad(number, 5, ' '), ' ', {name}, ' ', lpad(name, 3, ' '), ' ', chain, "
              "lpad(seq_id, 4, ' '), icode, '   ', format_string('%8.3f%8.3f%8.3f%6.2f%6.2f', x, y, z, occupancy, bfactor), "
              "'          ', lpad(element, 2, ' '))")
    lines = counted.selectExpr("structure_id", "CAST(number AS BIGINT) AS line_no", f"rtrim({record}) AS line")
    ters = ends.join(breaks, "structure_id").selectExpr(
        "structure_id", "CAST(last + size(filter(lasts, l -> l < last)) + 1 AS BIGINT) AS line_no", "name", "chain", "seq_id").selectExpr(
        "structure_id", "line_no", "concat('TER   ', lpad(line_no, 5, ' '), '      ', lpad(name, 3, ' '), ' ', chain, lpad(seq_id, 4, ' ')) AS line")
    final = lines.unionByName(ters)
    close = final.groupBy("structure_id").agg(F.expr("max(line_no) + 1 AS line_no")).selectExpr("structure_id", "line_no", "'END' AS line")
    return final.unionByName(close)


TABLE_HEADER = "record,chain,resnum,resname,atom,element,x,y,z"  # fixed value


def normalized_table(atoms: DataFrame) -> DataFrame:
    """``structure_id, line_no, line``: the comma-separated form, header first."""
    row = ("concat_ws(',', IF(polymer_kind IS NULL, 'HETATM', 'ATOM'), chain, seq_id, name, atom_name, element, "
           "format_string('%.3f', x), format_string('%.3f', y), format_string('%.3f', z))")
    heads = atoms.select("structure_id").distinct().selectExpr("structure_id", "0L AS line_no", f"'{TABLE_HEADER}' AS line")
    return heads.unionByName(atoms.selectExpr("structure_id", "CAST(serial AS BIGINT) AS line_no", f"{row} AS line"))


def parse_normalized(lines: DataFrame) -> DataFrame:
    """Back from table lines; a wrong header or column count is an error."""
    checked = lines.selectExpr(
        "structure_id", "line_no", "line", "split(line, ',') AS v",
        f"CASE WHEN line_no = 0 AND line <> '{TABLE_HEADER}' THEN raise_error('unexpected table header') "
        "WHEN size(split(line, ',')) <> 9 THEN raise_error(concat('unexpected column count in line ', line_no)) ELSE true END AS ok")

    def body(i: int) -> str:
        # The filter below may run after this projection, so the header must not reach a cast.
        return f"IF(line_no = 0, NULL, v[{i}])"

    return checked.filter("ok AND line_no > 0").selectExpr(
        "structure_id", "line_no AS serial", "v[0] AS record", "v[1] AS chain", f"CAST({body(2)} AS INT) AS seq_id", "v[3] AS name", "v[4] AS atom_name",
        "v[5] AS element", *[f"CAST({body(6 + i)} AS DOUBLE) AS {c}" for i, c in enumerate("xyz")])


def entity_legend(atoms: DataFrame) -> DataFrame:
    """Ligands with their heavy-atom count and metals by element, one line each in file order (fixed wording)."""
    rows = atoms.filter("entity IN ('ligand', 'metal')").groupBy("structure_id", "residue_idx", "label", "entity").agg(
        F.expr("count(*) AS n"), F.expr("first(element) AS element"))
    return rows.selectExpr("structure_id", "residue_idx",
                           "IF(entity = 'ligand', concat(label, ': non-polymer ligand with ', n, ' heavy atoms'), concat(label, ': ', initcap(element), ' ion')) AS line")


def as_documents(lines: DataFrame) -> DataFrame:
    """One text per structure. The text of a structure is one value by nature."""
    return lines.groupBy("structure_id").agg(
        F.expr("concat(array_join(transform(array_sort(collect_list(struct(line_no, line))), l -> l.line), '\\n'), '\\n') AS text"))
