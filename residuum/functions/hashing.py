"""Canonical JSON text, content hashes and reproducible seeds, as SQL expression text.

The canonical text is compact JSON with ASCII escapes: the same bytes on every
machine, so that the hash of a value is a stable identifier.
"""

from __future__ import annotations

import json

#: Characters JSON escapes with a backslash and a letter or themselves.
SHORT_ESCAPES = ('"', "\\", "\b", "\f", "\n", "\r", "\t")


def _code_points(text: str) -> str:
    entries = []
    for raw in SHORT_ESCAPES:
        entries += [f"char({ord(raw)})", " || ".join(f"char({ord(c)})" for c in json.dumps(raw)[1:-1])]
    units = "lower(hex(encode(c, 'UTF-16BE')))"
    u = "char(92) || 'u' || "
    return (
        f"array_join(transform(regexp_extract_all({text}, '(?s).', 0), c -> coalesce("
        f"try_element_at(map({', '.join(entries)}), c), CASE WHEN c >= ' ' AND c <= '~' THEN c "
        f"WHEN length({units}) = 8 THEN {u}substr({units}, 1, 4) || {u}substr({units}, 5, 4) "
        f"ELSE {u}{units} END)), '')"
    )


def json_string(text: str) -> str:
    """A JSON string literal. Plain ASCII text skips the per-character path."""
    plain = f"NOT {text} RLIKE '[^ -~]' AND instr({text}, char(34)) = 0 AND instr({text}, char(92)) = 0"
    return f"concat(char(34), CASE WHEN {plain} THEN {text} ELSE {_code_points(text)} END, char(34))"


def json_array(*parts) -> str:
    """Compact JSON array of SQL fragments.

    Plain strings are SQL text expressions and get quoted; ``raw(x)`` marks a value
    whose text is already JSON; Python numbers and ``text("...")`` are constants.
    """
    rendered = [p[1] if isinstance(p, tuple) else f"'{p}'" if isinstance(p, int) else json_string(p) for p in parts]
    return "concat('[', " + ", ',', ".join(rendered) + ", ']')"


def raw(expression: str) -> tuple[str, str]:
    return ("raw", f"CAST({expression} AS STRING)")


def text(constant: str) -> tuple[str, str]:
    quoted = json.dumps(constant)
    return ("raw", "'" + quoted.replace("\\", "\\\\").replace("'", "\\'") + "'")


def json_string_list(values: str) -> str:
    return f"concat('[', array_join(transform({values}, v -> {json_string('v')}), ','), ']')"


def stable_hash(*parts) -> str:
    return f"sha2({json_array(*parts)}, 256)"


def seed_of_digest(digest: str) -> str:
    """First 64 bits of a hex digest with the top bit cleared, as BIGINT."""
    head = f"translate(substr({digest}, 1, 1), '89abcdef', '01234567')"
    return f"CAST(conv(concat({head}, substr({digest}, 2, 15)), 16, 10) AS BIGINT)"


def derive_seed(*parts) -> str:
    return seed_of_digest(stable_hash(*parts))


def json_number(value: str) -> str:
    """A double as JSON writes it: shortest digits, plain from 1e-4 to 1e16, otherwise with a two-digit exponent."""
    size = f"abs({value})"
    plain = f"regexp_replace(regexp_replace(CAST(CAST({value} AS DECIMAL(38, 20)) AS STRING), '0+$', ''), '[.]$', '.0')"
    exponent = f"regexp_replace(regexp_replace(CAST({value} AS STRING), '[.]0E', 'E'), 'E(-?)([0-9]+)$', 'e$1$2')"
    padded = (f"regexp_replace(regexp_replace({exponent}, 'e([0-9])', 'e+$1'), 'e([+-])([0-9])$', 'e$10$2')")
    return (f"CASE WHEN {value} = 0 OR ({size} >= 1e-3 AND {size} < 1e7) THEN CAST({value} AS STRING) "
            f"WHEN {size} >= 1e-4 AND {size} < 1e16 THEN {plain} ELSE {padded} END")


def canonical(value: str, kind) -> str:
    """Compact JSON of any value by its Spark type: sorted keys, ASCII escapes, nulls written out."""
    from pyspark.sql import types as T
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [f"{_quoted(json.dumps(f.name) + ':')}, {canonical(f'{value}.`{f.name}`', f.dataType)}" for f in fields]
        body = f"concat('{{', {', '.join(x for p in parts for x in (p, _quoted(',')))[:-5]}, '}}')" if parts else "'{}'"
    elif isinstance(kind, T.ArrayType):
        name = f"e{abs(hash(value)) % 10 ** 9}"
        body = f"concat('[', array_join(transform({value}, {name} -> {canonical(name, kind.elementType)}), ','), ']')"
    elif isinstance(kind, T.MapType):
        name = f"m{abs(hash(value)) % 10 ** 9}"
        entry = f"concat({json_string(f'{name}.key')}, ':', {canonical(f'{name}.value', kind.valueType)})"
        body = f"concat('{{', array_join(transform(array_sort(map_entries({value})), {name} -> {entry}), ','), '}}')"
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        body = json_number(f"CAST({value} AS DOUBLE)")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        body = f"CAST({value} AS STRING)"
    else:
        body = json_string(f"CAST({value} AS STRING)")
    return f"coalesce({body}, 'null')"


def _quoted(constant: str) -> str:
    return "'" + constant.replace("\\", "\\\\").replace("'", "\\'") + "'"
