"""Reading free-text answers: locating the final value and bringing it to canonical form.

Everything is SQL text over string and array functions, so parsing runs inside the
JVM next to the join that brings the expected answer. Invalid input gives NULL; a NULL
canonical value is a format error.
"""

from __future__ import annotations

from .chemistry import sql_literal

#: Phrases that mark a refusal.
REFUSALS = (
    "i cannot", "i can't", "i am unable", "i'm unable", "cannot answer", "as an ai",
    "i do not have access", "i don't have access", "unable to determine",
    "insufficient information to answer",
)
#: Words that stand for an empty list.
EMPTY_WORDS = ("", "none", "no residues", "empty", "n/a", "-")
#: Fixed patterns. Flags make white space Unicode-wide and keep ``.`` off line feeds only.
MARKER = r"(?iUd)^[^\S\n]*[*_`#>]*[^\S\n]*final\b[*_`]*[^\S\n]*(:)?[*_`]*[^\S\n]*(.*)$"
FIELD = r"(?Ud)^[^\S\n]*[*_`]*([A-Za-z][A-Za-z0-9_ \-]*?)[*_`]*[^\S\n]*:[^\S\n]*(.*)$"
LABEL_ONLY = r"^[A-Za-z][A-Za-z ]*:$"
RESIDUE = r"(?U)^([A-Za-z0-9])[:\s]+([A-Za-z])\s*(-?[0-9]+)$"
ENTITY = r"(?U)^([A-Za-z0-9])[:\s]+([A-Za-z][A-Za-z0-9]{0,2}?)\s*(-?[0-9]+)$"
ATOM = r"(?U)^([A-Za-z0-9])[:\s]+([A-Za-z])\s*(-?[0-9]+)[:\s]+([A-Za-z0-9']{1,4})$"
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
MARKUP = r"(?U)^\s|[`*_]|[\s.]\z"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def _re(pattern: str) -> str:
    return sql_literal(pattern)


def stripped(text: str) -> str:
    return f"regexp_replace({text}, {_re(r'(?U)^\s+|\s+\z')}, '')"


def strip_markup(text: str) -> str:
    """Outer white space, back-ticks, bold markers, emphasis and trailing full stops removed, in that order."""
    out = f"regexp_replace({stripped('raw')}, '^`+|`+$', '')"
    out = f"regexp_replace({out}, {_re(r'(?d)\*\*(.*?)\*\*')}, '$1')"
    out = f"regexp_replace({out}, {_re(r'(?U)^[*_`\s]+|[*_`\s]+\z')}, '')"
    out = stripped(f"regexp_replace({out}, {_re(r'\.+\z')}, '')")
    # Most values have nothing to remove; one pattern tells.
    return let(text, "raw", f"IF(raw RLIKE {_re(MARKUP)}, {out}, raw)")


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it in ``body`` under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def final_marker(text: str) -> str:
    """Index of the last line carrying the marker, or -1; lines are separated by line feeds."""
    return f"array_max(transform(split({text}, '\\n'), (line, i) -> IF(line RLIKE {_re(MARKER)}, i, -1)))"


def final_columns(text: str) -> list[list[str]]:
    """Successive ``selectExpr`` steps that add ``inline`` and ``fields`` to a frame with a text column.

    ``inline`` is the single-line value ('' when there is none) and ``fields`` the named
    values of a multi-line answer; both are NULL when the text has no final block.
    """
    blank = f"{stripped('l')} = ''"
    wrapped = (
        "aggregate(rest, named_struct('v', inline0, 'go', inline0 LIKE '%,', 'begun', false), (s, l) -> CASE "
        f"WHEN NOT s.go THEN s WHEN NOT s.begun AND {blank} THEN s "
        f"WHEN {strip_markup('l')} = '' THEN named_struct('v', s.v, 'go', false, 'begun', true) "
        f"ELSE named_struct('v', concat(s.v, ' ', {strip_markup('l')}), 'go', {strip_markup('l')} LIKE '%,', 'begun', true) END, s -> s.v)"
    )
    key = f"regexp_replace(lower({stripped(f'regexp_extract(l, {_re(FIELD)}, 1)')}), ' ', '_')"
    value = strip_markup(f"regexp_extract(l, {_re(FIELD)}, 2)")
    named = (
        "aggregate(rest, named_struct('f', CAST(map() AS map<string, string>), 'go', inline1 = ''), (s, l) -> CASE "
        f"WHEN NOT s.go THEN s WHEN {blank} THEN named_struct('f', s.f, 'go', size(s.f) = 0) "
        f"WHEN NOT l RLIKE {_re(FIELD)} OR length({key}) = 1 THEN named_struct('f', s.f, 'go', false) "
        f"ELSE named_struct('f', map_concat(map_filter(s.f, (k, v) -> k <> {key}), map({key}, {value})), 'go', true) END, s -> s.f)"
    )
    below = f"coalesce(try_element_at(filter(transform(rest, l -> {strip_markup('l')}), v -> v <> ''), 1), '')"
    return [
        ["*", f"split({text}, '\\n') AS lines", f"{final_marker(text)} AS at"],
        ["* EXCEPT (lines, at)", "at",
         f"IF(at >= 0, {strip_markup(f'regexp_extract(lines[greatest(at, 0)], {_re(MARKER)}, 2)')}, NULL) AS inline0",
         f"IF(at >= 0, split(array_join(slice(lines, at + 2, size(lines)), '\\n'), {_re(LINE_BREAK)}), array('')) AS rest"],
        ["* EXCEPT (inline0)", f"{wrapped} AS inline1"],
        ["* EXCEPT (inline1)", "inline1", f"{named} AS fields1"],
        ["* EXCEPT (inline1, fields1, rest, at)",
         f"CASE WHEN at < 0 THEN NULL WHEN size(fields1) = 0 AND (inline1 = '' OR inline1 RLIKE {_re(LABEL_ONLY)}) "
         f"THEN IF({below} = '', inline1, {below}) ELSE inline1 END AS inline",
         "IF(at < 0, NULL, fields1) AS fields"],
    ]


def looks_like_refusal(text: str) -> str:
    return f"exists({sql_literal(list(REFUSALS))}, m -> contains(lower({text}), m))"


# -- canonical forms ------------------------------------------------------------

def _integer_text(text: str) -> str:
    """Leading zeros dropped, minus kept unless the value is zero."""
    digits = "regexp_replace(num, '^-?0*(?=[0-9])', '')"
    return let(text, "num", let(digits, "dg", "concat(IF(num LIKE '-%' AND dg <> '0', '-', ''), dg)"))


def canonical_residue(token: str) -> str:
    def build(pattern: str) -> str:
        # The pattern spans the whole token.
        return f"concat(upper(regexp_replace(tok, {_re(pattern)}, '$1:$2')), {_integer_text(f'regexp_extract(tok, {_re(pattern)}, 3)')})"
    return let(f"replace({strip_markup(token)}, ' ', '')", "tok",
               f"CASE WHEN tok RLIKE {_re(RESIDUE)} THEN {build(RESIDUE)} WHEN tok RLIKE {_re(ENTITY)} THEN {build(ENTITY)} END")


def canonical_atom(token: str) -> str:
    part = [f"regexp_extract(tok, {_re(ATOM)}, {i})" for i in (1, 2, 3, 4)]
    return let(f"replace({strip_markup(token)}, ' ', '')", "tok",
               f"CASE WHEN tok RLIKE {_re(ATOM)} THEN concat(upper({part[0]}), ':', upper({part[1]}), "
               f"{_integer_text(part[2])}, ':', upper({part[3]})) END")


def pair_parts(token: str) -> str:
    return f"filter(split({strip_markup(token)}, {_re('--+|—|–')}), p -> {stripped('p')} <> '')"


def canonical_pair(token: str) -> str:
    """Unordered pair of residues as ``first--second`` in sorted order."""
    ends = f"array_sort(transform({pair_parts(token)}, p -> {canonical_residue('p')}))"
    return let(ends, "ends", "CASE WHEN size(ends) = 2 AND NOT exists(ends, e -> e IS NULL) THEN array_join(ends, '--') END")


def split_list(text: str) -> str:
    words = f"regexp_replace(cl, {_re(r'(?iU)\band\b')}, ',')"
    items = f"filter(transform(split({words}, '[,;\\n]+'), p -> {stripped('p')}), p -> p <> '')"
    empty = ", ".join(sql_literal(w) for w in EMPTY_WORDS)
    return let(strip_markup(text), "cl", f"IF(lower(cl) IN ({empty}), CAST(array() AS array<string>), {items})")


def _canonical_set(text: str, each: str) -> str:
    return let(f"transform({split_list(text)}, t -> {each})", "vals",
               "CASE WHEN NOT exists(vals, v -> v IS NULL) THEN array_sort(array_distinct(vals)) END")


def canonical_residue_set(text: str) -> str:
    return _canonical_set(text, canonical_residue("t"))


def canonical_pair_set(text: str) -> str:
    return _canonical_set(text, canonical_pair("t"))


def canonical_string_set(text: str) -> str:
    return f"array_sort(array_distinct(filter(transform({split_list(text)}, t -> upper({strip_markup('t')})), t -> t <> '')))"


def canonical_category(text: str, allowed: str) -> str:
    """The allowed option equal to the text, else the longest one the text contains as a word.

    ``allowed`` is an array expression; NULL means any text is its own category.
    """
    squeezed = f"regexp_replace({strip_markup(text)}, {_re(r'(?U)\s+')}, ' ')"
    by_length = (f"array_sort({allowed}, (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) "
                 f"ELSE CAST(array_position({allowed}, a) - array_position({allowed}, b) AS INT) END)")
    inside = f"filter({by_length}, o -> cl RLIKE concat('(?U)\\\\b\\\\Q', lower(o), '\\\\E\\\\b'))"
    exact = f"filter({allowed}, o -> lower(o) = cl)"
    return let(f"lower({stripped(squeezed)})", "cl", f"CASE WHEN {allowed} IS NULL THEN cl "
               f"ELSE coalesce(try_element_at({exact}, -1), try_element_at({inside}, 1)) END")


def canonical_boolean(text: str) -> str:
    cleaned = f"lower({strip_markup(text)})"
    return f"CASE WHEN {cleaned} IN ('yes', 'y', 'true', 't') THEN true WHEN {cleaned} IN ('no', 'n', 'false', 'f') THEN false END"


def canonical_choice(text: str, options: str = "CAST(NULL AS array<string>)") -> str:
    letter = f"regexp_extract(upper({strip_markup(text)}), {_re(r'(?U)^\(?([A-Z])\)?\b')}, 1)"
    return let(letter, "lt", f"CASE WHEN lt <> '' AND ({options} IS NULL OR size({options}) = 0 "
               f"OR array_contains(transform({options}, o -> upper(o)), lt)) THEN lt END")


def canonical_number(text: str) -> str:
    cleaned = f"replace(replace({strip_markup(text)}, 'Å', ''), 'angstrom', '')"
    return f"try_cast(nullif(regexp_extract({cleaned}, '{NUMBER}', 0), '') AS DOUBLE)".replace("\\.", "\\\\.")


def canonical_integer(text: str) -> str:
    return let(canonical_number(text), "nr", "CASE WHEN abs(nr - rint(nr)) <= 1e-9 THEN CAST(rint(nr) AS BIGINT) END")


def canonical_triple(text: str) -> str:
    cleaned = f"translate({strip_markup(text)}, '()[]', '    ')"
    return let(f"regexp_extract_all({cleaned}, {_re(NUMBER)}, 0)", "nrs",
               "CASE WHEN size(nrs) = 3 THEN transform(nrs, n -> CAST(n AS DOUBLE)) END")


def canonical_path(text: str) -> str:
    parts = f"filter(split({strip_markup(text)}, '->|→'), p -> {stripped('p')} <> '')"
    return let(f"transform({parts}, p -> {canonical_residue('p')})", "nodes",
               "CASE WHEN size(nodes) >= 2 AND NOT exists(nodes, n -> n IS NULL) THEN nodes END")
