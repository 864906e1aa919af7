"""Shape checks of provider responses: JSON of unknown form, each failed rule a row.

A response is read as a variant; nothing is inferred and nothing raises. Rules are tried in order and the first that
fails is the error of the response, as a reader would report it; :func:`violations` lists all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where providers put a reasoning trace, in order of preference.
REASONING_FIELDS = ("reasoning_content", "reasoning")


def _kind(path: str) -> str:
    """object, array, string, number, boolean, null, or SQL NULL if the path is absent."""
    found = f"schema_of_variant(try_variant_get(body, '{path}', 'variant'))"
    return (f"CASE WHEN try_variant_get(body, '{path}', 'variant') IS NULL THEN NULL WHEN {found} LIKE 'OBJECT%' THEN 'object' WHEN {found} LIKE 'ARRAY%' THEN 'array' "
            f"WHEN {found} = 'STRING' THEN 'string' WHEN {found} = 'BOOLEAN' THEN 'boolean' WHEN {found} = 'VOID' THEN 'null' ELSE 'number' END")


def _text(path: str) -> str:
    return f"try_variant_get(body, '{path}', 'string')"


def _truthy(kind: str, text: str) -> str:
    """What counts as a declared error: anything but null, false, zero and empty values."""
    return f"coalesce({kind} NOT IN ('null') AND coalesce({text}, '') NOT IN ('', 'false', '0', '0.0', '{{}}', '[]'), false)"


def parsed(responses: DataFrame, column: str = "body") -> DataFrame:
    """``responses`` with the kinds of the parts that the rules look at; text that is no JSON has no kind at all."""
    read = responses.withColumn("_source", F.col(column)).withColumn("body", F.expr("try_parse_json(_source)"))
    paths = {"root": "$", "error": "$.error", "choices": "$.choices", "choice": "$.choices[0]", "choice_error": "$.choices[0].error", "message": "$.choices[0].message",
             "content": "$.choices[0].message.content", "refusal": "$.choices[0].message.refusal", "usage": "$.usage"}
    kinds = read.selectExpr("*", *[f"{_kind(p)} AS _{n}" for n, p in paths.items()],
                            f"{_text('$.error')} AS _error_text", f"{_text('$.error.message')} AS _error_message", f"{_text('$.choices[0].error')} AS _choice_error_text",
                            f"{_text('$.choices[0].error.message')} AS _choice_error_message", f"{_text('$.choices[0].finish_reason')} AS _finish")
    return kinds


#: Name, condition and message of every rule, in the order in which they are tried. The messages are fixed values.
RULES = (
    ("not_an_object", "NOT coalesce(_root = 'object', false)", "'response was not an object'"),
    ("declared_error", _truthy("_error", "_error_text"), "coalesce(_error_message, _error_text)"),
    ("choice_error", f"_choice = 'object' AND ({_truthy('_choice_error', '_choice_error_text')} OR coalesce(_finish = 'error', false))",
     f"IF({_truthy('_choice_error', '_choice_error_text')}, coalesce(_choice_error_message, _choice_error_text), 'generation failed')"),
    ("no_choices", "NOT coalesce(_choices = 'array' AND _choice IS NOT NULL, false)", "'response contained no choices'"),
    ("choice_not_an_object", "_choice IS NOT NULL AND _choice <> 'object'", "'response choice was not an object'"),
    ("no_message", "_choice = 'object' AND NOT coalesce(_message = 'object', false)", "'response choice contained no message object'"),
    ("content_not_text", "_message = 'object' AND coalesce(_content, 'null') NOT IN ('null', 'string')", "'response message content was not text'"),
    ("refusal_not_text", "_message = 'object' AND coalesce(_refusal, 'null') NOT IN ('null', 'string')", "'response message refusal was not text'"),
    ("usage_not_an_object", "_root = 'object' AND coalesce(_usage, 'null') NOT IN ('null', 'object')", "'response usage was not an object'"),
)


def violations(responses: DataFrame, key: str, column: str = "body") -> DataFrame:
    """``key, rule_no, rule, message``: every rule that a response breaks."""
    listed = ", ".join(f"IF({condition}, named_struct('rule_no', {i}, 'rule', '{name}', 'message', {message}), NULL)" for i, (name, condition, message) in enumerate(RULES))
    return parsed(responses, column).selectExpr(key, f"explode(filter(array({listed}), v -> v IS NOT NULL)) AS v").selectExpr(key, "v.*")


def errors(responses: DataFrame, key: str, column: str = "body") -> DataFrame:
    """``key, error``: the first broken rule of each response, NULL for a good one."""
    cases = " ".join(f"WHEN {condition} THEN {message}" for _, condition, message in RULES)
    return parsed(responses, column).selectExpr(key, f"CASE {cases} END AS error")


def reasoning(responses: DataFrame, key: str, column: str = "body") -> DataFrame:
    """``key, reasoning``: the first trace that carries text, in the message before the choice; lists of parts are joined by line."""
    options = []
    for name in REASONING_FIELDS:
        for at in ("$.choices[0].message", "$.choices[0]"):
            options.append(f"IF({_kind(f'{at}.{name}')} = 'string', nullif(regexp_replace({_text(f'{at}.{name}')}, '^\\\\s+$', ''), ''), NULL)")
            parts = f"transform(try_variant_get(body, '{at}.{name}', 'array<variant>'), p -> try_variant_get(p, '$.text', 'string'))"
            options.append(f"nullif(trim(array_join(filter({parts}, p -> p IS NOT NULL), '\\n')), '')")
    read = responses.withColumn("_source", F.col(column)).withColumn("body", F.expr("try_parse_json(_source)"))
    return read.selectExpr(key, f"coalesce({', '.join(options)}, '') AS reasoning")
