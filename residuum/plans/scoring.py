"""Parsing and scoring stored responses: one plan, no model in the loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as an
from ..operators.keyed import latest
from ..session import widened

DISTANCE_TOLERANCE, TRIPLE_TOLERANCE = 0.02, 0.001  # fixed values
SCALAR_SCHEMAS = ("residue", "atom", "category", "multiple_choice", "residue_pair")
SET_SCHEMAS = ("string_set", "residue_set", "residue_pair_set")
OTHER_SCHEMAS = ("boolean", "integer", "distance", "numeric_triple", "ordered_path", "two_interaction_sets")

#: Columns a parsed answer may fill; which one depends on the schema.
PARSED = {"text": "string", "number": "double", "flag": "boolean", "items": "array<string>",
          "numbers": "array<double>", "gained": "array<string>", "lost": "array<string>"}


def with_final(df: DataFrame, text: str = "response") -> DataFrame:
    """Add ``inline`` and ``fields`` of the last final block."""
    df = widened(df)
    for step in an.final_columns(text):
        df = df.selectExpr(*step)
    return df


def _two_sets(which: str) -> str:
    chunks = f"filter(transform(split(inline, ';|[|]'), c -> {an.stripped('c')}), c -> c RLIKE {an._re(an.FIELD)})"
    key = f"lower({an.stripped(f'regexp_extract(c, {an._re(an.FIELD)}, 1)')})"
    one_line = f"try_element_at(transform(filter({chunks}, c -> {key} = '{which}'), c -> regexp_extract(c, {an._re(an.FIELD)}, 2)), -1)"
    source = f"IF(size(fields) > 0, try_element_at(fields, '{which}'), {one_line})"
    return an.canonical_pair_set(source)


def with_parsed(df: DataFrame, schema: str = "answer_schema", allowed: str = "categories", options: str = "options") -> DataFrame:
    """Canonical value of ``inline``/``fields`` by schema, in the typed columns of :data:`PARSED`."""
    s = schema
    columns = {
        "text": f"CASE {s} WHEN 'residue' THEN {an.canonical_residue('inline')} WHEN 'atom' THEN {an.canonical_atom('inline')} "
                f"WHEN 'residue_pair' THEN {an.canonical_pair('inline')} WHEN 'category' THEN {an.canonical_category('inline', allowed)} "
                f"WHEN 'multiple_choice' THEN {an.canonical_choice('inline', options)} END",
        "number": f"CASE {s} WHEN 'distance' THEN {an.canonical_number('inline')} WHEN 'integer' THEN CAST({an.canonical_integer('inline')} AS DOUBLE) END",
        "flag": f"CASE WHEN {s} = 'boolean' THEN {an.canonical_boolean('inline')} END",
        "items": f"CASE {s} WHEN 'string_set' THEN {an.canonical_string_set('inline')} WHEN 'residue_set' THEN {an.canonical_residue_set('inline')} "
                 f"WHEN 'residue_pair_set' THEN {an.canonical_pair_set('inline')} WHEN 'ordered_path' THEN {an.canonical_path('inline')} END",
        "numbers": f"CASE WHEN {s} = 'numeric_triple' THEN {an.canonical_triple('inline')} END",
        "gained": f"CASE WHEN {s} = 'two_interaction_sets' THEN {_two_sets('gained')} END",
        "lost": f"CASE WHEN {s} = 'two_interaction_sets' THEN {_two_sets('lost')} END",
    }
    parsed = df.selectExpr("*", *[f"{v} AS parsed_{k}" for k, v in columns.items()])
    value = ("coalesce(parsed_text IS NOT NULL OR parsed_number IS NOT NULL OR parsed_flag IS NOT NULL OR parsed_items IS NOT NULL "
             "OR parsed_numbers IS NOT NULL OR (parsed_gained IS NOT NULL AND parsed_lost IS NOT NULL), false)")
    return parsed.selectExpr("*", f"NOT {value} AS format_error")


def f1(gold: str, predicted: str) -> str:
    """Set F1; two empty sets agree perfectly. Arguments are array expressions without duplicates."""
    hits = f"size(array_intersect({gold}, {predicted}))"
    total = f"(size({gold}) + size({predicted}))"
    return f"CASE WHEN {total} = 0 THEN 1D ELSE 2D * {hits} / {total} END"


def same_set(gold: str, predicted: str) -> str:
    return f"(size({gold}) = size({predicted}) AND size(array_except({gold}, {predicted})) = 0)"


def precision(gold: str, predicted: str) -> str:
    return (f"CASE WHEN size({predicted}) = 0 THEN IF(size({gold}) = 0, 1D, 0D) "
            f"ELSE size(array_intersect({gold}, {predicted})) / CAST(size({predicted}) AS DOUBLE) END")


def recall(gold: str, predicted: str) -> str:
    return precision(predicted, gold)


def per_position(gold: str, predicted: str) -> str:
    """Share of path positions that agree, over the length of the expected path."""
    return (f"aggregate(zip_with({gold}, {predicted}, (a, b) -> IF(a = b, 1D, 0D)), 0D, (s, v) -> s + coalesce(v, 0D)) "
            f"/ greatest(size({gold}), 1)")


def with_score(df: DataFrame, schema: str = "answer_schema", tolerance: str = "tolerance") -> DataFrame:
    """Add ``score`` and ``correct`` by comparing ``parsed_*`` with ``gold_*`` of the same type.

    A truncated response or a refusal signalled by the provider scores zero even when it parses.
    """
    s = schema
    dist = f"abs(parsed_number - gold_number) <= coalesce({tolerance}, {DISTANCE_TOLERANCE}D)"
    triple = (f"NOT exists(zip_with(parsed_numbers, gold_numbers, (p, g) -> abs(p - g) <= "
              f"coalesce({tolerance}, {TRIPLE_TOLERANCE}D)), ok -> NOT ok)")
    scalar = ", ".join(f"'{v}'" for v in SCALAR_SCHEMAS)
    sets = ", ".join(f"'{v}'" for v in SET_SCHEMAS)
    others = ", ".join(f"'{v}'" for v in OTHER_SCHEMAS)
    correct = (
        f"CASE WHEN format_error THEN false WHEN {s} IN ({scalar}) THEN parsed_text = gold_text "
        f"WHEN {s} = 'boolean' THEN parsed_flag = gold_flag WHEN {s} = 'integer' THEN parsed_number = gold_number "
        f"WHEN {s} = 'distance' THEN {dist} WHEN {s} = 'numeric_triple' THEN {triple} "
        f"WHEN {s} IN ({sets}) THEN {same_set('gold_items', 'parsed_items')} WHEN {s} = 'ordered_path' THEN parsed_items = gold_items "
        f"WHEN {s} = 'two_interaction_sets' THEN {same_set('gold_gained', 'parsed_gained')} AND {same_set('gold_lost', 'parsed_lost')} END")
    score = (
        f"CASE WHEN NOT coalesce({s} IN ({scalar}, {sets}, {others}), false) THEN raise_error(concat('no scorer for answer schema ', coalesce({s}, 'null'))) "
        f"WHEN format_error THEN 0D WHEN {s} IN ({sets}) THEN {f1('gold_items', 'parsed_items')} "
        f"WHEN {s} = 'two_interaction_sets' THEN ({f1('gold_gained', 'parsed_gained')} + {f1('gold_lost', 'parsed_lost')}) / 2D "
        f"ELSE IF({correct}, 1D, 0D) END")
    barred = "coalesce(truncated, false) OR coalesce(provider_refusal, false)"
    return df.selectExpr("*", f"IF({barred}, 0D, {score}) AS score", f"IF({barred}, false, {correct}) AS correct")


def score_responses(df: DataFrame) -> DataFrame:
    """Score single-valued answers. Input: ``response, answer_schema, gold_*, categories, options, tolerance, truncated, provider_refusal``."""
    scored = with_score(with_parsed(with_final(df, "response")))
    refused = f"provider_refusal OR (format_error AND {an.looks_like_refusal('response')})"
    return scored.selectExpr("*", f"{refused} AS refusal")


def score_fields(answers: DataFrame, fields: DataFrame) -> DataFrame:
    """Multi-field answers: every named field is scored by its own schema, then averaged.

    ``answers`` holds ``answer_id, response, truncated, provider_refusal``; ``fields`` one row per
    expected field with ``answer_id, field, answer_schema, gold_*, categories, options, tolerance``. A missing
    field makes the whole answer a format error; a malformed one only scores zero.
    """
    found = with_final(answers, "response").withColumnRenamed("fields", "named").drop("inline")
    rows = fields.join(found, "answer_id").selectExpr(
        "*", "try_element_at(named, field) AS inline", "CAST(map() AS map<string, string>) AS fields")
    scored = with_score(with_parsed(rows)).selectExpr("*", "inline IS NULL AS missing")
    whole = scored.groupBy("answer_id").agg(
        F.expr("bool_or(missing) OR bool_and(format_error) AS format_error"), F.expr("avg(score) AS field_score"),
        F.expr("bool_and(correct) AS field_correct"), F.expr("map_from_entries(collect_list(struct(field, score))) AS field_scores"))
    return whole.selectExpr("answer_id", "format_error", "IF(format_error, 0D, field_score) AS score",
                            "NOT format_error AND field_correct AS correct", "field_scores")


def latest_attempts(results: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The last stored attempt of every (run, render, completion)."""
    return latest(results, ["run_id", "render_id", "completion_index"], ordinal)


def unknown_renders(results: DataFrame, renders: DataFrame) -> DataFrame:
    return results.join(renders, "render_id", "left_anti").select("render_id").distinct()


def score_run(results: DataFrame, renders: DataFrame, instances: DataFrame, fields: DataFrame | None = None, every_attempt: bool = False) -> DataFrame:
    """Results joined to their renders and instances and scored. Unknown renders are an error, not a loss.

    ``fields`` lists the expected fields of ``multi_field`` instances: ``semantic_instance_id, field, answer_schema,
    gold_*, categories, options, tolerance``. Such an instance without a field is an error; its scores by field are in ``field_scores``.
    Only the last attempt of a completion is scored, unless ``every_attempt``.
    """
    known = renders.select("render_id", F.lit(True).alias("known"), *[c for c in renders.columns if c != "render_id"])
    joined = (results if every_attempt else latest_attempts(results)).join(known, "render_id", "left").join(instances, "semantic_instance_id", "left")
    checked = joined.filter("known OR raise_error(concat('response refers to an unknown render: ', render_id))").withColumnRenamed(
        "raw_response", "response").withColumnRenamed("refusal", "provider_refusal")
    several = "answer_schema <=> 'multi_field'"
    out = score_responses(checked.filter(f"NOT {several}")).withColumn("field_scores", F.lit(None).cast("map<string,double>"))
    many = checked.filter(several).withColumn("answer_id", F.struct("run_id", "render_id", "completion_index", *(["attempt"] if every_attempt else [])))
    if fields is None:
        scores = many.selectExpr("answer_id", "CAST(NULL AS BOOLEAN) AS format_error", "CAST(NULL AS DOUBLE) AS score", "CAST(NULL AS BOOLEAN) AS correct",
                                 "CAST(NULL AS map<string, double>) AS field_scores").limit(0)
    else:
        asked = many.select("answer_id", "semantic_instance_id").join(fields, "semantic_instance_id").drop("semantic_instance_id")
        scores = score_fields(many.select("answer_id", "response", "truncated", "provider_refusal"), asked)
    scored = many.join(scores, "answer_id", "left").filter(
        "score IS NOT NULL OR raise_error(concat('no expected fields for ', semantic_instance_id))").drop("answer_id")
    refused = f"provider_refusal OR (format_error AND {an.looks_like_refusal('response')})"
    return out.unionByName(scored.selectExpr("*", f"{refused} AS refusal"), allowMissingColumns=True).selectExpr(
        "*", "coalesce(cluster_id, protein_group_id) AS cluster", "error IS NOT NULL AND error <> '' AS api_error")
