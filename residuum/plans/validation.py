"""Dataset checks. Each returns its violations; an empty relation passes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import in_list
from ..functions.texts import contains_word
from ..session import merged, spread_by
from ..sources import records
from . import scoring

FORBIDDEN_RECORDS = ("HEADER", "TITLE", "COMPND", "SOURCE", "REMARK", "DBREF", "SEQRES", "HELIX", "SHEET", "SSBOND", "LINK", "SITE", "CONECT", "JRNL", "AUTHOR")  # fixed values


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return spread_by(df.select(key), key).groupBy(key).count().filter("count > 1").selectExpr(f"{key} AS id", "'duplicate_id' AS violation")


def orphan_renders(renders: DataFrame, instances: DataFrame) -> DataFrame:
    shown = spread_by(renders.select("render_id", "semantic_instance_id"), "semantic_instance_id")
    return shown.join(merged(instances), "semantic_instance_id", "left_anti").selectExpr("render_id AS id", "'render_without_instance' AS violation")


def instances_without_render(instances: DataFrame, renders: DataFrame) -> DataFrame:
    asked = spread_by(instances.select("semantic_instance_id"), "semantic_instance_id")
    return asked.join(merged(renders), "semantic_instance_id", "left_anti").selectExpr("semantic_instance_id AS id", "'instance_without_render' AS violation")


def prompt_hash_mismatch(renders: DataFrame) -> DataFrame:
    return renders.filter("prompt_sha256 <> sha2(user_prompt, 256)").selectExpr("render_id AS id", "'prompt_hash_mismatch' AS violation")


def forbidden_records(renders: DataFrame) -> DataFrame:
    """Prompts that still carry a record naming where a structure comes from."""
    return renders.filter(f"user_prompt RLIKE '(?m)^({'|'.join(FORBIDDEN_RECORDS)})\\\\b'").selectExpr(
        "render_id AS id", "'forbidden_record' AS violation")


def provenance_leaks(renders: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Prompts that show an identifier of their own instance.

    ``identifiers`` holds ``semantic_instance_id, kind, identifier``. An ``entry`` is searched as a word in any
    case; a ``publication``, without what stands before its first colon, as written if longer than four
    characters; a ``component`` as a word as written. Identifiers are literals, whatever they contain.
    """
    shown = renders.select("render_id", "semantic_instance_id", "user_prompt").join(merged(identifiers), "semantic_instance_id")
    token = "substr(identifier, instr(identifier, ':') + 1)"
    hit = ("CASE kind WHEN 'entry' THEN user_prompt RLIKE concat('(?iU)\\\\b\\\\Q', identifier, '\\\\E\\\\b') "
           f"WHEN 'publication' THEN length({token}) > 4 AND contains(user_prompt, {token}) "
           f"WHEN 'component' THEN {contains_word('user_prompt', 'identifier', any_case=False)} "
           "ELSE raise_error(concat('unknown kind of identifier: ', kind)) END")
    return shown.filter(hit).selectExpr("render_id AS id", "concat('leak:', kind, ':', identifier) AS violation").distinct()


def coordinate_mismatch(renders: DataFrame) -> DataFrame:
    """Renders of one instance in one frame must show the same coordinates."""
    frame = ["semantic_instance_id", "representation", "rotation_seed"]
    shown = spread_by(renders.filter("representation <> 'context_only'").select(*frame, "displayed_coordinates_sha256"), frame[0]).groupBy(*frame).agg(
        F.expr("count(DISTINCT displayed_coordinates_sha256) AS n"))
    return shown.filter("n > 1").selectExpr("semantic_instance_id AS id", "'coordinates_differ' AS violation")


def gold_text() -> str:
    """The answer written the way a reader is asked to write it."""
    return ("CASE answer_schema WHEN 'integer' THEN CAST(CAST(gold_number AS BIGINT) AS STRING) WHEN 'distance' THEN format_string('%.3f', gold_number) "
            "WHEN 'numeric_triple' THEN array_join(transform(gold_numbers, n -> format_string('%.3f', n)), ', ') WHEN 'boolean' THEN IF(gold_flag, 'yes', 'no') "
            "WHEN 'ordered_path' THEN array_join(gold_items, ' -> ') WHEN 'two_interaction_sets' THEN concat('\\ngained: ', "
            "IF(size(gold_gained) = 0, 'none', array_join(gold_gained, ', ')), '\\nlost: ', IF(size(gold_lost) = 0, 'none', array_join(gold_lost, ', '))) "
            f"ELSE IF({in_list('answer_schema', scoring.SET_SCHEMAS)}, IF(size(gold_items) = 0, 'none', array_join(gold_items, ', ')), gold_text) END")


def self_score(instances: DataFrame) -> DataFrame:
    """Every answer, formatted and read back, must score exactly one."""
    asked = instances.selectExpr("*", f"concat('FINAL: ', {gold_text()}) AS response", "CAST(NULL AS array<string>) AS categories",
                                 "CAST(NULL AS array<string>) AS options", "CAST(NULL AS DOUBLE) AS tolerance", "false AS truncated", "false AS provider_refusal")
    return scoring.score_responses(asked).filter("score <> 1D").selectExpr("semantic_instance_id AS id", "'answer_does_not_score_one' AS violation")


def changed_answers(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored answers that a fresh run of the family plan no longer gives: both have ``id`` and ``answer`` as text."""
    return stored.join(merged(recomputed.withColumnRenamed("answer", "fresh")), "id", "left").filter("NOT answer <=> fresh").selectExpr(
        "id", "'answer_changed' AS violation")


# -- the suite ----------------------------------------------------------------------

@dataclass(frozen=True)
class Dataset:
    """What is validated, and against what. ``identifiers`` and ``recomputed`` are optional inputs of the rules that need them."""

    instances: DataFrame
    renders: DataFrame
    targets: dict[str, int] = field(default_factory=dict)
    cap: int | None = None
    size: tuple[int, int] | None = None
    reviewed: bool = False
    identifiers: DataFrame | None = None
    recomputed: DataFrame | None = None


ERROR, WARNING = "error", "warning"
_SUITE: dict[str, tuple[str, Callable[[Dataset], DataFrame | None]]] = {}


def rule(name: str, severity: str = ERROR):
    """Register a check: a function from a dataset to rows ``id, violation``, or None where it does not apply."""
    def register(fn):
        _SUITE[name] = (severity, fn)
        return fn
    return register


def _where(instances: DataFrame, condition: str, violation: str) -> DataFrame:
    return instances.filter(condition).selectExpr("semantic_instance_id AS id", f"'{violation}' AS violation")


rule("unique_instances")(lambda d: duplicate_ids(d.instances, "semantic_instance_id"))
rule("unique_renders")(lambda d: duplicate_ids(d.renders, "render_id"))
rule("renders_belong")(lambda d: orphan_renders(d.renders, d.instances))
rule("instances_are_shown")(lambda d: instances_without_render(d.instances, d.renders))
rule("prompts_match_their_hash")(lambda d: prompt_hash_mismatch(d.renders))
rule("no_telling_records")(lambda d: forbidden_records(d.renders))
rule("one_frame_one_structure")(lambda d: coordinate_mismatch(d.renders))
rule("records")(lambda d: records.instance_violations(d.instances).withColumnRenamed("semantic_instance_id", "id"))
rule("no_leaks")(lambda d: None if d.identifiers is None else provenance_leaks(d.renders, d.identifiers))
rule("answers_are_stable")(lambda d: None if d.recomputed is None else changed_answers(d.instances.selectExpr("semantic_instance_id AS id", f"{gold_text()} AS answer"), d.recomputed))
rule("source_is_named")(lambda d: _where(d.instances, "coalesce(size(source_entries), 0) = 0 OR coalesce(size(source_file_sha256s), 0) = 0", "missing_source_provenance"))
rule("sources_have_hashes")(lambda d: _where(d.instances, "coalesce(size(source_entries), 0) <> coalesce(size(source_file_sha256s), 0)", "source_entries_and_hashes_differ"))
rule("margins")(lambda d: _where(d.instances, "question_family <> 'MECH' AND coalesce(selection_margins, '') IN ('', '{}')", "missing_selection_margins"))
rule("version")(lambda d: _where(d.instances, "coalesce(definition_version, '') = ''", "missing_definition_version"))
rule("reviewed")(lambda d: _where(d.instances, "coalesce(curation_status, '') <> 'accepted'", "not_accepted") if d.reviewed else None)
rule("override_notes", WARNING)(lambda d: _where(d.instances, "curator_override IS NOT NULL AND trim(coalesce(curator_notes, '')) = ''", "override_without_notes"))
rule("answers_match_their_hash")(lambda d: _where(d.instances, f"gold_hash <> sha2({records.gold_json()}, 256)", "gold_hash_mismatch"))


@rule("targets", WARNING)
def below_target(d: Dataset) -> DataFrame | None:
    if not d.targets:
        return None
    wanted = d.instances.sparkSession.createDataFrame(sorted(d.targets.items()), "question_family string, target long")
    counts = d.instances.groupBy("question_family").agg(F.expr("count(*) AS n"))
    return wanted.join(counts, "question_family", "left").filter("coalesce(n, 0) < target").selectExpr("question_family AS id", "'family_below_target' AS violation")


@rule("cap")
def above_cap(d: Dataset) -> DataFrame | None:
    """Automatic instances only; episodes do not count."""
    if d.cap is None:
        return None
    return d.instances.filter("question_family <> 'MECH'").groupBy("protein_group_id").count().filter(f"count > {d.cap}").selectExpr("protein_group_id AS id", "'protein_above_cap' AS violation")


@rule("size")
def outside_size(d: Dataset) -> DataFrame | None:
    if d.size is None:
        return None
    return d.instances.agg(F.expr("count(*) AS n")).filter(f"n NOT BETWEEN {d.size[0]} AND {d.size[1]}").selectExpr("'dataset' AS id", "'size_out_of_range' AS violation")


def violations(dataset: Dataset, names: list[str] | None = None) -> DataFrame:
    """``rule, severity, id, violation`` of all registered rules, or of those named."""
    parts = []
    for name in names or _SUITE:
        severity, check = _SUITE[name]
        found = check(dataset)
        if found is not None:
            parts.append(found.selectExpr(f"'{name}' AS rule", f"'{severity}' AS severity", "CAST(id AS STRING) AS id", "violation"))
    return reduce(DataFrame.unionByName, parts)


def verdict(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether the dataset passes, which warnings do not prevent."""
    return found.agg(F.expr("count_if(severity = 'error') AS n_errors"), F.expr("count_if(severity = 'warning') AS n_warnings")).selectExpr("*", "n_errors = 0 AS passes")
