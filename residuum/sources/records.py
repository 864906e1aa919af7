"""Record schemas and the JSON-lines files of a dataset directory."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chemistry import in_list
from ..functions.hashing import json_number, json_string, json_string_list

STRINGS = T.ArrayType(T.StringType())
DOUBLES = T.ArrayType(T.DoubleType())

# The columns of an answer, one of which is set, and of each kind of record.
GOLD_FIELDS = [
    T.StructField("gold_text", T.StringType()),
    T.StructField("gold_number", T.DoubleType()),
    T.StructField("gold_flag", T.BooleanType()),
    T.StructField("gold_items", STRINGS),
    T.StructField("gold_numbers", DOUBLES),
    T.StructField("gold_gained", STRINGS),
    T.StructField("gold_lost", STRINGS),
]
GOLD = [f.name for f in GOLD_FIELDS]
INSTANCE = T.StructType([
    T.StructField("semantic_instance_id", T.StringType()),
    T.StructField("question_family", T.StringType()),
    T.StructField("question_version", T.StringType()),
    T.StructField("protein_group_id", T.StringType()),
    T.StructField("cluster", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_entries", STRINGS),
    T.StructField("source_file_sha256s", STRINGS),
    T.StructField("question_parameters", T.StringType()),
    T.StructField("answer_schema", T.StringType()),
    T.StructField("gold_hash", T.StringType()),
    *GOLD_FIELDS,
    T.StructField("selection_margins", T.StringType()),
    T.StructField("definition_version", T.StringType()),
    T.StructField("curation_status", T.StringType()),
    T.StructField("required_labels", STRINGS),
])
RENDER = T.StructType([
    T.StructField("render_id", T.StringType()),
    T.StructField("semantic_instance_id", T.StringType()),
    T.StructField("question_family", T.StringType()),
    T.StructField("representation", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
    T.StructField("system_prompt", T.StringType()),
    T.StructField("user_prompt", T.StringType()),
    T.StructField("prompt_sha256", T.StringType()),
    T.StructField("displayed_coordinates_sha256", T.StringType()),
    T.StructField("rotation_seed", T.LongType()),
    T.StructField("is_rotation_variant", T.BooleanType()),
    T.StructField("answer_schema", T.StringType()),
    T.StructField("input_token_count", T.LongType()),
    T.StructField("atom_count", T.LongType()),
])
RESULT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("render_id", T.StringType()),
    T.StructField("completion_index", T.IntegerType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("recorded_at", T.TimestampType()),
    T.StructField("model_provider", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("max_output_tokens", T.IntegerType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("refusal", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("latency_seconds", T.DoubleType()),
])
DECISION = T.StructType([
    T.StructField("semantic_instance_id", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("curator", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("label_override", T.StringType()),
])
REJECTION = T.StructType([
    T.StructField("candidate_id", T.StringType()),
    T.StructField("question_family", T.StringType()),
    T.StructField("protein_group_id", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("criteria_failed", STRINGS),
])

#: Fixed values.
ANSWER_SCHEMAS = ("string_set", "integer", "numeric_triple", "distance", "atom", "residue", "residue_set", "residue_pair", "residue_pair_set",
                  "category", "boolean", "multiple_choice", "ordered_path", "two_interaction_sets", "multi_field")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file. A malformed line is an error; a missing local file is an empty relation."""
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in a total order, range-partitioned, so that part files read in name order are sorted."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def instance_violations(instances: DataFrame) -> DataFrame:
    """Rows that break a record rule: unknown schema, or neither an answer nor its hash."""
    gold = " AND ".join(f"{g} IS NULL" for g in GOLD)
    return instances.selectExpr(
        "semantic_instance_id", f"CASE WHEN NOT {in_list('answer_schema', ANSWER_SCHEMAS)} THEN 'unknown_answer_schema' "
        f"WHEN gold_hash IS NULL AND {gold} THEN 'gold_or_hash_required' END AS violation").filter("violation IS NOT NULL")


def decision_violations(decisions: DataFrame) -> DataFrame:
    """Decisions without the reason they need: every rejection and every label override."""
    return decisions.filter("(decision = 'reject' OR label_override IS NOT NULL) AND coalesce(trim(reason), '') = ''").selectExpr(
        "semantic_instance_id", "'reason_required' AS violation")


def gold_json(integer: str = "answer_schema = 'integer'") -> str:
    """Canonical text of the answer, the input of its hash: sorted keys, ASCII escapes, shortest numbers. ``integer`` says whether the number is a count."""
    number = f"IF({integer}, CAST(CAST(gold_number AS BIGINT) AS STRING), {json_number('gold_number')})"
    numbers = f"concat('[', array_join(transform(gold_numbers, n -> {json_number('n')}), ','), ']')"
    value = (f"CASE WHEN gold_items IS NOT NULL THEN {json_string_list('gold_items')} WHEN gold_text IS NOT NULL THEN {json_string('gold_text')} "
             f"WHEN gold_number IS NOT NULL THEN {number} WHEN gold_flag IS NOT NULL THEN CAST(gold_flag AS STRING) WHEN gold_numbers IS NOT NULL THEN {numbers} END")
    sets = f"concat('{{\"gained\":', {json_string_list('gold_gained')}, ',\"lost\":', {json_string_list('gold_lost')}, '}}')"
    return f"coalesce(concat('{{\"value\":', {value}, '}}'), {sets})"


def write_dataset(instances: DataFrame, renders: DataFrame, rejections: DataFrame, folder: str, header_id: str) -> None:
    """A dataset directory with the answers split off; the manifest keeps only their hash.

    ``header_id`` is written to the header relation and checked by every reader.
    """
    spark = instances.sparkSession
    gold = list(GOLD)
    hashed = instances.withColumn("gold_hash", F.expr(f"sha2({gold_json()}, 256)"))
    write_jsonl(hashed.select("semantic_instance_id", *gold), f"{folder}/gold", ["semantic_instance_id"])
    write_jsonl(hashed.drop(*gold), f"{folder}/instances", ["semantic_instance_id"])
    write_jsonl(renders, f"{folder}/renders", ["render_id"])
    write_jsonl(rejections, f"{folder}/rejections", ["question_family", "protein_group_id"])
    spark.createDataFrame([(header_id,)], "header_id string").coalesce(1).write.mode("overwrite").json(f"{folder}/header")


def check_header(spark: SparkSession, folder: str, header_id: str) -> None:
    found = spark.read.schema("header_id string").json(f"{folder}/header").limit(2).collect()
    if [r.header_id for r in found] != [header_id]:
        raise ValueError("the dataset does not carry the configured header")


def load_dataset(spark: SparkSession, folder: str, header_id: str) -> tuple[DataFrame, DataFrame]:
    """Instances with their answers joined back, and renders. A missing or altered answer is an error."""
    check_header(spark, folder, header_id)
    gold = T.StructType([f for f in INSTANCE.fields if f.name.startswith("gold_") and f.name != "gold_hash"])
    answers = read_jsonl(spark, f"{folder}/gold", T.StructType([T.StructField("semantic_instance_id", T.StringType()), *gold.fields])).withColumn(
        "present", F.lit(True))
    manifest = read_jsonl(spark, f"{folder}/instances", T.StructType([f for f in INSTANCE.fields if f not in gold.fields]))
    joined = manifest.join(answers, "semantic_instance_id", "left").filter(
        "present OR raise_error(concat('no answer for ', semantic_instance_id))").filter(
        f"gold_hash = sha2({gold_json()}, 256) OR raise_error(concat('answer does not match its hash: ', semantic_instance_id))").drop("present")
    return joined, read_jsonl(spark, f"{folder}/renders", RENDER)


def listed_ids(listed: DataFrame) -> DataFrame:
    """Instance ids of a published list with a text column ``value``; blanks and # lines do not count."""
    return listed.selectExpr("trim(value) AS semantic_instance_id").filter("semantic_instance_id <> '' AND semantic_instance_id NOT LIKE '#%'")


def drop_listed(instances: DataFrame, listed: DataFrame) -> DataFrame:
    """Remove instances whose answers were published."""
    return instances.join(listed_ids(listed), "semantic_instance_id", "left_anti")


def merge_manifests(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two source manifests ``entry, notes``; notes of the second win."""
    return first.join(second, "entry", "left_anti").unionByName(second).distinct().orderBy("entry")
