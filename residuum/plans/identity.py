"""Fingerprints: what a relation, an answer or a run is, as one digest that any machine computes alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as h
from ..sources import records

#: Leading hex digits of a row digest that make its bucket.
BUCKET_DIGITS = 3


def digest_of(relation: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row ``n, digest`` of a relation, whatever the order and layout of its rows.

    A row is the canonical JSON of ``columns``; rows are grouped by the leading digits of their own digest, sorted there by
    ``order`` and digest, and the bucket digests are digested in order. So no task holds more than a bucket of digests. An empty relation has
    the digest of the empty text.
    """
    kinds = {f.name: f.dataType for f in relation.schema.fields}
    row = "concat('[', " + ", ',', ".join(h.canonical(c, kinds[c]) for c in columns) + ", ']')"
    rows = relation.selectExpr(f"CAST({order} AS STRING) AS _key", f"sha2({row}, 256) AS _digest").selectExpr("_key", "_digest", f"substr(_digest, 1, {BUCKET_DIGITS}) AS _bucket")
    buckets = rows.groupBy("_bucket").agg(F.expr("count(*) AS n"), F.expr("sha2(array_join(transform(array_sort(collect_list(struct(_digest, _key))), r -> r._digest), ''), 256) AS _digest"))
    return buckets.agg(F.expr("coalesce(sum(n), 0L) AS n"), F.expr("sha2(array_join(transform(array_sort(collect_list(struct(_bucket, _digest))), b -> b._digest), ''), 256) AS digest"))


def gold_hash(instances: DataFrame) -> DataFrame:
    """``semantic_instance_id, gold_hash`` over the canonical text of the answer."""
    return instances.selectExpr("semantic_instance_id", f"sha2({records.gold_json()}, 256) AS gold_hash")


def dataset_fingerprint(renders: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: what an evaluation sees (prompts, schemas, coordinates) and what it is scored against. ``gold`` holds ``render_id, gold_hash``."""
    rows = renders.join(gold, "render_id", "left").selectExpr(
        "render_id", "prompt_version", "sha2(system_prompt, 256) AS system_sha256", "sha2(user_prompt, 256) AS user_sha256", "answer_schema", "displayed_coordinates_sha256", "gold_hash")
    return digest_of(rows, "render_id", rows.columns)


def run_ids(configs: DataFrame, fingerprint: str) -> DataFrame:
    """``configs`` with ``run_id``: a label or the model name, and ten digits over everything that changes a run.

    ``sampling`` may be any nested value; ``fingerprint`` is an SQL expression.
    """
    kinds = {f.name: f.dataType for f in configs.schema.fields}
    parts = ["model_id", "provider", "endpoint", "revision", "reasoning_effort", "completions", "sampling"]
    text = "concat('[', " + ", ',', ".join([h.canonical(c, kinds[c]) for c in parts] + [h.json_string(fingerprint)]) + ", ']')"
    return configs.selectExpr("*", f"concat(coalesce(nullif(label, ''), replace(model_id, '/', '_')), '-', substr(sha2({text}, 256), 1, 10)) AS run_id")
