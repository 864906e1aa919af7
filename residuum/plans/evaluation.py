"""The bookkeeping around model calls, as joins: what is cached, done, pending, and how it is batched.

Calls themselves are side effects outside Spark and are not part of this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..operators.keyed import argmin_by

BATCH_REQUESTS, BATCH_BYTES = 3000, 90 * 1024 * 1024  # fixed values
#: HTTP codes that a retry cannot help.
TERMINAL_STATUS = (400, 401, 402, 403, 404, 413, 422)


def request_digest(*parts) -> str:
    return stable_hash(*parts)


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached response. An entry whose stored request differs is an error, never a miss."""
    entries = cache.selectExpr("digest", "request AS cached_request", "response")
    joined = requests.join(entries, "digest", "left")
    bad = "cached_request IS NOT NULL AND cached_request <> request"
    return joined.filter(f"NOT ({bad}) OR raise_error(concat('cache entry does not match its request: ', digest))").drop("cached_request")


def put_once(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """New cache rows: first write of each digest wins, known digests stay as they are."""
    fresh = entries.join(cache, "digest", "left_anti")
    rest = [c for c in entries.columns if c not in ("digest", "ordinal")]
    return argmin_by(fresh, ["digest"], ["ordinal"], rest)


def pending(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a cached response, one per digest."""
    rest = [c for c in requests.columns if c not in ("digest", "render_id", "completion_index")]
    return argmin_by(requests.join(cache, "digest", "left_anti"), ["digest"], ["render_id", "completion_index"], rest)


def remaining(jobs: DataFrame, results: DataFrame, run_id: str) -> DataFrame:
    """Jobs a resumed run still has to do. Rows of another run, or outside the selection, are an error."""
    keys = ["render_id", "completion_index"]
    selected = jobs.select(*keys).withColumn("selected", F.lit(True))
    checked = results.join(selected, keys, "left").filter(
        f"(run_id = '{run_id}' OR raise_error('results belong to another run')) "
        "AND (selected OR raise_error(concat('result outside the selection: ', render_id)))")
    return jobs.join(checked.filter("error IS NULL OR error = ''"), keys, "left_anti")


def selection(renders: DataFrame, *, families: list[str] | None = None, max_tokens: int | None = None, accepted_only: bool = False,
              limit: int | None = None, only_renders: DataFrame | None = None) -> DataFrame:
    """Renders to evaluate. ``limit`` counts before ``only_renders`` narrows, in this order."""
    out = renders.filter("curation_status = 'accepted'" if accepted_only else "curation_status <> 'rejected'")
    if families:
        out = out.filter(F.col("question_family").isin(families))
    if max_tokens is not None:
        out = out.filter(f"input_token_count <= {max_tokens}")
    if limit is not None:
        out = out.orderBy("render_id").limit(limit)
    if only_renders is not None:
        out = out.join(only_renders, "render_id", "left_semi")
    return out


def repeat_seeds(renders: DataFrame, completions: int) -> DataFrame:
    """One row per completion; repeats get a seed of their own, a single completion none."""
    seed = "1000 + completion_index" if completions > 1 else "CAST(NULL AS INT)"
    return renders.selectExpr("*", f"explode(sequence(0, {completions - 1})) AS completion_index").selectExpr("*", f"{seed} AS seed")


def batch_chunks(requests: DataFrame, run_key: str = "run_id", max_requests: int = BATCH_REQUESTS, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """Requests in order, cut into chunks that are filled until the next request would not fit.

    ``requests`` holds the run key, a dense 0-based ``place`` and ``bytes``. Where a chunk
    starting at a row would end follows from running sizes, so every row first finds its
    successor; chunk starts are then the rows reached from row 0, found by doubling the
    stride: as many rounds as the logarithm of the number of chunks, and no row is
    visited one after the other.
    """
    from ..operators.sequence import BLOCK_ROWS
    from ..session import stage

    key = [run_key]
    blocked = requests.selectExpr(run_key, "place", "bytes", f"place div {BLOCK_ROWS} AS block")
    local = blocked.selectExpr("*", f"sum(bytes) OVER (PARTITION BY {run_key}, block ORDER BY place) AS upto")
    before = blocked.groupBy(*key, "block").agg(F.expr("sum(bytes) AS total")).selectExpr(
        run_key, "block", f"coalesce(sum(total) OVER (PARTITION BY {run_key} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    summed = stage(local.join(before, [*key, "block"]).selectExpr(run_key, "place", "bytes", "upto + base AS upto"))
    # A chunk ends within max_requests rows, so the search for its end meets at most two request blocks.
    ends = summed.selectExpr(run_key, "place AS last", "upto AS last_upto", f"explode(array(place div {max_requests}, place div {max_requests} - 1)) AS part")
    jumps = summed.selectExpr(run_key, "place", "upto - bytes AS base", f"place div {max_requests} AS part").join(ends, [*key, "part"]).filter(
        f"last >= place AND last < place + {max_requests} AND (last_upto - base <= {max_bytes} OR last = place)").groupBy(*key, "place").agg(
        F.expr("max(last) + 1 AS next"))
    jumps = stage(jumps)
    starts = requests.select(*key).distinct().selectExpr(run_key, "0L AS place")
    while True:
        reached = starts.join(jumps, [*key, "place"]).selectExpr(run_key, "next AS place").join(summed.select(*key, "place"), [*key, "place"], "left_semi")
        grown = stage(starts.unionByName(reached).distinct())
        if grown.count() == starts.count():
            break
        starts = grown
        jumps = stage(jumps.join(jumps.selectExpr(run_key, "place AS next", "next AS after"), [*key, "next"], "left").selectExpr(
            run_key, "place", "coalesce(after, next) AS next"))
    # The chunk of a row is the number of starts up to it: counted inside blocks, then across them.
    flagged = requests.join(starts.selectExpr(run_key, "place", "1L AS opens"), [*key, "place"], "left").selectExpr(
        "*", f"place div {BLOCK_ROWS} AS block")
    inside = flagged.selectExpr("*", f"sum(coalesce(opens, 0)) OVER (PARTITION BY {run_key}, block ORDER BY place) AS so_far")
    opened = flagged.groupBy(*key, "block").agg(F.expr("sum(coalesce(opens, 0)) AS n")).selectExpr(
        run_key, "block", f"coalesce(sum(n) OVER (PARTITION BY {run_key} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    return inside.join(opened, [*key, "block"]).selectExpr(*requests.columns, "so_far + base - 1 AS chunk")


def batch_outputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs that may be stored: ids seen once, in jobs whose every id is known.

    A job with any unknown id is replayed as a whole, so nothing of it is stored.
    """
    counted = outputs.groupBy("job_id", "custom_id").agg(F.expr("count(*) AS copies"), F.expr("any_value(body) AS body"))
    known = inputs.select("job_id", "custom_id").distinct().withColumn("known", F.lit(True))
    joined = counted.join(known, ["job_id", "custom_id"], "left")
    whole = joined.groupBy("job_id").agg(F.expr("count_if(known IS NULL) AS unknown")).filter("unknown = 0")
    return joined.filter("copies = 1").join(whole, "job_id", "left_semi").select("job_id", "custom_id", "body")


def error_histogram(results: DataFrame, length: int = 200) -> DataFrame:
    return results.filter("error IS NOT NULL AND error <> ''").groupBy(F.expr(f"substring(error, 1, {length})").alias("message")).count()


def last_decisions(decisions: DataFrame) -> DataFrame:
    from ..operators.keyed import latest
    return latest(decisions, ["semantic_instance_id"], "ordinal")


def with_decisions(instances: DataFrame, decisions: DataFrame) -> DataFrame:
    """Curation status per instance from the last decision; undecided instances stay candidates."""
    last = last_decisions(decisions).select("semantic_instance_id", "decision", "reason")
    return instances.join(last, "semantic_instance_id", "left").selectExpr(
        *[c for c in instances.columns if c != "curation_status"],
        "CASE decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'candidate' END AS curation_status", "reason")


def decided(instances: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Status, notes and answer after the last decision; ``label_override`` is the JSON of an answer and replaces the whole answer."""
    from ..functions.chemistry import in_list
    from ..sources.records import GOLD_FIELDS
    rest = [c for c in instances.columns if c not in {f.name for f in GOLD_FIELDS}]
    if decisions is None:
        return instances.selectExpr("*", "'proposed' AS curation_status", "'' AS curator_notes", "CAST(NULL AS STRING) AS curator_override")
    last = last_decisions(decisions).selectExpr("semantic_instance_id", "decision", "notes", "label_override AS curator_override")
    value = "get_json_object(curator_override, '$.value')"
    given = {"gold_number": f"IF({in_list('answer_schema', ('integer', 'distance'))}, CAST({value} AS DOUBLE), NULL)",
             "gold_flag": f"IF(answer_schema = 'boolean', CAST({value} AS BOOLEAN), NULL)",
             "gold_items": f"IF({in_list('answer_schema', ('string_set', 'residue_set', 'residue_pair_set', 'ordered_path'))}, from_json({value}, 'array<string>'), NULL)",
             "gold_numbers": f"IF(answer_schema = 'numeric_triple', from_json({value}, 'array<double>'), NULL)",
             "gold_gained": "from_json(get_json_object(curator_override, '$.gained'), 'array<string>')",
             "gold_lost": "from_json(get_json_object(curator_override, '$.lost'), 'array<string>')",
             "gold_text": f"IF({in_list('answer_schema', ('residue', 'atom', 'residue_pair', 'category', 'multiple_choice'))}, {value}, NULL)"}
    return instances.join(last, "semantic_instance_id", "left").selectExpr(
        *rest, *[f"IF(curator_override IS NULL, {f.name}, {given[f.name]}) AS {f.name}" for f in GOLD_FIELDS],
        "CASE decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'proposed' END AS curation_status", "coalesce(notes, '') AS curator_notes", "curator_override")
