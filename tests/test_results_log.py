"""Late, replayed and unknown attempts of the results log."""

import pytest

from residuum.streaming import results_log
from tests.test_dataset import full

COLUMNS = "run_id string, render_id string, completion_index int, attempt int, recorded_at string, raw_response string"


def test_late_attempts_are_scored_and_unknown_renders_raise(spark, tmp_path):
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    renders = full(spark, [("r1", "residue", "A:V22")]).withColumnRenamed("semantic_instance_id", "render_id").selectExpr(
        "*", "CAST(NULL AS array<string>) AS categories", "CAST(NULL AS array<string>) AS options", "CAST(NULL AS DOUBLE) AS tolerance")

    def arrive(*rows):
        spark.createDataFrame([("run", *r) for r in rows], COLUMNS).coalesce(1).write.mode("append").json(log)
        scored = results_log.score_stream(results_log.first_arrivals(results_log.results_stream(spark, log)), renders)
        results_log.start(scored.select("render_id", "attempt", "score"), out, check).awaitTermination(90)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert arrive(("r1", 0, 2, "2024-01-02T00:00:00", "FINAL: A:V22")) == [("r1", 2, 1.0)]
    # A day behind what was seen, and one that is there already.
    assert arrive(("r1", 0, 1, "2024-01-01T00:00:00", "FINAL: A:V22"), ("r1", 0, 2, "2024-01-02T00:00:00", "FINAL: A:V22")) == [("r1", 1, 1.0), ("r1", 2, 1.0)]
    with pytest.raises(Exception, match="unknown render"):
        arrive(("r9", 0, 1, "2024-01-02T00:00:00", "FINAL: A:V22"))


def test_log_scores_every_attempt_once_and_fields_too(spark, tmp_path):
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    cols = "run_id string, render_id string, completion_index int, attempt int, recorded_at string, raw_response string, truncated boolean, refusal boolean"
    row = lambda render, attempt, text: ("run", render, 0, attempt, "2024-01-01T00:00:00", text, False, False)
    renders = spark.createDataFrame([("n1", "i1"), ("n2", "i2")], "render_id string, semantic_instance_id string")
    extra = ["CAST(NULL AS array<string>) AS categories", "CAST(NULL AS array<string>) AS options", "CAST(NULL AS DOUBLE) AS tolerance"]
    instances = full(spark, [("i1", "residue", "A:V22"), ("i2", "multi_field", None)]).selectExpr("*", *extra, "CAST(NULL AS STRING) AS cluster_id", "'p' AS protein_group_id")
    fields = full(spark, [("site", "residue", "A:V22"), ("kind", "category", "helix")]).withColumnRenamed("semantic_instance_id", "field").selectExpr(
        "*", "'i2' AS semantic_instance_id", "array('helix', 'strand') AS categories", *extra[1:])
    batches = [[row("n1", 1, "none"), row("n1", 1, "none"), row("n1", 2, "FINAL: A:V22")], [row("n1", 2, "FINAL: A:V22"), row("n2", 1, "FINAL\nsite: A:V22\nkind: strand")]]
    for rows in batches:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").json(log)
        assert results_log.score_log(results_log.results_stream(spark, log), renders, instances, out, check, fields).awaitTermination(120)
    got = sorted((r.batch, r.render_id, r.attempt, r.score, r.format_error) for r in spark.read.parquet(out).collect())
    assert got == [(0, "n1", 1, 0.0, True), (0, "n1", 2, 1.0, False), (1, "n2", 1, 0.5, False)]
    assert results_log.scored_before(spark, out, 1).count() == 2 and results_log.scored_before(spark, out + "x", 9).count() == 0
    spark.createDataFrame([row("n9", 1, "x")], cols).coalesce(1).write.mode("append").json(log)
    with pytest.raises(Exception, match="unknown render"):
        results_log.score_log(results_log.results_stream(spark, log), renders, instances, out, check, fields).awaitTermination(120)
