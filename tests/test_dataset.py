import pytest
from pyspark.sql import functions as F

from residuum.plans import dataset, families, scoring, validation
from residuum.sources import records, tables
from residuum.streaming import results_log

GOLD_NULLS = {"gold_number": "double", "gold_flag": "boolean", "gold_items": "array<string>", "gold_numbers": "array<double>",
              "gold_gained": "array<string>", "gold_lost": "array<string>"}


@pytest.fixture(scope="module")
def built(spark, sf):
    a = families.Analysis(tables.atoms(spark, sf).filter("structure_id = 'S0'"))
    proposals = families.propose_all(a, ["P02", "S04", "S09", "N01"])
    return a, dataset.select_candidates(proposals, ["P02", "S04", "S09", "N01"], {"P02": 1, "S04": 2, "S09": 2, "N01": 1}, seed=7, cap=6)


def instances_of(chosen):
    rows = chosen.selectExpr("*", f"{dataset.instance_id()} AS semantic_instance_id", "'candidate' AS curation_status")
    return rows


def test_selection_fills_targets_up_to_the_cap(built):
    _, chosen = built
    counts = {r.family: r["count"] for r in chosen.groupBy("family").count().collect()}
    assert sum(counts.values()) == 6 and counts["P02"] == 1 and all(chosen.select("accepted").toPandas().accepted)


def test_renders_and_checks(spark, built):
    a, chosen = built
    atoms = a.atoms.selectExpr("*", "' ' AS icode", "row_number() OVER (PARTITION BY structure_id ORDER BY atom_idx) AS serial",
                               "1D AS occupancy", "0D AS bfactor", "false AS is_hetatm")
    inst = instances_of(chosen)
    out = dataset.renders(inst, atoms, seed=7).cache()
    forms = {(r.question_family, r.representation) for r in out.collect()}
    assert ("P02", "context_only") in forms and ("N01", "context_only") not in forms and ("N01", "minimal_pdb") in forms
    prompt = out.filter("question_family = 'P02' AND representation = 'minimal_pdb'").collect()[0].user_prompt
    assert "ATOM      1  N  " in prompt and prompt.rstrip().endswith("answer.") and "{" not in prompt
    assert validation.orphan_renders(out, inst).count() == 0 and validation.prompt_hash_mismatch(out).count() == 0
    assert validation.forbidden_records(out).count() == 0


def test_leaks_of_the_own_instance_only(spark):
    prompt = "see AF-P12345-F1, 10.1000/abc.9 and 1crn; HEM2 hem x1crny"
    shown = spark.createDataFrame([("r1", "i1", prompt), ("r2", "i2", prompt)], "render_id string, semantic_instance_id string, user_prompt string")
    ids = spark.createDataFrame([("i1", "entry", "AF-P12345-F1"), ("i1", "publication", "doi:10.1000/abc.9"), ("i1", "entry", "1CRN"), ("i1", "component", "HEM"),
                                 ("i2", "component", "hem"), ("i2", "publication", "doi:see"), ("i2", "entry", "P1.345")],
                                "semantic_instance_id string, kind string, identifier string")
    assert {(r.id, r.violation) for r in validation.provenance_leaks(shown, ids).collect()} == {
        ("r1", "leak:entry:AF-P12345-F1"), ("r1", "leak:publication:doi:10.1000/abc.9"), ("r1", "leak:entry:1CRN"), ("r2", "leak:component:hem")}


def full(spark, rows):
    df = spark.createDataFrame(rows, "semantic_instance_id string, answer_schema string, gold_text string")
    for name, kind in GOLD_NULLS.items():
        df = df.withColumn(name, F.expr(f"CAST(NULL AS {kind})"))
    return df


def test_every_schema_scores_its_own_answer(spark):
    df = full(spark, [("i1", "residue", "A:V22"), ("i2", "atom", "A:H57:NE2"), ("i3", "residue_pair", "A:D18--B:Y44"), ("i4", "integer", None), ("i5", "distance", None),
                      ("i6", "numeric_triple", None), ("i7", "residue_set", None), ("i8", "two_interaction_sets", None), ("i9", "ordered_path", None),
                      ("i10", "category", "helix"), ("i11", "boolean", None), ("i12", "residue_pair_set", None), ("i13", "string_set", None)])
    values = {"gold_number": "CASE answer_schema WHEN 'integer' THEN 142D WHEN 'distance' THEN 3.425D END", "gold_flag": "answer_schema = 'boolean'",
              "gold_numbers": "IF(answer_schema = 'numeric_triple', array(1.5D, -2.25D, 0D), NULL)",
              "gold_items": "CASE answer_schema WHEN 'residue_set' THEN array('A:D18', 'A:E21') WHEN 'ordered_path' THEN array('A:D18', 'B:K2', 'A:E21') "
                            "WHEN 'residue_pair_set' THEN array('A:D18--A:E21') WHEN 'string_set' THEN array('A', 'B') END",
              "gold_gained": "IF(answer_schema = 'two_interaction_sets', array('A:D18--A:E21'), NULL)",
              "gold_lost": "IF(answer_schema = 'two_interaction_sets', CAST(array() AS array<string>), NULL)"}
    df = df.withColumns({k: F.expr(v) for k, v in values.items()})
    assert validation.self_score(df).collect() == []


def test_fields_are_scored_one_by_one(spark):
    answers = spark.createDataFrame([("a", "FINAL\nsite: A:V22\nkind: strand"), ("b", "FINAL\nsite: A:V22")], "answer_id string, response string").selectExpr(
        "*", "false AS truncated", "false AS provider_refusal")
    fields = full(spark, [("site", "residue", "A:V22"), ("kind", "category", "helix")]).withColumnRenamed("semantic_instance_id", "field")
    fields = fields.crossJoin(answers.select("answer_id")).selectExpr("*", "IF(field = 'kind', array('helix', 'strand'), NULL) AS categories",
                                                                      "CAST(NULL AS array<string>) AS options", "CAST(NULL AS DOUBLE) AS tolerance")
    got = {r.answer_id: (r.format_error, r.score, r.correct) for r in scoring.score_fields(answers, fields).collect()}
    assert got == {"a": (False, 0.5, False), "b": (True, 0.0, False)}


def test_dataset_directory_round_trip(spark, tmp_path):
    df = full(spark, [("i1", "residue", "A:V22"), ("i2", "residue", "B:K1")]).withColumn("question_family", F.lit("S01")).withColumn("gold_hash", F.lit(None).cast("string"))
    renders = spark.createDataFrame([("r1", "i1")], "render_id string, semantic_instance_id string")
    rejections = spark.createDataFrame([("S01", "p", "x")], "question_family string, protein_group_id string, reason string")
    folder = str(tmp_path / "set")
    records.write_dataset(df, renders, rejections, folder, "header-1")
    got, back = records.load_dataset(spark, folder, "header-1")
    assert {(r.semantic_instance_id, r.gold_text) for r in got.collect()} == {("i1", "A:V22"), ("i2", "B:K1")} and back.count() == 1
    with pytest.raises(ValueError):
        records.load_dataset(spark, folder, "another")
    spark.createDataFrame([("i1", "A:V23"), ("i2", "B:K1")], "semantic_instance_id string, gold_text string").write.mode("overwrite").json(f"{folder}/gold")
    with pytest.raises(Exception, match="does not match its hash"):
        records.load_dataset(spark, folder, "header-1")[0].collect()


def test_results_stream_scores_each_attempt_once(spark, tmp_path):
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    rows = [("run", "r1", 0, 1, "2024-01-01T00:00:00", "FINAL: A:V22"), ("run", "r1", 0, 1, "2024-01-01T00:00:00", "FINAL: A:V22"), ("run", "r2", 0, 1, "2024-01-01T00:00:05", "no answer")]
    cols = "run_id string, render_id string, completion_index int, attempt int, recorded_at string, raw_response string"
    spark.createDataFrame(rows, cols).coalesce(1).write.json(log)
    renders = full(spark, [("r1", "residue", "A:V22"), ("r2", "residue", "A:V22")]).withColumnRenamed("semantic_instance_id", "render_id").selectExpr(
        "*", "CAST(NULL AS array<string>) AS categories", "CAST(NULL AS array<string>) AS options", "CAST(NULL AS DOUBLE) AS tolerance")
    scored = results_log.score_stream(results_log.first_arrivals(results_log.results_stream(spark, log)), renders)
    results_log.start(scored.select("render_id", "score", "format_error"), out, check).awaitTermination(90)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("r1", 1.0, False), ("r2", 0.0, True)]


def test_a_run_scores_single_and_several_fields(spark):
    results = spark.createDataFrame([("r", "n1", 0, 0, "FINAL: A:V22"), ("r", "n2", 0, 1, "FINAL\nsite: A:V22\nkind: strand"), ("r", "n2", 1, 2, "FINAL\nkind: helix")],
                                    "run_id string, render_id string, completion_index int, ordinal long, raw_response string").selectExpr(
        "*", "false AS truncated", "false AS refusal", "CAST(NULL AS STRING) AS error")
    renders = spark.createDataFrame([("n1", "i1"), ("n2", "i2")], "render_id string, semantic_instance_id string")
    extra = ["CAST(NULL AS array<string>) AS categories", "CAST(NULL AS array<string>) AS options", "CAST(NULL AS DOUBLE) AS tolerance"]
    instances = full(spark, [("i1", "residue", "A:V22"), ("i2", "multi_field", None)]).selectExpr(
        "*", *extra, "CAST(NULL AS STRING) AS cluster_id", "'p' AS protein_group_id")
    fields = full(spark, [("site", "residue", "A:V22"), ("kind", "category", "helix")]).withColumnRenamed("semantic_instance_id", "field").selectExpr(
        "*", "'i2' AS semantic_instance_id", "array('helix', 'strand') AS categories", *extra[1:])
    got = {(r.render_id, r.completion_index): (r.score, r.correct, r.format_error, r.field_scores) for r in scoring.score_run(results, renders, instances, fields).collect()}
    assert got == {("n1", 0): (1.0, True, False, None), ("n2", 0): (0.5, False, False, {"site": 1.0, "kind": 0.0}),
                   ("n2", 1): (0.0, False, True, {"site": 0.0, "kind": 1.0})}
    with pytest.raises(Exception, match="no expected fields"):
        scoring.score_run(results, renders, instances).collect()


def test_ids_are_compared_in_merged_joins_over_all_partitions(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "semantic_instance_id string")
    shown = spark.createDataFrame([("r1", "a"), ("r2", "c"), ("r3", None)], "render_id string, semantic_instance_id string")
    for found, want in ((validation.orphan_renders(shown, asked), ["r2", "r3"]), (validation.instances_without_render(asked, shown), ["b", "b"])):
        assert sorted(r.id for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "REPARTITION_BY_NUM" in plan
    twice = validation.duplicate_ids(asked, "semantic_instance_id")
    assert [r.id for r in twice.collect()] == ["b"] and "REPARTITION_BY_NUM" in twice._jdf.queryExecution().executedPlan().toString()
