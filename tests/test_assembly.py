"""Dataset assembly, episodes, reading back, responses and fingerprints on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from residuum.functions import hashing as h
from residuum.operators import select
from residuum.plans import assembly, dataset, episodes, evaluation, identity, reading, responses, validation
from residuum.sources import provenance, records, structures

from .test_dataset import full


def placed(spark, rows):
    return spark.createDataFrame(rows, "family string, cluster string, place int, structure_id string, parameters string").selectExpr(
        "*", "true AS usable", "0D AS rank", "'' AS tag", "array('A:X1') AS required", "true AS accepted", "CAST(NULL AS STRING) AS reason")


def one_by_one(rows, families, targets, cap, bad):
    """The plain rule: candidates in order, failures use up nothing."""
    used, taken, reached = {}, [], []
    for family in families:
        n = 0
        for f, cluster, place, sid, par in sorted((r for r in rows if r[0] == family), key=lambda r: r[2]):
            if n >= targets[family]:
                break
            if used.get(cluster, 0) >= cap:
                continue
            if (f, sid) in bad:
                reached.append((f, sid))
                continue
            used[cluster] = used.get(cluster, 0) + 1
            n += 1
            taken.append((f, sid))
    return sorted(taken), sorted(reached)


@pytest.mark.parametrize("case", range(2))
def test_failures_make_room_like_one_by_one(spark, monkeypatch, case):
    import random
    rng = random.Random(case)
    rows, bad = [], set()
    for family in "PQR":
        names = [(f"c{rng.randrange(3)}", f"{family}{i}") for i in range(12)]
        for place, (cluster, sid) in enumerate(names, 1):
            rows.append((family, cluster, place, sid, "{}"))
            if rng.random() < 0.45:
                bad.add((family, sid))
    targets, cap = {"P": 3, "Q": 4, "R": 4}, 4
    plan = assembly.Plan(tuple("PQR"), targets, 1, 10, cap)

    def made(chosen, atoms, plan):
        named = chosen.select(assembly.KEY, "family", "structure_id").collect()
        fails = [(r[0], "no_crop_centers", "x") for r in named if (r.family, r.structure_id) in bad]
        good = [r[0] for r in named if (r.family, r.structure_id) not in bad]
        gold = full(spark, [(g, "residue", "A:V1") for g in good] or [("none", "residue", "x")]).drop("answer_schema")
        return gold, spark.createDataFrame([], records.RENDER), spark.createDataFrame(fails, assembly.REASON)

    monkeypatch.setattr(assembly, "materialise", made)
    candidates = placed(spark, rows)
    published = spark.createDataFrame([("# a list",), ("",)], "value string")
    instances, _, failed = assembly.build(candidates, candidates, plan, published)
    taken, reached = one_by_one(rows, "PQR", targets, cap, bad)
    assert sorted((r.question_family, r.protein_group_id) for r in instances.collect()) == taken
    assert sorted((r.family, r.structure_id) for r in failed.collect()) == reached


def test_published_answers_are_turned_down_without_a_slot(spark, monkeypatch):
    rows = [("P", "c1", 1, "a", "{}"), ("P", "c2", 2, "b", "{}")]
    candidates = placed(spark, rows)
    first = candidates.selectExpr(f"{dataset.instance_id()} AS value", "structure_id").filter("structure_id = 'a'").select("value")
    monkeypatch.setattr(assembly, "materialise", lambda chosen, atoms, plan: (
        full(spark, [(r[0], "residue", "A:V1") for r in chosen.select(assembly.KEY).collect()]).drop("answer_schema"), spark.createDataFrame([], records.RENDER), spark.createDataFrame([], assembly.REASON)))
    decisions = spark.createDataFrame([(candidates.selectExpr(dataset.instance_id()).collect()[1][0], 1, "accept", "fine", '{"value":"B:K2"}', "r")],
                                      "semantic_instance_id string, ordinal long, decision string, notes string, label_override string, reason string")
    instances, _, failed = assembly.build(candidates, candidates, assembly.Plan(("P",), {"P": 1}, 1, 10, 4), first, decisions)
    assert [r.protein_group_id for r in instances.collect()] == ["b"] and [r.reason for r in failed.collect()] == ["answer_previously_published"]
    assert instances.collect()[0].curation_status == "accepted" and instances.collect()[0].curator_notes == "fine"
    assert assembly.build(candidates.limit(0), candidates, assembly.Plan(("P",), {"P": 1}, 1, 10, 4))[0].count() == 0
    assert select.PER_SOURCE == 6


def test_answers_and_overrides_keep_their_kind(spark):
    df = full(spark, [("i1", "residue", "A:V22"), ("i2", "residue_set", None), ("i3", "integer", None)]).withColumns(
        {"gold_items": F.expr("IF(answer_schema = 'residue_set', array('A:D1'), NULL)"), "gold_number": F.expr("IF(answer_schema = 'integer', 5D, NULL)")})
    decisions = spark.createDataFrame([("i2", 1, "reject", None, None, "r"), ("i2", 2, "accept", "n", '{"value":["B:K1","A:D1"]}', "r"), ("i3", 1, "accept", "", '{"value":7}', "r")],
                                      "semantic_instance_id string, ordinal long, decision string, notes string, label_override string, reason string")
    got = {r.semantic_instance_id: r for r in evaluation.decided(df, decisions).selectExpr("*", f"{records.gold_json()} AS text").collect()}
    assert [got[i].text for i in ("i1", "i2", "i3")] == ['{"value":"A:V22"}', '{"value":["B:K1","A:D1"]}', '{"value":7}']
    assert [got[i].curation_status for i in ("i1", "i2", "i3")] == ["proposed", "accepted", "accepted"]


def test_canonical_json_equals_the_library(spark):
    numbers = [0.0, -0.0, 1.0, 0.1, 1e-3, 1e-4, 1.5e-4, 9.99e-5, 1e-7, 1e7, 12345678.9, 1e15, 1e16, 1e22, -2.5e-10, 3.141592653589793, 123456789012345.6, 142.0]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").selectExpr("x", f"{h.json_number('x')} AS t").collect()
    assert all(json.dumps(r.x) == r.t for r in got)
    value = {"b": [1, 2, None], "a": {"z": 1.5, "é": None}, "c": True, "m": {"k2": ['x"y\\'], "k1": []}, "it's": "a\nb"}
    df = spark.createDataFrame([(value,)], "v struct<b:array<int>,a:struct<z:double,`é`:string>,c:boolean,m:map<string,array<string>>,`it's`:string>")
    assert df.selectExpr(h.canonical("v", df.schema["v"].dataType)).collect()[0][0] == json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, f"t{i}", None if i % 3 else i / 7) for i in range(500)], "id long, a string, b double")
    digest = lambda d: identity.digest_of(d, "id", d.columns).collect()[0]
    assert digest(df) == digest(df.orderBy(F.desc("id")).repartition(3)) and digest(df).n == 500
    assert digest(df) != digest(df.withColumn("a", F.expr("IF(id = 77, 'x', a)"))) and digest(df.limit(0)).n == 0
    configs = spark.createDataFrame([("m/x", "p", "e", "r", None, 1, {"t": 0.5}, ""), ("m/x", "p", "e", "r", None, 2, {"t": 0.5}, ""), ("m/x", "p", "e", "r", None, 1, {"t": 0.5}, "mine")],
                                    "model_id string, provider string, endpoint string, revision string, reasoning_effort string, completions int, sampling map<string,double>, label string")
    ids = [r.run_id for r in identity.run_ids(configs, "'abc'").collect()]
    assert ids[0].startswith("m_x-") and ids[2].startswith("mine-") and ids[0][-10:] == ids[2][-10:] != ids[1][-10:]


def test_chain_permutations_come_in_order(spark):
    from itertools import permutations
    for n in (1, 2, 3, 4, 6):
        got = spark.range(1).selectExpr(f"{episodes.permutations('array(' + ', '.join(map(repr, 'ABCDEF'[:n])) + ')')} AS p").collect()[0].p
        assert [tuple(x) for x in got] == list(permutations("ABCDEF"[:n]))[:13]


def test_unmapped_chains_get_free_letters(spark):
    cols = "structure_id string, residue_idx int, chain string, seq_id int, entity string, name string, poly_index int, label string"
    first = spark.createDataFrame([("e", i, c, 1, "protein", "ALA", 0, f"{c}:A1") for i, c in enumerate("ABC")], cols)
    second = spark.createDataFrame([("e", i, c, 1, "protein", "ALA", 0, f"{c}:A1") for i, c in enumerate(["X", "A", "C", "q"])], cols)
    aligned = spark.createDataFrame([("e", {"A": "X"})], "structure_id string, chain_map map<string,string>")
    assert {r.chain: r.new_chain for r in episodes.renames(aligned, first, second).collect()} == {"X": "A", "A": "D", "C": "E", "q": "q"}


def test_operator_expressions(spark):
    cases = {"1": [["1"]], "1,2": [["1"], ["2"]], "(1-3)": [["1"], ["2"], ["3"]], "(1-2)(3,P)": [["1", "3"], ["1", "P"], ["2", "3"], ["2", "P"]], "1,(2,P)": [["1", "2"], ["1", "P"]],
             "(X0)(1-2)(7)": [["X0", "1", "7"], ["X0", "2", "7"]]}
    rows = spark.createDataFrame([(k,) for k in cases], "e string").selectExpr("e", f"{structures.expanded_operators('e')} AS p").collect()
    assert {r.e: [list(x) for x in r.p] for r in rows} == cases


def test_prompts_are_read_line_by_line(spark):
    prompt = "Structure:\nnote\n\nATOM  x\nTER\nword\nEND\n\nATOM  after\nStructure 2:\nnothing\n\n Structure 3: \nHETATM y"
    got = [(r.block, r.label, r.content) for r in reading.blocks(spark.createDataFrame([("r", prompt), ("e", ""), ("n", None)], "render_id string, user_prompt string")).collect()]
    assert got == [(0, "Structure", "ATOM  x\nTER\nEND"), (2, "Structure 3", "HETATM y")]
    named = spark.createDataFrame([("i", '{"a":"A:V22 and A:V22"}', '["A:V22--B:ZN7"]', None)], "semantic_instance_id string, question_parameters string, gold string, evidence string")
    assert {(r.label, r.chain, r.number, r.role) for r in reading.highlights(named).collect()} == {("A:V22", "A", 22, "query"), ("B:ZN7", "B", 7, "gold")}


def test_reasoning_is_found_where_providers_put_it(spark):
    bodies = ['{"choices":[{"message":{"reasoning_content":"a","reasoning":"b"}}]}', '{"choices":[{"message":{"reasoning_content":"  "},"reasoning":"c"}]}', '{"choices":[{"message":{"reasoning":[{"text":"x"},{"n":1},{"text":"y"}]}}]}', '{"choices":[]}', "no json", None]
    got = {r.i: r.reasoning for r in responses.reasoning(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"), "i").collect()}
    assert got == {0: "a", 1: "c", 2: "x\ny", 3: "", 4: "", 5: ""}


def test_sources_of_a_configuration(spark, tmp_path):
    proteins = spark.createDataFrame([("pdb", "1abc"), ("pdb", "1ABC"), ("afdb", "p1")], "source_type string, entry string")
    pairs = spark.createDataFrame([(("pdb", "2xyz"), ("afdb", "p1"))], "state1 struct<source_type:string,entry:string>, state2 struct<source_type:string,entry:string>")
    chosen = spark.createDataFrame([("e1",)], "episode string")
    known = spark.createDataFrame([("e1", "3AAA"), ("e2", "4BBB")], "episode string, entry string")
    got = {(r.source_type, r.entry) for r in provenance.needed_sources(proteins, pairs, chosen, known).collect()}
    assert got == {("pdb", "1ABC"), ("afdb", "P1"), ("pdb", "2XYZ"), ("pdb", "3AAA")}
    for name, entry in (("b", "2"), ("a", "1")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"entry": entry}, indent=1))
    assert [(r.file_name, r.entry) for r in provenance.cached_records(spark, str(tmp_path), "entry string").collect()] == [("a.json", "1"), ("b.json", "2")]


def test_suite_passes_a_clean_dataset(spark):
    instances = full(spark, [("i1", "residue", "A:V22")]).selectExpr("*", "'S01' AS question_family", "'p' AS protein_group_id", "array('a') AS source_entries", "array('h') AS source_file_sha256s", "'{\"gap\":1}' AS selection_margins",
                                                                      "'1' AS definition_version", "'accepted' AS curation_status", "CAST(NULL AS STRING) AS curator_override", "'' AS curator_notes", f"sha2({records.gold_json()}, 256) AS gold_hash")
    renders = spark.createDataFrame([("r1", "i1", "minimal_pdb", 1, "ATOM", "c")], "render_id string, semantic_instance_id string, representation string, rotation_seed long, user_prompt string, displayed_coordinates_sha256 string").withColumn(
        "prompt_sha256", F.sha2("user_prompt", 256))
    fresh = spark.createDataFrame([("i1", "A:V22")], "id string, answer string")
    found = validation.violations(validation.Dataset(instances, renders, {"S01": 1}, 2, (1, 5), True, recomputed=fresh))
    assert found.count() == 0 and validation.verdict(found).collect()[0].passes
    assert [r.rule for r in validation.violations(validation.Dataset(instances, renders, {"S01": 9}, 2), ["targets", "cap"]).collect()] == ["targets"]


def test_candidates_of_a_dataset_are_not_broadcast(spark, sf, monkeypatch):
    from residuum.plans import families
    from residuum.session import stage
    from residuum.sources import tables

    seen = []

    def shown(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def watched(df):
        seen.append(shown(df))
        return stage(df)

    atoms = stage(tables.atoms(spark, sf))
    a = families.Analysis(atoms)
    proposals = [families.PROPOSERS[f](a).select(*families.COLUMNS) for f in ("S01", "S06", "S07")]
    seen += map(shown, proposals)
    monkeypatch.setattr(assembly, "stage", watched)
    monkeypatch.setattr(select, "stage", watched)
    confidence = atoms.select("structure_id", "label", "residue_idx").distinct().selectExpr("structure_id", "label", "IF(residue_idx % 53 = 7, 60D, NULL) AS confidence")
    good, _ = assembly.admissible(stage(proposals[0].unionByName(proposals[1])), atoms, assembly.Plan(("S01", "S06"), {}, 11, 34_600, predicted="true"), confidence)
    ordered = select.pooled_order(good, ["family", "structure_id"], ["rank", "parameters"], "xxhash64(parameters)")
    seen.append(shown(ordered))
    assert len(seen) == 8 and not any("BroadcastExchange" in p for p in seen)
    # Candidates of S01 within 8 of a residue of low confidence are left out, whatever the joins.
    assert 0 < ordered.count() < proposals[0].filter("accepted").count() + proposals[1].filter("accepted").count()
