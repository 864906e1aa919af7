import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.operators import backbone, contacts, network, select, sequence, spatial, surface
from residuum.operators.display import generator
from residuum.plans import evaluation, families, report


def cloud(spark, n=300, seed=1, hot=0):
    rng = np.random.default_rng(seed)
    xyz = np.vstack([rng.uniform(-9, 9, size=(n, 3)), rng.normal(scale=0.2, size=(hot, 3))]).round(3)
    rows = [("s", i, i // 4, f"A{i % 4}", *map(float, p)) for i, p in enumerate(xyz)]
    return xyz, spark.createDataFrame(rows, "structure_id string, atom_idx long, residue_idx long, atom_name string, x double, y double, z double")


@pytest.mark.parametrize("probe", [False, True])
@pytest.mark.parametrize("partitions", [1, 7])
def test_radius_pairs_match_brute_force(spark, probe, partitions):
    xyz, df = cloud(spark, 200, hot=100)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {(r.a_atom_idx, r.b_atom_idx) for r in spatial.radius_pairs(df, 2.5, [], probe=probe, hot_rows=20).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=-1)
    assert got == {(i, j) for i in range(len(xyz)) for j in range(i + 1, len(xyz)) if d[i, j] <= 2.5}


def test_boundary_distance_is_included(spark):
    df = spark.createDataFrame([("s", 0, 0, "A", 0.0, 0.0, 0.0), ("s", 1, 1, "A", 4.0, 0.0, 0.0), ("s", 2, 2, "A", 8.001, 0.0, 0.0)],
                               "structure_id string, atom_idx long, residue_idx long, atom_name string, x double, y double, z double")
    assert [(r.a_atom_idx, r.b_atom_idx) for r in spatial.radius_pairs(df, 4.0, []).collect()] == [(0, 1)]


def test_nearest_target_is_unbounded(spark):
    xyz, df = cloud(spark, 60)
    far = df.withColumn("x", F.col("x") + 300)
    got = {r.residue_idx: r.distance for r in contacts.min_distance_to(df, far, 4.0).collect()}
    moved = xyz + [300, 0, 0]
    d = np.linalg.norm(xyz[:, None] - moved[None], axis=-1).min(axis=1)
    assert all(abs(got[i] - d[4 * i:4 * i + 4].min()) < 1e-9 for i in range(15))


def test_greedy_matching(spark):
    rng = np.random.default_rng(4)
    edges = [("g", i, j, float(rng.integers(1, 9))) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.4]
    df = spark.createDataFrame(edges, "g string, a long, b long, d double")
    got = {(r.a, r.b) for r in contacts.greedy_matching(df, ["g"], "a", "b", ["d", "a", "b"]).collect()}
    used, want = set(), set()
    for _, a, b, _ in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    assert got == want


def test_runs_cross_block_borders(spark):
    values = [0, 0, 1, 1, 1, None, None, 1, 0, 0, 0, 0, 0, 2]
    positions = [*range(9), *range(10, 15)]
    df = spark.createDataFrame([("k", p, v) for p, v in zip(positions, values)], "k string, p long, v int")
    rows = {r.p: (r.run_start, r.run_length, r.edge_distance) for r in sequence.runs(df, ["k"], "p", "v", block_rows=3).collect()}
    assert rows[1] == (0, 2, 0) and rows[3] == (2, 3, 1) and rows[6] == (5, 2, 0)
    assert rows[8] == (8, 1, 0) and rows[12] == (10, 4, 1)


def test_numbering_and_dense_positions(spark):
    df = spark.createDataFrame([(f"k{i % 3}", i * 7 % 101) for i in range(101)], "k string, v long")
    got = sequence.numbered(df, ["k"], ["v"], "v div 10", "n").collect()
    for key in ("k0", "k1", "k2"):
        ordered = sorted((r.v, r.n) for r in got if r.k == key)
        assert [n for _, n in ordered] == list(range(len(ordered)))
    names = spark.range(500).selectExpr("concat('c', id * 37 % 500) AS c")
    ranks = {r.c: r.position for r in sequence.dense_positions(names, "c", buckets=8).collect()}
    assert [c for c, _ in sorted(ranks.items(), key=lambda kv: kv[1])] == sorted(ranks) and sorted(ranks.values()) == list(range(500))


def chain_atoms(spark, kind):
    """Ideal helix or strand pair built from cylinder coordinates; hydrogen-bond geometry of textbooks."""
    rows, atom = [], 0
    shape = {"N": (1.53, -27.3, -0.88), "CA": (2.29, 0.0, 0.0), "C": (1.66, 26.3, 1.07), "O": (1.90, 20.0, 2.27)}
    for k in range(16):
        for name, (r, turn, z) in shape.items():
            t = np.radians(100.0 * k + turn)
            rows.append(("s", atom, k, name, name[0], float(r * np.cos(t)), float(r * np.sin(t)), 1.5 * k + z, "A", "ALA", "ALA", "protein", k, f"A:A{k}"))
            atom += 1
    return spark.createDataFrame(rows, "structure_id string, atom_idx long, residue_idx long, atom_name string, element string, x double, y double, "
                                 "z double, chain string, name string, parent string, entity string, poly_index int, label string")


def test_ideal_helix_is_a_helix(spark):
    codes = {r.residue_idx: r.code for r in backbone.secondary_structure(chain_atoms(spark, "helix")).collect()}
    assert all(codes[k] == "H" for k in range(1, 14)) and codes[0] != "H"


def test_surface_of_isolated_and_touching_atoms(spark):
    rows = [("one", 0, 0, "C", 0.0), ("two", 0, 0, "C", 0.0), ("two", 1, 1, "C", 3.0), ("ion", 0, 0, "C", 0.0), ("ion", 1, 1, "NA", 6.0)]
    df = spark.createDataFrame([(s, a, r, e, x, 0.0, 0.0) for s, a, r, e, x in rows],
                               "structure_id string, atom_idx long, residue_idx long, element string, x double, y double, z double")
    got = {(r.structure_id, r.atom_idx): (r.area, r.open_points) for r in surface.atom_areas(df).collect()}
    assert got["one", 0][0] == pytest.approx(4 * np.pi * 3.1 ** 2)
    unit = surface.sphere_points(960) * 3.1
    assert got["two", 0][1] == int((((unit - [3.0, 0, 0]) ** 2).sum(axis=1) >= 3.1 ** 2).sum())
    # a wide ion reaches further than the common grid
    assert got["ion", 0][1] == int((((unit - [6.0, 0, 0]) ** 2).sum(axis=1) >= 3.67 ** 2).sum()) < 960


def test_shortest_paths_keep_all_ties(spark):
    edges = spark.createDataFrame([("s", a, b, 1.0) for a, b in [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5)]], "structure_id string, i long, j long, distance double")
    pairs = spark.createDataFrame([("s", 0, 3), ("s", 0, 4), ("s", 0, 5), ("s", 2, 2)], "structure_id string, source long, target long")
    got = sorted(tuple(r.path) for r in network.shortest_paths(edges, pairs, 3).collect())
    assert got == [(0, 1, 3), (0, 1, 3, 4), (0, 2, 3), (0, 2, 3, 4), (2,)]


def test_quota_fold_equals_sequential_choice(spark):
    rng = np.random.default_rng(8)
    rows = [(f"f{rng.integers(3)}", int(rng.integers(6)), i, bool(rng.random() < 0.8)) for i in range(200)]
    df = spark.createDataFrame(rows, "family string, cluster long, place long, usable boolean")
    got = {r.place for r in select.quota_fold(df, ["f0", "f1", "f2"], {"f0": 9, "f1": 9, "f2": 9}, 4).collect()}
    used, want = {}, set()
    for family in ("f0", "f1", "f2"):
        made = 0
        for f, c, p, ok in rows:
            if f == family and ok and made < 9 and used.get(c, 0) < 4:
                used[c] = used.get(c, 0) + 1
                made += 1
                want.add(p)
    assert got == want


def test_bootstrap_equals_resampling_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{rng.integers(7)}", f"f{rng.integers(3)}", float(rng.integers(5)) / 4) for _ in range(90)]
    df = spark.createDataFrame(rows, "cluster string, question_family string, score double").withColumn("protein_group_id", F.lit("p"))
    got = report.clustered_bootstrap(df, "macro", samples=300).collect()[0]
    clusters = sorted({c for c, _, _ in rows})
    draw = generator("macro", len(clusters), 300)
    values = []
    for _ in range(300):
        families = {}
        for pick in draw.integers(0, len(clusters), size=len(clusters)):
            for c, f, s in rows:
                if c == clusters[pick]:
                    families.setdefault(f, []).append(s)
        values.append(np.mean([np.mean(v) for v in families.values()]))
    assert got.ci_low == pytest.approx(np.percentile(values, 2.5)) and got.ci_high == pytest.approx(np.percentile(values, 97.5))
    assert got.n_clusters == 7


def test_cache_mismatch_is_an_error(spark):
    requests = spark.createDataFrame([("d1", "r1"), ("d2", "r2")], "digest string, request string")
    good = spark.createDataFrame([("d1", "r1", "x")], "digest string, request string, response string")
    assert {(r.digest, r.response) for r in evaluation.with_cache(requests, good).collect()} == {("d1", "x"), ("d2", None)}
    bad = spark.createDataFrame([("d1", "other", "x")], "digest string, request string, response string")
    with pytest.raises(Exception, match="does not match"):
        evaluation.with_cache(requests, bad).collect()


def test_batch_outputs_are_all_or_nothing(spark):
    inputs = spark.createDataFrame([("j1", "a"), ("j1", "b"), ("j2", "c")], "job_id string, custom_id string")
    outputs = spark.createDataFrame([("j1", "a", "1"), ("j1", "b", "2"), ("j1", "b", "3"), ("j2", "c", "4"), ("j2", "zz", "5")], "job_id string, custom_id string, body string")
    assert [tuple(r) for r in evaluation.batch_outputs(inputs, outputs).collect()] == [("j1", "a", "1")]


def test_batches_are_filled_greedily(spark):
    rng = np.random.default_rng(9)
    sizes = [int(v) for v in rng.integers(1, 60, size=157)]
    df = spark.createDataFrame([("r", i, b) for i, b in enumerate(sizes)], "run_id string, place long, bytes long")
    got = [r.chunk for r in evaluation.batch_chunks(df, max_requests=6, max_bytes=100).orderBy("place").collect()]
    want, chunk, count, total = [], 0, 0, 0
    for b in sizes:
        if count and (count == 6 or total + b > 100):
            chunk, count, total = chunk + 1, 0, 0
        count, total = count + 1, total + b
        want.append(chunk)
    assert got == want


def test_clashes_of_wide_elements(spark):
    rows = [("s", 0, 0, "K1", "K", 0.0), ("s", 1, 1, "C1", "C", 3.9), ("s", 2, 2, "K2", "K", -4.0), ("s", 3, 3, "C2", "C", 8.0)]
    atoms = spark.createDataFrame(rows, "structure_id string, residue_idx int, atom_idx int, atom_name string, element string, x double").selectExpr(
        "*", "0D AS y", "0D AS z", "'ligand' AS entity", "CAST(residue_idx AS STRING) AS label")
    none = spark.createDataFrame([], "structure_id string, atom_a int, atom_b int")
    got = {(r.residue_idx_i, r.residue_idx_j): round(r.overlap, 2) for r in contacts.clashes(atoms, none).collect()}
    assert got == {(0, 1): 0.15, (0, 2): 1.10}


def test_pooled_order_keeps_the_rest(spark):
    rows = select.pooled_order(spark.range(40).selectExpr("'k' AS k", "id"), ["k"], ["id"], "-id").orderBy(F.col("pool_rank").asc_nulls_last(), "id").collect()
    assert [r.id for r in rows] == [*range(15, -1, -1), *range(16, 40)]


def test_contact_changes_fall_back_to_both_pools(spark):
    def pairs(name, gained, lost):
        return [(name, f"A{i:02}", f"B{i:02}", 9.0, 9.0 - i / 10, v) for i, v in enumerate(["gained"] * gained + ["lost"] * lost)]
    changes = spark.createDataFrame(pairs("x", 1, 10) + pairs("y", 5, 5) + pairs("z", 3, 0) + pairs("w", 2, 2) + [("v", "a", "b", 5.0, 5.0, "retained_noncontact")],
                                    "structure_id string, l1 string, l2 string, d1 double, d2 double, verdict string")
    got = {r.structure_id: (r.reason, len(r.required) // 2) for r in families.t01(changes, "xxhash64(l1, l2)").collect()}
    lacks = "state_pair_lacks_both_gained_and_lost_contacts"
    assert got == {"x": (None, 8), "y": (None, 8), "z": (lacks, 3), "w": ("too_few_unambiguous_contact_changes", 4), "v": (lacks, 0)}


def test_copied_sides_are_not_broadcast(spark, sf):
    """Catalyst takes rows copied to touching cells for as small as their source: no static broadcast may rest on that."""
    from residuum.operators import covalent, network
    from residuum.operators.spatial import radius_join, radius_pairs
    from residuum.session import stage
    from residuum.sources import tables

    atoms = stage(tables.atoms(spark, sf))
    bonds = covalent.bonds(atoms)
    edges = radius_pairs(atoms, 4.0, []).selectExpr("structure_id", "a_atom_idx AS i", "b_atom_idx AS j", "distance")
    for df in (radius_pairs(atoms, 4.0, []), radius_join(atoms, atoms, 4.0), bonds, covalent.separations(bonds, 2),
               network.common_neighbours(edges)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_equal_sequence_pairs_are_aligned_once_and_spread(spark):
    from residuum.operators import superpose

    pairs = spark.createDataFrame([(i, "green anvil", "red anvil" if i % 2 else "blue anvil") for i in range(60)], "pair_id long, first string, second string")
    found = superpose.aligned_sequences(pairs)
    assert found.count() == 2 and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = superpose.align_chains(pairs).groupBy("pair_id").count().collect()
    want = {k: len(superpose.align_sequences("green anvil", b)[0]) for k, b in ((0, "blue anvil"), (1, "red anvil"))}
    assert {r.pair_id: r["count"] for r in rows} == {i: want[i % 2] for i in range(60)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gained_interactions_do_not_broadcast(spark, sf):
    from residuum.plans import mechanistic
    from residuum.session import stage
    from residuum.sources import tables

    first = stage(tables.atoms(spark, sf))
    second = first.selectExpr(*["x + 1D AS x" if c == "x" else c for c in first.columns])
    anchors = first.filter("entity = 'ligand'").select("structure_id", "label").distinct()
    assert "BroadcastExchange" not in plan(mechanistic.gained_interactions(anchors, first, second))


def test_target_pairs_of_g03_are_not_broadcast(spark, sf, monkeypatch):
    from residuum.session import stage
    from residuum.sources import tables

    seen = []

    def watched(df):
        if "other_label" in df.columns:
            seen.append(plan(df))
        return stage(df)

    monkeypatch.setattr(families, "stage", watched)
    families.g03(families.Analysis(tables.atoms(spark, sf)))
    assert len(seen) == 2 and not any("BroadcastExchange" in p for p in seen)


def test_secondary_structure_does_not_broadcast(spark, sf):
    from residuum.sources import tables

    chains = backbone.chain_backbone(tables.atoms(spark, sf))
    assert "BroadcastExchange" not in plan(backbone.bridges(chains, backbone.hydrogen_bonds(chains)))
    assert "BroadcastExchange" not in plan(backbone.secondary_structure(tables.atoms(spark, sf)))


def test_staged_relations_are_not_broadcast_for_their_compressed_size(spark):
    from residuum.session import estimated_bytes, stage
    rows = spark.range(400_000).selectExpr("concat('S', id div 1000) AS structure_id", "id % 1000 AS residue_idx", "'a name that compresses well' AS label")
    kept = stage(rows)
    assert estimated_bytes(kept) < 1 << 20  # of 20 MB in memory
    joined = kept.join(kept.withColumnRenamed("label", "other"), ["structure_id", "residue_idx"])
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert joined.count() == 400_000
