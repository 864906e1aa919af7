from pyspark.sql import functions as F

from residuum.operators import cleaning, display
from residuum.sources import structures

from .conftest import cif_text, pdb_text


def load(spark, text, name="toy"):
    return spark.createDataFrame([(name, text)], "structure_id string, content string")


def test_pdb_and_mmcif_give_the_same_atoms(spark):
    pdb = structures.parse_pdb(load(spark, pdb_text()))
    cif = structures.parse_mmcif(load(spark, cif_text()))
    cols = ["is_hetatm", "atom_name", "altloc", "name", "chain", "seq_id", "x", "y", "z", "occupancy", "bfactor", "element"]
    key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(pdb) == key(cif)
    assert pdb.count() == 16


def test_cleaning_rules(spark):
    atoms, residues, rejected = cleaning.clean(structures.parse_pdb(load(spark, pdb_text())))
    rows = {(r.label, r.atom_name): r for r in atoms.collect()}
    assert rejected.count() == 0
    # zero occupancy, hydrogen, water and additive are gone; conformer B has the larger occupancy
    assert set(rows) == {("A:K1", "N"), ("A:K1", "CA"), ("A:K1", "CB"), ("A:K1", "C"), ("A:M2", "N"), ("A:M2", "CA"), ("B:D7", "N"), ("B:D7", "CA"),
                         ("A:CA101", "CA"), ("B:L1201", "C1"), ("B:L1201", "O2")}
    assert rows["A:K1", "CB"].y == -1.4
    assert [r.serial for r in sorted(rows.values(), key=lambda r: r.atom_idx)] == list(range(1, 12))
    kinds = {r.label: (r.entity, r.poly_index, r.parent) for r in residues.collect()}
    assert kinds["A:M2"] == ("protein", 1, "MET") and kinds["B:D7"][1] == 0
    assert kinds["A:CA101"][0] == "metal" and kinds["B:L1201"][0] == "ligand"
    confidence = {r.label: r.confidence for r in residues.collect()}
    assert confidence["A:M2"] == 10.0


def test_keeping_a_component_drops_the_others(spark):
    atoms, _, _ = cleaning.clean(structures.parse_pdb(load(spark, pdb_text())), keep=("SO4",))
    assert {r.orig_name for r in atoms.select("orig_name").distinct().collect()} == {"LYS", "MSE", "ASP", "SO4"}


def test_missing_chain_and_ranges(spark):
    raw = structures.parse_pdb(load(spark, pdb_text()))
    chains = spark.createDataFrame([("toy", "A"), ("toy", "Z")], "structure_id string, chain string")
    atoms, _, rejected = cleaning.clean(raw, chains=chains)
    assert [tuple(r) for r in rejected.collect()] == [("toy", "requested_chain_absent", "Z")] and atoms.count() == 0
    ranges = spark.createDataFrame([("toy", "A", 2, 9)], "structure_id string, chain string, first int, last int")
    splits = spark.createDataFrame([("toy", "B", 0, 7, 7, "P")], "structure_id string, chain string, priority int, first int, last int, new_chain string")
    atoms, _, _ = cleaning.clean(raw, ranges=ranges, splits=splits)
    assert {r.label for r in atoms.select("label").collect()} == {"A:M2", "P:D7", "B:L1201"}


def test_long_chain_names_are_remapped(spark):
    raw = structures.parse_pdb(load(spark, pdb_text())).withColumn("chain", F.expr("IF(chain = 'B', 'A2', chain)"))
    assert {r.chain for r in cleaning.remap_chains(raw).select("chain").distinct().collect()} == {"A", "B"}


def test_assembly_expansion(spark):
    contents = load(spark, cif_text())
    raw = structures.parse_mmcif(contents)
    out = structures.expand_assembly(raw, contents, "1")
    assert out.count() == 2 * raw.count()
    moved = out.filter("chain = 'A2' AND atom_name = 'N' AND seq_id = 1").collect()[0]
    assert (moved.x, moved.y, moved.z) == (50.0, 60.0, 70.0)


def test_render_round_trip(spark):
    atoms, _, _ = cleaning.clean(structures.parse_pdb(load(spark, pdb_text())))
    text = structures.as_documents(structures.minimal_pdb(atoms)).collect()[0].text
    lines = text.splitlines()
    assert lines[-1] == "END"
    # both chains end on a hetero residue here, so there is nothing to terminate
    assert not [line for line in lines if line.startswith("TER")]
    polymer = structures.as_documents(structures.minimal_pdb(atoms.filter("polymer_kind IS NOT NULL").withColumn(
        "serial", F.expr("IF(chain = 'A', serial, serial - 1)")))).collect()[0].text.splitlines()
    assert [line for line in polymer if line.startswith("TER")] == ["TER       7      MSE A   2", "TER      10      ASP B   7"]
    assert lines[0] == "ATOM      1  N   LYS A   1       0.000   0.000   0.000  1.00  0.00           N"
    again = structures.parse_pdb(load(spark, text))
    want = sorted((r.atom_name, r.name, r.x, r.y, r.z) for r in atoms.collect())
    assert sorted((r.atom_name, r.name, r.x, r.y, r.z) for r in again.collect()) == want
    table = structures.parse_normalized(structures.normalized_table(atoms))
    assert sorted((r.atom_name, r.name, r.x, r.y, r.z) for r in table.collect()) == want


def test_display_is_a_rigid_motion(spark):
    atoms, _, _ = cleaning.clean(structures.parse_pdb(load(spark, pdb_text())))
    seeds = spark.createDataFrame([("toy", "d1", 42)], "structure_id string, display_id string, seed long")
    shown = display.displayed(atoms.withColumn("display_id", F.lit("d1")), display.transforms(atoms, seeds))
    a = {r.atom_idx: (r.x, r.y, r.z) for r in atoms.collect()}
    b = {r.atom_idx: (r.x, r.y, r.z) for r in shown.collect()}
    dist = lambda p, q: sum((u - v) ** 2 for u, v in zip(p, q)) ** 0.5
    assert all(abs(dist(a[i], a[j]) - dist(b[i], b[j])) < 0.003 for i in a for j in a)
    assert all(round(v, 3) == v for p in b.values() for v in p)
