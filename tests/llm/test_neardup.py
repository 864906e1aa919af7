"""Near duplicates, components and the pipeline against brute force."""

import random
import re

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from residuum.llm import neardup, quality, secrets
from residuum.llm.components import components

DOCS = "doc_id long, text string, set_key string, _id int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def plain_components(rows, percent):
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one TWO three"), (5, "One two THREE"), (6, "one two three four"), (7, "İ x y z q w"), (None, "one two three")]
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(copy)))
    return rows + [rows[-1], (rows[-1][0], "another text under the same id altogether")]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    for percent in (85, 80):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent).collect()), key=str)
        assert got == sorted(plain_components(rows, percent), key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(d, t) for (d, t), (_, n, c) in zip(rows, plain_components(rows, 80)) if c == d}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_cuts_and_chunks_lose_nothing(spark, monkeypatch):
    """Many small parts and blocks give the same components."""
    rows = corpus(9)
    monkeypatch.setattr(neardup, "ENTRIES", 300)
    monkeypatch.setattr(neardup, "CHUNK", 3)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted(plain_components(rows, 85), key=str)


def test_links_that_the_forest_misses_are_found(spark, monkeypatch):
    """Without a single neighbour from the forest the components are the same."""
    rows = corpus(11)
    none = spark.createDataFrame([], "a binary, near array<binary>")
    monkeypatch.setattr(neardup, "candidates", lambda nodes, percent: none)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    for percent in (85, 80):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent).collect()), key=str)
        assert got == sorted(plain_components(rows, percent), key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "bpe_tokens"]
    kept = {r.doc_id for r in quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    first = {d for d, (_, _, c) in zip((d for d, _ in rows), plain_components(rows, 80)) if c == d}
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {}
    for d, t in rows:
        clean = " ".join(re.findall(r"[^\W_]+", t.lower()))
        if d in first and not any(" ".join(i) in clean for i in items):
            left[d] = t
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(left) and len(got) == len(left)
    for r in got:
        found = [m for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX) for m in re.finditer(p, left[r.doc_id])]
        if not found:
            assert r.ids == library.encode(left[r.doc_id], add_special_tokens=False).ids
        else:
            assert "secret" in r.decoded and not any(m[0].lower() in r.decoded.replace("</w> ", "") for m in found)
    empty = docs.limit(0)
    for _, stage_function in corpus_pipeline.STAGES:
        assert stage_function(spark, empty, sf).count() == 0


def test_each_text_is_cut_once_for_signatures_and_bins(spark):
    texts = ["a b c d e f g", None, "  ", "a b c d e f g", "one two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    described, bins = neardup.describe(docs)
    assert sorted(r.doc_id for r in described.collect()) == [0, 1, 2, 3, 4]
    want = {}
    for t in texts:
        for h in neardup.shingles(t):
            want[int(h) >> 64 - neardup.BIN_BITS] = want.get(int(h) >> 64 - neardup.BIN_BITS, 0) + 1
    assert {r.bin: r.n for r in bins.collect()} == want


def test_bins_of_many_tasks_are_added_without_a_row_for_each_bin_and_task(spark):
    texts = [f"w{i} x y z v u t {i % 3} one two three" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    _, bins = neardup.describe(docs)
    want = {}
    for t in texts:
        for h in neardup.shingles(t):
            want[int(h) >> 64 - neardup.BIN_BITS] = want.get(int(h) >> 64 - neardup.BIN_BITS, 0) + 1
    rows = bins.collect()
    assert len(rows) == len(want) and {r.bin: r.n for r in rows} == want
    assert "Generate" not in bins._jdf.queryExecution().optimizedPlan().toString()
