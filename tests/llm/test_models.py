"""Learned operators and spaced seeds against plain versions and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from residuum.llm import catalogue, decontaminate, gru, langid, lm

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double"


def plain_cell(table_row, weights, h):
    size = len(h)
    through = h @ weights
    z = np.clip(0.25 * (table_row[:size] + through[:size]) + 0.5, 0, 1)
    r = np.clip(0.25 * (table_row[size:2 * size] + through[size:2 * size]) + 0.5, 0, 1)
    new = np.tanh(table_row[2 * size:] + r * through[2 * size:])
    return z * h + (1 - z) * new


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, u, h0 = rng.standard_normal((5, 3, 12)).astype(np.float32), gru.glorot(rng, 4, 12), np.zeros((3, 4), np.float32)
    pull = rng.standard_normal((5, 3, 4)).astype(np.float32)
    _, memory = gru.forward(x, u, h0, True)
    dx, du = gru.backward(pull, u, memory)
    loss = lambda x, u: float((gru.forward(x, u, h0).astype(np.float64) * pull).sum())
    for array, grad in ((x, dx), (u, du)):
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in array.shape)
            moved = [array.copy() for _ in range(2)]
            moved[0][at] += 1e-2
            moved[1][at] -= 1e-2
            both = [loss(m, u) if array is x else loss(x, m) for m in moved]
            assert abs((both[0] - both[1]) / 2e-2 - grad[at]) < 2e-2


def test_language_positions_equal_plain_network():
    model = langid.train([("en", ["the cat and the dog"] * 4), ("fr", ["le chat été à la"] * 4)])
    p, text = model["params"], "the chat été".encode()
    codes = np.frombuffer(text.ljust(langid.WINDOW, b"\0"), np.uint8)
    f, b, h = [], [], np.zeros(langid.SIZE)
    for c in codes:
        f.append(h := plain_cell(p["t_f"][c], p["u_f"], h))
    h = np.zeros(langid.SIZE)
    for c in codes[::-1]:
        b.append(h := plain_cell(p["t_b"][c], p["u_b"], h))
    logits = np.concatenate([f, b[::-1]], axis=1) @ p["w"] + p["c"]
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(langid.position_labels(model, codes[None])[0], want, atol=1e-4)
    assert np.allclose(langid.pooled(model, [text, text * 20])[0], want[:len(text)].mean(axis=0), atol=1e-4)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = catalogue.QUERIES["op3_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)


def test_language_edges(spark):
    five = next(i for i in range(5, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = spark.createDataFrame([(1, None, "en", 0.), (2, "", "en", 0.), (3, "12 ?! \n", "de", 0.), (None, "words here", None, 0.), (five, "words " * 9000, "en", 0.), (five, "words " * 9000, "en", 0.)], DOCS)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (five, "en"), (five, "en")], key=str)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_base(texts):
    cut = {i: lm.tokens(t) for i, t in texts.items()}
    counts = Counter(w for i, ws in cut.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in ws)) for i, ws in cut.items()}


def test_lm_base_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 3000)  # so that many words take the join
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, want = plain_base(texts)
    rows = catalogue.QUERIES["op10_lm_scoring"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n) and math.isclose(r.base_score, want[r.doc_id][2], rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_is_a_distribution_and_carries_its_state():
    model = lm.Model([("the", 50), (lm.END, 30), ("a", 20), ("b", 5), ("c", 4), ("d", 1)])
    rng = np.random.default_rng(1)
    model.train([list(rng.integers(0, 7, 40)) for _ in range(30)])
    h = np.repeat(rng.standard_normal((1, lm.SIZE)).astype(np.float32), 7, axis=0)
    assert math.isclose(np.exp(model.log_probs(h, np.arange(7))).sum(), 1, rel_tol=1e-5)
    texts = [rng.integers(0, 7, n) for n in (1, 200, 33, 64, 32)]
    for text, got in zip(texts, model.score(texts)):
        state, last, total = np.zeros(lm.SIZE), model.end(), 0.0
        for symbol in text:
            state = plain_cell(model.p["table"][last], model.p["u"], state)
            total += model.log_probs(state[None].astype(np.float32), np.array([symbol]))[0]
            last = symbol
        assert math.isclose(total, got, rel_tol=1e-4)


def test_lm_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)  # so that a round has several shards
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = []
    for laid in (docs.coalesce(1), docs.repartition(7, "n_chars")):
        monkeypatch.setattr(lm, "TASKS", 3 if scores else 16_384)
        scores.append({r.doc_id: r.score for r in lm.score_texts(laid).collect()})
    assert all(math.isclose(s, scores[1][i], rel_tol=1e-4) for i, s in scores[0].items())


def test_log_softmax_with_and_without_shift():
    rng = np.random.default_rng(3)
    logits, targets = rng.normal(0, 9, (50, 11)).astype(np.float32), rng.integers(0, 11, 50)
    exact = logits.astype(float) - np.log(np.exp(logits.astype(float)).sum(axis=1, keepdims=True))
    for shifted in (True, False):
        np.testing.assert_allclose(lm._log_softmax(logits.copy(), targets, shifted), exact[np.arange(50), targets], rtol=1e-4, atol=1e-4)


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", 0.), (2, "", "x", 0.), (None, "Ab ab", None, 0.), (3, "q " * 5000, "x", 0.), (3, "q " * 5000, "x", 0.)], DOCS)
    got = sorted((r.n_tokens, r.n_known) for r in lm.score_texts(docs).collect())
    assert [n for n, _ in got] == [1, 1, 3, 5001, 5001]
    assert lm.score_texts(docs.limit(0)).count() == 0
    one = lm.score_texts(docs.where("doc_id = 999")).collect()
    assert one == []


BENCH = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi", "one two three four five", "solo", None, "?!",
         "red orange yellow green blue indigo violet black white brown pink grey"]


def plain_leaks(texts, items):
    import re
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text in texts:
        for i, item in enumerate(items):
            a, b = cut(text), cut(item)
            for shift in range(-len(b), len(a)):
                now = equal = best = best_equal = 0
                for j in range(len(b)):
                    if not 0 <= j + shift < len(a):
                        continue
                    same = a[j + shift] == b[j]
                    if now <= 0:
                        now = equal = 0
                    now, equal = now + (1 if same else -4), equal + same
                    if now > best:
                        best, best_equal = now, equal
                if b and best > 0 and best_equal >= min(decontaminate.MIN_WORDS, len(b)):
                    out.add((d, i))
    return out


def test_leaks_equal_plain_search(spark):
    a = BENCH[0].split()
    texts = ["x y " + BENCH[0] + " z", " ".join(a[:6] + ["CHANGED"] + a[7:]), " ".join(a[:5]), "it is One, two; three FOUR five!", "a solo act", None, "", "clean words only",
             BENCH[0] + " pad " + BENCH[0] + " " + BENCH[5], " ".join(a[:4] + ["u", "v", "w"] + a[7:]), " ".join(BENCH[5].split()[:11]), "one two three six five"]
    docs = spark.createDataFrame([(i, t, "x", 0.) for i, t in enumerate(texts)] + [(0, texts[0], "x", 0.), (None, BENCH[5], "x", 0.)], DOCS).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(BENCH)) + [(0, BENCH[0])], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    want = plain_leaks([*enumerate(texts), (None, BENCH[5])], BENCH)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    clean = decontaminate.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert decontaminate.leaks(docs, bench.limit(0)).count() == decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_leaks_on_given_tables(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    texts[0] = (texts[0][0], texts[0][1][:300] + " " + items[2] + " " + texts[0][1][300:])
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == plain_leaks([(d, t) for d, t in texts if len(t) < 3000 or d == texts[0][0]], items)


def test_words_are_counted_in_parts_and_others_once_a_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 3)  # so that a task sends its counts on several times
    texts = ["A b\x0bC a", None, "", "é É x\u00a0y  x\u00a0y\tb", "zz " * 500]
    docs = spark.createDataFrame([(i, t, False, i) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean, deal long")
    plain = Counter(w for t in texts for w in lm.tokens(t))
    got = lm.count_words(docs)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.word: r.c for r in got.collect()} == plain
    cut = lm.cut_texts(docs, {lm.END: 5, "a": 2, "b": 2}, 2, float, float).orderBy("doc_id").collect()
    assert [{w.word: w.k for w in r.others} for r in cut] == [{k: n for k, n in Counter(lm.tokens(t)).items() if k not in (lm.END, "a", "b")} for t in texts]
    assert [(r.n_tokens, r.n_known, r.base) for r in cut] == [(5, 4, 11.0), (1, 1, 5.0), (1, 1, 5.0), (6, 2, 7.0), (501, 1, 5.0)]
