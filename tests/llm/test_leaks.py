"""Planted substitutions in benchmark items against rules that are not the operator's own."""

import random

from residuum.llm import decontaminate


def found(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}


def seeded(equal):
    return any(all(equal[i + k] for k, bit in enumerate(mask) if bit == "1") for mask in decontaminate.MASKS for i in range(len(equal) - len(mask) + 1))


def test_one_and_two_changes_at_every_place(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in (10, 12, 15, 16, 20)]
    rows, want = [], set()
    for n, text in items:
        w = text.split()
        for i in range(n):
            for j in range(i, n):
                changed = [f"c{k}" if k in (i, j) else x for k, x in enumerate(w)]
                rows.append((len(rows), " ".join(["before", "it", *changed, "behind", "it"])))
                if seeded([k not in (i, j) for k in range(n)]):
                    want.add((len(rows) - 1, n))
    got = found(spark, rows, items)
    assert set(got) == want and len(want) > 400
    assert all(r.n_equal >= 0.8 * r.n_words for r in got.values())


def test_part_of_a_long_item_and_spread_changes(spark):
    w = [f"q{k}" for k in range(60)]
    part = " ".join(["x", "y", *w[20:23], "c", *w[24:35], "z"])  # 14 of 15 words, the change at word 4
    spread = " ".join("c" if k % 7 == 3 and not 20 < k < 30 else x for k, x in enumerate(w))
    got = found(spark, [(1, part), (2, spread), (3, " ".join(w[20:31])), (4, " ".join(x if k % 2 else "c" for k, x in enumerate(w[:30])) + " " + " ".join(w[40:51]))], [(0, " ".join(w))])
    assert set(got) == {(1, 0), (2, 0)}
    assert (got[1, 0].n_equal, got[1, 0].n_words, got[1, 0].doc_word) == (14, 15, 3)


def test_random_changes_are_found(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"i{i}k{k}" for k in range(rng.randint(15, 59)))) for i in range(150)]
    rows, want = [], set()
    for i, text in items:
        w = text.split()
        hit = set(rng.sample(range(len(w)), round(0.15 * len(w))))
        equal = [k not in hit for k in range(len(w))]
        rows.append((i, "a b " + " ".join(x if e else "new" for x, e in zip(w, equal)) + " c"))
        if seeded(equal) and not any(not any(equal[k:k + 3]) for k in range(len(w) - 2)):
            want.add((i, i))
    assert set(found(spark, rows, items)) >= want and len(want) > 100
