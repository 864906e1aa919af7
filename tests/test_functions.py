import hashlib
import json
import math
import random

import numpy as np
import pytest

from residuum.functions import answers as an
from residuum.functions import hashing as h
from residuum.functions.geometry import dihedral, vec
from residuum.functions.numeric import linspace_index, round3
from residuum.operators import display, superpose
from residuum.plans import scoring


def test_round3_matches_printf(spark):
    rng = random.Random(5)
    values = [1.0005, 0.1445, 8.1235, 2.0005, -0.0001, -1.0005, 0.0, 9999.9995, -0.0005, 0.0005]
    values += [rng.uniform(-9999, 9999) for _ in range(3000)] + [rng.randint(-10**7, 10**7) / 2000 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("x", f"{round3('x')} AS r")
    for row in df.collect():
        want = float("%.3f" % row.x)
        assert row.r == want and math.copysign(1, row.r) == math.copysign(1, want), row


def test_hashes_match_canonical_json(spark):
    texts = ["plain", 'quo"te', "back\\slash", "tab\tnew\nline", "é ü – 漢", "astral 😀", "\x7f\x01", ""]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    rows = df.selectExpr("t", "i", f"{h.stable_hash(h.text('a'), 't', h.raw('i'))} AS d", f"{h.derive_seed(h.text('a'), 't', h.raw('i'))} AS s").collect()
    for r in rows:
        text = json.dumps(("a", r.t, r.i), sort_keys=True, separators=(",", ":"))
        assert r.d == hashlib.sha256(text.encode()).hexdigest()
        assert r.s == display.seed_of("a", r.t, r.i)


def test_linspace_index(spark):
    for n, k in [(8, 8), (9, 4), (100, 12), (61, 60), (1, 1), (12345, 60)]:
        got = [r.v for r in spark.range(k).selectExpr(f"{linspace_index(f'{n}L', f'{k}L', 'id')} AS v").orderBy("id").collect()]
        assert got == np.linspace(0, n - 1, num=k, dtype=int).tolist()


def test_dihedral_sign_and_value(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, rng.normal(size=12))) for _ in range(200)]
    cols = [f"{p}_{c} double" for p in "abcd" for c in "xyz"]
    got = spark.createDataFrame(rows, ", ".join(cols)).selectExpr("*", f"{dihedral(*(vec(p + '_') for p in 'abcd'))} AS t").collect()
    for r in got:
        p = np.array(r[:12]).reshape(4, 3)
        b = (p[2] - p[1]) / np.linalg.norm(p[2] - p[1])
        v, w = p[0] - p[1], p[3] - p[2]
        v, w = v - v.dot(b) * b, w - w.dot(b) * b
        assert abs(r.t - math.degrees(math.atan2(np.cross(b, v).dot(w), v.dot(w)))) < 1e-9


FINALS = [
    ("thinking\nFINAL: A:V22", "A:V22", {}), ("**FINAL:** A:V22", "A:V22", {}), ("> final: `A:V22`.", "A:V22`", {}), ("> final: `A:V22`", "A:V22", {}),
    ("FINAL: A:V1\nFINAL: B:V2", "B:V2", {}), ("FINAL: A:D18, A:E21,\n\nB:Y44\nmore", "A:D18, A:E21, B:Y44", {}),
    ("FINAL\nA:V22", "A:V22", {}), ("### Final Answer:\n**helix**", "helix", {}),
    ("FINAL\ngained: A:V1--A:V2\nlost: none\n\nrest: x", "", {"gained": "A:V1--A:V2", "lost": "none"}),
    ("**Answer:** 3", None, None), ("", None, None), ("the finality of it", None, None),
]


def test_final_block(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(FINALS)], "i int, response string")
    for r in scoring.with_final(df).collect():
        _, inline, fields = FINALS[r.i]
        assert (r.inline, r.fields) == (inline, fields), FINALS[r.i]


@pytest.mark.parametrize("expression, text, want", [
    (an.canonical_residue, "a: v 022", "A:V22"), (an.canonical_residue, "M:ZN501", "M:ZN501"), (an.canonical_residue, "A:V-3", "A:V-3"),
    (an.canonical_residue, "V22", None), (an.canonical_atom, "a:h57: ne2", "A:H57:NE2"), (an.canonical_atom, "A:H57", None),
    (an.canonical_pair, "B:Y44 -- A:D18", "A:D18--B:Y44"), (an.canonical_pair, "A:D18—B:Y44", "A:D18--B:Y44"), (an.canonical_pair, "A:D18", None),
    (an.canonical_residue_set, "A:D18, A:E21 and B:Y44; a:d18", ["A:D18", "A:E21", "B:Y44"]), (an.canonical_residue_set, "none", []),
    (an.canonical_residue_set, "A:D18, nonsense", None), (an.canonical_string_set, "a, B and c", ["A", "B", "C"]),
    (an.canonical_number, "3.42 Å", 3.42), (an.canonical_number, "about -1.5e2", -150.0), (an.canonical_number, "none", None),
    (an.canonical_integer, "142 residues", 142), (an.canonical_integer, "1.5", None), (an.canonical_triple, "(1.0, -2, 3.5)", [1.0, -2.0, 3.5]),
    (an.canonical_triple, "1, 2", None), (an.canonical_path, "A:D18 -> A:E21 → B:Y44", ["A:D18", "A:E21", "B:Y44"]), (an.canonical_path, "A:D18", None),
    (an.canonical_boolean, "**Yes**.", True), (an.canonical_boolean, "perhaps", None), (an.canonical_choice, "(b) because", "B"), (an.canonical_choice, "both", None),
])
def test_canonical_forms(spark, expression, text, want):
    assert spark.createDataFrame([(text,)], "t string").selectExpr(f"{expression('t')} AS v").collect()[0].v == want


def brute_alignment_score(a, b):
    best = np.full((3, len(a) + 1, len(b) + 1), -np.inf)
    best[0, 0, 0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                best[0, i, j] = best[:, i - 1, j - 1].max() + (2 if a[i - 1] == b[j - 1] else -1)
            if i:
                best[1, i, j] = max(best[0, i - 1, j] - 10, best[1, i - 1, j] - 0.5)
            if j:
                best[2, i, j] = max(best[0, i, j - 1] - 10, best[2, i, j - 1] - 0.5)
    return best[:, -1, -1].max()


def score_of(a, b, left, right):
    """Score implied by the matched positions, gaps opened once per stretch on each side."""
    total, i, j = 0.0, 0, 0
    for p, q in [*zip(left, right), (len(a), len(b))]:
        for gap in (p - i, q - j):
            total += (-10 - 0.5 * (gap - 1)) if gap else 0
        if p < len(a):
            total += 2 if a[p] == b[q] else -1
        i, j = p + 1, q + 1
    return total


def test_alignment_is_optimal():
    rng = random.Random(11)
    for _ in range(60):
        a = "".join(rng.choice("ACDE") for _ in range(rng.randint(12, 40)))
        b = "".join(c for c in a if rng.random() > 0.05) + "A"
        left, right, identity = superpose.align_sequences(a, b)
        assert score_of(a, b, left, right) == pytest.approx(brute_alignment_score(a, b))
        assert identity == sum(a[p] == b[q] for p, q in zip(left, right)) / min(len(a), len(b))
    assert superpose.align_sequences("ACD", "")[2] == 0.0


def test_superposition_recovers_a_rotation(spark):
    rng = np.random.default_rng(2)
    rotation, shift = display.rotation_matrix(99), np.array([3.0, -4.0, 5.0])
    assert np.linalg.det(rotation) == pytest.approx(1.0)
    points = rng.normal(size=(40, 3)) * 10
    target = points @ rotation.T + shift
    target[7] += 9.0  # an outlier the second fit must drop
    rows = [("p", i, True, *map(float, m), *map(float, t)) for i, (m, t) in enumerate(zip(points, target))]
    df = spark.createDataFrame(rows, "k string, pair_idx long, is_core boolean, m_x double, m_y double, m_z double, t_x double, t_y double, t_z double")
    fits, placed = superpose.superpose_states(df, ["k"])
    fit = fits.collect()[0]
    assert np.allclose(np.array(fit.rotation).reshape(3, 3), rotation, atol=1e-9) and np.allclose(fit.translation, shift, atol=1e-9)
    assert fit.n_outliers == 1 and fit.refitted and fit.rmsd_after < 1e-9 < fit.rmsd_before
    assert [r.pair_idx for r in placed.filter("displacement_class = 'substantially displaced'").collect()] == [7]


def test_plain_values_skip_the_markup_patterns(spark):
    values = ["A:K22", "A:K 22", " A:K22", "A:K22. ", "**A:K22**", "`a:k022`", "_A:K-007_", "A:K-0", "\u00a0A:K22", "A:K22\u2003", "A:KAL0012", "A:K22\n", "", ".", None, "A_K", "a. b", "B:D00"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: (r.m, r.c) for r in rows.selectExpr("i", f"{an.strip_markup('v')} AS m", f"{an.canonical_residue('v')} AS c").collect()}
    full = f"regexp_replace({an.stripped('v')}, '^`+|`+$', '')"
    for pattern, to in ((r"(?d)\*\*(.*?)\*\*", "$1"), (r"(?U)^[*_`\s]+|[*_`\s]+\z", "")):
        full = f"regexp_replace({full}, {an._re(pattern)}, '{to}')"
    full = an.stripped(f"regexp_replace({full}, {an._re(r'[.]+' + chr(92) + 'z')}, '')")
    assert {r.i: r.m for r in rows.selectExpr("i", f"{full} AS m").collect()} == {i: m for i, (m, _) in got.items()}
    assert [got[i][1] for i in range(len(values))] == ["A:K22", "A:K22", "A:K22", "A:K22", "A:K22", "A:K22", "A:K-7", "A:K0", "A:K22", "A:K22", "A:KAL12", "A:K22", None, None, None, None, None, "B:D0"]
    # Each of the two forms of a label is cut once for its number.
    assert an.canonical_residue("v").count("regexp_extract(") == 2
