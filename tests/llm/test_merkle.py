"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from residuum.llm import merkle

DOCS = "doc_id int, source string, lang string, n_chars long, text string, tree string, rank int, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else ""))
        i //= 2
    return out


def plain_manifest(rows):
    trees = {}
    for doc, source, lang, n, text, *_ in rows:
        leaf = sha("".join(map(field, (doc, source, lang, n, text))))
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
        shown = sha("".join(map(field, (doc, source, lang, n + 1, text)))) if hit else leaf
        trees.setdefault((lang is not None, (lang or "").encode()), []).append((doc is not None, doc or 0, leaf, shown))
    levels = {key: plain_levels([x[2] for x in sorted(v)]) for key, v in sorted(trees.items())}
    top = plain_levels([x[-1][0] for x in levels.values()])
    out = []
    for place, (key, own) in enumerate(levels.items()):
        for i, (known, doc, leaf, shown) in enumerate(sorted(trees[key])):
            path = plain_path(own, i) + plain_path(top, place)
            for right, other in path:
                shown = sha(other + shown if right else shown + other)
            out.append((doc if known else -1, leaf, own[-1][0], top[-1][0], sha("".join(x for _, x in path)), shown, shown == top[-1][0]))
    return sorted(out)


def manifest(docs, levels=merkle.LEVELS):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.manifest(docs, levels).collect())


def rows_of(n, langs):
    rows = [(i * 3 % n, f"s{i % 4}" if i % 5 else None, langs[i % len(langs)], None if i % 11 == 0 else i, None if i % 13 == 0 else f"tëxt {i}") for i in range(n)]
    return [(*r, "tree", 1, 2) for r in rows]


@pytest.mark.parametrize("levels", [2, 12])
def test_manifest_equals_plain_tree(spark, levels):
    rows = rows_of(150, ["en", "en", "en", "de", None, "", "fr", "en", "es", "ñ"])
    rows += [(None, None, None, None, None, "", 0, 0), (7, "s", "en", 5, "x" * 300_000, "", 0, 0), (7, "s", "en", 5, "x" * 300_000, "", 0, 0), (9, "s", "lone", 1, "", "", 0, 0)]
    assert manifest(spark.createDataFrame(rows, DOCS), levels) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 33])
def test_small_tables(spark, n):
    rows = rows_of(n, ["en"])
    got = manifest(spark.createDataFrame(rows, DOCS))
    assert got == plain_manifest(rows)
    assert all(r[6] == (zlib.crc32(str(r[0]).encode()) % 7 != 0 or r[5] == r[3]) for r in got)


def test_sweeps_deliver_every_sibling():
    digests = [sha(str(i)) for i in range(11)]
    top, nodes = merkle.forward(digests, 0, 4)
    paths = merkle.backward(nodes, 0, 11, "")
    levels = plain_levels(digests)
    assert top == levels[-1][0]
    for i, path in enumerate(paths):
        assert merkle.siblings(path) == [("L" if right else "R" if other else "N", other) for right, other in plain_path(levels, i)]
        assert merkle.fold(digests[i], merkle.siblings(path)) == top
