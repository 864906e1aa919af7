"""The prefix trie against a plain trie of dictionaries."""

import hashlib
import zlib

import pytest

from residuum.llm import prefixes

TURNS = "conv_id long, turn long, role string, text string, id string, n long"


def plain_trie(rows):
    """Rows (conv_id, turn, role, text): a trie whose nodes are dictionaries, walked without recursion."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes = [{"depth": 0, "up": None, "members": [], "ends": [], "kids": {}, "last": ""}]
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        at = 0
        nodes[0]["members"].append(c)
        for step in own.get(c - c % 5, [])[:h] + own[c][h:]:
            if step not in nodes[at]["kids"]:
                nodes[at]["kids"][step] = len(nodes)
                nodes.append({"depth": nodes[at]["depth"] + 1, "up": at, "members": [], "ends": [], "kids": {}, "last": step[1]})
            at = nodes[at]["kids"][step]
            nodes[at]["members"].append(c)
        nodes[at]["ends"].append(c)
    for n in reversed(nodes):  # children come after their parents
        n["leaves"] = sum(nodes[k]["leaves"] for k in n["kids"].values()) or 1
        n["saved"] = (len(n["members"]) - 1) * len(n["last"].encode()) + sum(nodes[k]["saved"] for k in n["kids"].values())
    return sorted((n["members"][0], n["depth"], -1 if n["up"] is None else nodes[n["up"]]["members"][0], len(n["members"]), len(n["kids"]), n["leaves"], n["saved"],
                   hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest()) for n in nodes if n["members"])


def trie(turns):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in prefixes.prefix_trie(turns).collect())


def odd_rows():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"é{t}" if c % 3 else f"{t * (c % 2)}") for c in range(40) for t in range(c % 11)]
    rows += [(100, 0, None, None), (100, 0, None, None), (100, None, "x", "null first"), (101, 5, "user", None), (101, 5, "assistant", "tie"), (None, 0, "user", "nobody's"),
             (102, 0, "", ""), (7, -3, "system", "before"), (10 ** 12, 0, "user", "y" * 100_000), (10 ** 12 + 1, 0, "user", "y" * 100_000)]
    return [(*r, "clash", 1) for r in rows]


@pytest.mark.parametrize("block", [3, 64])
def test_trie_equals_plain_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefixes, "BLOCK", block)
    monkeypatch.setattr(prefixes, "PACK", 4)
    rows = odd_rows()
    assert trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_long_conversations_and_many_copies(spark):
    long = [f"turn {t}" for t in range(70)]
    rows = [(c, t, "user", x) for c in (0, 5, 10) for t, x in enumerate(long[:c * 7 or 70])]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400, 5) for t in range(2)]
    rows = [(*r, "", 0) for r in rows]
    assert trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
    assert trie(spark.createDataFrame([], TURNS)) == []
