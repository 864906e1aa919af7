"""Personal data: base spans against plain patterns, labelers and classifier against planted values."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from residuum.llm import catalogue, pii

DOCS = "doc_id long, text string, base string, candidates int"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
EDGE = ["", None, "a@b.c@d.e a@b.c%x@e.f @@ a@ a@b a@b. a@.b x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.02.3.4 0.0.0.0000 1.2.3.4444 99999999999.1.1.1.1", "4111 1111 1111 1111 4111111111111111 4111-1111-1111-1112 4 1 1",
        "+1 (826) 555-4081 190.137.223.204", "+12 +1-2 +1 2 3 4 5 6 7 8 9 0 +1  (((5", "é😀+49 30 1234567 😀a.b@c.de😀4111111111111111", "9" * 20 + " 4111111111111111 4111111111111111"]


def plain(text):
    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return [True, kind == 1 and all(int(p) < 256 for p in value.split(".")), 14 <= len(digits) <= 19 and total % 10 == 0, 10 <= len(digits) <= 15][kind]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "", re.ASCII) if good(k, m[0]))


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_equal_plain_patterns(spark, sf):
    rng = random.Random(5)
    texts = EDGE + ["".join(rng.choices("01234567890 .-+()@ab%", k=rng.randrange(80))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in texts:
        assert pii.base_spans(text or "") == plain(text), text


def test_long_texts_take_linear_time():
    n = 200_000
    for text in ("a" * n, "1" * n, "1." * n, "+1 " * n, "a@" * n, "1 " * n, "(1)" * n, "0" * n + ".1.1.1"):
        base = pii.base_spans(text)
        pii.candidates(text, base)


def test_query_keeps_base_and_adds_what_patterns_miss(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = ["Call +1 (826) 555-4081 190.137.223.204 now", "two cards 4111111111111111 5500005555555559 side by side", "reach me: jane.doe (at) example (dot) com today", "order 1234567812345678 is no card",
            "fe80:0:0:0:1:2:3:4 and (212) 555-0199", "lyon and nothing else 2024", None, "", "x " * 150_000 + "+49 30 1234567"]
    planted = spark.createDataFrame([(10_000 + i, t, "b", 1) for i, t in enumerate(more)] + [(10_000, more[0], "b", 1)], DOCS)
    got = pii.find_personal(docs.withColumns({"base": F.lit("x"), "candidates": F.lit(0)}).unionByName(planted)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()} | {10_000 + i: t for i, t in enumerate(more)}
    assert len(got) == docs.count() + len(more) + 1
    for r in got:
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(filter(None, listed(base).split(","))) <= set(r.spans.split(",")) and r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)
        spans = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans)
    by = {r.doc_id - 10_000: r.spans for r in got if r.doc_id >= 10_000}
    assert by[0] == "phone:5:22,ip:23:38"
    assert by[1] == "card:10:26,card:27:43"
    assert by[2] == "email:10:41"
    assert by[3] == by[5] == by[6] == by[7] == ""
    assert by[4] == "ip:0:18,phone:23:37"
    assert by[8] in ("phone:300000:300014", "")  # nine digits: only the labelers can find it
    assert pii.find_personal(docs.limit(0)).count() == 0


def test_labelers_are_weighed_by_what_they_agree_on():
    cells = {"2+++++0ln": 500, "20-0++0ln": 450, "20++++0ln": 40}
    post, theta = pii.reliabilities(cells)
    assert post["2+++++0ln"] > 0.95 and post["20-0++0ln"] < 0.05 and post["20++++0ln"] > 0.5
    assert theta["checksum"][0, 0] > 0.95 > theta["isolation"][1, 0] > theta["checksum"][1, 0]
    model = pii.classifier(cells, post)
    assert all(abs(pii.probability(model, c) - p) < 0.1 for c, p in post.items())
    assert pii.train.__doc__ and pii.probability({}, "2+++++0ln") == 0.5


def test_query_on_given_tables(spark, sf):
    rows = catalogue.QUERIES["op13_personal_data"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
