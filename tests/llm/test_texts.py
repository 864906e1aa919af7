"""Tokenizers against the public libraries, html against expected renderings."""

import hashlib

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from residuum.llm import catalogue, htmltext, tokencount, wordbpe

TEXTS = ["", None, " \n", "Hello  World's 123 don't <|endoftext|> Été İstanbul ΣΑΣ ß\n\n|| ### a_b 😀x", "<|STARTOFTEXT|> x<|startoftext|>y", "a" * 300, "é Å \x85 \x1c​　z",
         "antidisestablishmentarianism " * 40, "".join(map(chr, [*range(1, 0x250), *range(0x370, 0x400), *range(0x2000, 0x208f)]))]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def test_bpe_equals_the_library(spark, sf):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    encoded = wordbpe.encode_texts(frame(spark, texts), P.path("word_bpe_49k.json"))
    for r in encoded.collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    back = {r.doc_id: r.text for r in wordbpe.decode_texts(encoded, P.path("word_bpe_49k.json")).collect()}
    assert back == {r.doc_id: r.decoded for r in encoded.collect()}
    assert wordbpe.encode_texts(frame(spark, texts).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(wordbpe, "GENERATION", 3)
    own = wordbpe.Codec(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = "one two three four five six seven one two three eight nine one"
    assert own.encode(text)[0] == own.encode(text)[0] == library.encode(text, add_special_tokens=False).ids
    assert len(own.young) <= 3 and len(own.old) <= 3


def test_bpe_query(spark, sf):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.QUERIES["op8_bpe_encode_decode"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[::20]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_counts(library, sections):
    """Tokens with character offsets from another library; most bytes decide, the earlier of equals."""
    whole = "".join(sections)
    ends, at = [], 0
    for s in sections:
        at += len(s.encode())
        ends.append(at)
    counts, start = [0] * len(sections), 0
    for token in library.encode(whole, add_special_tokens=False).tokens:
        end = start + len(token)  # one letter stands for one byte
        shares = [max(0, min(end, e) - max(start, b)) for b, e in zip([0, *ends], ends)]
        counts[shares.index(max(shares))] += 1
        start = end
    return counts


def test_section_counts(spark, sf):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    cut = [["a cat", "egory of", "", " things"], ["x\n", "\n\n", "y"], [None, "é", "t", "é"], None, [], [""], ["😀", "😀 12", "345"]]
    cut += [r.text.splitlines(True) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()]
    cut += [[r.text[i:i + 7] for i in range(0, len(r.text), 7)] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(5).collect()]
    got = {}
    for r in tokencount.section_tokens(spark.createDataFrame(list(enumerate(cut)), "doc_id long, sections array<string>"), P.path("byte_bpe_50k.tiktoken")).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
        assert r.n_crossing <= r.n_tokens
    for i, sections in enumerate(cut):
        sections = [s or "" for s in sections or [""]]
        assert [got[i][k] for k in range(len(sections))] == plain_counts(library, sections)


def test_section_query_covers_texts(spark, sf):
    out = catalogue.QUERIES["op4_token_counts"](spark, sf).groupBy("doc_id").agg(F.sum("n_chars").alias("n"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.join(docs, "doc_id").where("n = length(text)").count() == docs.count()


PAGES = {
    "<p>a<p>b  c\n d<br>e": "a\n\nb c d\ne",
    "<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>z": "- one\n- two\n  3. x\n  4. y\n\nz",
    "<title>t</title><style>p{}</style><script>var t='</p>';</script><div>shown</div><div hidden>no</div><p style='display: none'>no</p>": "shown",
    "<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>b<td>22</table>after": "name       n\nlong name  1\nb          22\n\nafter",
    "<b>bold<i>both</b> x &amp; y&copy; &lt;z&gt;": "boldboth x & y© <z>",
    "<pre>a  b\n c</pre>": "a  b\n c",
    "a<!-- <p>no</p> -->b<!-- open": "ab",
    "<div>a</div>b<span>c</span>d <em> e</em>": "a\nbcd e",
    "plain < 5 text": "plain < 5 text",
    "": "", "<div><div></div></div>": "", "<table></table>": "",
    "<h1>T</h1><dl><dt>k<dd>v</dl><blockquote>q</blockquote>": "T\n\nk\n  v\n\n  q",
    "<table><caption>c</caption>stray<tbody><tr><td><table><tr><td>in<td>ner</table><td>x</table>": "stray\nc\nin  ner  x",
}


def test_renderings():
    assert {k: htmltext.visible_text(k) for k in PAGES} == PAGES
    assert htmltext.visible_text(None) == ""
    assert htmltext.visible_text("<div>" * 20000 + "deep") == "deep"


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = catalogue.QUERIES["op2_html_extraction"](spark, sf).collect()
    assert len(rows) == pages.count() and all("<p>" not in r.text and "track(" not in r.text for r in rows)
    odd = spark.createDataFrame([(1, None, "u"), (1, "", "u"), (None, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted(r.text for r in htmltext.extract_text(odd).collect()) == ["", "", "x"]
