"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from residuum.llm import chat, decontaminate, htmltext, langid, lm, merkle, neardup, pii, prefixes, quality, secrets, tokencount, wordbpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; every executor has it at the same place."""
    import public_tokenizers
    return public_tokenizers.path(name)


PROBE_TEXT = "</s>[INST] ok [/INST]"


@query("op1_chat_formatting", rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE_TEXT}'), (-1, 1, 'assistant', '{PROBE_TEXT}')),
lengths AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', ''))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 19 + 2 * length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) END AS written,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
    -- After a turn the machine stands at the last role that it knows.
    coalesce(last_value(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'start') AS stood FROM turns),
moves AS (SELECT *, stood || ' ' || role NOT IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user') AS bad FROM lengths)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(written)::BIGINT AS formatted_chars, NOT bool_or(bad) AS valid, (min(place) FILTER (bad))::INT AS bad_turn,
  NOT bool_or(bad) AND arg_max(role, place) FILTER (role IN ('system', 'user', 'assistant')) = 'assistant' AS complete
FROM moves GROUP BY conv_id""")
def op1(spark, folder):
    turns = table(spark, folder, "conversations")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE_TEXT}'), (-1L, 1L, 'assistant', '{PROBE_TEXT}') AS t(conv_id, turn, role, text)")
    probe = probe.select(*[F.col(c).cast(turns.schema[c].dataType) for c in ("conv_id", "turn", "role", "text")])
    out = chat.format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(probe))
    back = out.select("conv_id", "valid", "bad_turn", "complete", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
                       "valid", "bad_turn", "complete")


@query("op5_quality_rules")
def op5(spark, folder):
    return quality.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_secret_scans")
def op6(spark, folder):
    return secrets.find_secrets(table(spark, folder, "documents"))


@query("op9_minhash_near_dedup", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
ends AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)""")
def op9(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents")).drop("set_key")


@query("op2_html_extraction")
def op2(spark, folder):
    return htmltext.extract_text(table(spark, folder, "pages"))


@query("op4_token_counts")
def op4(spark, folder):
    # A section is a line with its line break; the last one may be empty.
    lines = F.split(F.coalesce("text", F.lit("")), "(?<=\n)")
    return tokencount.section_tokens(table(spark, folder, "documents").select("doc_id", lines.alias("sections")), tokenizer_file("byte_bpe_50k.tiktoken"))


@query("op8_bpe_encode_decode")
def op8(spark, folder):
    encoded = wordbpe.encode_texts(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_language_id")
def op3(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query("op7_benchmark_decontamination")
def op7(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_lm_scoring")
def op10(spark, folder):
    return lm.score_texts(table(spark, folder, "documents"))


#: CRC-32 of a decimal number in SQL that has no such function: bit by bit over its characters.
CRC32_SQL = """
WITH crc AS (SELECT {key} AS {key}, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM (SELECT DISTINCT {key} FROM {table} WHERE {key} IS NOT NULL)),
"""


@query("op11_prefix_trie", CRC32_SQL.format(key="conv_id", table="conversations") + """
turns AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY pos) AS l FROM turns GROUP BY conv_id),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:(crc % 9)::BIGINT], a.l[(crc % 9 + 1)::BIGINT:]) AS l
  FROM lists a JOIN crc USING (conv_id) LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 5),
starts AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS p, l[1:greatest(d - 1, 0)] AS up, CASE WHEN d > 0 THEN strlen(l[d].t) ELSE 0 END AS bytes FROM rebuilt, unnest(range(0, len(l) + 1)) u(d)),
nodes AS (SELECT p, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM starts GROUP BY p, d),
children AS (SELECT up AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
under AS (SELECT s.p, sum(v.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes v JOIN starts s ON s.conv_id = v.conv_id AND s.d <= v.d LEFT JOIN children c ON c.p = v.p GROUP BY s.p)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN under u ON u.p = x.p LEFT JOIN children c ON c.p = x.p LEFT JOIN nodes y ON x.d > 0 AND y.p = x.up AND y.d = x.d - 1""")
def op11(spark, folder):
    return prefixes.prefix_trie(table(spark, folder, "conversations"))


@query("op12_merkle_manifest", CRC32_SQL.format(key="doc_id", table="documents").replace("WITH", "WITH RECURSIVE", 1) + """
fields AS (SELECT doc_id, lang, n_chars, coalesce(crc % 7 = 0, false) AS hit, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-')
  || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS tail
  FROM documents LEFT JOIN crc USING (doc_id)),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1), '-') || tail) AS changed, hit FROM fields),
own AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS l FROM own GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM levels WHERE len(l) > 1),
subroots AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(l) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS l FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM tops WHERE len(l) > 1),
moves AS (
  SELECT o.lang, o.place, x.level, o.place >> x.level AS spot, x.l FROM own o JOIN levels x ON x.lang IS NOT DISTINCT FROM o.lang WHERE len(x.l) > 1
  UNION ALL
  SELECT o.lang, o.place, 100 + t.level, s.place >> t.level, t.l FROM own o JOIN subroots s ON s.lang IS NOT DISTINCT FROM o.lang JOIN tops t ON len(t.l) > 1),
paths AS (SELECT lang, place, list(CASE WHEN spot % 2 = 1 THEN 'L' WHEN spot + 1 < len(l) THEN 'R' ELSE 'N' END || coalesce(l[xor(spot, 1) + 1], '') ORDER BY level) AS path FROM moves GROUP BY lang, place),
ends AS (
  SELECT o.doc_id, o.leaf, s.subroot, (SELECT l[1] FROM tops WHERE len(l) = 1) AS root, coalesce(p.path, []) AS path, CASE WHEN o.hit THEN o.changed ELSE o.leaf END AS shown
  FROM own o JOIN subroots s ON s.lang IS NOT DISTINCT FROM o.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM o.lang AND p.place = o.place),
folded AS (SELECT *, list_reduce(list_concat([shown], path), lambda h, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root FROM ends)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded""")
def op12(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))


@query("op13_personal_data")
def op13(spark, folder):
    return pii.find_personal(table(spark, folder, "documents"))
