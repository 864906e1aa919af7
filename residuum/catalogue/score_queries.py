"""Answer parsing, scoring, report, selection and bookkeeping queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import hashing as h
from ..functions import texts
from ..functions.numeric import fixed_text, round3
from ..operators import keyed, select
from ..operators.sequence import runs
from ..plans import evaluation, report, scoring, validation
from ..sources.tables import table
from .registry import query


def scores(spark, sf_dir):
    """Score rows derived from events: a family per event type, a cluster per group of users."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat(user_id, '-', event_type) AS render_id", "concat('I', user_id % 60, '-', event_type) AS semantic_instance_id",
        "event_id AS completion_index", "event_type AS question_family", "concat('P', user_id % 40) AS protein_group_id",
        "IF(user_id % 5 = 0, NULL, concat('C', user_id % 17)) AS cluster",
        "element_at(array('minimal_pdb', 'normalized_coordinates', 'context_only', 'minimal_pdb'), CAST(event_id % 4 + 1 AS INT)) AS representation",
        "event_id % 4 = 3 AS is_rotation_variant", "IF(event_type IN ('view', 'click'), 'residue_set', 'residue') AS answer_schema",
        "event_id % 5 / 4D AS score", "event_id % 5 = 4 AS correct", "event_id % 11 = 0 AS format_error", "event_id % 23 = 0 AS refusal",
        "event_id % 7 = 0 AS truncated", "event_type = 'error' AS api_error", "sha2(concat(event_type, user_id % 9), 256) AS prompt_sha256",
        "array_sort(array_distinct(array(concat('k', event_id % 3), concat('k', event_id div 7 % 4)))) AS answer_items",
        "array_join(array_sort(array_distinct(array(concat('k', event_id % 3), concat('k', event_id div 7 % 4)))), ',') AS answer_key")


S = """WITH s AS (SELECT user_id || '-' || event_type AS render_id, 'I' || (user_id % 60) || '-' || event_type AS semantic_instance_id,
  event_id, event_type AS question_family, 'P' || (user_id % 40) AS protein_group_id,
  ['minimal_pdb', 'normalized_coordinates', 'context_only', 'minimal_pdb'][event_id % 4 + 1] AS representation, event_id % 4 = 3 AS rot,
  event_type IN ('view', 'click') AS is_set, event_id % 5 / 4.0::double AS score, event_id % 5 = 4 AS correct, event_id % 11 = 0 AS format_error,
  event_id % 23 = 0 AS refusal, event_id % 7 = 0 AS truncated, event_type || (user_id % 9) AS prompt,
  list_sort(list_distinct(['k' || event_id % 3, 'k' || event_id // 7 % 4])) AS items FROM events)"""


@query("macro_micro", f"""{S}, f AS (SELECT question_family, sum(score) AS t, count(*) AS n FROM s GROUP BY ALL)
  SELECT avg(t / n) AS macro_score, sum(t) / sum(n) AS micro_score, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_families FROM f""")
def macro_micro(spark, sf_dir):
    return report.macro_micro(scores(spark, sf_dir)).select("macro_score", "micro_score", "n", "n_families")


@query("instance_mean", f"{S} SELECT semantic_instance_id, avg(score) AS mean_score, count(*) AS n FROM s GROUP BY ALL")
def instance_mean(spark, sf_dir):
    return report.instance_scores(scores(spark, sf_dir))


@query("group_summary", f"""{S} SELECT representation AS grp, count(*) AS n, count(DISTINCT semantic_instance_id) AS n_instances, avg(score) AS mean_score,
  avg(correct::int) AS exact, count(*) FILTER (format_error) AS format_errors, count(*) FILTER (refusal) AS refusals, count(*) FILTER (truncated) AS truncated FROM s GROUP BY ALL""")
def group_summary(spark, sf_dir):
    return report.group_summary(scores(spark, sf_dir), "representation")


@query("failure_counts", f"""{S} SELECT count(*) FILTER (format_error) AS format_error, count(*) FILTER (refusal) AS refusal, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (question_family = 'error') AS api_error, count(*) FILTER (score = 0) AS scored_zero, count(*) AS total FROM s""")
def failure_counts(spark, sf_dir):
    return report.failure_counts(scores(spark, sf_dir))


@query("context_floor", f"""{S}, b AS (SELECT * FROM s WHERE representation = 'context_only'),
  v AS (SELECT s.* FROM s WHERE representation = 'minimal_pdb' AND NOT rot AND (question_family, semantic_instance_id) IN (SELECT question_family, semantic_instance_id FROM b)),
  x AS (SELECT question_family, count(DISTINCT semantic_instance_id) AS n_instances, count(DISTINCT prompt) AS n_distinct_prompts, avg(score) AS context_only_score FROM b GROUP BY ALL),
  y AS (SELECT question_family, avg(score) AS with_coordinates_score FROM v GROUP BY ALL)
  SELECT *, least(n_distinct_prompts, n_instances) AS effective_sample_size, n_distinct_prompts < n_instances AS identical_prompts,
    with_coordinates_score - context_only_score AS gain_over_context_only FROM x JOIN y USING (question_family)""")
def context_floor(spark, sf_dir):
    return report.context_baseline(scores(spark, sf_dir))


@query("pairwise_agreement", f"""{S}, p AS (SELECT a.render_id, a.is_set, a.items = b.items AS same,
    len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))::double AS jac
    FROM s a JOIN s b ON a.render_id = b.render_id AND a.event_id < b.event_id)
  SELECT render_id, count(*) AS n_pairs, count(*) FILTER (same) AS same_pairs, CAST(floor(sum(CASE WHEN is_set THEN jac ELSE same::int END) * 1000 + 0.5) AS BIGINT) AS agreeing_milli
  FROM p GROUP BY ALL""")
def pairwise_agreement(spark, sf_dir):
    return report.agreement(scores(spark, sf_dir)).selectExpr(
        "render_id", "n_pairs", "same_pairs", "CAST(floor(agreeing * 1000 + 0.5) AS BIGINT) AS agreeing_milli")


@query("worst_instances", f"""{S} SELECT semantic_instance_id, question_family, min(protein_group_id) AS protein_group_id, avg(score) AS mean_score FROM s
  GROUP BY semantic_instance_id, question_family, protein_group_id ORDER BY mean_score, semantic_instance_id, question_family, protein_group_id LIMIT 12""")
def worst_instances(spark, sf_dir):
    return report.worst_instances(scores(spark, sf_dir))


@query("completion_conditioned", f"""{S} SELECT question_family, count(*) AS n, count(*) FILTER (truncated) AS n_truncated, avg(score) AS score_all,
  avg(score) FILTER (NOT truncated) AS score_finished FROM s GROUP BY ALL""")
def completion_conditioned(spark, sf_dir):
    return report.completion_conditioned(scores(spark, sf_dir), "question_family")


@query("paired_gap", f"""{S}, a AS (SELECT semantic_instance_id, avg(score) AS v FROM s WHERE representation = 'minimal_pdb' AND NOT rot GROUP BY ALL),
  b AS (SELECT semantic_instance_id, avg(score) AS v FROM s WHERE representation = 'normalized_coordinates' GROUP BY ALL)
  SELECT count(*) AS n_pairs, CAST(floor(avg(a.v - b.v) * 1e6) AS BIGINT) AS gap_micro FROM a JOIN b USING (semantic_instance_id)""")
def paired_gap(spark, sf_dir):
    s = scores(spark, sf_dir)
    base = s.filter("representation = 'minimal_pdb' AND NOT is_rotation_variant")
    out = report.paired_difference(base, s.filter("representation = 'normalized_coordinates'"), "representation", samples=400)
    return out.selectExpr("n_pairs", "floor(mean_difference * 1e6) AS gap_micro")


@query("bootstrap_cluster_ci")
def bootstrap_cluster_ci(spark, sf_dir):
    return report.clustered_bootstrap(scores(spark, sf_dir), "macro", samples=500)


@query("bootstrap_family_ci", f"""{S}, c AS (SELECT *, CASE WHEN CAST(split_part(render_id, '-', 1) AS BIGINT) % 5 = 0 THEN protein_group_id ELSE 'C' || (CAST(split_part(render_id, '-', 1) AS BIGINT) % 17) END AS cluster FROM s),
  g AS (SELECT question_family, count(DISTINCT cluster) AS n_clusters, avg(score) AS micro, avg(correct::int) AS exact, stddev_pop(score) AS spread FROM c GROUP BY ALL)
  SELECT question_family, statistic, CAST(floor(point * 1000 + 0.5) AS BIGINT) AS milli, n_clusters, true AS covered FROM (UNPIVOT g ON micro, exact, spread INTO NAME statistic VALUE point)""")
def bootstrap_family_ci(spark, sf_dir):
    """Three statistics with an interval for every family; SQL tells the points, and that an interval covers its point."""
    rows, parts = scores(spark, sf_dir), []
    for name in ("micro", "exact", "spread"):
        out = report.family_intervals(rows, "family", samples=200, statistic=name)
        parts.append(out.selectExpr("question_family", f"'{name}' AS statistic", "CAST(floor(point * 1000 + 0.5D) AS BIGINT) AS milli", "n_clusters", "ci_low <= point AND point <= ci_high AND ci_low < ci_high AS covered"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("score_summary", f"""{S} SELECT count(*) AS n, count(DISTINCT render_id) AS n_renders, count(DISTINCT semantic_instance_id) AS n_instances, count(DISTINCT question_family) AS n_families, CAST(floor(avg(score) * 1e6 + 0.5) AS BIGINT) AS micro,
  CAST(floor(avg(correct::int) * 1e6 + 0.5) AS BIGINT) AS exact, count(*) FILTER (format_error) AS format_errors, count(*) FILTER (refusal) AS refusals, count(*) FILTER (truncated) AS truncated, count(*) FILTER (question_family = 'error') AS api_errors FROM s""")
def score_summary(spark, sf_dir):
    return report.score_summary(scores(spark, sf_dir)).selectExpr(
        "n", "n_renders", "n_instances", "n_families", "CAST(floor(mean_score * 1e6 + 0.5D) AS BIGINT) AS micro", "CAST(floor(exact * 1e6 + 0.5D) AS BIGINT) AS exact", "format_errors", "refusals", "truncated", "api_errors")


@query("run_report", f"""{S}, f AS (SELECT 'format_error' AS c1, count(*) FILTER (format_error) AS a, count(*) FILTER (refusal) AS b, count(*) FILTER (truncated) AS c, count(*) FILTER (question_family = 'error') AS d, count(*) FILTER (score = 0) AS e, count(*) AS g FROM s),
  r AS (SELECT representation, concat_ws(' | ', representation, count(*), count(DISTINCT semantic_instance_id), count(*) FILTER (format_error)) AS line FROM s GROUP BY representation),
  m AS (SELECT '# Run report' || chr(10) || chr(10) || '## failures' || chr(10) || chr(10) || '| format_error | refusal | truncated | api_error | scored_zero | total |' || chr(10) || '|---|---|---|---|---|---|' || chr(10)
    || '| ' || concat_ws(' | ', a, b, c, d, e, g) || ' |' || chr(10) || chr(10) || '## forms' || chr(10) || chr(10) || '| grp | n | n_instances | format_errors |' || chr(10) || '|---|---|---|---|' || chr(10)
    || (SELECT string_agg('| ' || line || ' |', chr(10) ORDER BY line) FROM r) || chr(10) AS text FROM f)
  SELECT sha256(text) AS markdown_sha256, 2::BIGINT AS n_tables, 1 + (SELECT count(*) FROM r) AS n_rows, 1 + (SELECT count(*) FROM r) AS n_html_rows FROM m""")
def run_report(spark, sf_dir):
    """Three forms of one value: the text is compared, and the other two hold as many tables and rows."""
    rows = scores(spark, sf_dir)
    texts = report.report_texts(report.report_value({
        "failures": report.failure_counts(rows), "forms": report.group_summary(rows, "representation").select("grp", "n", "n_instances", "format_errors")}))
    parsed = "from_json(json, 'array<struct<name: string, columns: array<string>, rows: array<array<string>>>>')"
    return texts.selectExpr("sha2(markdown, 256) AS markdown_sha256", f"CAST(size({parsed}) AS BIGINT) AS n_tables", f"CAST(aggregate({parsed}, 0, (n, t) -> n + size(t.rows)) AS BIGINT) AS n_rows",
                            "CAST(size(split(html, '<tr><td>')) - 1 AS BIGINT) AS n_html_rows")


# -- exact numbers, hashes, text -------------------------------------------------

@query("round3_exact", """WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_tax / 8 AS v FROM lineitem)
  SELECT l_orderkey, l_linenumber, printf('%.3f', v)::double AS rounded, printf('%10.3f', v) AS text FROM v""")
def round3_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice * l_tax / 8 AS v")
    return rows.selectExpr("l_orderkey", "l_linenumber", f"{round3('v')} AS rounded").selectExpr(
        "*", f"{fixed_text('rounded', 3, 10)} AS text")


@query("sha_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "sha2(text, 256) AS digest")


@query("seed63", """SELECT doc_id, CAST(('0x' || substr(sha256('["seed","' || lang || '","' || source || '",' || doc_id || ']'), 1, 16))::UBIGINT
  & 9223372036854775807::UBIGINT AS BIGINT) AS seed FROM documents""")
def seed63(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{h.derive_seed(h.text('seed'), 'lang', 'source', h.raw('doc_id'))} AS seed")


@query("token_estimate", "SELECT doc_id, CAST(floor(length(text) / 2.9::double) AS BIGINT) + 1 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{texts.token_estimate('text')} AS tokens")


_WORDS = "regexp_extract_all(text, '[A-Za-z0-9]+')"


@query("leak_scan", f"""WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  ids AS (SELECT item_id, unnest([{{'kind': 'entry', 'identifier': w[1]}}, {{'kind': 'publication', 'identifier': 'doi:' || w[-1]}}, {{'kind': 'component', 'identifier': w[2]}}], recursive := true) FROM w),
  d AS (SELECT doc_id, text, identifier, kind FROM documents JOIN ids ON item_id % 40 = doc_id % 40)
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, 'leak:' || kind || ':' || identifier AS violation FROM d
  WHERE CASE kind WHEN 'entry' THEN regexp_matches(text, '(?i)(^|[^\\pL\\pN_])' || identifier || '([^\\pL\\pN_]|$)')
    WHEN 'publication' THEN length(identifier) > 8 AND contains(text, substr(identifier, 5))
    ELSE regexp_matches(text, '(^|[^A-Za-z0-9])' || identifier || '([^A-Za-z0-9]|$)') END""")
def leak_scan(spark, sf_dir):
    """Every text against the identifiers of the benchmark items of its group."""
    words = "regexp_extract_all(text, '[A-Za-z0-9]+', 0)"
    ids = table(spark, sf_dir, "benchmark").selectExpr("item_id", f"{words} AS w").selectExpr(
        "item_id % 40 AS semantic_instance_id", "stack(3, 'entry', try_element_at(w, 1), 'publication', concat('doi:', try_element_at(w, -1)), 'component', try_element_at(w, 2)) AS (kind, identifier)")
    shown = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS render_id", "doc_id % 40 AS semantic_instance_id", "text AS user_prompt")
    return validation.provenance_leaks(shown, ids)


# -- parsing and scoring ---------------------------------------------------------

_N = "l_partkey % 400 + 1"


@query("final_extract", f"""WITH r AS (SELECT *, CAST(l_orderkey % 6 AS INT) AS v, {_N} AS n FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN v <= 2 THEN 'A:K' || n WHEN v = 5 THEN 'B:E' || n END AS answer, v IN (3, 4) AS format_error, v = 4 AS refusal,
    CASE WHEN v <= 2 THEN 1.0::double ELSE 0.0::double END AS score FROM r""")
def final_extract(spark, sf_dir):
    """Six ways of answering, built from line items: plain, marked up, on the next line, malformed, refused, corrected."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey % 6 AS v", f"{_N} AS n")
    response = ("CASE v WHEN 0 THEN concat('Looking at it.\\nFINAL: a:k', n, '\\n') WHEN 1 THEN concat('**FINAL**: `A:K0', n, '`.') "
                "WHEN 2 THEN concat('### Final Answer:\\n\\n**A:K', n, '**') WHEN 3 THEN 'final answer is not known' "
                "WHEN 4 THEN 'I cannot answer this.' ELSE concat('FINAL: A:K', n, '\\nOn second thought\\nFINAL: B:E', n) END")
    built = rows.selectExpr("*", f"{response} AS response", "concat('A:K', n) AS gold_text", "'residue' AS answer_schema", *_EMPTY_GOLD)
    return scoring.score_responses(built).selectExpr(
        "l_orderkey", "l_linenumber", "parsed_text AS answer", "format_error", "refusal", "score")


_EMPTY_GOLD = ["CAST(NULL AS DOUBLE) AS gold_number", "CAST(NULL AS BOOLEAN) AS gold_flag", "CAST(NULL AS array<double>) AS gold_numbers",
               "CAST(NULL AS array<string>) AS gold_items", "CAST(NULL AS array<string>) AS gold_gained", "CAST(NULL AS array<string>) AS gold_lost",
               "CAST(NULL AS array<string>) AS categories", "CAST(NULL AS array<string>) AS options", "CAST(NULL AS DOUBLE) AS tolerance",
               "false AS truncated", "false AS provider_refusal"]


def _gold(**given: str) -> list[str]:
    return [next((f"{v} AS {k}" for k, v in given.items() if e.endswith(f" AS {k}")), e) for e in _EMPTY_GOLD]


@query("set_f1", f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_N} AS a, l_suppkey % 50 + 500 AS b, l_orderkey % 3 AS v FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE v WHEN 0 THEN 2 * 2 / 5.0::double WHEN 1 THEN 0.0::double ELSE 1.0::double END AS score, v = 2 AS correct FROM r""")
def set_f1(spark, sf_dir):
    """Residue sets: one answer with two of three members found, an empty one, and an exact one that wraps a line."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_N} AS a", "l_suppkey % 50 + 500 AS b", "l_orderkey % 3 AS v")
    response = ("CASE v WHEN 0 THEN concat('FINAL: A:K', a, ' and A:D', b) WHEN 1 THEN 'FINAL: none' "
                "ELSE concat('FINAL: B:G1, A:D', b, ',\\n a:k', a) END")
    built = rows.selectExpr("*", f"{response} AS response", "CAST(NULL AS STRING) AS gold_text", "'residue_set' AS answer_schema",
                            *_gold(gold_items="array(concat('A:K', a), concat('A:D', b), 'B:G1')"))
    return scoring.score_responses(built).select("l_orderkey", "l_linenumber", "score", "correct")


@query("tolerance_scores", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity / 8 AS g, l_quantity / 8 + CASE l_orderkey % 3 WHEN 0 THEN 0.015625 WHEN 1 THEN 0.03125 ELSE 0 END AS p FROM lineitem)
  SELECT l_orderkey, l_linenumber, abs(p - g) <= 0.02 AS correct FROM r""")
def tolerance_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity / 8 AS g",
        "l_quantity / 8 + CASE l_orderkey % 3 WHEN 0 THEN 0.015625D WHEN 1 THEN 0.03125D ELSE 0D END AS p")
    built = rows.selectExpr("*", "concat('FINAL: ', format_string('%.6f', p), ' Å') AS response", "CAST(NULL AS STRING) AS gold_text",
                            "'distance' AS answer_schema", *_gold(gold_number="g"))
    return scoring.score_responses(built).select("l_orderkey", "l_linenumber", "correct")


@query("pair_canonical", f"""WITH r AS (SELECT l_orderkey, l_linenumber, 'A:K' || ({_N}) AS a, 'B:E' || (l_suppkey % 50 + 1) AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, a || '--' || b AS pair FROM r""")
def pair_canonical(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"concat(' b:e ', l_suppkey % 50 + 1, IF(l_orderkey % 2 = 0, ' -- ', ' — '), 'A: K', {_N}) AS t")
    return rows.selectExpr("l_orderkey", "l_linenumber", f"{an.canonical_pair('t')} AS pair")


@query("category_choice", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderpriority END AS category,
  CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN NULL ELSE o_orderkey % 2 = 0 END AS flag FROM orders""")
def category_choice(spark, sf_dir):
    """Options found exactly, inside a sentence, or not at all; booleans in several spellings."""
    options = "array('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"
    text = ("CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN concat('**', o_orderpriority, '**.') "
            "WHEN 2 THEN concat('it is ', lower(o_orderpriority), ' here') ELSE 'unclear' END")
    flag = "CASE o_orderkey % 4 WHEN 0 THEN ' Yes.' WHEN 1 THEN '`false`' WHEN 2 THEN 'maybe' ELSE '' END"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS t", f"{flag} AS b", f"{options} AS options")
    return rows.selectExpr("o_orderkey", f"{an.canonical_category('t', 'options')} AS category", f"{an.canonical_boolean('b')} AS flag")


# -- bookkeeping -----------------------------------------------------------------

@query("latest_attempt", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_attempt(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return keyed.latest(rows, ["user_id", "event_type"], "event_id")


@query("last_decision_join", """WITH d AS (SELECT event_id % 700 AS doc_id, event_id, CASE event_type WHEN 'error' THEN 'reject' ELSE 'accept' END AS decision FROM events
    QUALIFY row_number() OVER (PARTITION BY event_id % 700 ORDER BY event_id DESC) = 1)
  SELECT doc_id, CASE decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'candidate' END AS status FROM documents LEFT JOIN d USING (doc_id)""")
def last_decision_join(spark, sf_dir):
    decisions = table(spark, sf_dir, "events").selectExpr(
        "event_id % 700 AS semantic_instance_id", "event_id AS ordinal", "IF(event_type = 'error', 'reject', 'accept') AS decision", "props AS reason")
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS semantic_instance_id", "'candidate' AS curation_status")
    return evaluation.with_decisions(docs, decisions).selectExpr("semantic_instance_id AS doc_id", "curation_status AS status")


@query("resume_remaining", """SELECT o_orderkey AS render_id, c AS completion_index FROM orders o, (VALUES (0), (1), (2)) t(c)
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_linenumber - 1) % 3 = c AND l_returnflag <> 'R')""")
def resume_remaining(spark, sf_dir):
    """Three completions an order; every line of it is a stored attempt, those sent back failed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    jobs = orders.selectExpr("o_orderkey AS render_id", "explode(array(0, 1, 2)) AS completion_index")
    done = table(spark, sf_dir, "lineitem").join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "left_semi").selectExpr(
        "'run' AS run_id", "l_orderkey AS render_id", "(l_linenumber - 1) % 3 AS completion_index", "IF(l_returnflag = 'R', 'timeout', NULL) AS error")
    return evaluation.remaining(jobs, done, "run").select("render_id", "completion_index")


@query("pending_dedup", """SELECT l_partkey AS digest, min(l_orderkey) AS render_id FROM lineitem WHERE l_partkey NOT IN (SELECT 2 * p_partkey FROM part) GROUP BY ALL""")
def pending_dedup(spark, sf_dir):
    """Requests by part; what is cached belongs to twice the number of each part."""
    requests = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS digest", "l_orderkey AS render_id", "l_linenumber AS completion_index")
    cache = table(spark, sf_dir, "part").selectExpr("2 * p_partkey AS digest")
    return evaluation.pending(requests, cache).select("digest", "render_id")


@query("cache_lookup", """SELECT l_orderkey, l_linenumber, p_name AS response FROM lineitem LEFT JOIN part ON 2 * p_partkey = l_partkey""")
def cache_lookup(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS digest", "CAST(l_partkey AS STRING) AS request", "l_orderkey", "l_linenumber")
    cache = table(spark, sf_dir, "part").selectExpr("2 * p_partkey AS digest", "CAST(2 * p_partkey AS STRING) AS request", "p_name AS response")
    return evaluation.with_cache(requests, cache).select("l_orderkey", "l_linenumber", "response")


@query("gold_left_join_missing", "SELECT lang, count(*) AS n, count(*) FILTER (quality IS NULL) AS n_missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def gold_left_join_missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("lang").agg(
        F.expr("count(*) AS n"), F.expr("count_if(quality IS NULL) AS n_missing"))


@query("error_histogram", "SELECT substr(event_type || ':' || user_id % 10, 1, 200) AS message, count(*) AS count FROM events WHERE event_type = 'error' GROUP BY ALL")
def error_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("IF(event_type = 'error', concat(event_type, ':', user_id % 10), NULL) AS error")
    return evaluation.error_histogram(rows)


# -- ordered and selecting operators ---------------------------------------------

@query("runs_islands", """WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events),
  g AS (SELECT *, p - row_number() OVER (PARTITION BY user_id, event_type ORDER BY p) AS grp FROM o)
  SELECT user_id, event_id, min(p) OVER w AS run_start, count(*) OVER w AS run_length FROM g WINDOW w AS (PARTITION BY user_id, event_type, grp)""")
def runs_islands(spark, sf_dir):
    """Runs of equal event type per user; positions and runs are both built in blocks of days."""
    from ..operators.sequence import numbered
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    placed = numbered(rows, ["user_id"], ["ts", "event_id"], "to_date(ts)", "p")
    return runs(placed, ["user_id"], "p", "event_type").select("user_id", "event_id", "run_start", "run_length")


_SEED = "CAST(('0x' || substr(sha256('[\"{p}\",' || {c} || ']'), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT)"


@query("pooled_choice", f"""WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents)
  SELECT lang, doc_id, CASE WHEN k <= 16 THEN CAST(row_number() OVER (PARTITION BY lang, k <= 16 ORDER BY {_SEED.format(p='pool', c='doc_id')}) AS INT) END AS pool_rank FROM p""")
def pooled_choice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return select.pooled_order(docs, ["lang"], ["n_chars DESC", "doc_id"], h.derive_seed(h.text("pool"), h.raw("doc_id"))).select(
        "lang", "doc_id", "pool_rank")


@query("diversify_tags", """WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 3)
  SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY r, source) AS INT) AS pick FROM t QUALIFY pick <= 6""")
def diversify_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return select.diversified(docs, ["lang"], "source", ["n_chars DESC", "doc_id"]).select("lang", "doc_id", "pick")


@query("round_robin_select", f"""WITH t AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang || source ORDER BY n_chars DESC, doc_id) AS turn,
    CAST(('0x' || substr(sha256('["protein","' || lang || source || '"]'), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS seed FROM documents)
  SELECT doc_id, lang || source AS cluster FROM t ORDER BY turn, seed, cluster LIMIT 200""")
def round_robin_select(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(lang, source) AS cluster", "n_chars")
    return select.round_robin(docs, "cluster", ["n_chars DESC", "doc_id"], h.derive_seed(h.text("protein"), "cluster"), 200).select("doc_id", "cluster")


@query("capped_rejections", """WITH c AS (SELECT event_type, user_id % 20 AS source, event_id, count(*) OVER w AS n_rejections, row_number() OVER (w ORDER BY event_id) AS k FROM events WINDOW w AS (PARTITION BY event_type, user_id % 20))
  SELECT event_type, source, event_id, n_rejections FROM c WHERE k <= 8""")
def capped_rejections(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type", "user_id % 20 AS source", "event_id")
    return select.capped_rejections(rows, ["event_type", "source"], ["event_id"]).select("event_type", "source", "event_id", "n_rejections")


def _quota_sql(families, target, cap):
    """The families one after another, each as its own step."""
    steps, used = [], "SELECT NULL::BIGINT AS cluster, 0 AS n WHERE false"
    for i, f in enumerate(families):
        steps.append(f"""u{i} AS ({used}), r{i} AS (SELECT e.family, e.cluster, e.place, coalesce(u.n, 0) AS used,
          row_number() OVER (PARTITION BY e.cluster ORDER BY e.place) AS k FROM e LEFT JOIN u{i} u USING (cluster) WHERE e.family = '{f}'),
          c{i} AS (SELECT family, cluster, place FROM r{i} WHERE k + used <= {cap} ORDER BY place LIMIT {target})""")
        taken = " UNION ALL ".join(f"SELECT * FROM c{j}" for j in range(i + 1))
        used = f"SELECT cluster, count(*) AS n FROM ({taken}) GROUP BY ALL"
    head = "e AS (SELECT event_type AS family, user_id % 30 AS cluster, event_id AS place FROM events WHERE value > 20)"
    return f"WITH {head}, {', '.join(steps)} {taken}"


@query("quota_fold", _quota_sql(["click", "error", "purchase", "signup", "view"], 25, 4))
def quota_fold(spark, sf_dir):
    """Five families filled in turn with at most four rows per cluster overall."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS family", "user_id % 30 AS cluster", "event_id AS place", "value > 20 AS usable")
    families = ["click", "error", "purchase", "signup", "view"]
    return select.quota_fold(rows, families, {f: 25 for f in families}, 4).select("family", "cluster", "place")


@query("state_change", """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_tax * 100 AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN b <= 4 AND a >= 4.5 THEN 'gained' WHEN a <= 4 AND b >= 4.5 THEN 'lost' WHEN a <= 4 AND b <= 4 THEN 'retained_contact'
    WHEN a >= 4.5 AND b >= 4.5 THEN 'retained_noncontact' ELSE 'ambiguous' END AS verdict FROM v""")
def state_change(spark, sf_dir):
    from ..functions.geometry import contact_change
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity / 10 AS a", "l_tax * 100 AS b")
    return rows.selectExpr("l_orderkey", "l_linenumber", f"{contact_change('a', 'b')} AS verdict")
