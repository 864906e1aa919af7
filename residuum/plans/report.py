"""Report statistics over a ``scores`` relation.

Columns used: ``render_id, semantic_instance_id, completion_index, question_family, protein_group_id,
cluster, representation, is_rotation_variant, answer_schema, score, correct, format_error, refusal,
truncated, api_error`` and, where named, ``answer_key``, ``answer_items``, ``prompt_sha256``, ``field_scores``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import in_list
from ..operators.display import generator
from ..operators.sequence import dense_positions
from ..session import beside, stage

SET_SCHEMAS = ("residue_set", "string_set", "residue_pair_set", "two_interaction_sets")  # fixed values
OBSERVATION = ("changed_residue", "changed_residues", "gained_pair", "initial_residues")  # fixed values
INTERACTION = ("gained_interactions", "gained_interaction", "new_contact", "packing_change", "mature_residues",
               "displaced_entity", "within_protomer", "helix6_displacement")  # fixed values
PRIMARY = "representation <> 'context_only' AND NOT is_rotation_variant"


def macro_micro(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean over families of the family mean, and the plain mean; an empty input gives zeros."""
    keys = list(keys)
    family = scores.groupBy(*keys, "question_family").agg(F.expr("sum(score) AS s"), F.expr("count(*) AS n"))
    return family.groupBy(*keys).agg(
        F.expr("coalesce(avg(s / n), 0D) AS macro_score"), F.expr("coalesce(sum(s) / sum(n), 0D) AS micro_score"),
        F.expr("coalesce(sum(n), 0) AS n"), F.expr("count(*) AS n_families"))


def instance_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("semantic_instance_id").agg(F.expr("avg(score) AS mean_score"), F.expr("count(*) AS n"))


def group_summary(scores: DataFrame, key: str) -> DataFrame:
    """Counts and means per value of ``key``; a missing value is the group ``None``."""
    return scores.selectExpr("*", f"coalesce(CAST({key} AS STRING), 'None') AS grp").groupBy("grp").agg(
        F.expr("count(*) AS n"), F.expr("count(DISTINCT semantic_instance_id) AS n_instances"), F.expr("avg(score) AS mean_score"),
        F.expr("avg(IF(correct, 1D, 0D)) AS exact"), F.expr("count_if(format_error) AS format_errors"),
        F.expr("count_if(refusal) AS refusals"), F.expr("count_if(truncated) AS truncated"))


def failure_counts(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.expr("count_if(format_error) AS format_error"), F.expr("count_if(refusal) AS refusal"),
        F.expr("count_if(truncated) AS truncated"), F.expr("count_if(api_error) AS api_error"),
        F.expr("count_if(score = 0) AS scored_zero"), F.expr("count(*) AS total"))


def agreement(scores: DataFrame) -> DataFrame:
    """Pairwise agreement of repeated completions per render, without forming the pairs.

    Equal answers are counted per distinct answer: ``n`` copies make ``n(n-1)/2`` agreeing
    pairs. For sets, only distinct answers sharing an element can have a non-zero
    Jaccard index, and those meet through the element.
    """
    answers = scores.selectExpr(
        "render_id", f"{in_list('answer_schema', SET_SCHEMAS)} AS is_set", "answer_key", "answer_items").groupBy(
        "render_id", "is_set", "answer_key").agg(F.expr("count(*) AS n"), F.expr("any_value(answer_items) AS items"))
    answers = stage(answers)
    totals = answers.groupBy("render_id", "is_set").agg(
        F.expr("sum(n) AS rows"), F.expr("sum(n * (n - 1) div 2) AS same_pairs"))
    sets = answers.filter("is_set")
    elements = sets.selectExpr("render_id", "answer_key", "n", "size(items) AS m", "explode(items) AS e")
    left = elements.selectExpr("render_id", "e", "answer_key AS a", "n AS n_a", "m AS m_a")
    right = elements.selectExpr("render_id", "e", "answer_key AS b", "n AS n_b", "m AS m_b")
    overlap = left.join(right, ["render_id", "e"]).filter("a < b").groupBy("render_id", "a", "b").agg(
        F.expr("count(*) AS hit"), F.expr("max(n_a * n_b) AS weight"), F.expr("max(m_a + m_b) AS total"))
    partial = overlap.groupBy("render_id").agg(F.expr("sum(weight * hit / (total - hit)) AS jaccard"))
    return totals.filter("rows > 1").join(partial, "render_id", "left").selectExpr(
        "render_id", "is_set", "rows", "rows * (rows - 1) div 2 AS n_pairs", "same_pairs",
        "IF(is_set, same_pairs + coalesce(jaccard, 0D), CAST(same_pairs AS DOUBLE)) AS agreeing")


def agreement_summary(scores: DataFrame) -> DataFrame:
    return agreement(scores).agg(
        F.expr("count(*) AS n_repeated_renders"),
        F.expr("sum(agreeing) FILTER (WHERE NOT is_set) / sum(n_pairs) FILTER (WHERE NOT is_set) AS pairwise_exact_agreement"),
        F.expr("sum(agreeing) FILTER (WHERE is_set) / sum(n_pairs) FILTER (WHERE is_set) AS pairwise_jaccard_agreement"),
        F.expr("coalesce(sum(n_pairs) FILTER (WHERE NOT is_set), 0) AS n_exact_pairs"),
        F.expr("coalesce(sum(n_pairs) FILTER (WHERE is_set), 0) AS n_jaccard_pairs"))


def context_baseline(scores: DataFrame) -> DataFrame:
    """Per family, what the question alone scores against the same instances with coordinates."""
    blind = scores.filter("representation = 'context_only'")
    seeing = scores.filter("representation = 'minimal_pdb' AND NOT is_rotation_variant").join(
        blind.select("question_family", "semantic_instance_id").distinct(), ["question_family", "semantic_instance_id"], "left_semi")
    floor = blind.groupBy("question_family").agg(
        F.expr("count(DISTINCT semantic_instance_id) AS n_instances"), F.expr("count(DISTINCT prompt_sha256) AS n_distinct_prompts"),
        F.expr("avg(score) AS context_only_score"))
    top = seeing.groupBy("question_family").agg(F.expr("avg(score) AS with_coordinates_score"))
    return floor.join(top, "question_family").selectExpr(
        "*", "least(n_distinct_prompts, n_instances) AS effective_sample_size", "n_distinct_prompts < n_instances AS identical_prompts",
        "with_coordinates_score - context_only_score AS gain_over_context_only")


def mechanistic(scores: DataFrame) -> DataFrame:
    """Observation, interaction and mechanism sub-scores of multi-field answers."""
    def mean_of(names: tuple[str, ...]) -> str:
        picked = f"map_values(map_filter(field_scores, (k, v) -> {in_list('k', names)}))"
        return f"IF(size({picked}) > 0, aggregate({picked}, 0D, (s, v) -> s + v) / size({picked}), NULL)"
    rows = scores.filter("answer_schema = 'multi_field'").selectExpr(
        "*", f"{mean_of(OBSERVATION)} AS observation", f"{mean_of(INTERACTION)} AS interaction", f"{mean_of(('mechanism',))} AS mechanism")
    blind = "representation = 'context_only'"
    return rows.agg(
        F.expr("count(*) AS n_results"), F.expr("avg(observation) AS observation_score"), F.expr("avg(interaction) AS interaction_score"),
        F.expr("avg(mechanism) AS mechanism_score"), F.expr("avg(mechanism) FILTER (WHERE observation >= 1) AS mechanism_given_correct_observation"),
        F.expr(f"avg(score) FILTER (WHERE {blind}) AS context_only_score"), F.expr(f"avg(score) FILTER (WHERE NOT {blind}) AS with_coordinates_score")
    ).selectExpr("*", "with_coordinates_score - context_only_score AS gain_over_context_only")


def worst_instances(scores: DataFrame, limit: int = 12) -> DataFrame:
    return scores.groupBy("semantic_instance_id", "question_family", "protein_group_id").agg(
        F.expr("avg(score) AS mean_score")).orderBy("mean_score", "semantic_instance_id", "question_family", "protein_group_id").limit(limit)


def completion_conditioned(scores: DataFrame, key: str) -> DataFrame:
    """Scores over finished completions only, next to all of them."""
    return scores.groupBy(key).agg(
        F.expr("count(*) AS n"), F.expr("count_if(truncated) AS n_truncated"), F.expr("avg(score) AS score_all"),
        F.expr("avg(score) FILTER (WHERE NOT truncated) AS score_finished"))


def rerun_merge(first: DataFrame, second: DataFrame, key: str = "render_id") -> DataFrame:
    """Rows of ``first`` replaced by the rows of ``second`` that share their key."""
    return first.join(second, key, "left_anti").select(*first.columns).unionByName(second.select(*first.columns))


def headline(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("macro_score"), "run_id")


# -- bootstrap -------------------------------------------------------------------

def _draws(n: int, samples: int, parts: tuple, per_task: int):
    """Map tasks to their share of the resampling draws.

    The samples come from one generator in sequence. A task replays the generator up
    to its own samples, which costs random numbers but no memory and no exchange.
    """
    step = 1 << 20

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in batch["id"]:
                rng = generator(*parts)
                first, last = int(start) * per_task, min(samples, (int(start) + 1) * per_task)
                for sample in range(last):
                    for left in range(0, n, step):
                        picked = rng.integers(0, n, size=min(step, n - left))
                        if sample >= first:
                            where, times = np.unique(picked, return_counts=True)
                            yield pd.DataFrame({"sample": sample, "position": where, "times": times})

    return run


def bootstrap_draws(spark, n: int, samples: int, *parts, per_task: int = 125) -> DataFrame:
    """``(sample, position, times)``: how often each of ``n`` units is drawn in each resample."""
    tasks = -(-samples // per_task)
    return spark.range(tasks, numPartitions=tasks).mapInPandas(
        _draws(n, samples, (*parts, n, samples), per_task), "sample bigint, position bigint, times bigint")


@dataclass(frozen=True)
class Statistic:
    """An aggregate by its parts, so that resampling never goes back to rows.

    ``update`` names SQL aggregates over the rows of one cluster and group; they merge by addition. ``value`` makes a
    number of a group's merged parts, ``finish`` one of the values of all groups.
    """

    update: dict[str, str]
    group: str = "'all'"
    value: str = "s / n"
    finish: str = "avg(value)"


_MEAN = {"s": "sum(score)", "n": "count(*)"}
#: Statistics by name; any other is passed as a :class:`Statistic`.
STATISTICS = {
    "macro": Statistic(_MEAN, "question_family"), "micro": Statistic(_MEAN), "exact": Statistic({"s": "sum(IF(correct, 1D, 0D))", "n": "count(*)"}),
    "spread": Statistic(_MEAN | {"q": "sum(score * score)"}, value="sqrt(greatest(0D, q / n - (s / n) * (s / n)))"),
}


def _statistic(statistic: str | Statistic) -> Statistic:
    return STATISTICS[statistic] if isinstance(statistic, str) else statistic


def _parts(scores: DataFrame, st: Statistic, keys: list[str] = ()) -> DataFrame:
    return stage(scores.selectExpr("*", "coalesce(cluster, protein_group_id) AS _cluster", f"{st.group} AS _group").drop("cluster").withColumnRenamed("_cluster", "cluster").groupBy(
        *keys, "cluster", "_group").agg(*[F.expr(f"{v} AS {k}") for k, v in st.update.items()]))


def _finished(merged: DataFrame, st: Statistic, keys: list[str], out: str) -> DataFrame:
    return merged.selectExpr(*keys, f"{st.value} AS value").groupBy(*keys).agg(F.expr(f"coalesce({st.finish}, 0D) AS {out}"))


def clustered_bootstrap(scores: DataFrame, seed: str, *, samples: int = 2000, statistic: str | Statistic = "macro", alpha: float = 0.05) -> DataFrame:
    """Percentile interval from resampling whole clusters.

    Scores shrink to the parts of the statistic per (cluster, group) first. Resamples join these
    by cluster position and are summed per group, so neither clusters nor resamples
    ever sit in one task.
    """
    st = _statistic(statistic)
    stats = _parts(scores, st)
    names = stats.select("cluster").distinct()
    n = names.count()
    point = _finished(stats.groupBy("_group").agg(*[F.sum(k).alias(k) for k in st.update]), st, [], "point")
    if n < 2:
        return point.selectExpr("point", "point AS ci_low", "point AS ci_high", f"CAST({n} AS BIGINT) AS n_clusters", "CAST(0 AS BIGINT) AS samples")
    placed = stats.join(dense_positions(names, "cluster"), "cluster")
    merged = bootstrap_draws(scores.sparkSession, n, samples, seed).join(placed, "position").groupBy("sample", "_group").agg(
        *[F.expr(f"sum(times * {k}) AS {k}") for k in st.update])
    resampled = _finished(merged, st, ["sample"], "value")
    interval = resampled.agg(F.expr(f"percentile(value, {alpha / 2}D) AS ci_low"), F.expr(f"percentile(value, {1 - alpha / 2}D) AS ci_high"))
    return beside(point, interval).selectExpr("*", f"CAST({n} AS BIGINT) AS n_clusters", f"CAST({samples} AS BIGINT) AS samples")


def family_intervals(scores: DataFrame, seed: str, *, samples: int = 2000, statistic: str | Statistic = "micro", alpha: float = 0.05) -> DataFrame:
    """The same interval for every question family, each over its own clusters; one cluster gives no interval.

    Families with as many clusters share their draws, as they are drawn from one seed and the number of clusters.
    """
    st = _statistic(statistic)
    key = ["question_family"]
    stats = _parts(scores, st, key)
    point = _finished(stats.groupBy(*key, "_group").agg(*[F.sum(k).alias(k) for k in st.update]), st, key, "point")
    placed = stage(stats.select(*key, "cluster").distinct().selectExpr("*", "row_number() OVER (PARTITION BY question_family ORDER BY cluster) - 1 AS position"))
    sizes = stage(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n_clusters")))
    counts = sorted(r[0] for r in sizes.filter("n_clusters > 1").select("n_clusters").distinct().collect())
    out = point.join(sizes, key)
    if not counts:
        return out.selectExpr(*key, "point", "point AS ci_low", "point AS ci_high", "n_clusters")
    draws = reduce(DataFrame.unionByName, [bootstrap_draws(scores.sparkSession, n, samples, seed).withColumn("n_clusters", F.lit(n).cast("long")) for n in counts])
    known = stats.join(placed, [*key, "cluster"]).join(sizes, key)
    merged = draws.join(known, ["n_clusters", "position"]).groupBy(*key, "sample", "_group").agg(*[F.expr(f"sum(times * {k}) AS {k}") for k in st.update])
    values = _finished(merged, st, [*key, "sample"], "value").groupBy(*key).agg(
        F.expr(f"percentile(value, {alpha / 2}D) AS ci_low"), F.expr(f"percentile(value, {1 - alpha / 2}D) AS ci_high"))
    return out.join(values, key, "left").selectExpr(*key, "point", "coalesce(ci_low, point) AS ci_low", "coalesce(ci_high, point) AS ci_high", "n_clusters")


def score_summary(scores: DataFrame) -> DataFrame:
    """One row over all scores, those without coordinates too."""
    return scores.agg(
        F.expr("count(*) AS n"), F.expr("count(DISTINCT render_id) AS n_renders"), F.expr("count(DISTINCT semantic_instance_id) AS n_instances"), F.expr("count(DISTINCT question_family) AS n_families"),
        F.expr("coalesce(avg(score), 0D) AS mean_score"), F.expr("coalesce(avg(IF(correct, 1D, 0D)), 0D) AS exact"), F.expr("count_if(format_error) AS format_errors"),
        F.expr("count_if(refusal) AS refusals"), F.expr("count_if(truncated) AS truncated"), F.expr("count_if(api_error) AS api_errors"))


def paired_difference(first: DataFrame, second: DataFrame, seed: str, *, samples: int = 2000, alpha: float = 0.05) -> DataFrame:
    """Mean within-instance difference of two arms with a bootstrap interval over instances."""
    a = instance_scores(first).selectExpr("semantic_instance_id", "mean_score AS a")
    b = instance_scores(second).selectExpr("semantic_instance_id", "mean_score AS b")
    pairs = stage(a.join(b, "semantic_instance_id"))
    n = pairs.count()
    summary = pairs.agg(F.expr("count(*) AS n_pairs"), F.expr("coalesce(avg(a - b), 0D) AS mean_difference"),
                        F.expr("avg(a) AS arm_a_mean"), F.expr("avg(b) AS arm_b_mean"))
    if n == 0:
        return summary.selectExpr("*", "0D AS ci_low", "0D AS ci_high")
    placed = pairs.join(dense_positions(pairs.select("semantic_instance_id"), "semantic_instance_id"), "semantic_instance_id")
    values = bootstrap_draws(first.sparkSession, n, samples, seed).join(placed, "position").groupBy("sample").agg(
        F.expr("sum(times * (a - b)) / sum(times) AS value"))
    return beside(summary, values.agg(F.expr(f"percentile(value, {alpha / 2}D) AS ci_low"), F.expr(f"percentile(value, {1 - alpha / 2}D) AS ci_high")))


def analyse_run(scores: DataFrame, samples: int = 2000) -> dict[str, DataFrame]:
    """Every table of a run report. Each is a handful of rows, ready to be written or shown."""
    scores = stage(scores)
    primary = scores.filter(PRIMARY)
    base = scores.filter("representation = 'minimal_pdb' AND NOT is_rotation_variant")
    return {
        "macro": clustered_bootstrap(primary, "macro", samples=samples),
        "micro": clustered_bootstrap(primary, "micro", samples=samples, statistic="micro"),
        "summary": score_summary(scores),
        "per_family": group_summary(primary, "question_family"),
        "family_intervals": family_intervals(primary, "family", samples=samples),
        "per_protein": group_summary(primary, "protein_group_id"),
        "per_representation": group_summary(scores, "representation"),
        "context_baseline": context_baseline(scores),
        "representation_gap": paired_difference(base, scores.filter("representation = 'normalized_coordinates'"), "representation", samples=samples),
        "rotation_gap": paired_difference(base, scores.filter("is_rotation_variant"), "rotation", samples=samples),
        "consistency": agreement_summary(scores),
        "failures": failure_counts(scores),
        "worst": worst_instances(scores),
    }


def markdown(tables: dict[str, DataFrame]) -> str:
    """The report tables as Markdown, every row of them, read part by part."""
    lines = ["# Run report", ""]
    for name, df in tables.items():
        rows = df.toLocalIterator()
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
        lines.append("")
    return "\n".join(lines)


def report_value(tables: dict[str, DataFrame]) -> DataFrame:
    """The report as one nested value, a row a table: ``position, name, columns, rows``, all texts; a null stays null.

    Tables of a report are short; one that grows with the data, such as ``per_protein``, is written as a table instead.
    """
    parts = []
    for position, (name, df) in enumerate(tables.items()):
        cells = [f"format_string('%.4f', {c})" if kind in ("double", "float") else f"CAST({c} AS STRING)" for c, kind in df.dtypes]
        row = f"array({', '.join(f'IF({c} IS NULL, NULL, {t})' for (c, _), t in zip(df.dtypes, cells))})"
        columns = ", ".join(f"'{c}'" for c in df.columns)
        parts.append(df.agg(F.expr(f"array_sort(collect_list({row})) AS rows")).selectExpr(f"{position} AS position", f"'{name}' AS name", f"array({columns}) AS columns", "rows"))
    return reduce(DataFrame.unionByName, parts)


_MARKED = "concat('| ', array_join({r}, ' | ', ''), ' |')"
_ESCAPED = "replace(replace(replace(coalesce(c, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def report_texts(value: DataFrame) -> DataFrame:
    """``json, markdown, html`` of one :func:`report_value`, one row."""
    marked = (f"concat('## ', name, '\\n\\n', {_MARKED.format(r='columns')}, '\\n|', repeat('---|', size(columns)), '\\n', "
              f"array_join(transform(rows, r -> {_MARKED.format(r='r')}), '\\n'))")

    def cells(row: str, tag: str) -> str:
        return f"concat('<tr>', array_join(transform({row}, c -> concat('<{tag}>', {_ESCAPED}, '</{tag}>')), ''), '</tr>')"

    page = f"concat('<h2>', name, '</h2><table>', {cells('columns', 'th')}, array_join(transform(rows, r -> {cells('r', 'td')}), ''), '</table>')"
    rows = value.selectExpr("position", "to_json(named_struct('name', name, 'columns', columns, 'rows', rows), map('ignoreNullFields', 'false')) AS j", f"{marked} AS m", f"{page} AS h")
    whole = lambda c: f"transform(array_sort(collect_list(struct(position, {c}))), x -> x.{c})"
    return rows.agg(F.expr(f"concat('[', array_join({whole('j')}, ','), ']') AS json"), F.expr(f"concat('# Run report\\n\\n', array_join({whole('m')}, '\\n\\n'), '\\n') AS markdown"),
                    F.expr(f"concat('<!doctype html><title>Run report</title>', array_join({whole('h')}, '')) AS html"))


def write_report(texts: DataFrame, folder: str) -> None:
    """The three forms as text files, one folder each."""
    for form in ("json", "markdown", "html"):
        texts.select(F.col(form).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{form}")
