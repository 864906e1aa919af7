"""Statistics by parts, intervals by family, and a report in three forms."""

import json
import statistics

import pytest
from pyspark.sql import functions as F

from residuum.operators import display
from residuum.plans import report


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(f"f{i % 3}", f"c{i % 7}", f"p{i % 5}", (i * 37 % 11) / 10, i % 4 == 0) for i in range(120)] + [("lone", "one", "p", 0.5, True)]
    return spark.createDataFrame(rows, "question_family string, cluster string, protein_group_id string, score double, correct boolean")


def resampled(rows, seed, samples, value):
    """Whole clusters drawn one by one, the statistic taken over all their rows."""
    clusters = sorted({r.cluster for r in rows})
    rng, out = display.generator(seed, len(clusters), samples), []
    for _ in range(samples):
        drawn = [clusters[i] for i in rng.integers(0, len(clusters), size=len(clusters))]
        out.append(value([r for c in drawn for r in rows if r.cluster == c]))
    cut = sorted(out)
    at = lambda q: cut[int(q * (samples - 1))] + (q * (samples - 1) - int(q * (samples - 1))) * (cut[min(samples - 1, int(q * (samples - 1)) + 1)] - cut[int(q * (samples - 1))])
    return at(0.025), at(0.975)


@pytest.mark.parametrize("name, value", [("micro", lambda x: statistics.fmean(r.score for r in x)), ("exact", lambda x: statistics.fmean(float(r.correct) for r in x)),
                                         ("spread", lambda x: statistics.pstdev([r.score for r in x]))])
def test_family_intervals_equal_resampled_rows(scores, name, value):
    rows = scores.collect()
    for r in report.family_intervals(scores, "s", samples=60, statistic=name).collect():
        own = [x for x in rows if x.question_family == r.question_family]
        assert abs(r.point - value(own)) < 1e-9
        want = resampled(own, "s", 60, value) if r.n_clusters > 1 else (r.point, r.point)
        assert abs(r.ci_low - want[0]) < 1e-9 and abs(r.ci_high - want[1]) < 1e-9


def test_own_statistic_is_taken(scores):
    share = report.Statistic({"high": "count_if(score > 0.5)", "n": "count(*)"}, "question_family", "high / n", "max(value)")
    got = report.clustered_bootstrap(scores, "s", samples=40, statistic=share).collect()[0]
    want = max(sum(r.score > 0.5 for r in own) / len(own) for own in ([r for r in scores.collect() if r.question_family == f] for f in ("f0", "f1", "f2", "lone")))
    assert abs(got.point - want) < 1e-9 and got.ci_low <= got.ci_high


def test_three_forms_agree(spark, tmp_path):
    tables = {"a": spark.createDataFrame([("x<y", 0.5, None), ("p&q", 1.0, 3)], "k string, v double, n int"), "empty": spark.createDataFrame([], "k string")}
    texts = report.report_texts(report.report_value(tables))
    row = texts.collect()[0]
    assert json.loads(row.json) == [{"name": "a", "columns": ["k", "v", "n"], "rows": [["p&q", "1.0000", "3"], ["x<y", "0.5000", None]]}, {"name": "empty", "columns": ["k"], "rows": []}]
    assert row.markdown.startswith("# Run report\n\n## a\n\n| k | v | n |\n|---|---|---|\n| p&q | 1.0000 | 3 |\n| x<y | 0.5000 |  |\n\n## empty")
    assert "<td>x&lt;y</td><td>0.5000</td><td></td>" in row.html and row.html.count("<table>") == 2
    report.write_report(texts, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r" / "json"), wholetext=True).collect()[0].value.strip() == row.json


def test_summary_counts_everything(scores):
    rows = scores.withColumns({"render_id": F.lit("r"), "semantic_instance_id": F.col("cluster"), "format_error": F.lit(False), "refusal": F.lit(True), "truncated": F.lit(False), "api_error": F.lit(False)})
    got = report.score_summary(rows).collect()[0]
    assert (got.n, got.n_renders, got.n_instances, got.n_families, got.refusals, got.format_errors) == (121, 1, 8, 4, 121, 0)
    assert report.score_summary(rows.limit(0)).collect()[0].mean_score == 0
