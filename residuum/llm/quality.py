"""Quality rules with risk-controlled cutoffs.

Four ratios are compared with cutoffs. The cutoffs of a stratum (a language) come from labelled
documents that pass the base rules and are labelled good: along one ladder, fixed beforehand, all four
rules grow stricter together, and each step is an exact binomial test of "the rules together reject at
least ``RISK`` of the good documents"; the walk stops at the first step that is not refuted, and the
last refuted one gives the cutoffs. A fixed order needs no correction along the ladder, and rules need
none as their union is tested; over strata the level is divided by their number (Bonferroni). So with
probability ``1 - LEVEL`` no stratum loses more than ``RISK`` of its good documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from residuum.llm.text import BLANKS, count_of, indices, let, without, words
from residuum.session import stage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of good documents a stratum may lose over all rules, and the probability that any loses more.
RISK, LEVEL = 0.02, 0.05
#: Ladders from loose to strict; a document is rejected if its ratio is above the cutoff.
LADDERS = {
    "symbols_per_word": [4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "repeat_share": [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "mean_word_chars": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0],
}
#: Steps of the common ladder; a shorter ladder stays on a cutoff for several steps.
STEPS = max(map(len, LADDERS.values()))
JOINT = [{rule: ladder[i * len(ladder) // STEPS] for rule, ladder in LADDERS.items()} for i in range(STEPS)]


def _repeat_words(count: Column, grams: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more; ``grams`` has one value per window."""
    def covered(places: Column) -> Column:
        # Each repeated window covers three words, fewer if the next one begins earlier.
        return F.aggregate(indices(1, F.size(places)), F.lit(0).cast("long"), lambda acc, i: acc + F.when(
            i < F.size(places), F.least(F.lit(3), F.element_at(places, i + 1) - F.element_at(places, i))).otherwise(3))

    def repeated(rows: Column) -> Column:
        same = lambda i, j: F.element_at(rows, i)["gram"] == F.element_at(rows, j)["gram"]
        return F.array_sort(F.transform(
            F.filter(indices(1, F.size(rows)), lambda i: ((i > 1) & same(i, F.greatest(i - 1, F.lit(1)))) | (
                (i < F.size(rows)) & same(i, F.least(i + 1, F.size(rows))))), lambda i: F.element_at(rows, i)["place"]))

    def counted(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("gram"), i.alias("place"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
            let(ordered, lambda rows: let(repeated(rows), covered)))

    return F.when(count < 3, F.lit(0).cast("long")).otherwise(let(grams, counted))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long). Null text: all 0.

    Windows are compared as strings of three words joined by a blank, which no word contains.
    """
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(indices(1, n - 2), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        lines = F.filter(F.split(text, "\n"), lambda x: without(x, BLANKS) != "")
        return let(lines, lambda kept: F.struct(
            n.cast("long").alias("n_words"), F.length(without(text, BLANKS)).cast("long").alias("word_chars"),
            count_of(text, SYMBOLS).alias("n_symbols"), F.size(kept).cast("long").alias("n_lines"),
            (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
            _repeat_words(n, grams).alias("n_repeat_words")))

    return let(words(text), of)


def _failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _ratios(m: Column) -> dict[str, Column]:
    least_one = lambda c: F.greatest(c, F.lit(1))
    return {"symbols_per_word": m["n_symbols"] / least_one(m["n_words"]), "dup_line_share": m["n_dup_lines"] / least_one(m["n_lines"]),
            "repeat_share": m["n_repeat_words"] / least_one(m["n_words"]), "mean_word_chars": m["word_chars"] / least_one(m["n_words"])}


def _kept(failed: Column, ratios, cut: Column) -> Column:
    """False if the base rules failed or a ratio is above the cutoff of the stratum."""
    kept = ~failed
    for rule in LADDERS:
        kept = kept & ~F.coalesce(ratios[rule] > cut[rule], F.lit(False))
    return kept


def with_measures(docs: DataFrame) -> DataFrame:
    """Adds ``_m`` (the counts), ``_base_failed``, ``_stratum`` and ``_ratios`` (rule to value)."""
    m = F.col("_m")
    return docs.select("*", measures(F.col("text")).alias("_m")).select(
        "*", _failed(m).alias("_base_failed"), F.coalesce(F.col("lang"), F.lit("und")).alias("_stratum"),
        F.struct(*[v.alias(k) for k, v in _ratios(m).items()]).alias("_ratios"))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series eight places higher, where it is exact to a double."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    for k in range(1, 9):
        series = series - F.log(n.cast("double") + k)
    return series


def binomial_tail(k: Column, n: Column, p: float | Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from the largest term down; 1 if k is not below the mean.

    Below the mean every term is smaller than the one above it, and forty standard deviations further
    down they no longer change a double, so the number of terms grows with sqrt(n) only.
    """
    p = F.lit(p) if isinstance(p, float) else p
    n_, k_ = n.cast("double"), k.cast("double")
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k_ * F.log(p) + (n_ - k_) * F.log(1 - p))
    steps = F.least(k_, F.ceil(40 * F.sqrt(n_ * p * (1 - p))) + 200).cast("int")
    begin = F.struct(top.alias("term"), top.alias("sum"))

    def down(acc: Column, j: Column) -> Column:
        i = k_ - j + 1
        term = acc["term"] * i * (1 - p) / ((n_ - i + 1) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    return F.when(k_ >= n_ * p, F.lit(1.0)).otherwise(F.aggregate(indices(1, steps), begin, down)["sum"])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum: ``_stratum`` and ``_cut``, a struct of rule to cutoff (null: no step was refuted).

    ``measured`` comes from ``with_measures``. Good documents have only labels of quality 1; labels
    without a document, documents without a label and null labels say nothing. All labelled rows count.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1")
    held = measured.where(~F.col("_base_failed")).join(good, "doc_id")
    rejected = lambda cut: F.expr(" OR ".join(f"coalesce(_ratios.{rule} > {value}D, false)" for rule, value in cut.items()))
    counts = stage(held.groupBy("_stratum").agg(F.count("*").alias("n"), *[F.count_if(rejected(cut)).alias(f"k_{i}") for i, cut in enumerate(JOINT)]))
    strata = max(1, counts.count())
    steps = counts.select("_stratum", "n", F.posexplode(F.array(*[f"k_{i}" for i in range(STEPS)])).alias("step", "k"))
    walked = (steps.withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk)).groupBy("_stratum")
              .agg(F.coalesce(F.min(F.when(F.col("p") > level / strata, F.col("step"))), F.lit(STEPS)).alias("passed")))
    cuts = F.array(*[F.struct(*[F.lit(value).alias(rule) for rule, value in cut.items()]) for cut in JOINT])
    return walked.select("_stratum", F.when(F.col("passed") > 0, F.element_at(cuts, F.greatest("passed", F.lit(1)))).alias("_cut"))


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``_kept``. The cutoffs are a written table of one small row per language: joined by what its files weigh."""
    return measured.join(cuts, "_stratum", "left").withColumn("_kept", _kept(F.col("_base_failed"), F.col("_ratios"), F.col("_cut")))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed and kept.

    Null text has no words and fails; null lang is stratum ``und``; repeated rows are judged alike, each
    on its own; empty tables give no rows; without labels only the base rules reject.
    """
    measured = stage(with_measures(docs.select("doc_id", "text", "lang")).drop("text", "lang"))
    out = judged(measured, stage(cutoffs(measured, labels)))
    return out.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words",
                      F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    measured = stage(with_measures(docs.select("doc_id", "text", "lang")).drop("text", "lang", "_m"))
    cuts = stage(cutoffs(measured, labels))
    # Texts are measured once more instead of being written beside their measures.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).withColumn("_stratum", F.coalesce(F.col("_doc.lang"), F.lit("und")))
    met = own.join(cuts, "_stratum", "left")
    return met.where(let(measures(F.col("_doc.text")), lambda m: _kept(_failed(m), _ratios(m), F.col("_cut")))).select("_doc.*")
