"""Benchmark decontamination by spaced seeds, in column expressions.

A mask lays a pattern over consecutive words and hashes only some of them, so a substituted word at an
ignored place does not hide a passage. Hashes of the benchmark and of the documents meet in a join. Each hit
names a diagonal (place in the document minus place in the item); along it the words are compared one by
one. It is a leak if a stretch of it, or an item that is there as a whole, has enough equal words and they are
four fifths of it; where three or more substituted words stand together, five sixths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from residuum.llm.text import indices, let
from residuum.session import stage

#: Fixed masks of one span: 1 is hashed, 0 is ignored.
MASKS = ["11011011", "11100111"]
SPAN = len(MASKS[0])
#: Equal words a leak has at least, unless the item is there as a whole. Items shorter than the span must be equal.
MIN_WORDS = 12
PENALTY = 4
#: Seeds of a benchmark that is sent to every executor (about 40 bytes each); a larger one is joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def codes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(c: Column, short: list[int]) -> Column:
    """(at, seed) of every window of words; items shorter than the span have a seed of their own length."""
    def window(mask: str) -> Column:
        places = [k for k, bit in enumerate(mask) if bit == "1"]
        return F.transform(indices(1, F.size(c) - len(mask) + 1), lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.lit(mask), *[F.element_at(c, i + k) for k in places]).alias("seed")))

    return F.flatten(F.array(*[window(m) for m in MASKS], *[window("1" * n) for n in short]))


def _best(doc: Column, item: Column, shift: Column) -> Column:
    """The best stretch along a diagonal: (sum, equal, first, last), places in the item from 1."""
    nothing = [F.lit(0).alias(n) for n in ("sum", "equal", "first", "last")]
    begin = F.struct(F.struct(*nothing).alias("now"), F.struct(*nothing).alias("best"))
    first, last = F.greatest(F.lit(1), 1 - shift), F.least(F.size(item), F.size(doc) - shift)

    def step(acc: Column, i: Column) -> Column:
        same, now, fresh = F.element_at(doc, i + shift) == F.element_at(item, i), acc["now"], acc["now"]["sum"] <= 0
        grown = F.struct((F.when(fresh, 0).otherwise(now["sum"]) + F.when(same, 1).otherwise(-PENALTY)).alias("sum"),
                         (F.when(fresh, 0).otherwise(now["equal"]) + same.cast("int")).alias("equal"),
                         F.when(fresh, i).otherwise(now["first"]).alias("first"), i.alias("last"))
        return let(grown, lambda g: F.struct(g.alias("now"), F.when(g["sum"] > acc["best"]["sum"], g).otherwise(acc["best"]).alias("best")))

    return F.aggregate(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), begin, step)["best"]


def _enough(equal: Column, words: Column, joined: Column) -> Column:
    """Whether ``equal`` of ``words`` suffice; ``joined`` tells that no three substituted words stand together."""
    return F.when(joined, equal * 5 >= words * 4).otherwise(equal * 6 >= words * 5)


def _verdict(doc: Column, item: Column, shift: Column) -> Column:
    """The leak along a diagonal, (sum, equal, first, last), or null.

    A stretch begins and ends with an equal word. One of twice as many equal words or more can be halved, and one
    half has at least the same share of them, so fewer decide. Reported is the stretch with the best sum if it
    suffices, else all of the overlap, else the stretch of most equal words among those that decide.
    """
    first, last = F.greatest(F.lit(1), 1 - shift), F.least(F.size(item), F.size(doc) - shift)
    places = F.filter(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(doc, i + shift) == F.element_at(item, i))

    def judged(e: Column) -> Column:
        n = F.size(e)
        at = lambda k: F.element_at(e, k)
        joined = lambda a, b: F.forall(F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>")), lambda k: at(k + 1) - at(k) <= 3)
        stretch = lambda equal, a, b: F.struct((equal - PENALTY * (b - a + 1 - equal)).alias("sum"), equal.alias("equal"), a.alias("first"), b.alias("last"))
        # All of the item has a counterpart, or the words from the first to the last equal one are judged.
        inside = (first == 1) & (last == F.size(item)) & (F.size(item) >= SPAN)
        ends = (at(F.lit(1)) <= 3) & (at(n) >= F.size(item) - 2)
        whole = F.when(inside & (n < MIN_WORDS), _enough(n, F.size(item), ends & joined(F.lit(1), n))).otherwise(
            (n >= MIN_WORDS) & _enough(n, at(n) - at(F.lit(1)) + 1, joined(F.lit(1), n)))
        tried = F.flatten(F.transform(indices(MIN_WORDS, F.least(n, F.lit(2 * MIN_WORDS - 1))), lambda m: F.transform(
            F.filter(F.sequence(F.lit(1), n - m + 1), lambda k: _enough(m, at(k + m - 1) - at(k) + 1, F.lit(True)) & _enough(m, at(k + m - 1) - at(k) + 1, joined(k, k + m - 1))),
            lambda k: F.struct(m.alias("equal"), (-at(k)).alias("back"), at(k + m - 1).alias("last")))))
        part = let(F.array_max(tried), lambda t: F.when(t.isNotNull(), stretch(t["equal"], -t["back"], t["last"])))
        best = let(_best(doc, item, shift), lambda b: F.when(b["equal"] >= F.least(F.lit(MIN_WORDS), F.size(item)), b))
        return F.when((n >= F.least(F.lit(MIN_WORDS), F.size(item))) | (inside & (n * 5 >= F.size(item) * 4)), F.coalesce(best, F.when(whole, stretch(n, at(F.lit(1)), at(n))), part))

    return let(places, judged)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, n_equal, n_words (of the stretch), item_words, doc_word.

    ``doc_word`` is where the best stretch begins, from 1. Clean documents have no row. Null and wordless
    texts or items match nothing; null ids are ids of their own; repeated rows count once; rows that share an
    id are judged each and the best stretch is given; empty tables give no rows; further columns are ignored.
    """
    own = docs.select("doc_id", codes(F.col("text")).alias("c"))
    items = benchmark.select("item_id", codes(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    short = sorted(r["n"] for r in items.where(F.size("item") < SPAN).select(F.size("item").alias("n")).distinct().collect())
    own_seeds = lambda c: F.when(F.size(c) < SPAN, F.filter(seeds(c, short), lambda s: s["at"] == 1)).otherwise(seeds(c, []))
    keys = stage(items.select("item_id", "item", F.inline(own_seeds(F.col("item")))).withColumnRenamed("at", "item_at"))
    known = keys.select("seed", F.col("item_id"), "item_at").distinct()
    known = F.broadcast(known) if keys.count() <= BROADCAST_SEEDS else known
    windows = own.select("doc_id", F.explode(let(F.col("c"), lambda c: seeds(c, short))).alias("s")).select("doc_id", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    hits = stage(windows.join(known, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    # The hits are a written table: few are sent to the documents, many are shuffled to them.
    renamed = hits.select(F.col("doc_id").alias("_id"), F.col("item_id").alias("_item"), "shift")
    met = own.join(renamed, F.col("doc_id").eqNullSafe(F.col("_id"))).join(items, F.col("item_id").eqNullSafe(F.col("_item")))
    tried = met.select("doc_id", "item_id", F.size("item").alias("item_words"), "shift", let(F.col("c"), lambda c: _verdict(c, F.col("item"), F.col("shift"))).alias("b"))
    real = tried.where(F.col("b").isNotNull())
    top = F.max_by(F.struct("b.equal", "b.first", "b.last", "shift", "item_words"), F.struct("b.equal", -F.col("shift"), "item_words"))
    return real.groupBy("doc_id", "item_id").agg(top.alias("t")).select(
        "doc_id", "item_id", F.col("t.equal").cast("long").alias("n_equal"), (F.col("t.last") - F.col("t.first") + 1).cast("long").alias("n_words"),
        F.col("t.item_words").cast("long").alias("item_words"), (F.col("t.first") + F.col("t.shift")).cast("long").alias("doc_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with the columns of ``docs``."""
    found = stage(leaks(docs, benchmark).select(F.col("doc_id").alias("_leaky")).distinct())
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return own.join(found, F.col("_doc.doc_id").eqNullSafe(F.col("_leaky")), "left_anti").select("_doc.*")
