"""Choosing among candidates: seeded pools, spread over tags, round-robin, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import merged, stage
from .keyed import first_per_key

POOL, ROUNDS, PER_SOURCE, OVERSAMPLE, EXAMPLES = 16, 3, 6, 4, 8  # fixed values


def pooled_order(df: DataFrame, keys: list[str], order: list[str], seed: str, pool: int = POOL) -> DataFrame:
    """Reorder the best ``pool`` rows of each key by ``seed`` and keep the rest in order.

    Adds ``pool_rank``, the place in the new order, for pool rows; other rows keep NULL and
    follow in ``order`` (sort by :func:`pooled_terms`). Only the pool is ranked, which a group
    limit prunes map-side; rows are written once with a number of their own and joined on it.
    """
    marked = stage(df.withColumn("_row", F.monotonically_increasing_id()))
    head = first_per_key(marked, keys, order, pool, "_place")
    ranked = head.selectExpr("_row", f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {seed}, _place) AS pool_rank")
    return marked.join(merged(ranked), "_row", "left").drop("_row")


def pooled_terms(order: list[str]) -> list[str]:
    """Sort terms of rows from :func:`pooled_order`: the pool in its new order, then the rest."""
    return ["pool_rank NULLS LAST", *order]


def diversified(df: DataFrame, keys: list[str], tag: str, order: list[str], rounds: int = ROUNDS, keep: int = PER_SOURCE) -> DataFrame:
    """At most ``keep`` rows per key, taken in rounds over the sorted tags, at most ``rounds`` per tag."""
    by_tag = first_per_key(df, [*keys, tag], order, rounds, "_round")
    return first_per_key(by_tag, keys, ["_round", tag], keep, "pick").drop("_round")


def round_robin(df: DataFrame, cluster: str, order: list[str], seed: str, limit: int) -> DataFrame:
    """The first ``limit`` rows when clusters take turns, clusters ordered by ``seed`` then name.

    No cluster can contribute more than ``limit`` rows, so the rest is pruned map-side
    and the final order is a bounded top-k.
    """
    turns = first_per_key(df, [cluster], order, limit, "turn")
    return turns.selectExpr("*", f"{seed} AS cluster_seed").orderBy("turn", "cluster_seed", cluster).limit(limit)


def quota_fold(candidates: DataFrame, families: list[str], targets: dict[str, int], cap: int) -> DataFrame:
    """Fill each family in turn, no cluster giving more than ``cap`` rows over all families.

    ``candidates`` holds ``family, cluster, place`` and ``usable``: candidates that fail later do
    not use up quota. Within a family a cluster may give its first rows up to the quota it
    has left, then the family keeps the first ones up to its target; that equals taking
    candidates one by one. Families depend on each other, so they go in order.
    """
    used, chosen = None, None
    for family in families:
        target = targets.get(family, 0)
        if target <= 0:
            continue
        rows = candidates.filter(F.col("family") == family).filter("usable")
        ranked = first_per_key(rows, ["cluster"], ["place"], cap, "_nth")
        if used is None:
            ranked = ranked.selectExpr("*", "0L AS _used")
        else:
            ranked = ranked.join(used, "cluster", "left").selectExpr(*ranked.columns, "coalesce(n_used, 0) AS _used")
        taken = stage(ranked.filter(f"_nth + _used <= {cap}").orderBy("place").limit(target).select(*candidates.columns))
        chosen = taken if chosen is None else stage(chosen.unionByName(taken))
        used = chosen.groupBy("cluster").agg(F.expr("count(*) AS n_used"))
    return chosen if chosen is not None else candidates.limit(0)


def capped_rejections(rejections: DataFrame, keys: list[str], order: list[str], keep: int = EXAMPLES) -> DataFrame:
    """All rejections counted, the first ``keep`` of each key shown."""
    shown = first_per_key(rejections, keys, order, keep, "example")
    counts = rejections.groupBy(*keys).agg(F.expr("count(*) AS n_rejections"))
    return shown.join(counts, keys)


def coin(seed: str, fraction: float) -> str:
    """Seeded yes/no with the given share of yes."""
    return f"{seed} % 1000 < {fraction * 1000!r}D"
