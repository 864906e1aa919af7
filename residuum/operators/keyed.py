"""Per-key selection written as aggregates, so that a hot key combines map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def argmin_by(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              keep: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest ``order`` tuple of each key, as ``keys + order + keep``.

    ``min`` over a struct compares field by field, which makes ``order`` a complete
    tie-break and lets every task reduce its rows before anything is shuffled.
    """
    return _best(df, keys, order, keep, "min")


def _best(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str], how: str) -> DataFrame:
    columns = list(dict.fromkeys([*order, *keep]))
    best = df.groupBy(*keys).agg(F.expr(f"{how}(struct({', '.join(columns)})) AS _best"))
    return best.select(*keys, "_best.*")


def argmax_by(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              keep: Sequence[str] = ()) -> DataFrame:
    return _best(df, keys, order, keep, "max")


def latest(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The last row of each key by an ingest ordinal (last attempt, last decision)."""
    rest = [c for c in df.columns if c not in keys and c != ordinal]
    return argmax_by(df, keys, [ordinal], rest).select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key by the SQL sort terms ``order``, numbered from 1.

    The ``row_number <= k`` filter is planned as a partial and a final group
    limit, so at most ``k`` rows per key and task reach the shuffle.
    """
    over = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)})"
    return df.selectExpr("*", f"{over} AS {rank}").filter(f"{rank} <= {k}")


def two_smallest(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 keep: Sequence[str] = ()) -> DataFrame:
    """Winner and runner-up of each key: ``best`` and ``second`` structs (NULL if absent)."""
    ranked = first_per_key(df.selectExpr(*keys, f"struct({', '.join([*order, *keep])}) AS _row", *order),
                           keys, order, 2, "_rank")
    return ranked.groupBy(*keys).agg(
        F.expr("max(CASE WHEN _rank = 1 THEN _row END) AS best"),
        F.expr("max(CASE WHEN _rank = 2 THEN _row END) AS second"))
