"""Ordered operators that never need one task to hold a whole key.

Numbering and run detection are two-level: windows run inside blocks of the
ordering column (``position div block_rows``, a time bucket, ...), and a second
window over one summary row per block carries the totals across blocks. A key
with a third of all rows is therefore spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

BLOCK_ROWS = 4096


def _partition(keys: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(keys)}" if keys else ""


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str,
             out: str = "position") -> DataFrame:
    """0-based position of each row within its key, in ``order``.

    ``block`` is an SQL expression that must not decrease along ``order``.
    """
    keys = list(keys)
    blocked = df.selectExpr("*", f"{block} AS _block")
    local = blocked.selectExpr(
        "*", f"row_number() OVER ({_partition([*keys, '_block'])} ORDER BY {', '.join(order)}) - 1 AS _local")
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.selectExpr(*keys, "_block", f"coalesce(sum(_n) OVER ({_partition(keys)} ORDER BY _block "
                               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset")
    return local.join(offsets, [*keys, "_block"]).selectExpr(*df.columns, f"CAST(_local + _offset AS BIGINT) AS {out}")


def runs(df: DataFrame, keys: Sequence[str], position: str, value: str, *, breaks: str = "false",
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Contiguous equal-value runs over a dense position.

    Adds ``run_start``, ``run_length``, ``run_offset`` and ``edge_distance`` (to the
    nearer end of the run). NULL values form runs of their own; a gap in the
    positions ends a run, and so does a row where ``breaks`` holds.
    """
    keys, df = list(keys), stage(df)
    linked = df.selectExpr("*", f"{value} AS _value", f"{breaks} AS _breaks", f"{position} div {block_rows} AS _block")
    # The row before is found by an equality on position, not by a window over the key.
    before = linked.selectExpr(*keys, f"{position} + 1 AS {position}", "_value AS _before", "true AS _joined")
    marked = linked.join(before, [*keys, position], "left").selectExpr(
        *linked.columns, f"IF(_joined IS NULL OR _breaks OR NOT (_before <=> _value), {position}, NULL) AS _start")
    marked, block = stage(marked), [*keys, "_block"]
    local = marked.selectExpr("*", f"max(_start) OVER ({_partition(block)} ORDER BY {position}) AS _last")
    earlier = marked.groupBy(*block).agg(F.max("_start").alias("_top")).selectExpr(
        *block, f"max(_top) OVER ({_partition(keys)} ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _earlier")
    placed = local.join(earlier, block).selectExpr(*df.columns, "coalesce(_last, _earlier) AS run_start")
    lengths = placed.groupBy(*keys, "run_start").agg(F.count(F.lit(1)).alias("run_length"))
    return placed.join(lengths, [*keys, "run_start"]).selectExpr(
        *df.columns, "run_start", "run_length", f"{position} - run_start AS run_offset",
        f"least({position} - run_start, run_length - 1 - ({position} - run_start)) AS edge_distance")


def with_neighbour(df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str],
                   offset: int, prefix: str, how: str = "left") -> DataFrame:
    """Add ``<prefix><column>`` from the row ``offset`` positions away.

    An equi-join on a dense position replaces ``lag``/``lead``, which would pull a
    whole key into one window partition.
    """
    moved = df.selectExpr(*keys, f"{position} - ({offset}) AS {position}", *[f"{c} AS {prefix}{c}" for c in columns])
    return df.join(moved, [*keys, position], how)


def dense_positions(df: DataFrame, column: str, out: str = "position", buckets: int = 64) -> DataFrame:
    """0-based rank of distinct, sortable values without a single-partition window.

    Boundaries come from a small sample of the values, so they only decide how
    evenly the buckets fill; the ranks are exact whatever the sample was.
    """
    rows = df.select(column).orderBy(F.xxhash64(column)).limit(buckets * 20).collect()
    sample = sorted(r[0] for r in rows)
    bounds = sample[:: max(1, len(sample) // buckets)][1:] if len(sample) >= 2 * buckets else []
    from ..functions.chemistry import sql_literal
    bucket = f"size(filter({sql_literal(bounds)}, b -> b <= {column}))" if bounds else "0"
    return numbered(df, [], [column], bucket, out)
