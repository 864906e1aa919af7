"""Radius joins on a uniform grid.

A raw distance predicate has no equality in it, so Catalyst can only plan it as a
nested loop. Cutting space into cells as wide as the cutoff turns it into an
equi-join on the cell: a pair within the cutoff always lies in the same cell or in
two touching ones. The join is a sorted merge, since the copied side is many times larger than
Catalyst takes it for. Crowded cells are left to the skew join of adaptive execution, or, with ``probe``,
counted first and cut into slices; the pairs are the same. The self-join visits only half of the touching cells, which
finds every pair once.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import distance, squared_distance
from ..session import merged, stage
from .keyed import argmin_by

#: Half of the 26 touching cells plus the cell itself.
HALF_SHELL = [(0, 0, 0)] + [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
FULL_SHELL = list(product((-1, 0, 1), repeat=3))

#: Rows one cell may hold before its left side is split over several join keys.
HOT_CELL_ROWS = 2000

CELL = ["_cx", "_cy", "_cz"]


def _cell(coordinate: str, cutoff: float) -> str:
    # A hair wider than the cutoff, so that rounding in the division can never put
    # two points exactly one cutoff apart into cells that do not touch.
    # Non-nullable on purpose: for a nullable join key Catalyst pushes an IS NOT NULL
    # copy of everything the coordinate was computed from down to the scan.
    return f"coalesce(floor({coordinate} * {1.0 / (cutoff * (1.0 + 1e-9))!r}D), 0L)"


def _celled(df: DataFrame, cutoff: float, columns: list[str], group: list[str], prefix: str) -> DataFrame:
    cells = [f"{_cell(axis, cutoff)} AS {c}" for axis, c in zip("xyz", CELL)]
    return df.selectExpr(*group, *cells, *[f"{c} AS {prefix}{c}" for c in columns if c not in group])


def _spread(df: DataFrame, shell: list[tuple[int, int, int]]) -> DataFrame:
    """One copy of each row per touching cell."""
    offsets = ", ".join(f"named_struct('a', {a}L, 'b', {b}L, 'c', {c}L)" for a, b, c in shell)
    others = [c for c in df.columns if c not in CELL]
    moved = [f"coalesce({c} + _o.{o}, 0L) AS {c}" for c, o in zip(CELL, "abc")]
    return df.selectExpr("*", f"explode(array({offsets})) AS _o").selectExpr(*others, *moved)


def hot_cells(df: DataFrame, cutoff: float, group: list[str], hot_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """Cells above ``hot_rows`` with the number of slices each should be cut into."""
    return (
        _celled(df, cutoff, [], list(group), "").groupBy(*group, *CELL).count().filter(f"count > {hot_rows}")
        .selectExpr(*group, *CELL, f"CAST(ceil(count / {hot_rows}) AS INT) AS _slices")
    )


def _sliced(left: DataFrame, right: DataFrame, hot: DataFrame, keys: list[str], spread_by: str) -> tuple[DataFrame, DataFrame]:
    """Cut the left rows of a hot cell into slices and copy its right rows to each slice.

    ``hot`` holds one row per hot cell, at most input rows / HOT_CELL_ROWS. Catalyst
    sees its true size at run time and picks the join; it is never forced. The slice
    comes from a hash of the row, so a recomputed task makes the same choice.
    """
    cut = left.join(hot, keys, "left").selectExpr(
        *left.columns, f"pmod(xxhash64({spread_by}), coalesce(_slices, 1)) AS _slice")
    copied = right.join(hot, keys, "left").selectExpr(
        *right.columns, "explode(sequence(0L, CAST(coalesce(_slices, 1) - 1 AS BIGINT))) AS _slice")
    return cut, copied


def _join_cells(left: DataFrame, right: DataFrame, cutoff: float, group: list[str],
                shell, probe: bool, hot_rows: int, extra: str | None) -> DataFrame:
    a = _celled(left, cutoff, left.columns, group, "a_")
    b = _spread(_celled(right, cutoff, right.columns, group, "b_"), shell)
    keys = [*group, *CELL]
    if probe:
        a, b = _sliced(a, b, hot_cells(left, cutoff, group, hot_rows), keys, "a_x, a_y, a_z, a_" + next(
            c for c in [*left.columns] if c not in group))
        keys = [*keys, "_slice"]
    within = f"{squared_distance('a_', 'b_')} <= {cutoff * cutoff!r}D"
    if extra:
        within = f"({within}) AND ({extra})"
    carried = [c for c in [*a.columns, *b.columns] if c not in keys]
    return a.join(merged(b), keys).filter(within).selectExpr(*group, *carried, f"{distance('a_', 'b_')} AS distance")


def radius_pairs(points: DataFrame, cutoff: float, columns: list[str], *,
                 group: list[str] = ("structure_id",), ident: str = "atom_idx",
                 probe: bool = False, hot_rows: int = HOT_CELL_ROWS,
                 extra: str | None = None) -> DataFrame:
    """Every unordered pair of distinct points of a group within ``cutoff`` (inclusive).

    ``columns`` are carried as ``a_<column>`` and ``b_<column>`` with
    ``a_<ident> < b_<ident>``; only columns named here reach the shuffle. ``extra``
    is a predicate over the carried columns that must not depend on the order.
    """
    group = list(group)
    carried = list(dict.fromkeys([ident, "x", "y", "z", *columns]))
    base = points.select(*group, *carried)
    # The half shell meets every touching pair once, in either order; pairs in
    # the same cell meet twice and keep the ordered one.
    same_cell = " AND ".join(f"{_cell(f'a_{axis}', cutoff)} = {_cell(f'b_{axis}', cutoff)}" for axis in "xyz")
    once = f"(a_{ident} < b_{ident} OR NOT ({same_cell}))"
    if extra:
        once = f"{once} AND ({extra})"
    pairs = _join_cells(base, base, cutoff, group, HALF_SHELL, probe, hot_rows, once)
    flip = f"a_{ident} > b_{ident}"
    ordered = [c for n in carried for c in (
        f"IF({flip}, b_{n}, a_{n}) AS a_{n}", f"IF({flip}, a_{n}, b_{n}) AS b_{n}")]
    return pairs.selectExpr(*group, *ordered, "distance")


def radius_join(left: DataFrame, right: DataFrame, cutoff: float, *,
                group: list[str] = ("structure_id",), probe: bool = False,
                hot_rows: int = HOT_CELL_ROWS, extra: str | None = None) -> DataFrame:
    """Every (left, right) pair of a group within ``cutoff``; columns become ``a_*`` and ``b_*``.

    Pass the larger side first: the second one is copied to 27 cells.
    """
    return _join_cells(left, right, cutoff, list(group), FULL_SHELL, probe, hot_rows, extra)


def residue_pair_minima(points: DataFrame, cutoff: float, columns: list[str] = (), *,
                        probe: bool = False, extra: str | None = None) -> DataFrame:
    """Closest atom pair of every residue pair within ``cutoff``.

    Ties are broken by atom index, so the witnesses do not depend on partitioning.
    """
    carried = list(dict.fromkeys(["residue_idx", "atom_name", *columns]))
    different = "a_residue_idx <> b_residue_idx" + (f" AND ({extra})" if extra else "")
    pairs = radius_pairs(points, cutoff, carried, probe=probe, extra=different)
    # Residue order can differ from atom order only if atoms are not numbered by residue.
    flip = "a_residue_idx > b_residue_idx"
    oriented = [c for n in ["atom_idx", *carried] for c in (
        f"IF({flip}, b_{n}, a_{n}) AS {n}_i", f"IF({flip}, a_{n}, b_{n}) AS {n}_j")]
    keep = [f"{n}_{s}" for n in carried if n != "residue_idx" for s in "ij"]
    return argmin_by(pairs.selectExpr("structure_id", "distance", *oriented),
                     ["structure_id", "residue_idx_i", "residue_idx_j"],
                     ["distance", "atom_idx_i", "atom_idx_j"], keep)


def nearest_target(sources: DataFrame, targets: DataFrame, *, group: list[str],
                   source_key: list[str], first_radius: float, max_rounds: int = 24) -> DataFrame:
    """Distance from every source key to its nearest target point of the same group, unbounded.

    Rounds double the radius and look only at sources that are still unmatched; a
    hit within the radius is final, because anything nearer would also be inside.
    The number of rounds is the logarithm of the extent, not of the row count.
    """
    group, keys = list(group), [*group, *source_key]
    sources = sources.join(targets.select(*group).distinct(), group, "left_semi")
    pending, found, radius = sources, None, first_radius
    for _ in range(max_rounds):
        pairs = radius_join(pending, targets, radius, group=group).selectExpr(
            *group, *[f"a_{k} AS {k}" for k in source_key], "distance")
        hits = stage(pairs.groupBy(*keys).agg(F.min("distance").alias("distance")))
        found = hits if found is None else found.unionByName(hits)
        pending = stage(pending.join(merged(hits), keys, "left_anti"))
        if pending.isEmpty():
            return found
        radius *= 2.0
    raise RuntimeError("targets lie beyond the widest search radius")
