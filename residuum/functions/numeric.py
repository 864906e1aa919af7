"""Exact decimal rounding and distances, as SQL expression text.

Functions in this package take and return SQL fragments for ``selectExpr`` and
``filter``: a plan is then built with a handful of calls into the JVM, and every
fragment stays inside whole-stage code generation.
"""

from __future__ import annotations

#: Veltkamp splitting factor for IEEE doubles, 2**27 + 1.
SPLITTER = "134217729D"


def round_decimals(x: str, decimals: int = 3) -> str:
    """The double nearest to ``'%.<decimals>f' % x``, sign of zero included.

    ``rint`` of the scaled value is right except where the product *looks* like a
    tie only because it was itself rounded. There the exact error of the product
    (Veltkamp split; the scale has few bits) tells on which side the value lies.
    ``round`` works on the shortest decimal text instead and gets 1.0005 wrong.

    ``x`` is repeated in the result: pass a column name, not a long expression.
    """
    scale = f"{10 ** decimals}D"
    product = f"({x} * {scale})"
    high = f"({x} * {SPLITTER} - ({x} * {SPLITTER} - {x}))"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    # Past this size neighbouring doubles are further apart than the last digit.
    limit = f"{2 ** 51 // 10 ** decimals}D"
    return (
        f"CASE WHEN abs({x}) >= {limit} THEN {x} "
        f"WHEN abs({product} - rint({product})) = 0.5D AND {error} > 0D THEN CAST(ceil({product}) AS DOUBLE) / {scale} "
        f"WHEN abs({product} - rint({product})) = 0.5D AND {error} < 0D THEN CAST(floor({product}) AS DOUBLE) / {scale} "
        f"ELSE rint({product}) / {scale} END"
    )


def round3(x: str) -> str:
    return round_decimals(x, 3)


def fixed_text(x: str, decimals: int = 3, width: int | str = "") -> str:
    """Fixed-point text of an already rounded column, right-aligned to ``width``."""
    return f"format_string('%{width}.{decimals}f', {x})"


def squared_distance(a: str, b: str) -> str:
    """Squared distance between the points ``<a>x <a>y <a>z`` and ``<b>x <b>y <b>z``."""
    return " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in "xyz")


def distance(a: str, b: str) -> str:
    return f"sqrt({squared_distance(a, b)})"


def linspace_index(n: str, k: str, i: str) -> str:
    """Integer part of the i-th of ``k`` evenly spaced values over ``0 .. n-1``.

    The step is formed first and then multiplied, as evenly spaced sampling in
    floating point does it; the last value is the end point itself.
    """
    return (
        f"CASE WHEN {k} > 1 AND {i} = {k} - 1 THEN CAST({n} - 1 AS BIGINT) "
        f"ELSE CAST(floor({i} * (CAST({n} - 1 AS DOUBLE) / greatest({k} - 1, 1))) AS BIGINT) END"
    )
