"""Two-state mapping, least-squares superposition, and what changed between states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import displacement_class
from ..session import stage

MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2.0, -1.0, -10.0, -0.5  # fixed values
_DOUBLES, _INTS = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
FIT = T.StructType().add("rotation", _DOUBLES).add("translation", _DOUBLES)
ALIGNED = T.StructType().add("identity", T.DoubleType()).add("i", _INTS).add("j", _INTS)


# -- sequence alignment ----------------------------------------------------------

def align_sequences(a: str, b: str) -> tuple[list[int], list[int], float]:
    """Global alignment with affine gaps, one numpy row at a time.

    Returns the aligned position lists and identity over the shorter sequence. Equal
    scores prefer opening a gap over extending one, and the later of the states
    (match, gap in b, gap in a). Gaps along a row depend on each other, but through
    a running maximum only.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return [], [], 0.0
    letters = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    ramp = GAP_EXTEND * np.arange(m + 1)
    low = -np.inf
    match, down = np.full(m + 1, low), np.full(m + 1, low)
    match[0] = 0.0
    right = np.concatenate([[low], GAP_OPEN + ramp[:-1]])
    came = np.zeros((3, n + 1, m + 1), dtype=np.int8)
    came[1, 2:, 0] = 1
    came[2, 0, 2:] = 2
    for i in range(1, n + 1):
        stack = np.stack([match, down, right])
        best = 2 - np.argmax(stack[::-1], axis=0)
        top = np.take_along_axis(stack, best[None], axis=0)[0]
        new_match = np.full(m + 1, low)
        new_match[1:] = top[:-1] + np.where(letters == ord(a[i - 1]), MATCH, MISMATCH)
        came[0, i, 1:] = best[:-1]
        opened, extended = match + GAP_OPEN, down + GAP_EXTEND
        came[1, i, 1:] = (opened < extended)[1:]
        down = np.maximum(opened, extended)
        if i == 1:
            down[0] = GAP_OPEN
        # right[j] = max over k < j of match[k] + open + extend * (j - 1 - k)
        opened = new_match[:-1] + GAP_OPEN
        right = np.concatenate([[low], np.maximum.accumulate(opened - ramp[:-1]) + ramp[:-1]])
        came[2, i, 1:] = np.where(opened >= right[:-1] + GAP_EXTEND, 0, 2)
        match = new_match
    state = 2 - int(np.argmax([right[m], down[m], match[m]]))
    i, j, left, other = n, m, [], []
    while i > 0 or j > 0:
        if i == 0 or j == 0:
            break
        origin = came[state, i, j]
        if state == 0:
            i, j = i - 1, j - 1
            left.append(i)
            other.append(j)
        elif state == 1:
            i -= 1
        else:
            j -= 1
        state = int(origin)
    left.reverse()
    other.reverse()
    same = sum(a[p] == b[q] for p, q in zip(left, other))
    return left, other, same / max(1, min(n, m))


@F.pandas_udf(ALIGNED)
def alignment(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    rows = [align_sequences(a, b) for a, b in zip(first, second)]
    return pd.DataFrame({"identity": [r[2] for r in rows], "i": [r[0] for r in rows], "j": [r[1] for r in rows]})


def chain_sequences(residues: DataFrame) -> DataFrame:
    """One-letter sequence of each protein chain in polymer order.

    A sequence is one value of one row by nature; it is built from (position, letter)
    pairs, which is all of the residue that travels.
    """
    return residues.filter("entity = 'protein'").groupBy("structure_id", "chain").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(poly_index, one_letter))), r -> r.one_letter), '') AS sequence"))


def aligned_sequences(pairs: DataFrame) -> DataFrame:
    """Sequence pairs ``first, second`` with their alignment as ``a``: each different pair is aligned once.

    An alignment costs far more time than its input has bytes, so the spread is fixed here rather than
    left to a size-based merge, and by a hash of the pair, as the exchange of the distinct pairs is merged.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("first", "second").distinct().repartition(tasks, F.xxhash64("first", "second")).withColumn(
        "a", alignment("first", "second"))


def align_chains(pairs: DataFrame) -> DataFrame:
    """Aligned positions of listed sequence pairs: input ``pair_id, first, second``."""
    found = pairs.join(aligned_sequences(pairs), ["first", "second"])
    return found.selectExpr(
        "pair_id", "a.identity AS identity", "first", "second", "explode(arrays_zip(a.i, a.j)) AS p").selectExpr(
        "pair_id", "identity", "p.i AS i", "p.j AS j", "substr(first, p.i + 1, 1) = substr(second, p.j + 1, 1) AS same_letter")


def map_residues(residues_1: DataFrame, residues_2: DataFrame, chain_pairs: DataFrame,
                 min_identity: float = 0.90) -> DataFrame:
    """Residue correspondence of two states by aligning their chains.

    ``chain_pairs`` holds ``pair_id, structure_1, chain_1, structure_2, chain_2``. Pairs
    below ``min_identity`` come back with ``accepted = false`` rather than vanishing.
    """
    first = chain_sequences(residues_1).selectExpr("structure_id AS structure_1", "chain AS chain_1", "sequence AS first")
    second = chain_sequences(residues_2).selectExpr("structure_id AS structure_2", "chain AS chain_2", "sequence AS second")
    joined = stage(chain_pairs.join(first, ["structure_1", "chain_1"]).join(second, ["structure_2", "chain_2"]))
    ends = ["structure_1", "chain_1", "structure_2", "chain_2"]
    rows = joined.join(aligned_sequences(joined), ["first", "second"]).selectExpr(
        "pair_id", *ends, "a.identity AS identity", "first", "second", "explode(arrays_zip(a.i, a.j)) AS p").filter(
        "substr(first, p.i + 1, 1) = substr(second, p.j + 1, 1)")
    by_position = [r.selectExpr(f"structure_id AS structure_{s}", f"chain AS chain_{s}", f"poly_index AS poly_{s}",
                                f"residue_idx AS residue_{s}", f"label AS label_{s}", f"one_letter AS letter_{s}")
                   for r, s in ((residues_1, 1), (residues_2, 2))]
    located = rows.selectExpr("pair_id", *ends, "identity", "p.i AS poly_1", "p.j AS poly_2")
    return located.join(by_position[0], ["structure_1", "chain_1", "poly_1"]).join(
        by_position[1], ["structure_2", "chain_2", "poly_2"]).selectExpr(
        "*", f"identity >= {min_identity}D AS accepted")


# -- superposition ---------------------------------------------------------------

def fit_of_moments(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proper rotation and translation from nine covariances and six means."""
    u, _, vt = np.linalg.svd(moments[:9].reshape(3, 3))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    rotation = vt.T @ flip @ u.T
    return rotation, moments[12:15] - rotation @ moments[9:12]


@F.pandas_udf(FIT)
def _fit(moments: pd.Series) -> pd.DataFrame:
    fits = [fit_of_moments(np.asarray(m, dtype=float)) for m in moments]
    return pd.DataFrame({"rotation": [f[0].ravel() for f in fits], "translation": [f[1] for f in fits]})


def kabsch(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares fit of ``m_`` points onto ``t_`` points per key.

    The fit needs only fifteen moments, which are ordinary aggregates; the 3x3
    decomposition then runs once per key on one small row.
    """
    moments = [f"covar_pop(m_{a}, t_{b})" for a in "xyz" for b in "xyz"]
    means = [f"avg({s}_{a})" for s in ("m", "t") for a in "xyz"]
    summed = pairs.groupBy(*keys).agg(
        F.expr("count(*) AS n_pairs"), F.expr(f"array({', '.join(moments + means)}) AS moments")).filter("n_pairs >= 3")
    return summed.withColumn("fit", _fit("moments")).selectExpr(*keys, "n_pairs", "fit.rotation", "fit.translation")


def moved(prefix: str) -> dict[str, str]:
    """``R p + t`` for the point ``<prefix>x y z`` with columns ``rotation`` and ``translation``."""
    return {c: f"rotation[{3 * r}] * {prefix}x + rotation[{3 * r + 1}] * {prefix}y + rotation[{3 * r + 2}] * {prefix}z "
               f"+ translation[{r}]" for r, c in enumerate("xyz")}


def _residuals(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    m = moved("m_")
    gap = " + ".join(f"power({m[c]} - t_{c}, 2)" for c in "xyz")
    return pairs.join(fits, keys).selectExpr(*pairs.columns, f"sqrt({gap}) AS residual")


def superpose_states(pairs: DataFrame, keys: list[str], outlier: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Fit on core pairs, drop residuals above ``outlier`` once, and fit again.

    ``pairs`` has ``keys``, ``is_core`` and the points ``m_*`` (moving) and ``t_*``. Returns the
    fits with RMSD before and after, and every pair with its displacement under the final fit.
    """
    pairs = stage(pairs)
    core = pairs.filter("is_core")
    first = stage(kabsch(core, keys))
    measured = stage(_residuals(core, first, keys))
    kept = measured.filter(f"residual <= {outlier}D").drop("residual")
    second = kabsch(kept, keys)
    state = measured.groupBy(*keys).agg(
        F.expr("count(*) AS n_core"), F.expr(f"count_if(residual > {outlier}D) AS n_outliers"),
        F.expr("sqrt(avg(residual * residual)) AS rmsd_before"))
    refit = "n_outliers > 0 AND n_core - n_outliers >= 3"
    fits = stage(first.join(state, keys).join(
        second.selectExpr(*keys, "rotation AS rotation_2", "translation AS translation_2"), keys, "left").selectExpr(
        *keys, "n_core", "n_outliers", "rmsd_before", f"{refit} AS refitted",
        f"IF({refit}, rotation_2, rotation) AS rotation", f"IF({refit}, translation_2, translation) AS translation"))
    placed = _residuals(pairs, fits, keys).withColumnRenamed("residual", "displacement")
    used = placed.join(measured.select(*keys, "pair_idx", "residual"), [*keys, "pair_idx"]).join(
        fits.select(*keys, "refitted"), keys).filter(f"NOT refitted OR residual <= {outlier}D")
    after = used.groupBy(*keys).agg(F.expr("sqrt(avg(displacement * displacement)) AS rmsd_after"))
    return fits.join(after, keys), placed.selectExpr("*", f"{displacement_class('displacement')} AS displacement_class")


def apply_superposition(atoms: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    m = moved("")
    joined = atoms.join(fits.select(*keys, "rotation", "translation"), keys)
    return joined.selectExpr(*[f"{m[c]} AS {c}" if c in "xyz" else c for c in atoms.columns])
