"""What a reader sees: a rigid move, three decimals, and excerpts of a structure."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round3
from .spatial import radius_join

ROTATION_ALGORITHM = "pcg64_unit_quaternion_v1"  # fixed value
MAX_COORDINATE = 9999.999  # fixed value


def seed_of(*parts) -> int:
    """The 63-bit seed of a tuple of parts; ``functions.hashing.derive_seed`` is its column form."""
    digest = hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return int(digest[:16], 16) & ((1 << 63) - 1)


def generator(*parts) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed_of(*parts)))


def rotation_matrix(seed: int) -> np.ndarray:
    """Uniform proper rotation: four normal draws make a unit quaternion."""
    q = generator("rotation", ROTATION_ALGORITHM, int(seed)).standard_normal(4)
    w, v = q[0] / np.linalg.norm(q), q[1:] / np.linalg.norm(q)
    skew = np.array([[0.0, -v[2], v[1]], [v[2], 0.0, -v[0]], [-v[1], v[0], 0.0]])
    return np.eye(3) + 2.0 * w * skew + 2.0 * skew @ skew


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rotations(seeds: pd.Series) -> pd.Series:
    """Row-major rotation matrix per seed. The generator is numpy's, so this cannot be a JVM expression."""
    return pd.Series([rotation_matrix(s).ravel() for s in seeds])


def transforms(atoms: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rotation and translation per display: minus the centroid of all its atoms, states together.

    ``seeds`` holds ``structure_id, display_id, seed``; structures sharing a display share a move.
    """
    centres = atoms.join(seeds, "structure_id").groupBy("display_id", "seed").agg(
        *[F.expr(f"avg({c}) AS c{c}") for c in "xyz"])
    return centres.withColumn("rotation", rotations("seed")).selectExpr(
        "display_id", "seed", "rotation", "array(-cx, -cy, -cz) AS translation")


def displayed(atoms: DataFrame, moves: DataFrame) -> DataFrame:
    """``R (x + t)`` rounded to three decimals. ``atoms`` carries ``display_id``; overflow is an error."""
    columns = [c for c in atoms.columns if c not in "xyz"]
    row = [f"rotation[{3 * r}] * (x + translation[0]) + rotation[{3 * r + 1}] * (y + translation[1]) "
           f"+ rotation[{3 * r + 2}] * (z + translation[2]) AS raw_{c}" for r, c in enumerate("xyz")]
    turned = atoms.join(moves, "display_id").selectExpr(*columns, *row)
    rounded = turned.selectExpr(*columns, *[f"{round3(f'raw_{c}')} AS {c}" for c in "xyz"])
    guard = "IF(greatest(abs(x), abs(y), abs(z)) > {m}D, raise_error('coordinate exceeds the fixed field'), {c}) AS {c}"
    return rounded.selectExpr(*columns, *[guard.format(m=MAX_COORDINATE, c=c) for c in "xyz"])


def crop_around(atoms: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Residue keys kept by a whole-residue excerpt around listed residues.

    Any residue with an atom within ``radius`` of a centre atom stays; ligands and metals
    stay out to 1.5 times that. ``centres`` holds ``structure_id, residue_idx``.
    """
    points = atoms.select("structure_id", "residue_idx", "entity", "x", "y", "z")
    middle = points.join(centres.select("structure_id", "residue_idx").distinct(), ["structure_id", "residue_idx"], "left_semi")
    near = radius_join(points.select("structure_id", "residue_idx", "x", "y", "z"), middle.select("structure_id", "x", "y", "z"), radius)
    hetero = points.filter("entity IN ('ligand', 'metal')").select("structure_id", "residue_idx", "x", "y", "z")
    far = radius_join(hetero, middle.select("structure_id", "x", "y", "z"), 1.5 * radius)
    kept = near.selectExpr("structure_id", "a_residue_idx AS residue_idx").unionByName(
        far.selectExpr("structure_id", "a_residue_idx AS residue_idx")).unionByName(
        middle.select("structure_id", "residue_idx"))
    return kept.distinct()


def crop_to_ranges(residues: DataFrame, ranges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Residue keys inside inclusive ``(structure_id, chain, first, last)`` ranges, or listed by label."""
    inside = residues.join(ranges, ["structure_id", "chain"]).filter("seq_id BETWEEN first AND last").select(
        "structure_id", "residue_idx")
    if labels is not None:
        inside = inside.unionByName(residues.join(labels, ["structure_id", "label"], "left_semi").select(
            "structure_id", "residue_idx"))
    return inside.distinct()


def crop_like(residues: DataFrame, kept_labels: DataFrame) -> DataFrame:
    """The same excerpt on another state, by label."""
    return residues.join(kept_labels.select("structure_id", "label").distinct(), ["structure_id", "label"], "left_semi").select(
        "structure_id", "residue_idx")


def union_of_crops(*kept: DataFrame) -> DataFrame:
    out = kept[0]
    for other in kept[1:]:
        out = out.unionByName(other)
    return out.distinct()


def missing_required(kept: DataFrame, required: DataFrame) -> DataFrame:
    """Required residues an excerpt would lose."""
    return required.join(kept, ["structure_id", "residue_idx"], "left_anti")


def subset(atoms: DataFrame, kept: DataFrame) -> DataFrame:
    """Atoms of the kept residues with ``poly_index`` renumbered, as an excerpt is read on its own."""
    from .cleaning import assign_poly_index
    return assign_poly_index(atoms.join(kept, ["structure_id", "residue_idx"], "left_semi").drop("poly_index"))


def crop_boundary(residues: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept polymer residues that lost a neighbour they had before."""
    polymer = residues.filter("poly_index IS NOT NULL").select("structure_id", "chain", "poly_index", "residue_idx", "label")
    inside = polymer.join(kept, ["structure_id", "residue_idx"], "left_semi")
    lost = polymer.join(kept, ["structure_id", "residue_idx"], "left_anti").selectExpr(
        "structure_id", "chain", "explode(array(poly_index - 1, poly_index + 1)) AS poly_index").distinct()
    return inside.join(lost, ["structure_id", "chain", "poly_index"], "left_semi").select("structure_id", "residue_idx", "label")
