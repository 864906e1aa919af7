"""Angles, torsions and threshold classifications, as SQL expression text.

A vector is a triple of SQL fragments; ``vec("a_")`` names the columns ``a_x a_y a_z``.
"""

from __future__ import annotations

Vec = tuple[str, str, str]


def vec(prefix: str) -> Vec:
    return (f"{prefix}x", f"{prefix}y", f"{prefix}z")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(f"({p} - {q})" for p, q in zip(a, b))


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def cross(a: Vec, b: Vec) -> Vec:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def norm(a: Vec) -> str:
    return f"sqrt({dot(a, a)})"


def angle(p1: Vec, p2: Vec, p3: Vec) -> str:
    """Degrees at ``p2``; NULL where either arm has no length."""
    u, v = sub(p1, p2), sub(p3, p2)
    arms = f"({norm(u)} * {norm(v)})"
    return (f"CASE WHEN {norm(u)} >= 1e-9 AND {norm(v)} >= 1e-9 "
            f"THEN degrees(acos(greatest(-1D, least(1D, {dot(u, v)} / {arms})))) END")


def normalise_angle(degrees: str) -> str:
    """Wrap to ``[-180, 180)``."""
    return f"(pmod({degrees} + 180D, 360D) - 180D)"


def circular_difference(a: str, b: str) -> str:
    gap = f"pmod(abs({normalise_angle(a)} - {normalise_angle(b)}), 360D)"
    return f"least({gap}, 360D - {gap})"


def dihedral(p1: Vec, p2: Vec, p3: Vec, p4: Vec) -> str:
    """Signed torsion in ``[-180, 180)``; NULL where the central bond has no length.

    Written with cross products, which needs no normalised axis.
    """
    b0, b1, b2 = sub(p2, p1), sub(p3, p2), sub(p4, p3)
    n1, n2 = cross(b0, b1), cross(b1, b2)
    y = f"({norm(b1)} * {dot(b0, n2)})"
    x = dot(n1, n2)
    return f"CASE WHEN {norm(b1)} >= 1e-9 THEN {normalise_angle(f'degrees(atan2({y}, {x}))')} END"


# -- chi1 ---------------------------------------------------------------------

#: The only chi1 bin edges. The trans bin runs through +/-180.
CHI1_EDGES = (-120.0, 0.0, 120.0)


def chi1_bin(chi: str) -> str:
    return (f"CASE WHEN {chi} >= 0D AND {chi} < 120D THEN 'g+' "
            f"WHEN {chi} >= 120D OR {chi} < -120D THEN 't' WHEN {chi} IS NOT NULL THEN 'g-' END")


def chi1_edge_distance(chi: str) -> str:
    return "least(" + ", ".join(circular_difference(chi, f"{edge}D") for edge in CHI1_EDGES) + ")"


def chi1_change_reasons(chi1: str, chi2: str, shift: str = "CAST(NULL AS DOUBLE)", *, min_difference: float = 60.0,
                        margin: float = 15.0, max_shift: float = 1.0) -> str:
    """Why two chi1 angles do *not* count as a rotamer change; empty when they do."""
    return (
        f"array_compact(array(CASE WHEN {chi1_bin(chi1)} = {chi1_bin(chi2)} THEN 'same_rotamer_bin' END, "
        f"CASE WHEN {circular_difference(chi1, chi2)} < {min_difference}D THEN 'difference_below_minimum' END, "
        f"CASE WHEN least({chi1_edge_distance(chi1)}, {chi1_edge_distance(chi2)}) < {margin}D THEN 'within_boundary_margin' END, "
        f"CASE WHEN {shift} > {max_shift}D THEN 'ca_displacement_exceeds_limit' END))"
    )


def omega_class(omega: str, cis_max: float = 30.0, trans_deviation: float = 30.0) -> str:
    return (f"CASE WHEN abs({omega}) <= {cis_max}D THEN 'cis' "
            f"WHEN abs(abs({omega}) - 180D) <= {trans_deviation}D THEN 'trans' ELSE '' END")


# -- threshold classifications ------------------------------------------------

def burial_class(rasa: str, buried_max: float = 0.20, exposed_min: float = 0.40) -> str:
    return (f"CASE WHEN {rasa} <= {buried_max}D THEN 'buried' "
            f"WHEN {rasa} >= {exposed_min}D THEN 'solvent-exposed' ELSE 'intermediate' END")


def contact_change(d1: str, d2: str, contact: float = 4.0, apart: float = 4.5) -> str:
    """Five-way verdict with a hysteresis band; the order of the tests matters."""
    near, far = f"<= {contact}D", f">= {apart}D"
    return (f"CASE WHEN {d2} {near} AND {d1} {far} THEN 'gained' WHEN {d1} {near} AND {d2} {far} THEN 'lost' "
            f"WHEN {d1} {near} AND {d2} {near} THEN 'retained_contact' "
            f"WHEN {d1} {far} AND {d2} {far} THEN 'retained_noncontact' ELSE 'ambiguous' END")


def displacement_class(d: str, unchanged_max: float = 1.0, displaced_min: float = 3.0) -> str:
    return (f"CASE WHEN {d} <= {unchanged_max}D THEN 'approximately unchanged' "
            f"WHEN {d} >= {displaced_min}D THEN 'substantially displaced' ELSE 'intermediate' END")


def fold_class(helix: str, beta: str) -> str:
    """Fold label from helix and strand fractions, NULL when no rule applies."""
    return (
        f"CASE WHEN {helix} >= 0.35D AND {helix} > 2D * {beta} THEN 'predominantly alpha helical' "
        f"WHEN {beta} >= 0.25D AND {beta} > 2D * {helix} THEN 'predominantly beta sheet' "
        f"WHEN {helix} >= 0.15D AND {beta} >= 0.15D AND {helix} >= 0.5D * {beta} AND {helix} <= 2D * {beta} "
        f"THEN 'mixed alpha/beta' END")


def hbond_energy(on: str, ch: str, oh: str, cn: str) -> str:
    """Kabsch-Sander electrostatic energy in kcal/mol from the four distances; 0 where any pair nearly coincides."""
    return (f"CASE WHEN least({on}, {ch}, {oh}, {cn}) < 0.5D THEN 0D "
            f"ELSE {0.084 * 332.0}D * (1D / {on} + 1D / {ch} - 1D / {oh} - 1D / {cn}) END")
