"""Diffraction geometry and lattice formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CU_K_ALPHA = 1.5406


def theta(two_theta: Column) -> Column:
    return F.radians(two_theta / 2)


def d_from_angle(two_theta: Column, wavelength: float = CU_K_ALPHA, order: int = 1) -> Column:
    return F.lit(order * wavelength) / (2 * F.sin(theta(two_theta)))


def angle_from_d(d: Column, wavelength: float = CU_K_ALPHA) -> Column:
    """NULL when the plane spacing is too small to diffract."""
    return F.when(d > wavelength / 2, 2 * F.degrees(F.asin(F.lit(wavelength) / (2 * d))))


def allowed(h: Column, k: Column, l: Column, centering: Column) -> Column:  # noqa: E741
    """Whether lattice centering lets a reflection appear; unknown centerings allow all."""
    even = lambda c: F.pmod(c, F.lit(2)) == 0
    c = F.upper(F.coalesce(centering, F.lit("P")))
    rule = (
        F.when(c == "I", even(h + k + l))
        .when(c == "F", (even(h) & even(k) & even(l)) | (~even(h) & ~even(k) & ~even(l)))
        .when(c == "C", even(h + k))
        .when(c == "A", even(k + l))
        .when(c == "B", even(h + l))
        .when(c == "R", F.pmod(k + l - h, F.lit(3)) == 0)
        .when(c == "HCP", ~((F.pmod(h + 2 * k, F.lit(3)) == 0) & ~even(l)))
        .otherwise(F.lit(True))
    )
    return rule & ~((h == 0) & (k == 0) & (l == 0))


def d_from_hkl(
    h: Column, k: Column, l: Column, system: Column, a: Column, b: Column, c: Column,  # noqa: E741
    alpha: Column | None = None, beta: Column | None = None, gamma: Column | None = None,
    triclinic: bool = False,
) -> Column:
    """Plane spacing of a reflection; NULL for a system without a formula.

    The triclinic formula (reciprocal metric) is only used by reverse indexing.
    """
    sys = F.lower(system)
    sin2b = F.pow(F.sin(F.radians(beta)), F.lit(2.0)) if beta is not None else F.lit(1.0)
    cosb = F.cos(F.radians(beta)) if beta is not None else F.lit(0.0)
    inv = (
        F.when(sys == "cubic", (h * h + k * k + l * l) / (a * a))
        .when(sys == "tetragonal", (h * h + k * k) / (a * a) + (l * l) / (c * c))
        .when(sys == "orthorhombic", (h * h) / (a * a) + (k * k) / (b * b) + (l * l) / (c * c))
        .when(sys == "hexagonal", 4 * (h * h + h * k + k * k) / (3 * a * a) + (l * l) / (c * c))
        .when(
            sys == "monoclinic",
            (h * h) / (a * a * sin2b) + (k * k) / (b * b) + (l * l) / (c * c * sin2b)
            - (2 * h * l * cosb) / (a * c * sin2b),
        )
    )
    if triclinic:
        inv = inv.when(sys == "triclinic", _triclinic(h, k, l, a, b, c, alpha, beta, gamma))
    return F.when(inv > 0, 1 / F.sqrt(inv))


def _triclinic(h, k, l, a, b, c, alpha, beta, gamma) -> Column:  # noqa: E741
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    sa, sb, sg = (F.sin(F.radians(x)) for x in (alpha, beta, gamma))
    volume = a * b * c * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
    ra, rb, rc = b * c * sa / volume, a * c * sb / volume, a * b * sg / volume
    x, y, z = h * ra, k * rb, l * rc
    return (
        x * x + y * y + z * z
        + 2 * x * y * (ca * cb - cg) / (sa * sb)
        + 2 * x * z * (ca * cg - cb) / (sa * sg)
        + 2 * y * z * (cb * cg - ca) / (sb * sg)
    )


def hcp_factor(h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    """Squared structure factor of the close-packed basis, 0..100."""
    phase = 2 * math.pi * (h + 2 * k) / 3 + math.pi * l
    return F.greatest(F.lit(0.0), 50 * (1 + F.cos(phase)))


def relative_intensity(h: Column, k: Column, l: Column, centering: Column) -> Column:  # noqa: E741
    c = F.upper(F.coalesce(centering, F.lit("P")))
    return (
        F.when(c == "F", 16.0).when(c == "I", 4.0).when(c == "HCP", hcp_factor(h, k, l))
        .when(c == "R", 9.0)
        .otherwise(F.greatest(F.lit(5.0), 100 / (1 + 0.3 * (h * h + k * k + l * l))))
    )


def cubic_multiplicity(h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    """Equivalent planes as the analysis counts them (all-distinct indices give 24)."""
    s = F.array_sort(F.array(F.abs(h), F.abs(k), F.abs(l)))
    x, y, z = F.get(s, 0), F.get(s, 1), F.get(s, 2)
    return (
        F.when(z == 0, 0).when(y == 0, 6).when((x == 0) & (y == z), 12).when(x == 0, 24)
        .when((x == y) & (y == z), 8).otherwise(24)
    )


def family(h: Column, k: Column, l: Column, system: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Representative indices of the equivalent planes (cubic, tetragonal); else as given."""
    ah, ak, al = F.abs(h), F.abs(k), F.abs(l)
    sys = F.lower(F.coalesce(system, F.lit("cubic")))
    desc = F.sort_array(F.array(ah, ak, al), asc=False)
    pick = lambda i, tet, raw: (
        F.when(sys == "cubic", F.get(desc, i)).when(sys == "tetragonal", tet).otherwise(raw)
    )
    return pick(0, F.greatest(ah, ak), h), pick(1, F.least(ah, ak), k), pick(2, al, l)


def family_label(h: Column, k: Column, l: Column, system: Column) -> Column:  # noqa: E741
    a, b, c = family(h, k, l, system)
    body = F.concat(a.cast("string"), b.cast("string"), c.cast("string"))
    braces = F.lower(F.coalesce(system, F.lit("cubic"))).isin("cubic", "tetragonal")
    return F.when(braces, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(
        F.concat(F.lit("("), body, F.lit(")"))
    )


def implied_edge(d: Column, h: Column, k: Column, l: Column, system: Column, c: Column):  # noqa: E741
    """Cell edge a that puts a reflection at spacing d, and why there is none."""
    sys = F.lower(F.coalesce(system, F.lit("cubic")))
    fh, fk, fl = family(h, k, l, system)
    good = (d > 0) & h.isNotNull() & k.isNotNull() & l.isNotNull()
    has_c = F.coalesce(c > 0, F.lit(False))
    n3, n2 = fh * fh + fk * fk + fl * fl, fh * fh + fk * fk
    rest = 1 / (d * d) - (l * l) / (c * c)
    hexn = h * h + h * k + k * k
    flat = (fl == 0) & (n2 > 0)
    edge = (
        F.when((sys == "cubic") & (n3 > 0), d * F.sqrt(n3))
        .when((sys == "tetragonal") & flat, d * F.sqrt(n2))
        .when((sys == "tetragonal") & has_c & (rest > 0) & (n2 > 0), F.sqrt(n2 / rest))
        .when((sys == "hexagonal") & has_c & (rest > 0) & (hexn > 0), F.sqrt(4 * hexn / (3 * rest)))
    )
    why = (
        F.when(edge.isNotNull(), "solved")
        .when(sys.isin("tetragonal", "hexagonal") & has_c, "inconsistent")
        .when(sys.isin("tetragonal", "hexagonal"), "needs c")
        .when(sys == "cubic", "undefined")
        .otherwise("unsupported")
    )
    return F.when(good, edge), F.when(good, why)


def metric(system: Column, a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column,
           triclinic: bool = False) -> dict[str, Column]:
    """Coefficients of 1/d^2 as a quadratic form in h, k, l - once per cell, for any system."""
    sys = F.lower(system)
    zero = F.lit(0.0)
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    sa, sb, sg = (F.sin(F.radians(x)) for x in (alpha, beta, gamma))
    a2, b2, c2 = a * a, b * b, c * c
    hexa = 4 / (3 * a2)
    det = 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg
    square = F.when(sys.isin("cubic", "tetragonal"), 1 / a2)
    out = {
        "m11": square.when(sys == "orthorhombic", 1 / a2).when(sys == "hexagonal", hexa)
        .when(sys == "monoclinic", 1 / (a2 * sb * sb)),
        "m22": square.when(sys.isin("orthorhombic", "monoclinic"), 1 / b2).when(sys == "hexagonal", hexa),
        "m33": F.when(sys == "cubic", 1 / a2).when(sys == "monoclinic", 1 / (c2 * sb * sb)).when(
            sys.isin("tetragonal", "orthorhombic", "hexagonal"), 1 / c2),
        "m12": F.when(sys == "hexagonal", hexa).when(sys != "triclinic", zero),
        "m13": F.when(sys == "monoclinic", -2 * cb / (a * c * sb * sb)).when(sys != "triclinic", zero),
        "m23": F.when(sys != "triclinic", zero),
    }
    if triclinic:
        full = {
            "m11": sa * sa / (a2 * det), "m22": sb * sb / (b2 * det), "m33": sg * sg / (c2 * det),
            "m12": 2 * (ca * cb - cg) / (a * b * det), "m13": 2 * (ca * cg - cb) / (a * c * det),
            "m23": 2 * (cb * cg - ca) / (b * c * det),
        }
        out = {k: v.when(sys == "triclinic", full[k]) for k, v in out.items()}
    return out


def _form(h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    return (
        F.col("m11") * h * h + F.col("m22") * k * k + F.col("m33") * l * l
        + F.col("m12") * h * k + F.col("m13") * h * l + F.col("m23") * k * l
    )


def may_diffract(h: Column, k: Column, l: Column, wavelength: float = CU_K_ALPHA) -> Column:  # noqa: E741
    """Cheap test before angles are worked out; lets a little too much through, nothing too little."""
    return _form(h, k, l) <= 4 / wavelength**2 * (1 + 1e-6)


def d_from_metric(h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    inv = _form(h, k, l)
    return F.when(inv > 0, 1 / F.sqrt(inv))
