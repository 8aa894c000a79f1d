"""Peak profile and background functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FWHM_TO_SIGMA = 1.0 / (2.0 * math.sqrt(2.0 * math.log(2.0)))


def gaussian(x: Column, centre: Column, height: Column, fwhm: Column) -> Column:
    z = (x - centre) / (fwhm * FWHM_TO_SIGMA)
    return height * F.exp(-0.5 * z * z)


def lorentzian(x: Column, centre: Column, height: Column, fwhm: Column) -> Column:
    g2 = fwhm * fwhm / 4
    return height * g2 / ((x - centre) * (x - centre) + g2)


def pseudo_voigt(x: Column, centre: Column, height: Column, fwhm_g: Column, fwhm_l: Column) -> Column:
    """Equal parts of both shapes."""
    return 0.5 * gaussian(x, centre, height, fwhm_g) + 0.5 * lorentzian(x, centre, height, fwhm_l)


def linear_background(x: Column, slope: Column, level: Column) -> Column:
    return slope * x + level


def polynomial_background(x: Column, coefficients: Column) -> Column:
    """Sum of coefficient i times x to the power i."""
    terms = F.transform(coefficients, lambda c, i: c * F.pow(x, i.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def gaussian_area(height: Column, fwhm: Column) -> Column:
    """Integrated intensity of a Gaussian; NULL without a positive width."""
    return F.when(fwhm > 0, height * fwhm * FWHM_TO_SIGMA * math.sqrt(2 * math.pi))
