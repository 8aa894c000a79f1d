"""Bounded least-squares fits of peak profiles, one pattern per group.

A fit needs all samples of its curve at once; exported curves have a capped number of
samples (RESAMPLE_CAP), which bounds the arrays. Python only solves the small system.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.profiles import FWHM_TO_SIGMA
from latticework.operators.peaks import start_values

CENTRE_REACH, WIDTH_MIN, WIDTH_MAX = 5.0, 0.1, 10.0


def _shape(x, c, h, w, kind):
    z = (x[:, None] - c) / (w * FWHM_TO_SIGMA)
    g = np.exp(-0.5 * z * z)
    q = (w / 2) ** 2
    lor = q / ((x[:, None] - c) ** 2 + q)
    unit = {"gaussian": g, "lorentzian": lor, "voigt": 0.5 * (g + lor)}[kind]
    return h * unit


def _model(p, x, n, kind):
    c, h, w = p[2::3][:n], p[3::3][:n], p[4::3][:n]
    return p[0] * x + p[1] + _shape(x, c, h, w, kind).sum(axis=1)


def _solve(x, y, p, lo, hi, n, kind, rounds=1000, stop=1e-6):
    """Damped Gauss-Newton steps, clipped to the bounds after every step."""
    damp = 1e-2
    res = y - _model(p, x, n, kind)
    cost = float(res @ res)
    for i in range(rounds):
        step = np.maximum(np.abs(p), 1e-3) * 1e-6
        jac = np.stack([(_model(p + step[k] * (np.arange(len(p)) == k), x, n, kind) - (y - res)) / step[k] for k in range(len(p))], axis=1)
        a, g = jac.T @ jac, jac.T @ res
        new = np.clip(p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0], lo, hi)
        nres = y - _model(new, x, n, kind)
        ncost = float(nres @ nres)
        if ncost < cost:
            done = cost - ncost <= stop * max(cost, 1e-30)
            p, res, cost, damp = new, nres, ncost, max(damp / 10, 1e-12)
            if done:
                return p, cost, i + 1
        else:
            damp *= 10
            if damp > 1e12:
                return p, cost, i + 1
    return p, cost, rounds


def fit_peaks(points: DataFrame, peaks: DataFrame, kind: str = "gaussian", key: str = "pattern_id") -> DataFrame:
    """Fitted centre, height and width of every peak, with the shared background line."""
    start = start_values(points, peaks, [key])
    packed = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "two_theta", "intensity"))).alias("s"))
    guess = start.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "idx", "centre0", "height0", "width0", "bg_slope", "bg_level"))).alias("g"))
    rows = packed.join(guess, key).select(
        key, F.transform("s", lambda t: t["two_theta"]).alias("x"), F.transform("s", lambda t: t["intensity"]).alias("y"),
        F.transform("g", lambda t: t["idx"].cast("double")).alias("i"), F.transform("g", lambda t: t["centre0"]).alias("c"),
        F.transform("g", lambda t: t["height0"]).alias("h"), F.transform("g", lambda t: t["width0"]).alias("w"),
        F.array(F.get("g", F.lit(0))["bg_slope"], F.get("g", F.lit(0))["bg_level"]).alias("b"))

    def run(batches):
        for pdf in batches:
            out = []
            for k, x, y, i, c, h, w, b in pdf.itertuples(index=False, name=None):
                x, y, c = np.asarray(x, float), np.asarray(y, float), np.asarray(c, float)
                n = len(c)
                body = np.column_stack([c, h, np.clip(w, WIDTH_MIN, WIDTH_MAX)])
                low = np.column_stack([c - CENTRE_REACH, np.zeros(n), np.full(n, WIDTH_MIN)])
                high = np.column_stack([c + CENTRE_REACH, np.full(n, np.inf), np.full(n, WIDTH_MAX)])
                p = np.concatenate([b, body.ravel()])
                lo = np.concatenate([[-np.inf, -np.inf], low.ravel()])
                hi = np.concatenate([[np.inf, np.inf], high.ravel()])
                p, cost, rounds = _solve(x, y, p, lo, hi, n, kind)
                for j in range(n):
                    out.append((k, int(i[j]), *map(float, p[2 + 3 * j:5 + 3 * j]), float(p[0]), float(p[1]), float(np.sqrt(cost / len(x))), rounds))
            yield pd.DataFrame(out, columns=[key, "idx", "centre", "height", "fwhm", "bg_slope", "bg_level", "rms", "rounds"])

    kind_of = dict(points.dtypes)[key]
    return rows.mapInPandas(run, f"{key} {kind_of}, idx bigint, centre double, height double, fwhm double, bg_slope double, bg_level double, rms double, rounds int")
