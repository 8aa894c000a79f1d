"""Lattice search over the whole trial grid.

A reflection of a trial cell stands at spacing a / s, where s depends on its indices and,
for two-parameter cells, on the axial ratio. Per peak, the distances of the nearest
reflections of all trial cells come from one sorted lookup; their sum bounds the cost of the
one-to-one match from below. Cells are matched by growing bound until the next bound exceeds
the best cost, so the winner is that of matching every cell. It is refined on a fine grid
with its assignments held, then matched again at full tolerance.

The vote (`votes`, `shortlist`, `cell_pairs`) is a bound of its own, by joins alone: every
(peak, reflection) pair names the edges for which the reflection falls on the peak. The
search doesn't use it; the tests hold it against plain loops.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from latticework.functions import bragg as B
from latticework.operators.crystal import (
    HCP_RATIOS, INTENSITY_SHARE, PEAKS_USED, UNMATCHED, size_penalty, strongest,
)
from latticework.session import settle, spread


@dataclass(frozen=True)
class Search:
    """Limits and steps of the search; the defaults are those of the workload.

    `kept` cells per pattern and structure are what `shortlist` lists of a vote; the search has no such limit.
    """

    a_min: float = 2.5
    a_max: float = 16.0
    step: float = 0.04
    tolerance: float = 0.12
    widen: float = 3.0
    hexagonal_a_max: float = 4.5
    hexagonal_c_max: float = 5.5
    tetragonal_a_max: float = 8.0
    kept: int = 16

    @property
    def coarse(self) -> float:
        return self.widen * self.tolerance


# closeness steps of a vote, as shares of the coarse tolerance, widest first
CLOSE = (1.0, 0.6, 0.35, 0.15)
# ln(s) is bucketed for the join of cells with reflections; ln(spacing) for that of peaks
SHELL, SPACING = 0.05, 0.25
CELL = ["structure", "centering", "system", "a", "c"]
# patterns dealt to a task and answered at a time
PATTERNS_A_TASK, PATTERNS_AT_ONCE = 64, 16
# angles whose distances to all trial cells are kept (90 kB each): patterns of one instrument share their angles
ANGLES_KEPT = 256
# bounds and costs add the same numbers in other orders
SLACK = 1e-9


def axial_ratios() -> tuple[list[float], list[float]]:
    """Ratios c / a tried for hexagonal and tetragonal cells."""
    hexagonal = sorted({*HCP_RATIOS, *[round(1.45 + 0.025 * i, 3) for i in range(21)]})
    return hexagonal, [round(0.4 + 0.1 * i, 2) for i in range(32)]


def shells(spark: SparkSession, search: Search) -> DataFrame:
    """Reflections of every structure and axial ratio by s = edge / spacing; bounded by the trial grid."""
    hexagonal, tetragonal = axial_ratios()
    kinds = [("fcc", "F", "cubic", [1.0]), ("bcc", "I", "cubic", [1.0]), ("sc", "P", "cubic", [1.0]), ("hcp", "HCP", "hexagonal", hexagonal),
             ("tetragonal-P", "P", "tetragonal", tetragonal), ("tetragonal-I", "I", "tetragonal", tetragonal)]
    rows = [(i, *kind) for i, kind in enumerate((n, c, s, q) for n, c, s, ratios in kinds for q in ratios)]
    top = F.when(F.col("system") == "hexagonal", 12).otherwise(14)
    at = lambda last: F.explode(F.sequence(F.lit(0), last))
    g = spark.createDataFrame(rows, "cell_no int, structure string, centering string, system string, q double").withColumn("h", at(top))
    g = g.withColumn("k", at(F.when(F.col("system") == "hexagonal", 12).otherwise(F.col("h"))))
    g = g.withColumn("l", at(F.when(F.col("system") == "cubic", F.col("k")).otherwise(20)))
    h, k, l, q = F.col("h"), F.col("k"), F.col("l"), F.col("q")  # noqa: E741
    s2 = F.when(F.col("system") == "hexagonal", 4 * (h * h + h * k + k * k) / 3 + l * l / (q * q)).otherwise(h * h + k * k + l * l / (q * q))
    a_max = F.when(F.col("system") == "hexagonal", F.least(F.lit(search.hexagonal_a_max), search.hexagonal_c_max / q))
    a_max = a_max.when(F.col("system") == "tetragonal", search.tetragonal_a_max).otherwise(search.a_max)
    a_max = F.least(a_max, F.lit(search.a_max))
    rel = F.when(F.col("system") == "hexagonal", B.hcp_factor(h, k, l)).when(
        F.col("system") == "tetragonal", F.when(F.col("centering") == "I", 100.0).otherwise(25.0)
    ).otherwise(F.when(F.col("centering") == "F", 16.0).when(F.col("centering") == "I", 4.0).otherwise(1.0))
    return g.where(B.allowed(h, k, l, F.col("centering"))).select(
        "cell_no", "structure", "centering", "system", "q", "h", "k", "l", F.sqrt(s2).alias("s"), a_max.alias("a_max"), rel.alias("rel")
    ).where(F.col("s") <= F.col("a_max") * 2 / B.CU_K_ALPHA)


def _angle(a: Column, s: Column) -> Column:
    return B.angle_from_d(a / s)


def votes(peaks: DataFrame, keys: list[str], table: DataFrame, search: Search) -> DataFrame:
    """(keys, structure, centering, system, q, step_no, bits): trial cells with the peaks they may explain.

    Bit 4 p + j of `bits` is set if peak number p has a reflection within CLOSE[j] of the tolerance.
    """
    tol, log = search.coarse, math.log
    spacing = B.d_from_angle(F.col("two_theta"))
    by_spacing = peaks.select(
        *keys, "two_theta", ((F.col("order_no") - 1) * 4).alias("bit"), F.floor(F.log(spacing) / SPACING).alias("bucket"),
        B.d_from_angle(F.col("two_theta") + tol).alias("d_lo"), B.d_from_angle(F.greatest(F.col("two_theta") - tol, F.lit(1e-3))).alias("d_hi"),
    )
    # spacings of all peaks that reach an edge of the grid, a bucket more on both sides for the tolerance
    first = F.floor((F.lit(log(search.a_min)) - F.log("s")) / SPACING) - 2
    last = F.floor((F.log("a_max") - F.log("s")) / SPACING) + 2
    reach = table.groupBy("cell_no", F.round("s", 9).alias("s")).agg(F.max("a_max").alias("a_max"))
    reach = reach.withColumn("bucket", F.explode(F.sequence(first, last)))
    near = by_spacing.join(F.broadcast(reach), "bucket")  # bounded by the trial grid
    number = lambda edge: (edge - search.a_min) / search.step
    low = F.greatest(F.ceil(number(F.col("d_lo") * F.col("s")) - 1e-9), F.lit(0))
    high = F.least(F.floor(number(F.col("d_hi") * F.col("s")) + 1e-9), F.floor(number(F.col("a_max")) + 1e-9))
    each = near.withColumns({"low": low, "high": high}).where("low <= high").withColumn("step_no", F.explode(F.sequence("low", "high")))
    a = F.lit(search.a_min) + F.col("step_no") * search.step
    each = each.withColumn("off", F.abs(_angle(a, F.col("s")) - F.col("two_theta")) / tol)
    code = F.when(F.col("off") <= CLOSE[3], 15).when(F.col("off") <= CLOSE[2], 7).when(F.col("off") <= CLOSE[1], 3).otherwise(1)
    bits = F.call_function("shiftleft", code.cast("long"), F.col("bit").cast("int"))
    # numbers alone are grouped; what they stand for is joined to the result
    gathered = each.where("off <= 1").groupBy(*keys, "cell_no", F.col("step_no").cast("int").alias("step_no")).agg(F.bit_or(bits).alias("bits"))
    named = table.select("cell_no", "structure", "centering", "system", "q").distinct()
    return gathered.join(F.broadcast(named), "cell_no").drop("cell_no")


def cost_bound(bits: Column, n: Column, tolerance: float) -> Column:
    """What a match of `n` peaks costs at least, from the vote."""
    masks = [sum(1 << (4 * p + j) for p in range(PEAKS_USED)) for j in range(4)]
    having = [F.bit_count(bits.bitwiseAND(F.lit(m))) for m in masks]
    # a peak is off by more than the next closer step it lacks
    least = [share * share for share in (*CLOSE[1:], 0.0)]
    closer = [*having[1:], F.lit(0)]
    return tolerance * tolerance * (UNMATCHED * (n - having[0]) + sum((x - y) * v for x, y, v in zip(having, closer, least)))


def shortlist(voted: DataFrame, sizes: DataFrame, keys: list[str], search: Search) -> DataFrame:
    """The `kept` cells per pattern and structure with the lowest bounds."""
    a = F.lit(search.a_min) + F.col("step_no") * search.step
    bound = cost_bound(F.col("bits"), F.col("n"), search.coarse) + _coarse_penalty(F.col("system"), a)
    # the votes stay in the tasks of their peaks: neither sorted nor moved for the sizes
    rows = voted.join(sizes.hint("shuffle_hash"), keys).withColumns({"a": a, "bound": bound})
    rank = F.row_number().over(Window.partitionBy(*keys, "structure").orderBy("bound", "q", "step_no"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= search.kept).select(*keys, *CELL[:3], "q", "a", (F.col("a") * F.col("q")).alias("c"), "bound")


def _coarse_penalty(system: Column, a: Column) -> Column:
    return F.when(system == "cubic", size_penalty(system, a)).otherwise(0.0)


def cell_pairs(peaks: DataFrame, cells: DataFrame, table: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Peaks of each pattern with the reflections of its shortlisted cells within the tolerance."""
    top = peaks.groupBy(*keys).agg(F.greatest(F.max("intensity"), F.lit(1e-12)).alias("_top"))
    lhs = peaks.join(top, keys).select(*keys, "order_no", F.col("two_theta").alias("angle"), (F.col("intensity") / F.col("_top")).alias("share"))
    both = cells.select(*keys, *CELL, "q").join(lhs.hint("shuffle_hash"), keys)
    ln = lambda angle: F.floor(F.log(F.col("a") / B.d_from_angle(angle)) / SHELL)
    shell = F.explode(F.sequence(ln(F.greatest(F.col("angle") - tolerance, F.lit(1e-3))), ln(F.col("angle") + tolerance)))
    rhs = table.select("structure", "q", "h", "k", "l", "s", "rel", F.floor(F.log("s") / SHELL).alias("shell"))
    found = both.withColumn("shell", shell).join(F.broadcast(rhs), ["structure", "q", "shell"])
    found = found.withColumn("two_theta", _angle(F.col("a"), F.col("s"))).withColumn("delta", F.abs(F.col("two_theta") - F.col("angle")))
    # reflections whose angles agree to three decimals are one
    return found.where(F.col("delta") <= tolerance).select(
        *keys, *CELL, "order_no", "angle", "share", F.round(F.col("two_theta") * 1000).cast("int").alias("i"), "delta", "rel", "h", "k", "l", "two_theta"
    )


def _fine_grid(system: str, a: float, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges and axes of the fine grid around a coarse winner, edge by edge."""
    steps = lambda span, step: np.arange(-round(span / step), round(span / step) + 1) * step
    if system == "cubic":
        edge = a + steps(0.08, 0.0005)
        return (edge[(edge >= 2) & (edge <= 24)],) * 2
    if system == "hexagonal":
        edge, ratio = (x.ravel() for x in np.meshgrid(np.round(a + steps(0.06, 0.001), 4), np.round(c / a + steps(0.04, 0.005), 4), indexing="ij"))
        keep = (edge >= 2) & (ratio >= 1.40) & (ratio <= 2.05) & (edge * ratio <= 5.5)
        return edge[keep], (edge * ratio)[keep]
    edge, axis = (x.ravel() for x in np.meshgrid(np.round(a + steps(0.08, 0.002), 4), np.round(c + steps(0.15, 0.005), 4), indexing="ij"))
    keep = (edge >= 2) & (axis >= 1.5)
    return edge[keep], axis[keep]


class Trial:
    """The trial grid in arrays: every cell of every kind, by structure, ratio and edge."""

    FAR = 1000.0  # more than any edge / spacing, so that the kinds' lists lie one after another

    def __init__(self, table: pa.Table, search: Search):
        rows = table.to_pandas().sort_values(["structure", "q", "h", "k", "l"], kind="stable")
        self.search, self.kinds, self.lists, self.indices, self.spans, self.planes, self.ratios = search, [], [], [], {}, {}, {}
        ends, cell_kind, edges, lengths, at = [0], [], [], [], 0
        for no, ((structure, q), g) in enumerate(rows.groupby(["structure", "q"], sort=True)):
            first = g.iloc[0]
            edge = search.a_min + np.arange(int(math.floor((first.a_max - search.a_min) / search.step + 1e-9)) + 1) * search.step
            g = g.assign(first=np.arange(len(g))).sort_values("s", kind="stable")
            self.kinds.append((structure, first.centering, first.system, float(q)))
            self.lists.append(tuple(g[c].to_numpy() for c in ("s", "first", "rel")))
            self.indices.append(g.sort_values("first")[["h", "k", "l"]].to_numpy())
            distinct = np.unique(g["s"].to_numpy())
            lengths.append(distinct + no * self.FAR)
            ends.append(ends[-1] + len(distinct))
            cell_kind.append(np.full(len(edge), no))
            edges.append(edge)
            start = self.spans.get(structure, (at, at))[0]
            at += len(edge)
            self.spans[structure] = (start, at)
            if structure not in self.planes:
                self.planes[structure] = _planes(first.system, first.centering)
                self.ratios[structure] = ratios(self.planes[structure][-1])
        self.kind, self.edge = np.concatenate(cell_kind), np.concatenate(edges)
        self.lengths, self.starts, self.ends = np.concatenate(lengths), np.array(ends[:-1])[self.kind], np.array(ends[1:])[self.kind]
        cubic = np.array([k[2] == "cubic" for k in self.kinds])[self.kind]
        self.penalty = np.where(cubic & (self.edge > 6), 0.5 * (self.edge - 6) ** 2, 0.0)
        self.near = lru_cache(ANGLES_KEPT)(self._near)

    def _near(self, angle: float) -> np.ndarray:
        """Squared distance of every cell's nearest reflection to an angle, infinite beyond the tolerance."""
        s = self.edge * (2 * math.sin(math.radians(angle / 2)) / B.CU_K_ALPHA)
        at = np.searchsorted(self.lengths, s + self.kind * self.FAR)
        off = np.full(len(s), np.inf)
        for place in (at - 1, at):
            here = (place >= self.starts) & (place < self.ends)
            length = self.lengths[np.where(here, place, 0)] - self.kind * self.FAR
            sine = np.where(here, B.CU_K_ALPHA * length / (2 * self.edge), 2.0)
            off = np.minimum(off, np.where(sine < 1, np.abs(2 * np.degrees(np.arcsin(np.minimum(sine, 1.0))) - angle), np.inf))
        return np.where(off <= self.search.coarse + SLACK, off * off, np.inf)

    def windows(self, peaks: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Doubled sines, over the wavelength, of the ends of the peaks' coarse windows."""
        angle, reach = np.array([p[1] for p in peaks]), self.search.coarse + 0.01
        return tuple(2 / B.CU_K_ALPHA * np.sin(np.radians(np.clip(angle + x, 0.0, 180.0) / 2)) for x in (-reach, reach))

    def angles(self, cell: int, windows: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Angles, places in the list and strengths of a cell's reflections in the windows; twice where these overlap."""
        length, first, rel = self.lists[self.kind[cell]]
        edge = self.edge[cell]
        starts, ends = length.searchsorted(edge * windows[0]).tolist(), length.searchsorted(edge * windows[1], "right").tolist()
        at = np.array([i for start, end in zip(starts, ends) for i in range(start, end)], int)
        sine = B.CU_K_ALPHA / (2 * edge) * length[at]
        at, sine = at[sine < 1], sine[sine < 1]
        return 2 * np.degrees(np.arcsin(sine)), first[at], rel[at]


def _planes(system: str, centering: str) -> tuple[np.ndarray, ...]:
    """h, k, l, the part of a plane's inverse square spacing that goes with a, and strength; in list order, of whatever angle."""
    top = 12 if system == "hexagonal" else 14
    h, k, l = (x.ravel() for x in np.meshgrid(np.arange(top + 1), np.arange(top + 1), np.arange(21), indexing="ij"))  # noqa: E741
    keep = h + k + l > 0
    if system != "hexagonal":
        keep &= k <= h
    if system == "cubic":
        keep &= l <= k
    if centering == "I":
        keep &= (h + k + l) % 2 == 0
    if centering == "F":
        keep &= (h % 2 == k % 2) & (k % 2 == l % 2)
    if centering == "HCP":
        keep &= ~(((h - k) % 3 == 0) & (l % 2 == 1))
    h, k, l = h[keep], k[keep], l[keep]  # noqa: E741
    if system == "hexagonal":
        return h, k, l, 4 * (h * h + h * k + k * k) / 3, np.maximum(0.0, 50 * (1 + np.cos(2 * math.pi * (h + 2 * k) / 3 + math.pi * l)))
    rel = {"I": 100.0, "P": 25.0} if system == "tetragonal" else {"F": 16.0, "I": 4.0, "P": 1.0}
    return h, k, l, (h * h + k * k).astype(float), np.full(len(h), rel[centering])


def one_to_one(angles: np.ndarray, first: np.ndarray, rel: np.ndarray, peaks: list[tuple], tolerance: float) -> tuple[float, list[tuple]]:
    """Cost and picks (peak, score, place, delta, angle) of a match: strongest peak first, best free reflection.

    Of reflections whose angles agree to three decimals the first of the list counts. `peaks`
    (order_no, angle, share) come strongest first.
    """
    key = np.round(angles * 1000)
    order = np.lexsort((first, key))
    if len(order):
        order = order[np.concatenate(([True], np.diff(key[order]) != 0))]
    theory, strength, place = angles[order].tolist(), np.maximum(rel[order], 1e-9).tolist(), first[order].tolist()
    tol2, used, picks, cost = tolerance * tolerance, set(), [], 0.0
    for no, angle, share in peaks:
        free = [j for j in range(bisect_left(theory, angle - tolerance - SLACK), bisect_right(theory, angle + tolerance + SLACK))
                if j not in used and abs(theory[j] - angle) <= tolerance]
        if not free:
            cost += UNMATCHED * tol2
            continue
        top = max(strength[j] for j in free)
        score, j = min((abs(theory[j] - angle) ** 2 + (0.0 if share is None else INTENSITY_SHARE * tol2 * (share - strength[j] / top) ** 2), j) for j in free)
        used.add(j)
        cost += score
        picks.append((no, score, place[j], abs(theory[j] - angle), theory[j]))
    return cost, picks


def ratios(rel: np.ndarray) -> list[float]:
    """Shares of the strongest that reflections of these strengths can have beside each other."""
    kinds = [max(x, 1e-9) for x in set(np.round(rel, 6).tolist())]
    return [x / y for x in kinds for y in kinds if x <= y]


def least_strength(share: float | None, shares: list[float]) -> float:
    """What a match adds at least for its strength, in units of the squared tolerance."""
    return 0.0 if share is None or not shares else INTENSITY_SHARE * min((share - x) ** 2 for x in shares)


def cheapest(bound: np.ndarray, some: np.ndarray, nothing: float, match: Callable[[int], float]) -> int | None:
    """First cell of least cost: cells are matched by growing bound until it exceeds the best cost. None: no peak is explained.

    Cells that explain `some` peak are matched, all others cost `nothing`.
    """
    best, cost = None, nothing
    at = np.flatnonzero(some & (bound <= nothing + SLACK))
    if len(at):
        best = int(at[bound[at].argmin()])
        cost = round(match(best), 12)
        at = at[(bound[at] <= cost + SLACK) & (at != best)]
    for cell in at[np.argsort(bound[at], kind="stable")].tolist():
        if bound[cell] > cost + SLACK:
            break
        cost, best = min((cost, best), (round(match(cell), 12), cell))
    return best


def coarse_cell(trial: Trial, structure: str, peaks: list[tuple]) -> int | None:
    """The trial cell of least cost of one structure."""
    lo, hi = trial.spans[structure]
    if lo == hi:
        return None
    tol2 = trial.search.coarse**2
    bound, some = trial.penalty[lo:hi].copy(), np.zeros(hi - lo, bool)
    for _, angle, share in peaks:
        near = trial.near(angle)[lo:hi]
        bound += np.minimum(near + least_strength(share, trial.ratios[structure]) * tol2, UNMATCHED * tol2)
        some |= near < np.inf
    # a penalty may make explaining a peak dearer than explaining none; such cells still compete
    nothing = UNMATCHED * tol2 * len(peaks) + float(trial.penalty[lo:hi].max())
    windows = trial.windows(peaks)
    best = cheapest(bound, some, nothing, lambda i: one_to_one(*trial.angles(lo + i, windows), peaks, trial.search.coarse)[0] + float(trial.penalty[lo + i]))
    return None if best is None else lo + best


def fine_cell(system: str, a: float, c: float, picks: list[dict], tolerance: float) -> tuple[float, float]:
    """The first fine cell of least cost for the assigned reflections; misses cost a fixed amount."""
    edge, axis = _fine_grid(system, a, c)
    if not len(edge):
        return a, c
    h, k, l, angle = (np.array([p[name] for p in picks], float)[:, None] for name in ("h", "k", "l", "angle"))  # noqa: E741
    plane = 4 * (h * h + h * k + k * k) / 3 if system == "hexagonal" else h * h + k * k
    sine = B.CU_K_ALPHA / 2 * np.sqrt(plane / edge**2 + l * l / axis**2)
    off = np.abs(2 * np.degrees(np.arcsin(np.minimum(sine, 1.0))) - angle)
    cost = np.where((off <= tolerance) & (sine < 1), off * off, UNMATCHED * tolerance * tolerance).sum(axis=0)
    best = int(np.argmin(np.round(cost, 12)))
    return float(edge[best]), float(axis[best])


def solve(trial: Trial, peaks: list[tuple]) -> list[dict]:
    """Per structure the refined cell of a pattern and its match; `peaks` (order_no, angle, share), strongest first."""
    out, tolerance = [], trial.search.tolerance
    windows, angles, by_no = trial.windows(peaks), [angle for _, angle, _ in peaks], {no: angle for no, angle, _ in peaks}
    for structure in trial.spans:
        cell = coarse_cell(trial, structure, peaks)
        if cell is None:
            continue
        _, centering, system, q = trial.kinds[trial.kind[cell]]
        a = float(trial.edge[cell])
        held = one_to_one(*trial.angles(cell, windows), peaks, trial.search.coarse)[1]
        index = trial.indices[trial.kind[cell]]
        a, c = fine_cell(system, a, a * q, [{**dict(zip("hkl", index[place].tolist())), "angle": by_no[no]} for no, _, place, _, _ in held], tolerance)
        h, k, l, plane, rel = trial.planes[structure]  # noqa: E741
        sine = B.CU_K_ALPHA / 2 * np.sqrt(plane / a**2 + l * l / c**2)
        at = np.flatnonzero(sine < 1)
        theory = 2 * np.degrees(np.arcsin(sine[at]))
        inside = (theory >= min(angles) - 1.5) & (theory <= max(angles) + 1.5)
        at, theory = at[inside], theory[inside]
        cost, picks = one_to_one(theory, at, rel[at], peaks, tolerance)
        out.append({
            "structure": structure, "centering": centering, "system": system, "a": a, "c": c, "matched": len(picks), "n": len(peaks), "cost": cost,
            "rms_deg": math.sqrt(sum(p[3] ** 2 for p in picks) / len(picks)) if picks else None,
            "picks": [{"score": score, "i": place, "delta": delta, "h": int(h[place]), "k": int(k[place]), "l": int(l[place]), "two_theta": angle,
                       "order_no": no, "angle": by_no[no], "rel": float(rel[place])} for no, score, place, delta, angle in picks] or None})
    return out


GRIDS: dict[Search, Trial] = {}


def grid_of(search: Search, table: Broadcast) -> Trial:
    """The grid of a search, built once per Python worker."""
    if search not in GRIDS:
        GRIDS.clear()
        GRIDS[search] = Trial(table.value, search)
    return GRIDS[search]


PICK = "struct<score:double,i:int,delta:double,h:int,k:int,l:int,two_theta:double,order_no:int,angle:double,rel:double>"
FOUND = f"structure string, centering string, system string, a double, c double, matched int, n int, cost double, rms_deg double, picks array<{PICK}>"


def lattice_candidates(peaks: DataFrame, keys: list[str], search: Search = Search()) -> DataFrame:
    """One row per pattern and structure: cell, matched, n, cost, rms_deg, picks.

    Patterns need two peaks with a positive angle; the fourteen strongest are used. Missing
    intensities count last. Structures of which no cell explains a peak are left out.
    """
    spark = peaks.sparkSession
    used = strongest(peaks, keys).select(*keys, "order_no", "two_theta", "intensity")
    item = F.struct("order_no", F.col("two_theta").cast("double").alias("two_theta"), F.col("intensity").cast("double").alias("intensity"))
    lists = settle(used.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_peaks")).where("size(_peaks) >= 2"))
    # the grid's lists, bounded by the search alone
    table = spark.sparkContext.broadcast(shells(spark, search).toArrow())
    schema = StructType([*lists.select(*keys).schema.fields, *StructType.fromDDL(FOUND).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PATTERNS_AT_ONCE):
                part, places, rows, grid = batch.slice(start, PATTERNS_AT_ONCE), [], [], grid_of(search, table)
                for i, items in enumerate(part.column("_peaks").to_pylist()):
                    top = max(max((p["intensity"] for p in items if p["intensity"] is not None), default=0.0), 1e-12)
                    found = solve(grid, [(p["order_no"], p["two_theta"], None if p["intensity"] is None else p["intensity"] / top) for p in items])
                    rows += found
                    places += [i] * len(found)
                named = pa.RecordBatch.from_pylist(rows, pa.schema(list(arrow)[len(keys):]))
                own = [part.column(name).take(pa.array(places, pa.int32())).cast(arrow.field(name).type) for name in keys]
                yield pa.RecordBatch.from_arrays([*own, *named.columns], schema=arrow)

    # stored, as callers rank and join the rows: a pattern is searched once
    return settle(spread(lists, keys, PATTERNS_A_TASK).mapInArrow(run, schema))
