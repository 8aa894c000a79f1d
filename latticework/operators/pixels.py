"""Image corpora as pixel rows (image_id, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.scans import core, halo, ordered
from latticework.operators.stats import attach, percentiles
from latticework.session import settle

K = ["image_id"]


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def sizes(px: DataFrame) -> DataFrame:
    return px.groupBy(*K).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def crop(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside each image's plot box, counted from its corner."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return px.join(boxes, K).where(inside).withColumns({
        "x": (F.col("x") - F.greatest("x0", F.lit(0))).cast("int"), "y": (F.col("y") - F.greatest("y0", F.lit(0))).cast("int")}).drop("x0", "y0", "x1", "y1")


def drop_boxes(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Remove pixels covered by any ignored box (few boxes per image, kept as one array)."""
    packed = boxes.groupBy(*K).agg(F.collect_list(F.struct("bx0", "by0", "bx1", "by1")).alias("_boxes"))
    covered = F.exists("_boxes", lambda b: (F.col("x") >= b["bx0"]) & (F.col("x") < b["bx1"]) & (F.col("y") >= b["by0"]) & (F.col("y") < b["by1"]))
    return px.join(packed, K, "left").where(~F.coalesce(covered, F.lit(False))).drop("_boxes")


def colour_distance(target: tuple[Column, Column, Column]) -> Column:
    parts = [F.col(c) - t for c, t in zip("rgb", target, strict=True)]
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def background(px: DataFrame, patch: int = 20) -> DataFrame:
    """Median colour of the four corner patches per image."""
    dims = sizes(px)
    p = F.greatest(F.lit(1), F.least(F.lit(patch), F.floor(F.col("h") / 8), F.floor(F.col("w") / 8)))
    corner = px.join(dims, K).withColumn("_p", p).where(
        ((F.col("x") < F.col("_p")) | (F.col("x") >= F.col("w") - F.col("_p"))) & ((F.col("y") < F.col("_p")) | (F.col("y") >= F.col("h") - F.col("_p"))))
    out = None
    for c in "rgb":
        part = percentiles(corner, K, c, {f"bg_{c}": 0.5}).withColumn(f"bg_{c}", F.bround(f"bg_{c}"))
        out = part if out is None else out.join(part, K)
    return out


def match_threshold(curve: list[Column], bg: list[Column], fraction: float = 0.6, floor: float = 80.0) -> Column:
    d = [a - b for a, b in zip(curve, bg, strict=True)]
    return F.greatest(F.lit(floor), fraction * F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def curve_colour(px: DataFrame, points: DataFrame, radius: int = 2, search: int = 30, bright: float = 200.0) -> DataFrame:
    """Mean colour around each image's sample point; a bright one moves to the darkest pixel nearby."""
    def patch_mean(centres: DataFrame) -> DataFrame:
        near = px.join(centres, K).where(F.abs(F.col("x") - F.col("cx")).between(0, radius) & F.abs(F.col("y") - F.col("cy")).between(0, radius))
        return near.groupBy(*K).agg(*[F.avg(c).alias(f"m_{c}") for c in "rgb"])

    first = settle(patch_mean(points))
    pale = first.where(luma(F.col("m_r"), F.col("m_g"), F.col("m_b")) > bright).select(*K)
    around = px.join(points.join(pale, K, "left_semi"), K).where(
        (F.abs(F.col("x") - F.col("cx")) <= search) & (F.abs(F.col("y") - F.col("cy")) <= search))
    dark = around.groupBy(*K).agg(F.min_by(F.struct("x", "y"), F.struct(luma(F.col("r"), F.col("g"), F.col("b")), "y", "x")).alias("_d")).select(
        *K, F.col("_d.x").alias("cx"), F.col("_d.y").alias("cy"))
    final = first.join(pale, K, "left_anti").unionByName(patch_mean(dark))
    return final.select(*K, *[F.bround(f"m_{c}").alias(f"curve_{c}") for c in "rgb"])


def suppress_frames(matched: DataFrame, dims: DataFrame, row_share: float = 0.95, col_share: float = 0.80) -> DataFrame:
    """Drop matching pixels in rows and columns that match almost throughout.

    Columns next to such a column go too; columns are judged after the rows are gone.
    """
    rows = matched.groupBy(*K, "y").agg(F.count(F.lit(1)).alias("_n")).join(dims, K).where(F.col("_n") / F.col("w") > row_share).select(*K, "y")
    rest = matched.join(rows, [*K, "y"], "left_anti")
    cols = rest.groupBy(*K, "x").agg(F.count(F.lit(1)).alias("_n")).join(dims, K).where(F.col("_n") / F.col("h") > col_share)
    cols = cols.select(*K, F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)).alias("x")).distinct()
    return rest.join(cols, [*K, "x"], "left_anti")


def topmost(matched: DataFrame, all_px: DataFrame, limit: str = "max_dist") -> DataFrame:
    """First matching row per column, moved to where the colour distance crosses the limit."""
    top = matched.groupBy(*K, "x").agg(F.min("y").alias("top"), F.min_by("dist", "y").alias("d_at"), F.max(limit).alias("_md"))
    above = all_px.select(*K, "x", (F.col("y") + 1).alias("top"), F.col("dist").alias("d_above"))
    out = top.join(above, [*K, "x", "top"], "left")
    span = F.col("d_above") - F.col("d_at")
    cross = (F.col("d_above") > F.col("_md")) & (F.col("_md") > F.col("d_at")) & (span > 1e-6)
    y = F.when(cross, F.col("top") - 1 + (F.col("d_above") - F.col("_md")) / span).otherwise(F.col("top").cast("double"))
    return out.select(*K, "x", y.alias("y"))


def closest_and_centroid(matched: DataFrame, all_px: DataFrame, limit: str = "max_dist") -> DataFrame:
    """Row of the best colour and the weighted mean row, for columns with a match."""
    best = all_px.groupBy(*K, "x").agg(F.min_by("y", F.struct("dist", "y")).cast("double").alias("y_closest"))
    w = F.greatest(F.lit(1.0), F.col(limit) - F.col("dist"))
    mid = matched.groupBy(*K, "x").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("y_centroid"))
    return mid.join(best, [*K, "x"])


def with_lab(px: DataFrame) -> DataFrame:
    """Add CIE Lab (L, A, B) of sRGB pixels (0..255), in three cheap steps."""
    def linear(c: str) -> Column:
        v = F.col(c) / 255.0
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    def curve(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    px = px.withColumns({f"_l{c}": linear(c) for c in "rgb"})
    lr, lg, lb = F.col("_lr"), F.col("_lg"), F.col("_lb")
    # fixed values: sRGB to XYZ matrix (D65) and white point
    px = px.withColumns({
        "_fx": curve((lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047),
        "_fy": curve(lr * 0.2126729 + lg * 0.7151522 + lb * 0.0721750),
        "_fz": curve((lr * 0.0193339 + lg * 0.1191920 + lb * 0.9503041) / 1.08883)})
    x, y, z = F.col("_fx"), F.col("_fy"), F.col("_fz")
    return px.withColumns({"L": 116.0 * y - 16.0, "A": 500.0 * (x - y), "B": 200.0 * (y - z)}).drop(
        "_lr", "_lg", "_lb", "_fx", "_fy", "_fz")


def prototype_distance(px_lab: DataFrame, protos: DataFrame) -> DataFrame:
    """Lab distance of every pixel to the nearest prototype of its image (a handful, as one array)."""
    packed = protos.groupBy(*K).agg(F.collect_list(F.struct("L", "A", "B")).alias("_protos"))
    d = F.array_min(F.transform("_protos", lambda p: F.sqrt(
        (F.col("L") - p["L"]) * (F.col("L") - p["L"]) + (F.col("A") - p["A"]) * (F.col("A") - p["A"]) + (F.col("B") - p["B"]) * (F.col("B") - p["B"]))))
    return px_lab.join(packed, K).withColumn("lab_dist", d).drop("_protos")


def prototypes(px_lab: DataFrame, reference: DataFrame, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Colour prototypes at three columns and the matching threshold they imply.

    ``reference``: image_id and Lab (L0, A0, B0) of the curve. The best row of the columns
    at 20, 50 and 80 % of the width is taken; each prototype is a 5 x 5 mean. The pixels of an
    image meet in one task, in a window that spills; deal them by image before `with_lab` and
    whole numbers are shuffled instead of Lab values.
    """
    here = Window.partitionBy(*K)
    mid = {f"bg{c}": F.percentile(F.when(~F.isnan(c), F.col(c)), F.lit(0.5)).over(here) for c in "LAB"}
    at = F.array_distinct(F.array(*[F.floor(F.col("_w") * s).cast("int") for s in (0.2, 0.5, 0.8)]))
    seen = px_lab.select(*K, "x", "y", *"LAB").withColumns({"_w": F.max("x").over(here) + 1, **mid})
    # one pass over the pixels: width and medians ride along, only the columns around the three are stored
    near = settle(seen.withColumn("cx", F.explode(F.filter(at, lambda c: F.abs(F.col("x") - c) <= radius))).drop("_w"))
    d = F.sqrt(F.pow(F.col("L") - F.col("L0"), F.lit(2.0)) + F.pow(F.col("A") - F.col("A0"), F.lit(2.0)) + F.pow(F.col("B") - F.col("B0"), F.lit(2.0)))
    best = near.where("x = cx").join(reference, K).groupBy(*K, "cx").agg(F.min_by("y", F.struct(d, "y")).alias("cy"))
    cells = near.join(best, [*K, "cx"]).where(F.abs(F.col("y") - F.col("cy")) <= radius)
    found = settle(cells.groupBy(*K, "cx").agg(*[F.avg(c).alias(c) for c in "LAB"], *[F.max(c).alias(c) for c in mid]))
    gap = F.sqrt(sum((F.col(c) - F.col(f"bg{c}")) * (F.col(c) - F.col(f"bg{c}")) for c in "LAB"))
    limit = found.dropna(subset=list(mid)).groupBy(*K).agg(F.least(F.lit(13.4), F.greatest(F.lit(11.6), F.min(gap) * 0.32)).alias("threshold"))
    return found.select(*K, "cx", *"LAB"), limit


def line_ratios(px: DataFrame, axis: str, contrast: float = 30.0) -> DataFrame:
    """Share of non-background pixels in every row (``y``) or column (``x``)."""
    bg = background(px)
    grey = px.join(bg, K).withColumn("_g", luma(F.col("r"), F.col("g"), F.col("b")) - luma(F.col("bg_r"), F.col("bg_g"), F.col("bg_b")))
    return grey.groupBy(*K, axis).agg(F.avg((F.abs("_g") > contrast).cast("double")).alias("ratio"))


def axis_lines(px: DataFrame, share: float = 0.35, contrast: float = 30.0, back: int = 30) -> DataFrame:
    """Inner edges of the four axis lines, searched from the image centre outward.

    The first row or column whose share of non-background pixels reaches the level is
    hit; its inner edge is the next position back toward the centre below the level.
    Nothing found gives the centre and confidence 0.
    """
    out = dims = settle(sizes(px))
    for axis, size, names in (("y", "h", ("x_axis_row", "top_row")), ("x", "w", ("right_col", "y_axis_col"))):
        ratios = settle(line_ratios(px, axis, contrast).join(dims, K).withColumn("_mid", F.floor(F.col(size) / 2)))
        for name, sign in zip(names, (1, -1), strict=True):
            step = (F.col(axis) - F.col("_mid")) * sign
            hit = ratios.where((step >= 0) & (F.col("ratio") >= share)).groupBy(*K).agg(
                F.min_by(F.struct(F.col(axis).alias("p"), "ratio"), step).alias("_h"))
            behind = ratios.join(hit, K).withColumn("_b", (F.col("_h.p") - F.col(axis)) * sign).where(
                (F.col("_b") >= 0) & (F.col("_b") < back) & (F.col("ratio") < share))
            inner = behind.groupBy(*K).agg(F.min_by(axis, "_b").alias("_i"))
            found = hit.join(inner, K, "left").select(
                *K, F.coalesce("_i", F.col("_h.p") - sign).alias(name), F.least(F.col("_h.ratio"), F.lit(1.0)).alias(f"{name}_conf"))
            out = out.join(found, K, "left").withColumns({
                name: F.coalesce(name, F.floor(F.col(size) / 2)).cast("int"), f"{name}_conf": F.coalesce(f"{name}_conf", F.lit(0.0))})
    return out.drop("w", "h")


def dominant_colour(px: DataFrame, quant: int = 32) -> DataFrame:
    """Most frequent colour bin after removing background and the darkest quarter, and a pixel of it."""
    top = px.groupBy(*K).agg(F.greatest(F.lit(200), F.floor(F.max(F.greatest("r", "g", "b")) * 0.92)).alias("_bg"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    ink = px.join(top, K).where(~((F.col("r") >= F.col("_bg")) & (F.col("g") >= F.col("_bg")) & (F.col("b") >= F.col("_bg")))).withColumn(
        "_l", luma(F.col("r"), F.col("g"), F.col("b")))
    dark = percentiles(ink, K, "_l", {"_q": 0.25})
    ink = attach(ink, dark, K).where(F.col("_l") > F.col("_q"))
    q = [F.floor(F.col(c) / quant).cast("int").alias(f"q{c}") for c in "rgb"]
    ink = ink.select("*", *q)
    count = ink.groupBy(*K, "qr", "qg", "qb").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(
            (F.pow(F.col("y") - F.col("h") / 2.0, F.lit(2.0)) + F.pow(F.col("x") - F.col("w") / 2.0, F.lit(2.0))).alias("d"), "y", "x")).alias("_near"))
    best = count.groupBy(*K).agg(F.max_by(F.struct("qr", "qg", "qb", "_near"), F.struct("_n", -F.col("qr"), -F.col("qg"), -F.col("qb"))).alias("_b"))
    half = quant // 2
    return best.select(*K, *[(F.col(f"_b.q{c}") * quant + half).alias(f"curve_{c}") for c in "rgb"],
                       F.col("_b._near.x").alias("sample_x"), F.col("_b._near.y").alias("sample_y"))


def ridge_response(px: DataFrame) -> DataFrame:
    """Vertical change of grey relative to the 95th percentile of its column, 0..1."""
    grey = px.select(*K, "x", "y", ((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("_g"))
    w = ordered([*K, "x"], "y")
    p, n = F.lag("_g").over(w), F.lead("_g").over(w)
    slope = F.when(p.isNull(), n - F.col("_g")).when(n.isNull(), F.col("_g") - p).otherwise((n - p) / 2)
    grad = core(halo(grey, "y", 1).withColumn("_d", F.abs(slope)))
    q = percentiles(grad, [*K, "x"], "_d", {"_p95": 0.95})
    return attach(grad, q, [*K, "x"]).select(*K, "x", "y", F.least(F.greatest(F.col("_d") / (F.col("_p95") + 1e-6), F.lit(0.0)), F.lit(1.0)).alias("ridge"))


def strip_border(px: DataFrame, margin: int = 3) -> DataFrame:
    d = px.join(sizes(px), K)
    ok = (F.col("x") >= margin) & (F.col("y") >= margin) & (F.col("x") < F.col("w") - margin) & (F.col("y") < F.col("h") - margin)
    return d.where(ok).drop("w", "h")
