"""Readers for pattern files, calibration records, manifests and images.

Every reader works on whole folders and returns long tables keyed by file or sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"
DEFAULT_WAVELENGTH = 1.5406

# fixed values: file extensions with their own reader; all others are delimited text
FORMATS = {"json": "json", "cif": "cif"}


def format_of(path: Column) -> Column:
    """Reader name for a path, by its lower-cased extension."""
    ext = F.lower(F.substring_index(path, ".", -1))
    out = F.lit("delimited")
    for name, reader in FORMATS.items():
        out = F.when(ext == name, reader).otherwise(out)
    return out


def number_prefix(text: Column) -> Column:
    """The leading number of a text, NULL when it does not start with one."""
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines with their file and the byte order of the line inside the file.

    Line order inside a file comes from reading each file as one value; pattern files
    are small, the corpus is many of them.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    bom = F.lit("﻿")
    line = F.trim(F.col("line"))
    line = F.when(F.startswith(line, bom), F.substring(line, 2, 1 << 30)).otherwise(line)
    return lines.withColumn("line", line).where("line <> ''")


def parse_lines(lines: DataFrame) -> DataFrame:
    """First two fields of every line: tab, else comma, else white space separated."""
    line = F.col("line")
    fields = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).when(F.contains(line, F.lit(",")), F.split(line, ",")).otherwise(
        F.filter(F.split(line, r"\s+"), lambda p: p != ""))
    out = lines.withColumn("_f", fields).where(F.size("_f") >= 2)
    out = out.withColumns({"first": F.trim(F.get("_f", F.lit(0))), "second": F.trim(F.get("_f", F.lit(1)))}).drop("_f")
    return out.withColumns({"angle": number_prefix(F.col("first")), "value": number_prefix(F.col("second"))})


def delimited_points(parsed: DataFrame) -> DataFrame:
    """Samples per file in angle order."""
    pts = parsed.where("angle IS NOT NULL AND value IS NOT NULL")
    order = Window.partitionBy("file").orderBy("angle", "line_no")
    return pts.select("file", (F.row_number().over(order) - 1).alias("idx"), F.col("angle").alias("two_theta"), F.col("value").alias("intensity"))


def delimited_metadata(parsed: DataFrame) -> DataFrame:
    """Key/value pairs from the lines before the first sample; the last value of a key counts.

    The first line that names an angle is the header: it and what follows it are no metadata.
    """
    number = F.col("angle").isNotNull() & F.col("value").isNotNull()
    head = F.lower("first").contains("theta") | F.lower("first").contains("angle")
    marks = parsed.groupBy("file").agg(
        F.min(F.when(number, F.col("line_no"))).alias("_data"), F.min(F.when(~number & head, F.col("line_no"))).alias("_head"))
    pairs = parsed.join(marks, "file").where(
        ~number & (F.col("_data").isNull() | (F.col("line_no") < F.col("_data"))) & (F.col("_head").isNull() | (F.col("line_no") < F.col("_head")))
        & (F.col("first") != "") & (F.col("second") != ""))
    return pairs.groupBy("file", F.col("first").alias("key")).agg(F.max_by("second", "line_no").alias("value"))


def metadata_maps(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def files_without_points(parsed: DataFrame, points: DataFrame) -> DataFrame:
    return parsed.select("file").distinct().join(points.select("file").distinct(), "file", "left_anti")


JSON_PATTERN = T.StructType([
    T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("two_theta_values", "twoTheta", "x", "intensities", "intensity", "y")
] + [T.StructField("label", T.StringType()), T.StructField("metadata", T.StringType())])


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(JSON_PATTERN).option("multiLine", True).json(path)
    return doc.select(
        F.col("_metadata.file_path").alias("file"), F.coalesce("two_theta_values", "twoTheta", "x").alias("_x"),
        F.coalesce("intensities", "intensity", "y").alias("_y"), "label")


def json_points(docs: DataFrame) -> DataFrame:
    pts = docs.where("_x IS NOT NULL AND _y IS NOT NULL").select("file", "_y", F.posexplode("_x").alias("idx", "two_theta"))
    return pts.select("file", "idx", "two_theta", F.coalesce(F.get("_y", F.col("idx")), F.lit(0.0)).alias("intensity"))


def json_wavelength(docs: DataFrame) -> DataFrame:
    """Wavelength from the JSON text nested in the label; the default otherwise."""
    info = F.get_json_object("label", "$.xray_info")
    value = number_prefix(F.get_json_object(info, "$.primary_wavelength"))
    return docs.select("file", F.coalesce(value, F.lit(DEFAULT_WAVELENGTH)).alias("wavelength"))


def cif_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell parameters and space group per structure: a file holds one, or several as data blocks."""
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    blocks = F.split("value", r"(?m)^(?=data_\S+\s*?$)")
    # what stands before the first block belongs to none
    blocks = F.when(F.size(blocks) > 1, F.filter(blocks, lambda b: b.startswith("data_"))).otherwise(blocks)
    doc = doc.select("file", F.explode(blocks).alias("value"))
    block = F.nullif(F.regexp_extract("value", r"^data_(\S+)", 1), F.lit(""))
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^\s*{name}\s+(.+?)\s*$", 1)), F.lit(""))
    num = lambda name: F.nullif(number_prefix(tag(name)), F.lit(0.0))
    text = lambda name: F.regexp_replace(tag(name), r"^['\"]|['\"]$", "")
    return doc.select(
        "file", *[num(f"_cell_length_{n}").alias(n) for n in "abc"], *[num(f"_cell_angle_{n}").alias(n) for n in ("alpha", "beta", "gamma")],
        F.coalesce(text("_cell_space_group_name_H-M_alt"), F.lit("cubic")).alias("system"), text("_space_group_name_H-M_alt").alias("space_group"), block.alias("block"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Samples of every supported file under a folder, each with the reader of its extension.

    The condition on the file's name is one on file metadata, so files of other formats are not opened.
    """
    of = lambda name: format_of(F.col("file")) == name
    text = delimited_points(parse_lines(text_lines(spark, path).where(of("delimited"))))
    docs = json_points(json_documents(spark, path).where(of("json")))
    cols = ["file", "idx", "two_theta", "intensity"]
    both = text.select(*cols, F.lit("delimited").alias("format")).unionByName(docs.select(*cols, F.lit("json").alias("format")))
    return both.withColumn("file", F.regexp_replace("file", "^file:/+", "/"))


def with_defaults(meta: DataFrame) -> DataFrame:
    """Envelope defaults: copper wavelength and an empty lattice."""
    out = meta.withColumn("wavelength", F.coalesce("wavelength", F.lit(DEFAULT_WAVELENGTH)))
    return out.withColumn("lattice", F.create_map().cast("map<string,double>"))


POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))
CALIBRATION = T.StructType([
    T.StructField("plot_box", T.ArrayType(T.DoubleType())), T.StructField("x_axis_points", POINTS),
    T.StructField("x_axis_values", T.ArrayType(T.DoubleType())), T.StructField("y_axis_points", POINTS),
    T.StructField("y_axis_values", T.ArrayType(T.DoubleType())), T.StructField("color_sample_point", T.ArrayType(T.DoubleType())),
    T.StructField("legend_ignore_boxes", POINTS), T.StructField("perspective_corners", POINTS),
    T.StructField("color_resample_points", POINTS), T.StructField("export_resample_points", T.IntegerType())])
REQUIRED = [f.name for f in CALIBRATION.fields[:6]]


def calibrations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Calibration records, and the rejected ones with the names of their missing keys."""
    doc = spark.read.schema(CALIBRATION).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), k) for k in REQUIRED]))
    doc = doc.withColumn("missing", missing)
    return doc.where(F.size("missing") == 0).drop("missing"), doc.where(F.size("missing") > 0).select("file", "missing")


def manifest(spark: SparkSession, path: str, have_result: DataFrame, have_debug: DataFrame, max_samples: int = 0) -> DataFrame:
    """Listed samples that have both outputs; ``max_samples`` above 0 takes the first rows by file and place in it."""
    rows = spark.read.schema("sample_id string, gt_path string").option("header", True).csv(path)
    if max_samples > 0:
        # ids ascend within a split; splits of a file are ordered by where they start
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        rows = rows.withColumn("_order", place).orderBy("_order").limit(max_samples).drop("_order")
    return rows.join(have_result.select("sample_id"), "sample_id", "left_semi").join(have_debug.select("sample_id"), "sample_id", "left_semi")


def normalise_truth(gt: DataFrame) -> DataFrame:
    """Fill an empty peak list from the plain list of peak positions."""
    made = F.transform("peak_x_values", lambda x: F.struct(x.cast("double").alias("two_theta")))
    empty = F.col("peaks").isNull() | (F.size("peaks") == 0)
    return gt.withColumn("peaks", F.when(empty & (F.size("peak_x_values") > 0), made).otherwise(F.col("peaks")))


def training_manifest(spark: SparkSession, images: str, truth: DataFrame) -> DataFrame:
    """Rendered variants (styled v1, v3, v5 and clean) of samples with usable truth."""
    files = spark.read.format("binaryFile").load(images).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.select("path", F.regexp_extract(name, r"^(.+?)_(styled_v[135]|clean)\.\w+$", 1).alias("sample_id"),
                         F.regexp_extract(name, r"^(.+?)_(styled_v[135]|clean)\.\w+$", 2).alias("variant")).where("sample_id <> ''")
    return parts.join(truth.where("plot_box IS NOT NULL AND per_column_y_gt IS NOT NULL"), "sample_id")


def rejected_images(spark: SparkSession, path: str) -> DataFrame:
    """Files that the image decoder can't read."""
    img = spark.read.format("image").option("dropInvalid", False).load(path)
    return img.where("image.nChannels IS NULL OR image.nChannels < 1").select(F.col("image.origin").alias("file"))


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images as pixel rows; the decoder delivers blue, green, red (and alpha) bytes.

    Files that can't be decoded are those of ``rejected_images``.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(path).where("image.nChannels > 0").select(
        F.col("image.origin").alias("file"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))

    def explode(batches):
        for pdf in batches:
            for file, w, n, data in pdf.itertuples(index=False, name=None):
                raw = np.frombuffer(data, np.uint8).reshape(-1, n)
                b, g, r = (raw[:, min(k, n - 1) if n < 3 else k].astype("int32") for k in range(3))
                at = np.arange(len(raw), dtype="int32")
                yield pd.DataFrame({"file": file, "x": at % w, "y": at // w, "r": r, "g": g, "b": b})

    return img.mapInPandas(explode, "file string, x int, y int, r int, g int, b int")


def sample_pattern(spark: SparkSession) -> DataFrame:
    """The demonstration pattern: four Gaussians on a sloping, rippled background."""
    t = F.lit(10.0) + F.col("id") * 0.02
    bump = lambda c, a, w: a * F.exp(-((t - c) * (t - c)) / (2 * w * w))
    # fixed values: centres, heights and widths of the demonstration peaks
    y = 120 + 0.35 * t + bump(31.76, 4200, 0.11) + bump(45.52, 2800, 0.13) + bump(56.6, 1900, 0.14) + bump(67.0, 800, 0.16)
    y = y + 8 * F.sin(t * 3.17 + 0.4)
    return spark.range(4001).select(F.col("id").cast("int").alias("idx"), F.round(t, 2).alias("two_theta"), F.greatest(F.lit(0.0), y).alias("intensity"))
