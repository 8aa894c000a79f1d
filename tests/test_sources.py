"""Files written from a small curve and read back."""

import json

from pyspark.sql import functions as F

from latticework.plans import source_queries
from latticework.sources import readers as RD
from latticework.sources import sinks


def test_text_and_json_patterns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Operator,Kim\nOperator,Lee\n2Theta,Intensity\n20.5,11\n10.5,7cps\nbad,line\n")
    (tmp_path / "b.xy").write_text("10 1\n20\t2\n30   3.5e1\n")
    (tmp_path / "c.json").write_text(json.dumps({"twoTheta": [1, 2, 3], "y": [5, 6], "label": json.dumps({"xray_info": json.dumps({"primary_wavelength": "0.71"})})}))
    (tmp_path / "d.txt").write_text("nothing here\n")
    pts = RD.read_patterns(spark, str(tmp_path))
    got = {}
    for r in pts.orderBy("file", "idx").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.two_theta, r.intensity))
    assert got == {"a.csv": [(10.5, 7.0), (20.5, 11.0)], "b.xy": [(10.0, 1.0), (20.0, 2.0), (30.0, 35.0)], "c.json": [(1.0, 5.0), (2.0, 6.0), (3.0, 0.0)]}
    parsed = RD.parse_lines(RD.text_lines(spark, str(tmp_path / "a.csv")))
    assert RD.metadata_maps(RD.delimited_metadata(parsed)).first().metadata == {"Operator": "Lee"}
    empty = RD.parse_lines(RD.text_lines(spark, str(tmp_path / "d.txt")))
    assert RD.files_without_points(empty, RD.delimited_points(empty)).count() == 1
    docs = RD.json_documents(spark, str(tmp_path / "c.json"))
    assert RD.json_wavelength(docs).first().wavelength == 0.71


def test_cif_calibration_manifest_and_images(spark, tmp_path):
    (tmp_path / "x.cif").write_text("data_x\n_cell_length_a 4.05(1)\n_cell_length_b 4.05\n_cell_length_c 4.05\n_cell_angle_alpha 90\n_space_group_name_H-M_alt 'F m -3 m'\n")
    cell = RD.cif_cells(spark, str(tmp_path / "x.cif")).first()
    assert (cell.a, cell.alpha, cell.gamma, cell.space_group, cell.system) == (4.05, 90.0, None, "F m -3 m", "cubic")
    good = {k: [[1, 2], [3, 4]] if "points" in k else [1, 2] for k in RD.REQUIRED}
    (tmp_path / "g.json").write_text(json.dumps(good))
    (tmp_path / "h.json").write_text(json.dumps({"plot_box": [0, 0, 1, 1]}))
    ok, bad = RD.calibrations(spark, str(tmp_path / "*.json"))
    assert ok.count() == 1 and len(bad.first().missing) == 5
    (tmp_path / "m.csv").write_text("sample_id,gt_path\ns1,a\ns2,b\ns3,c\n")
    have = spark.createDataFrame([("s1",), ("s3",)], "sample_id string")
    assert RD.manifest(spark, str(tmp_path / "m.csv"), have, have).count() == 2
    assert RD.manifest(spark, str(tmp_path / "m.csv"), have, have, max_samples=2).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", float("nan"), [1.0, float("inf")])], "sample_id string, v double, a array<double>")
    sinks.write_results(df, str(tmp_path / "r"))
    back = spark.read.text(str(tmp_path / "r")).first().value
    assert json.loads(back) == {"sample_id": "s1", "a": [1.0, None]}
    for _ in range(2):
        sinks.append_risk_rows(df.select("sample_id"), str(tmp_path / "risk"))
    assert spark.read.option("header", True).csv(str(tmp_path / "risk")).count() == 2


def test_sample_pattern_and_formats(spark):
    rows = RD.sample_pattern(spark)
    assert rows.count() == 4001 and rows.agg(F.max_by("two_theta", "intensity")).first()[0] == 31.76
    got = spark.createDataFrame([("/a/B.JSON",), ("x.Cif",), ("y.xyz",)], "p string").select(RD.format_of(F.col("p")).alias("f")).collect()
    assert [g.f for g in got] == ["json", "cif", "delimited"]


def test_structure_files_hold_several_blocks(spark, tmp_path):
    (tmp_path / "many.cif").write_text("# list\ndata_p1\n_cell_length_a 4.05(1)\n_space_group_name_H-M_alt 'P 1'\ndata_p2\n  _cell_length_c 3.5\n_cell_angle_gamma ?\n")
    (tmp_path / "plain.cif").write_text("_cell_length_a 2.5\n")
    got = {r.block: (r.a, r.c, r.gamma, r.space_group) for r in RD.cif_cells(spark, str(tmp_path)).collect()}
    assert got == {"p1": (4.05, None, None, "P 1"), "p2": (None, 3.5, None, None), None: (2.5, None, None, None)}
    assert source_queries.STRUCTURES_A_FILE > 1
