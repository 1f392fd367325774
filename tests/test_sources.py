import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from sitewise.evaluate import reports
from sitewise.operators.geocode import clean_postcodes
from sitewise.operators.polygon import area
from sitewise.sources import shapes, sinks, tables


def shapefile(base, kind, shapes_, names, field=b"NAME"):
    """A small shapefile: parts of points per record and one text attribute."""
    body, index = b"", b""
    for i, parts in enumerate(shapes_):
        flat = [p for part in parts for p in part]
        starts, at = [], 0
        for part in parts:
            starts.append(at)
            at += len(part)
        box = (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat))
        record = struct.pack("<i4d2i", kind, *box, len(parts), len(flat)) + struct.pack(f"<{len(parts)}i", *starts)
        record += struct.pack(f"<{2 * len(flat)}d", *[c for p in flat for c in p])
        index += struct.pack(">2i", (100 + len(body)) // 2, len(record) // 2)
        body += struct.pack(">2i", i + 1, len(record) // 2) + record
    files = {".shp": b"\0" * 100 + body, ".shx": b"\0" * 100 + index}
    field_row = field.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([30]) + b"\0" * 15
    rows = b"".join(b" " + n.encode("latin-1").ljust(30) for n in names)
    files[".dbf"] = b"\x03\0\0\0" + struct.pack("<I2H", len(names), 65, 31) + b"\0" * 20 + field_row + b"\r" + rows
    for ending, data in files.items():
        with open(str(base) + ending, "wb") as out:
            out.write(data)


def box(x, y, s, hole=False):
    ring = [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    return ring[::-1] if hole else ring


def test_shapefile_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapes, "RECORDS_PER_SPLIT", 2)
    shapes.register(spark)
    shapefile(tmp_path / "District_Borough_Unitary_Region", 5, [[box(0, 0, 4), box(1, 1, 2, True)], [box(9, 9, 1)], [box(0, 0, 1), box(5, 5, 1)]],
              ["Ämt", "B District", "C"])
    shapefile(tmp_path / "county_region", 5, [[box(0, 0, 2)]], ["B District"])
    df = shapes.read_admin_polygons(spark, str(tmp_path))
    got = {(r.layer_rank, r.name): (r.a, r.n) for r in df.withColumns({"a": area(F.col("geom")), "n": F.size("geom")}).collect()}
    assert got == {(0, "Ämt"): (12.0, 1), (0, "B District"): (1.0, 1), (0, "C"): (2.0, 2), (1, "B District"): (4.0, 1)}
    assert len(shapes.ShapefileReader(str(tmp_path / "District_Borough_Unitary_Region.shp")).partitions()) == 2


def test_road_archives_and_index(spark, tmp_path):
    shapefile(tmp_path / "TL_Road", 3, [[[(0.04, 0), (10, 5)]], [[(1, 1), (2, 2)]]], ["Manor Road", ""], b"DISTNAME")
    with zipfile.ZipFile(tmp_path / "opmplc_essh_tl.zip", "w") as archive:
        for ending in (".shp", ".shx", ".dbf"):
            archive.write(f"{tmp_path}/TL_Road{ending}", f"data/TL_Road{ending}")
    zipfile.ZipFile(tmp_path / "opmplc_essh_sea.zip", "w").close()
    out = str(tmp_path / "index")
    sinks.build_road_index(spark, shapes.read_road_archives(spark, f"{tmp_path}/*.zip"), out)
    row = spark.read.parquet(out).collect()
    assert len(row) == 1 and (row[0].name_lc, row[0].tile, row[0].letter, row[0].maxx) == ("manor road", "TL", "m", 10.0)
    assert row[0].points[0].x == 0.0
    with pytest.raises(RuntimeError):
        sinks.build_road_index(spark, shapes.read_road_archives(spark, f"{tmp_path}/*sea.zip"), out)
    assert spark.read.parquet(out).count() == 1


def test_geopackage_layer_with_box(spark, tmp_path):
    path = str(tmp_path / "z.gpkg")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads_local', 'geom')")
    con.execute("CREATE TABLE roads_local (fid INTEGER PRIMARY KEY, name TEXT, type TEXT, geom BLOB)")
    con.execute("CREATE TABLE rtree_roads_local_geom (id INTEGER, minx REAL, maxx REAL, miny REAL, maxy REAL)")
    for k in range(10):
        wkb = b"\x01" + struct.pack("<2I4d", 2, 2, k * 10.0, 0.0, k * 10.0 + 5, 5.0)
        con.execute("INSERT INTO roads_local VALUES (?, ?, 'Alley', ?)", (k + 1, f"r{k}", b"GP\0\x01" + b"\0" * 4 + wkb))
        con.execute("INSERT INTO rtree_roads_local_geom VALUES (?, ?, ?, 0, 5)", (k + 1, k * 10.0, k * 10.0 + 5))
    con.commit()
    con.close()
    shapes.register(spark)
    assert shapes.read_layer(spark, path, "roads_local").count() == 10
    rows = shapes.read_layer(spark, path, "roads_local", (12.0, 0.0, 31.0, 9.0)).collect()
    assert {r.name for r in rows} == {"r1", "r2", "r3"} and [(p.x, p.y) for p in sorted(rows, key=lambda r: r.fid)[0].geom[0][0]] == [(10, 0), (15, 5)]


def test_postcodes_and_places(spark, tmp_path):
    lines = ['"AL1 1AG",10,514800,207000,"E","","","","E07"', '"AL1 1AH",90,1,1,"E","","","","E07"', '"AL1 1AJ",10,0,0', '"AL1 1AK",10,x,5', '"AL1 1AG",10,514801,207001,"E","","","","E08"']
    (tmp_path / "al.csv").write_text("\n".join(lines))
    rows = clean_postcodes(tables.read_postcodes(spark, f"{tmp_path}/*.csv")).collect()
    assert [(r.postcode, r.easting, r.district_code, r.area) for r in rows] == [("AL1 1AG", 514801, "E08", "al")]
    cells = [""] * 34
    cells[2], cells[7], cells[8], cells[9], cells[21] = " Weybourne ", "Village", "611000", "342000", "North Norfolk"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.csv").write_text(",".join(cells) + "\n")
    place = tables.read_places(spark, f"{tmp_path}/p/*.csv").collect()[0]
    assert (place.name_lc, place.local_type, place.easting, place.district_borough) == ("weybourne", "village", 611000.0, "North Norfolk")


def test_run_truth_and_documents(spark, tmp_path):
    for case, metrics in (("12:1", {"status": "ok", "iou": 0.5, "agent_stats": {"critic": {"iterations": [{"wall_s": 2.5}]}}}), ("b c", {"status": "crashed", "error": "x"})):
        folder = tmp_path / "run" / case.replace(":", "_")
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text(json.dumps(metrics, indent=1))
    run = {r.case_id: r for r in tables.read_run(spark, str(tmp_path / "run")).collect()}
    assert run["12_1"].iou == 0.5 and run["12_1"].agent_stats.critic.iterations[0].wall_s == 2.5
    assert run["b c"].iou is None and run["b c"].error == "x"
    data = tmp_path / "data" / "c1"
    data.mkdir(parents=True)
    for k in range(2):
        feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[k, 0], [k + 1, 0], [k + 1, 1], [k, 1], [k, 0]]]}}
        (data / f"{k}.geojson").write_text(json.dumps(feature))
    for name in ("a_notice.pdf", "z_Plan.pdf"):
        (data / name).write_bytes(b"%PDF")
    truth = tables.read_truth(spark, str(tmp_path / "data")).select(area(F.col("geom")).alias("a")).collect()
    assert [round(r.a, 9) for r in truth] == [2.0]
    assert tables.case_documents(spark, str(tmp_path / "data")).collect()[0].path.endswith("z_Plan.pdf")


def test_maps_csv_and_subsets(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"p1": {"fold": 1, "sem_iou": 0.5}, "p2": {"fold": 2, "sem_iou": 0.7}}))
    assert {r.key: r.value.sem_iou for r in tables.read_json_map(spark, str(tmp_path / "m.json"), tables.PAGE_SCORES).collect()} == {"p1": 0.5, "p2": 0.7}
    (tmp_path / "r.csv").write_text("case,fold,filename,iou,n_polygons,call_seconds,error,notes\na,1,x/p.png,0.2,1,1,,\na,1,p.png,0.4,1,1,,\nb,1,q.png,,1,1,bad,\n")
    scores = tables.page_scores(tables.read_result_csv(spark, str(tmp_path / "r.csv"), tables.SEGMENT_SCHEMA)).collect()
    assert [(r.page_id, r.iou) for r in scores] == [("p", 0.4)]
    (tmp_path / "s.json").write_text(json.dumps({"config": {}, "cases": []}))
    with pytest.raises(Exception, match="no cases"):
        tables.read_subset(spark, str(tmp_path / "s.json")).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "r1", "ok", 0.5), ("b", "r1", "crashed", None)], "case_id string, run string, status string, iou double")
    path = str(tmp_path / "out")
    sinks.write_results(rows, path)
    sinks.write_results(rows.where("status = 'ok'").withColumn("iou", F.lit(0.9)), path)
    assert {(r.case_id, r.iou) for r in spark.read.parquet(path).collect()} == {("a", 0.9), ("b", None)}
    target = str(tmp_path / "t")
    sinks.replace_table(rows, target)
    sinks.replace_table(spark.read.parquet(target).where("case_id = 'a'"), target)
    assert spark.read.parquet(target).count() == 1
    sinks.write_summary(rows, str(tmp_path / "sum"), ["case_id"], "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "sum")).count() == 2


def test_results_keep_other_cases_and_replace_a_retried_one(spark, tmp_path):
    schema, path = "case_id string, run string, status string, iou double", str(tmp_path / "out")
    sinks.write_results(spark.createDataFrame([("a", "007", "crashed", None), ("b", "007", "ok", 0.4), ("c", "007", "ok", 0.5), ("a", "8", "ok", 0.1)], schema), path)
    sinks.write_results(spark.createDataFrame([("a", "007", "ok", 0.9)], schema), path)
    got = spark.read.schema(schema).parquet(path).collect()
    assert sorted((r.run, r.case_id, r.status, r.iou) for r in got) == [
        ("007", "a", "ok", 0.9), ("007", "b", "ok", 0.4), ("007", "c", "ok", 0.5), ("8", "a", "ok", 0.1),
    ]
    sinks.write_results(spark.createDataFrame([("d", "8", "late")], "case_id string, run string, note string"), path)
    got = spark.read.schema(schema + ", note string").parquet(path).where("run = '8'").collect()
    assert sorted((r.case_id, r.status, r.note) for r in got) == [("a", "ok", None), ("d", None, "late")]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_results_without_run_or_case_are_kept_once(spark, tmp_path):
    schema, path = "case_id string, run string, iou double", str(tmp_path / "out")
    sinks.write_results(spark.createDataFrame([("a", None, 0.1), ("b", None, 0.2), (None, None, 0.3), (None, "r", 0.4), ("c", "r", 0.5), ("d", "s", 0.6)], schema), path)
    sinks.write_results(spark.createDataFrame([("a", None, 0.9), (None, None, 0.8), (None, "r", 0.7)], schema), path)
    got = {(str(r.run), str(r.case_id), r.iou) for r in spark.read.schema(schema).parquet(path).collect()}
    want = {("None", "a", 0.9), ("None", "b", 0.2), ("None", "None", 0.8), ("r", "None", 0.7), ("r", "c", 0.5), ("s", "d", 0.6)}
    assert got == want and spark.read.parquet(path).count() == len(want)
    sinks.write_results(spark.createDataFrame([("e", "s", 1.0)], schema), path)
    assert spark.read.parquet(path).count() == len(want) + 1


def test_report_sections_skip_what_is_missing(spark):
    labels = spark.createDataFrame([("a", " White", "Good?", "easy"), ("b", "yellow", "bad", "Hard")], "folder string, colour string, quality string, complexity string")
    scores = spark.createDataFrame([("a", 0.9), ("b", None)], "folder string, iou double")
    out = reports.sections(["attributes", "folds"], {"labels": lambda: labels, "scores": lambda: scores})
    assert out["folds"] is None
    assert {(r.bucket, r.n, r.mean_iou) for r in out["attributes"].where("dimension = 'total'").collect()} == {("all", 2, 0.45)}
    with pytest.raises(ValueError):
        reports.sections(["nope"], {})
