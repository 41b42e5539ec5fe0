"""Readers and writers on tiny files."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from scorelake.operators import quality, score
from scorelake.sources import readers, writers


@pytest.fixture
def annotation_file(tmp_path):
    doc = {"info": {}, "images": [{"id": 1, "filename": "a.png", "width": 100, "height": 80, "ann_ids": ["7", "8", "9"]}],
           "annotations": {"7": {"a_bbox": [1.0, 2.0, 3.0, 4.0], "o_bbox": [1.0] * 8, "cat_id": ["71"], "area": 4, "img_id": "1", "comments": ""},
                           "8": {"a_bbox": [1.0, 2.0, 1.0, 4.0], "o_bbox": [1.0] * 8, "cat_id": ["71", "150"], "area": 0, "img_id": "2", "comments": ""}},
           "categories": {"71": {"name": "accent", "annotation_set": "dense", "color": 1}}}
    path = tmp_path / "train.json"
    path.write_text(json.dumps(doc, indent=1))
    return str(path)


def test_annotations(spark, annotation_file, tmp_path):
    raw = readers.read_annotation_file(spark, annotation_file, "train")
    images, ann = readers.images_of(raw), readers.annotations_of(raw)
    assert [tuple(r) for r in images.select("image_id", "width").collect()] == [("1", 100)]
    codes = {(r.code, r.context) for r in quality.reference_issues(images, ann).collect()}
    assert codes == {("annotation_image_id_mismatch", "8"), ("missing_annotation_reference", "9")}
    readers.stage_annotations(raw, str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged" / "annotation")).count() == 2
    inventory = {r.field: r.n for r in readers.field_inventory(ann, readers.categories_of(raw)).collect()}
    assert inventory["a_bbox"] == 2 and inventory["annotation_set:dense"] == 1


def test_class_map(spark, tmp_path):
    classes = [{"deepscores_id": 71 + i, "deepscores_name": n, "yolo_id": i, "normalized_semantic_class": n, "side": "above"} for i, n in enumerate("ab")]
    good = {"schema_version": 1, "deepscores_to_yolo": {"71": 0, "72": 1}, "yolo_names": ["a", "b"], "classes": classes}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps({**good, "yolo_names": ["b", "a"], "deepscores_to_yolo": {"71": 1}}))
    assert readers.class_map_issues(spark, str(tmp_path / "good.json")).isEmpty()
    assert {r.code for r in readers.class_map_issues(spark, str(tmp_path / "bad.json")).collect()} == {"class_names_out_of_order", "declared_map_differs"}
    assert [r.class_id for r in readers.read_class_map(spark, str(tmp_path / "good.json")).orderBy("position").collect()] == [0, 1]


def test_labels_strict_and_tolerant(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "t1.txt").write_text("0 0.5 0.5 0.25 0.5\n\n1 0.5 0.5\nx 0.1 0.1 0.1 0.1\n")
    lines = readers.read_label_lines(spark, str(folder), "train")
    found = {(r.line_no, r.tile_name) for r in lines.collect()}
    assert found == {(i, "t1") for i in (1, 2, 3, 4)}
    codes = sorted(r.code for r in quality.label_issues(lines, class_count=2).collect())
    assert codes == ["blank_label_line", "label_field_count", "label_parse_error"]
    box = readers.read_labels(spark, str(folder), "train").filter("class_id = 0").first()
    assert (box.x0, box.y0, box.x1, box.y1) == (384.0, 256.0, 640.0, 768.0)


def test_manifest_and_piece(spark, tmp_path):
    tile = {"source_image": "a.png", "source_image_id": "1", "split": "train", "tile_filename": "a__id1__x0000_y0768.png", "tile_offset": {"x": 0, "y": 768},
            "tile_size": 1024, "source_width": 1960, "source_height": 2800, "valid_source_region_in_tile": {"width": 1024, "height": 1024},
            "padding": {"right": 0, "bottom": 0, "value": 255}, "is_negative": False, "annotation_ids": ["7"], "clipped_annotation_ids": [],
            "unclipped_annotation_ids": ["7"], "annotations": [{"annotation_id": "7", "yolo_cxcywh": [0.1, 0.1, 0.1, 0.1]}]}
    (tmp_path / "m.json").write_text(json.dumps({"split": "train", "tiles": [tile, {**tile, "tile_filename": "b.png", "padding": {"right": 9, "bottom": 0, "value": 255}}]}))
    tiles = readers.read_manifest(spark, str(tmp_path / "m.json"))
    images = spark.createDataFrame([("train", "1", "a.png", 1960, 2800)], "split string, image_id string, filename string, width int, height int")
    labels = spark.createDataFrame([("train", "a__id1__x0000_y0768", 1), ("train", "b", 1)], "split string, tile_name string, n_labels int")
    found = {(r.code, r.context) for r in quality.manifest_issues(tiles, images, labels, tile_size=1024, stride=768).collect()}
    assert found == {("padding_metadata_mismatch", "b")}
    (tmp_path / "op1.json").write_text(json.dumps({"numPage": 3, "tsChange": [{"page": 1, "loc": [0, 2], "time_signature": [3, 4], "mov": 1}], "clef_options": [[1], [-1, -2]]}))
    config = readers.read_piece_config(spark, str(tmp_path / "op1.json"))
    assert config.select("piece", "pages_per_sheet", "rotate", "confidence").first() == ("op1", 1, False, 0.25)
    assert tuple(readers.time_changes(config).select("page", "line", "bar_in_line", "ts_num", "ts_den").first()) == (1, 0, 2, 3, 4)


def test_images_hashes_and_log(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 321, 123) + b"\x08\x02\x00\x00\x00"
    (folder / "a.png").write_bytes(png)
    assert readers.list_images(spark, str(folder)).select("stem", "width", "height").first() == ("a", 321, 123)
    assert readers.hash_inputs(spark, str(folder)).first().sha256 == hashlib.sha256(png).hexdigest()
    log = tmp_path / "results.csv"
    log.write_text("﻿  epoch,  loss , map\n0, 2.5, 0.1\n1, 1.5, 0.3\n")
    df = readers.read_training_log(spark, str(log))
    assert df.columns == ["epoch", "loss", "map"]
    from scorelake.operators.stats import run_summary
    s = run_summary(df.withColumn("run", F.lit("r")), losses=["loss"], metric="map").first()
    assert (s.best_epoch, s.min_loss) == (2.0, 1.5)


def test_writers(spark, tmp_path):
    gt = spark.createDataFrame([(0, 1, 2, 0, 0, 9, 9)], "page_id int, gt_seq int, class_id int, x0 int, y0 int, x1 int, y1 int")
    pred = spark.createDataFrame([(0, 5, 2, 0, 0, 9, 9, 0.5), (0, 6, 2, 50, 0, 59, 9, 0.5)], "page_id int, det_seq int, class_id int, x0 int, y0 int, x1 int, y1 int, confidence double")
    matches = spark.createDataFrame([(0, 1, 5)], "page_id int, gt_seq int, pred_seq int")
    out = str(tmp_path / "d")
    writers.write_detections_jsonl(gt, pred, matches, out)
    row = spark.read.json(out).first()
    assert (row.tp, row.fp, row.fn, len(row.predictions)) == (1, 1, 0, 2)
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_detections_jsonl(gt, pred, matches, out)
    writers.write_page_documents(gt.withColumn("piece", F.lit("p")), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).first().candidate_count == 1
    rows = spark.createDataFrame([("t", 1, "10", .5, .5, .1, .1), ("t", 1, "9", .25, .5, .1, .1)], "tile string, class_id int, ann_id string, cx double, cy double, w double, h double")
    assert writers.label_text(rows, key=["tile"]).first().text.splitlines() == [
        "1 0.25000000 0.50000000 0.10000000 0.10000000", "1 0.50000000 0.50000000 0.10000000 0.10000000"]
    bars = spark.createDataFrame([("p", 1, 4), ("p", 2, 5)], "piece string, page_id int, v int")
    writers.checkpoint_bars(bars, str(tmp_path / "bars"))
    writers.checkpoint_bars(bars.filter("page_id = 2").withColumn("v", F.lit(9)), str(tmp_path / "bars"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "bars")).collect()) == [4, 9]
    report = [r.value for r in writers.metric_report(spark.createDataFrame([("accent", 0.5)], "name string, precision double")).collect()]
    assert report[1] == "| accent | 0.5000 |"


def test_score_text(spark, tmp_path):
    rows = [("p", 0, 0, 1, "note", ["C#5", "E5"], 20160, 60480, 7), ("p", 0, 0, 2, "rest", [], 30240, 60480, None), ("p", 0, 1, 1, "note", ["C5"], 0, 60480, None)]
    elements = spark.createDataFrame(rows, "piece string, part bigint, measure bigint, seq int, kind string, pitches array<string>, ticks bigint, target_ticks bigint, ref_id int")
    marks = spark.createDataFrame([("p", 7, "staccato", "above", None), ("p", 7, "fermata", "below", "inverted")], "piece string, ref_id int, element string, placement string, detail string")
    events = score.score_events(elements, marks)
    measures = score.measures_xml(events)
    text = {r.measure: r.xml for r in measures.collect()}
    assert "<step>C</step><alter>1</alter><octave>5</octave>" in text[0] and "<chord/>" in text[0] and "<dot/>" in text[0]
    assert '<staccato placement="above"/>' in text[0] and '<fermata placement="below">inverted</fermata>' in text[0]
    assert "<rest/><duration>60480</duration>" in text[1]
    lines = [r.value for r in score.musicxml_lines(measures).orderBy("piece", "part", "measure", "slot").collect()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</score-partwise>" and lines[3] == '<part id="P1">'
    import xml.etree.ElementTree as ET
    ET.fromstring("".join(lines))
    score.write_musicxml(score.musicxml_lines(measures), str(tmp_path / "xml"))


def test_image_headers_read_no_image(spark, tmp_path):
    """Sparse files of 64 MB and odd names; only headers are opened, and wrong sizes are raised."""
    folder = tmp_path / "images of a set" / "train"
    folder.mkdir(parents=True)
    for name, (width, height), size in (("a.png", (1024, 1024), 1 << 26), ("b c%.png", (321, 123), 1 << 26), ("d.png", (1024, 1024), 24)):
        with open(folder / name, "wb") as file:
            file.write(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big"))
            file.truncate(size)
    (folder / "e.png").write_bytes(b"no image")
    (folder / "f.png").write_bytes(b"")
    (folder / "g.txt").write_bytes(b"text")
    found = readers.image_headers(spark, str(tmp_path / "images of a set"))
    assert {r["stem"]: (r["length"], r["width"], r["height"]) for r in found.collect()} == {
        "a": (1 << 26, 1024, 1024), "b c%": (1 << 26, 321, 123), "d": (24, 1024, 1024), "e": (8, None, None)}
    assert "struct<path:string,length:bigint>" in found._jdf.queryExecution().executedPlan().toString()
    wrong = quality.image_size_issues(found.withColumn("split", F.lit("train")), 1024)
    assert {(r["code"], r["context"]) for r in wrong.collect()} == {("generated_image_size_mismatch", s) for s in ("b c%", "e")}
