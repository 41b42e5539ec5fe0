"""Readers for annotation JSON, class maps, labels, manifests, piece configs, images and logs."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import ship_package

# The shape of the annotation file and of the other input files.
ANNOTATION_FILE = """images array<struct<id:string,filename:string,width:int,height:int,ann_ids:array<string>>>,
annotations map<string,struct<a_bbox:array<double>,o_bbox:array<double>,cat_id:array<string>,area:double,img_id:string,comments:string>>,
categories map<string,struct<name:string,annotation_set:string,color:string>>"""
CLASS_MAP_FILE = """schema_version int, deepscores_to_yolo map<string,int>, yolo_names array<string>,
classes array<struct<deepscores_id:int,deepscores_name:string,yolo_id:int,normalized_semantic_class:string,side:string>>"""
MANIFEST_FILE = """split string, tiles array<struct<source_image:string,source_image_id:string,split:string,tile_filename:string,image_path:string,label_path:string,
tile_offset:struct<x:int,y:int>,tile_size:int,source_width:int,source_height:int,valid_source_region_in_tile:struct<width:int,height:int>,
padding:struct<right:int,bottom:int,value:int>,is_negative:boolean,annotation_ids:array<string>,clipped_annotation_ids:array<string>,
unclipped_annotation_ids:array<string>,annotations:array<struct<annotation_id:string,deepscores_class_id:string,yolo_cxcywh:array<double>,
original_source_bbox_xyxy:array<double>,tile_bbox_xyxy:array<double>,intersection_ratio:double,center_inside:boolean,clipped:boolean>>>>"""
PIECE_FILE = """numPage int, numPerPage int, rotate boolean, tsChange array<struct<page:int,loc:array<int>,time_signature:array<int>,mov:int>>,
numTrack int, track_shift array<int>, clef_options array<array<int>>, articulation struct<enabled:boolean,device:string,confidence:double,class_confidence:map<string,double>>,
slur_tie struct<enabled:boolean>"""


def read_annotation_file(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The raw file. One JSON document is one task: stage it once with `stage_annotations`."""
    return spark.read.schema(ANNOTATION_FILE).option("multiLine", True).json(path).withColumn("split", F.lit(split))


def images_of(raw: DataFrame) -> DataFrame:
    return raw.select("split", F.posexplode("images").alias("image_order", "i")).select(
        "split", "image_order", F.col("i.id").alias("image_id"), "i.filename", "i.width", "i.height", "i.ann_ids")


def annotations_of(raw: DataFrame) -> DataFrame:
    return raw.select("split", F.explode("annotations").alias("ann_id", "a")).select(
        "split", "ann_id", F.col("a.img_id").alias("image_id"), F.col("a.cat_id").alias("cat_ids"), "a.a_bbox", "a.o_bbox", "a.area", "a.comments")


def categories_of(raw: DataFrame) -> DataFrame:
    return raw.select("split", F.explode("categories").alias("category_id", "c")).select(
        "split", "category_id", "c.name", "c.annotation_set", "c.color")


def stage_annotations(raw: DataFrame, folder: str) -> None:
    """Write images, annotations and categories as parquet by split; later jobs read these."""
    for name, table in (("image", images_of(raw)), ("annotation", annotations_of(raw)), ("category", categories_of(raw))):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(f"{folder}/{name}")


def field_inventory(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """How many annotations fill each field, and the annotation sets in use."""
    fields = [c for c in annotations.columns if c != "split"]
    filled = annotations.groupBy("split").agg(*(F.count(c).alias(c) for c in fields))
    long_form = filled.unpivot("split", fields, "field", "n")
    sets = categories.groupBy("split", F.concat(F.lit("annotation_set:"), "annotation_set").alias("field")).agg(F.count("*").alias("n"))
    return long_form.unionByName(sets)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CLASS_MAP_FILE).option("multiLine", True).json(path)
    return raw.select(F.posexplode("classes").alias("position", "c")).select(
        "position", F.col("c.deepscores_id").cast("string").alias("category_id"), F.col("c.deepscores_name").alias("name"),
        F.col("c.yolo_id").alias("class_id"), F.col("c.normalized_semantic_class").alias("class_name"), "c.side")


def class_map_issues(spark: SparkSession, path: str) -> DataFrame:
    """The three integrity rules of a class map: ids in order, names in order, declared map as derived."""
    raw = spark.read.schema(CLASS_MAP_FILE).option("multiLine", True).json(path)
    derived = F.map_from_entries(F.transform("classes", lambda c: F.struct(c["deepscores_id"].cast("string"), c["yolo_id"])))
    order = lambda m: F.array_sort(F.map_entries(m))
    codes = F.array_compact(F.array(
        F.when(F.exists(F.transform("classes", lambda c, i: c["yolo_id"] != i), lambda x: x), "class_ids_not_consecutive"),
        F.when(F.transform("classes", lambda c: c["deepscores_name"]) != F.col("yolo_names"), "class_names_out_of_order"),
        F.when(order(derived) != order(F.col("deepscores_to_yolo")), "declared_map_differs")))
    return raw.select(F.explode(codes).alias("code"))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_label_lines(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One row per line of every label file, with its line number. A label file describes one tile."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("file"))
    lines = raw.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("pos", "text"))
    return lines.select(F.lit(split).alias("split"), "file", _stem(F.col("file")).alias("tile_name"), (F.col("pos") + 1).alias("line_no"), "text")


def read_labels(spark: SparkSession, folder: str, split: str, *, size: int = 1024) -> DataFrame:
    """Well-formed labels as boxes; blank lines are skipped."""
    from scorelake.functions.boxes import denormalize
    from scorelake.operators.quality import parse_labels

    p = parse_labels(read_label_lines(spark, folder, split)).filter(F.size("values") == 4)
    cx, cy, w, h = (F.get("values", F.lit(i)) for i in range(4))
    b = denormalize(cx, cy, w, h, size)
    return p.select("split", "tile_name", "line_no", "class_id", *b.columns())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(MANIFEST_FILE).option("multiLine", True).json(path)
    return raw.select("split", F.explode("tiles").alias("t")).select(
        "split", F.col("t.split").alias("declared_split"), _stem(F.col("t.tile_filename")).alias("tile_name"), F.col("t.source_image_id").alias("image_id"),
        F.col("t.source_image").alias("filename"), F.col("t.tile_offset.x").alias("tile_x"), F.col("t.tile_offset.y").alias("tile_y"), "t.tile_size",
        F.col("t.source_width").alias("width"), F.col("t.source_height").alias("height"), F.col("t.valid_source_region_in_tile.width").alias("valid_w"),
        F.col("t.valid_source_region_in_tile.height").alias("valid_h"), F.col("t.padding.right").alias("pad_right"), F.col("t.padding.bottom").alias("pad_bottom"),
        "t.is_negative", "t.annotation_ids", F.col("t.clipped_annotation_ids").alias("clipped_ids"), F.col("t.unclipped_annotation_ids").alias("unclipped_ids"),
        F.transform("t.annotations", lambda a: a["annotation_id"]).alias("record_ids"), "t.annotations")


def read_piece_config(spark: SparkSession, path: str) -> DataFrame:
    """Piece configs with defaults for what is absent; the piece is the file name."""
    raw = spark.read.schema(PIECE_FILE).option("multiLine", True).json(path)
    c = F.coalesce
    return raw.select(
        _stem(F.col("_metadata.file_path")).alias("piece"), F.col("numPage").alias("n_pages"), c("numPerPage", F.lit(1)).alias("pages_per_sheet"),
        c("rotate", F.lit(False)).alias("rotate"), F.col("tsChange").alias("ts_changes"), c("numTrack", F.lit(4)).alias("n_tracks"), "track_shift", "clef_options",
        c("articulation.enabled", F.lit(False)).alias("articulation_enabled"), c("articulation.confidence", F.lit(0.25)).alias("confidence"),
        c("articulation.class_confidence", F.create_map().cast("map<string,double>")).alias("class_confidence"), c("slur_tie.enabled", F.lit(False)).alias("curves_enabled"))


def time_changes(config: DataFrame) -> DataFrame:
    """Time-signature changes as rows (piece, page, line, bar_in_line, ts_num, ts_den, movement)."""
    return config.select("piece", F.posexplode("ts_changes").alias("change_no", "t")).select(
        "piece", "change_no", "t.page", F.get("t.loc", F.lit(0)).alias("line"), F.get("t.loc", F.lit(1)).alias("bar_in_line"),
        F.get("t.time_signature", F.lit(0)).alias("ts_num"), F.get("t.time_signature", F.lit(1)).alias("ts_den"), F.col("t.mov").alias("movement"))


def list_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Image files with width and height from the PNG header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.select("path", _stem(F.col("path")).alias("stem"), "length", number(17).alias("width"), number(21).alias("height"))


#: Bytes of a PNG file that hold its signature, width and height.
PNG_HEAD = 24


def _opened(path: str):
    """A file of any file system that pyarrow knows, as a stream that reads what it is asked for."""
    if path.startswith("file:"):
        return pa_fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = pa_fs.FileSystem.from_uri(quote(path, safe=":/"))
    return system.open_input_file(unquote(inner))


def _png_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = []
        for path in batch.column("path").to_pylist():
            with _opened(path) as file:
                head = file.read(PNG_HEAD)
            good = len(head) == PNG_HEAD and head[:8] == b"\x89PNG\r\n\x1a\n"
            sizes.append(struct.unpack(">II", head[16:]) if good else (None, None))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s[i] for s in sizes], pa.int32()) for i in (0, 1))],
                                         names=[*batch.schema.names, "width", "height"])


def image_headers(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Image files like `list_images`, of which only the first bytes are read: Spark lists the files, tasks open each for its header.

    The work depends on the number of files, not on their size. Files that are no PNG have neither width nor height; Spark lists no
    empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    ship_package(spark)
    listed = files.select("path", _stem(F.col("path")).alias("stem"), "length")
    return listed.mapInArrow(_png_sizes, "path string, stem string, length bigint, width int, height int")


def hash_inputs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.current_timestamp().alias("read_at"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Per-epoch metrics; header names are stripped of spaces and of a byte order mark."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [c.strip().lstrip("﻿").strip() for c in raw.columns]
    return raw.toDF(*names).select(*(F.col(f"`{c}`").try_cast("double").alias(c) for c in names))


def pages_to_process(pages: DataFrame, done: DataFrame) -> DataFrame:
    return pages.join(done.select("page_id").distinct(), "page_id", "left_anti")
