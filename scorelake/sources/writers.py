"""Writers. All go through the commit protocol of Spark, so a failed job leaves no partial output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_mode(overwrite: bool) -> str:
    """Refuse to write over existing output unless asked to."""
    return "overwrite" if overwrite else "errorifexists"


def write_detections_jsonl(gt: DataFrame, pred: DataFrame, matches: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """One JSON line per page (tile) with ground truth, predictions and error counts."""
    label = F.struct("class_id", "x0", "y0", "x1", "y1")
    hit_g = matches.select("page_id", "gt_seq", F.lit(True).alias("matched"))
    hit_p = matches.select("page_id", F.col("pred_seq").alias("det_seq"), F.lit(True).alias("matched"))
    found = F.coalesce("matched", F.lit(False))
    g = gt.join(hit_g, ["page_id", "gt_seq"], "left").groupBy("page_id").agg(
        F.collect_list(F.struct(label.alias("label"), found.alias("matched"))).alias("ground_truth"),
        F.count("matched").alias("tp"), F.count(F.when(~found, 1)).alias("fn"))
    p = pred.join(hit_p, ["page_id", "det_seq"], "left").groupBy("page_id").agg(
        F.collect_list(F.struct(label.alias("label"), "confidence", found.alias("matched"))).alias("predictions"), F.count(F.when(~found, 1)).alias("fp"))
    out = g.join(p, "page_id", "full_outer").fillna(0, ["tp", "fn", "fp"])
    out.write.mode(output_mode(overwrite)).json(path)


def write_page_documents(rows: DataFrame, path: str, *, piece: str = "piece", overwrite: bool = False) -> None:
    """One JSON document per page with its candidates or relations, in a folder per piece."""
    fields = [c for c in rows.columns if c not in (piece, "page_id")]
    docs = rows.groupBy(piece, "page_id").agg(F.lit(1).alias("schema_version"), F.count("*").alias("candidate_count"),
                                             F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))
    docs.write.mode(output_mode(overwrite)).partitionBy(piece).json(path)


def label_text(assigned: DataFrame, *, key: list[str], decimals: int = 8) -> DataFrame:
    """Label text of each tile from `class_id, cx, cy, w, h` and an order column `ann_id`."""
    form = "%d" + f" %.{decimals}f" * 4
    line = F.format_string(form, F.col("class_id"), *(F.col(c).cast("double") for c in ("cx", "cy", "w", "h")))
    numeric = F.coalesce(F.col("ann_id").try_cast("bigint"), F.lit(2 ** 62))
    lines = F.array_sort(F.collect_list(F.struct("class_id", numeric.alias("n"), F.col("ann_id").cast("string").alias("s"), line.alias("line"))))
    return assigned.groupBy(*key).agg(lines.alias("l")).select(*key, F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("text"))


def write_labels(texts: DataFrame, path: str, *, key: str, overwrite: bool = False) -> None:
    """Label text files, one folder per tile name."""
    texts.select(key, F.col("text").alias("value")).write.mode(output_mode(overwrite)).partitionBy(key).text(path)


def write_manifest(tiles: DataFrame, path: str, *, overwrite: bool = False) -> None:
    tiles.write.mode(output_mode(overwrite)).option("partitionOverwriteMode", "dynamic").partitionBy("split").json(path)


def write_bar_audit(audit: DataFrame, path: str, *, overwrite: bool = False) -> None:
    audit.write.mode(output_mode(overwrite)).json(path)


def checkpoint_bars(elements: DataFrame, path: str) -> None:
    """Bar elements by piece and page; pages written again replace only themselves."""
    elements.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("piece", "page_id").parquet(path)


def write_score_events(events: DataFrame, path: str, *, overwrite: bool = False) -> None:
    events.write.mode(output_mode(overwrite)).partitionBy("piece").parquet(path)


def metric_report(metrics: DataFrame) -> DataFrame:
    """Lines of a Markdown table from (name, precision, recall, f1, …)."""
    names = [c for c in metrics.columns if c != "name"]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "name", *(F.format_string("%.4f", F.col(c).cast("double")) for c in names)), F.lit(" |"))
    head = f"| name | {' | '.join(names)} |\n|{'---|' * (len(names) + 1)}"
    spark = metrics.sparkSession
    return spark.createDataFrame([(0, "", head)], "o int, name string, value string").unionByName(
        metrics.select(F.lit(1).alias("o"), "name", row.alias("value"))).orderBy("o", "name").select("value")


def write_metric_report(metrics: DataFrame, path: str, *, overwrite: bool = False) -> None:
    metric_report(metrics).coalesce(1).write.mode(output_mode(overwrite)).text(path)
