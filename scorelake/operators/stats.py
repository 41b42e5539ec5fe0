"""Dataset statistics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.operators.ranking import hash_rank_key, summarize
from scorelake.session import cut_lineage


def class_statistics(instances: DataFrame) -> DataFrame:
    """Instances and distinct images per (class, split), per class, per split and in total.

    Distinct images are counted from one row per (class, split, image), so all levels share a scan.
    """
    per_image = instances.groupBy("class_id", "split", "image_id").agg(F.count("*").alias("n"))
    return per_image.groupingSets(
        [["class_id", "split"], ["class_id"], ["split"], []], "class_id", "split").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("instances"), F.count_distinct("image_id").alias("images"))


def box_summary(boxes: DataFrame, *, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """count, min, quartiles, mean, p95 and max of several measures in long form."""
    long_form = boxes.select(*keys, F.explode(F.array(*(
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values))).alias("m"))
    return summarize(long_form.select(*keys, "m.measure", "m.value"), keys=[*keys, "measure"], value="value")


def run_summary(log: DataFrame, *, losses: Sequence[str], metric: str) -> DataFrame:
    """First and last epoch, lowest loss per column and the best epoch by metric (1-based)."""
    best = F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch")))
    return log.groupBy("run").agg(
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"),
        (best + 1).alias("best_epoch"), F.max(metric).alias("best_metric"),
        *(F.min(c).alias(f"min_{c}") for c in losses))


def sample_per_class(rows: DataFrame, *, class_col: str, image_col: str, n: int, seed: int) -> DataFrame:
    """n rows per class from distinct images, chosen by hash rank (a combinable minimum per image,
    then a bounded top-n that Spark limits before the shuffle)."""
    from pyspark.sql import Window as W

    keyed = rows.withColumn("__h", hash_rank_key(image_col, class_col, seed=seed))
    others = [c for c in rows.columns if c not in (class_col, image_col)]
    one = keyed.groupBy(class_col, image_col, "__h").agg(F.min(F.struct(*others)).alias("__row"))
    rank = F.row_number().over(W.partitionBy(class_col).orderBy("__h", image_col))
    return one.withColumn("__r", rank).filter(F.col("__r") <= n).select(class_col, image_col, "__row.*")


def select_subset(tiles: DataFrame, *, class_count: int, per_class: int, total: int, negatives: int, seed: int, keep: int = 64) -> DataFrame:
    """A small set of tiles that shows every class `per_class` times, filled up to `total`, plus negatives.

    `tiles(tile_id, annotation_ids, class_ids, n_clipped, padded, is_negative)`, with one class per annotation and unique ids.
    Classes are visited in order (a fixed short list). Each visit takes a bounded top-n of tiles not
    chosen yet: few annotations that are already shown, nothing clipped, no padding, about three of
    the class, few boxes, then hash order. What is shown already is known on the way only, so one pass ranks the tiles of all visits by
    the rest, and the first `keep` of each visit reach the driver: those that show nothing again are its best. A visit whose list runs out of
    such tiles, and does not hold all there are, asks the whole table.
    """
    from pyspark.sql import Window as W

    ranked = tiles.withColumn("__h", hash_rank_key("tile_id", seed=seed))
    of_class = lambda c: F.size(F.filter("class_ids", lambda x: x == c))
    order = [F.col("n_clipped") > 0, F.col("padded"), F.size("annotation_ids"), F.col("__h")]
    keep, fill, clear, empty = max(keep, negatives), class_count, -1, -2

    visit = lambda v, off: F.struct(F.lit(v).cast("long").alias("visit"), off.alias("off"))
    classes = F.filter(F.array_distinct("class_ids"), lambda c: (c >= 0) & (c < class_count))
    shows = F.concat(F.transform(classes, lambda c: F.struct(c.cast("long").alias("visit"), F.abs(of_class(c) - 3).alias("off"))), F.array(visit(fill, F.lit(0))))
    lacks = F.when(F.col("padded"), F.array(visit(empty, F.lit(0)))).otherwise(F.array(visit(empty, F.lit(0)), visit(clear, F.lit(0))))
    visits = ranked.filter("is_negative IS NOT NULL").select(
        "tile_id", *(o.alias(f"__o{i}") for i, o in enumerate(order)), "is_negative", F.explode(F.when(F.col("is_negative"), lacks).otherwise(shows)).alias("v"))
    # negatives go by their hash alone
    by = [F.when(~F.col("is_negative"), c) for c in (F.col("__o0"), F.col("__o1"), F.col("v.off"), F.col("__o2"))]
    first = visits.select("v.visit", "tile_id", *(c.alias(f"__b{i}") for i, c in enumerate(by)), "__o3").withColumn(
        "r", F.row_number().over(W.partitionBy("visit").orderBy(*(f"__b{i}" for i in range(len(by))), "__o3"))).filter(F.col("r") <= keep)
    lists: dict[int, list[str]] = {}
    for row in sorted(first.select("visit", "r", "tile_id").collect()):
        lists.setdefault(row.visit, []).append(row.tile_id)
    listed = cut_lineage(tiles.filter(F.col("tile_id").isin(sorted({t for ids in lists.values() for t in ids}))))
    annotations = {r.tile_id: r.annotation_ids for r in listed.filter(~F.col("is_negative")).select("tile_id", "annotation_ids").collect()}

    chosen: list[str] = []
    shown: set[str] = set()
    asked: list[DataFrame] = []

    def again(tile_id: str) -> int:
        return len(shown.intersection(annotations[tile_id]))

    def take(visit: int, n: int) -> int:
        ids = lists.get(visit, [])
        picked = sorted((t for t in ids if t not in chosen), key=again)[:n]
        if len(ids) == keep and (len(picked) < n or any(map(again, picked))):
            picked = whole_table(visit, n)
        chosen.extend(picked)
        shown.update(a for t in picked for a in annotations[t])
        return len(picked)

    def whole_table(visit: int, n: int) -> list[str]:
        if not asked:
            asked.append(cut_lineage(ranked.filter(~F.col("is_negative"))))
        seen = F.size(F.array_intersect("annotation_ids", F.from_json(F.lit(json.dumps(sorted(shown))), "array<string>")))
        pool = asked[0].filter(~F.col("tile_id").isin(chosen))
        extra = []
        if visit != fill:
            pool, extra = pool.filter(of_class(visit) > 0), [F.abs(of_class(visit) - 3)]
        rows = pool.orderBy(seen, *order[:2], *extra, *order[2:]).select("tile_id", "annotation_ids").take(n)
        annotations.update((r.tile_id, r.annotation_ids) for r in rows)
        return [r.tile_id for r in rows]

    for class_id in range(class_count):
        if take(class_id, per_class) < per_class:
            raise ValueError(f"fewer than {per_class} tiles show class {class_id}")
    if len(chosen) > total:
        raise ValueError(f"{len(chosen)} tiles are needed for all classes, more than {total}")
    take(fill, total - len(chosen))
    pool = lists.get(clear, []) if len(lists.get(clear, [])) >= negatives else lists.get(empty, [])
    result = listed.filter(F.col("tile_id").isin(chosen + pool[:negatives]))
    if asked:
        known = {t for ids in lists.values() for t in ids}
        result = result.unionByName(asked[0].filter(F.col("tile_id").isin([t for t in chosen if t not in known])).drop("__h"))
    return result


def limit_images(images: DataFrame, n: int) -> DataFrame:
    """The first n images in file order, for trial runs."""
    return images.orderBy("image_order").limit(n)


def manifest_order(tiles: DataFrame) -> DataFrame:
    """Tiles sorted by image, row and column; the sort is distributed by range."""
    return tiles.orderBy("split", "image_id", "tile_y", "tile_x")
