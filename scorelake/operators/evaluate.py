"""Detections against ground truth: matching, precision/recall, confusion, size buckets, AP."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import Box, box, iou, size_bucket
from scorelake.operators.greedy import MAX_GROUP, match
from scorelake.operators.prefix import row_number, running
from scorelake.operators.spatial import collapse_copies, grid_join
from scorelake.session import cut_lineage


def iou_pairs(gt: DataFrame, pred: DataFrame, *, iou_threshold: float = 0.5, same_class: bool = True,
              page: str = "page_id", cell: float = 128) -> DataFrame:
    """Overlapping pairs (page, gt_seq, pred_seq, gt_class, pred_class, iou) at or above the threshold."""
    g = gt.select(page, "gt_seq", F.col("class_id").alias("gt_class"), *box())
    p = pred.select(page, F.col("det_seq").alias("pred_seq"), F.col("class_id").alias("pred_class"), *box().columns("p_"))
    pb = Box(*(F.col("p_" + n) for n in Box._fields))
    condition = iou(box(), pb) >= iou_threshold
    keys = [page]
    if same_class:
        g, p = g.withColumn("class_key", F.col("gt_class")), p.withColumn("class_key", F.col("pred_class"))
        keys.append("class_key")
    return grid_join(g, p, keys=keys, left_region=box(), right_region=pb, condition=condition,
                     cell_w=cell, cell_h=cell).select(
        page, "gt_seq", "pred_seq", "gt_class", "pred_class", iou(box(), pb).alias("iou"))


def greedy_match(gt: DataFrame, pred: DataFrame, *, iou_threshold: float = 0.5, same_class: bool = True,
                 page: str = "page_id", max_group: int = MAX_GROUP, max_copies: int = 64) -> DataFrame:
    """One-to-one matches, best IoU first; ties prefer the larger gt, then the larger prediction index.

    Pages where labels and predictions both hold more than `max_copies` copies of a box are matched
    by groups of copies, so that no pairs are built between the members of two such groups.
    """
    keys = [page, "class_id"] if same_class else [page]
    copied = [d.groupBy(page, "class_id", *Box._fields).count().filter(F.col("count") > max_copies).select(*keys).distinct()
              for d in (gt, pred)]
    if copied[0].isEmpty():
        return _match_rows(gt, pred, iou_threshold, same_class, page, max_group)
    hot = cut_lineage(copied[0].join(copied[1], keys, "left_semi"))
    if hot.isEmpty():
        return _match_rows(gt, pred, iou_threshold, same_class, page, max_group)
    cold = _match_rows(gt.join(hot, keys, "left_anti"), pred.join(hot, keys, "left_anti"), iou_threshold, same_class, page, max_group)
    return cold.unionByName(_match_copies(gt.join(hot, keys, "left_semi"), pred.join(hot, keys, "left_semi"), iou_threshold, same_class, page))


def _match_rows(gt: DataFrame, pred: DataFrame, iou_threshold: float, same_class: bool, page: str, max_group: int) -> DataFrame:
    pairs = iou_pairs(gt, pred, iou_threshold=iou_threshold, same_class=same_class, page=page)
    keys = [page, "gt_class"] if same_class else [page]
    payload = ["pred_class", "iou"] if same_class else ["gt_class", "pred_class", "iou"]
    return match(pairs, keys=keys, left="gt_seq", right="pred_seq",
                 priority=[-F.col("iou"), -F.col("gt_seq"), -F.col("pred_seq")], payload=payload,
                 max_group=max_group).select(page, "gt_seq", "pred_seq", "gt_class", "pred_class", "iou")


def _members(rows: DataFrame, seq: str, group: str, page: str) -> DataFrame:
    """Rows with the id of their group of copies and their rank in it, larger sequence first.

    Ids may be sparse: a segment of the ranking is a share of the group's own range of ids that holds about 4096 rows.
    """
    key = [page, "class_id", *Box._fields]
    groups = rows.groupBy(*key).agg(F.min(seq).alias(group), F.max(seq).alias("top"), F.count("*").alias("copies"))
    share = (F.col("top") - F.col(seq)) / (F.col("top") - F.col(group) + 1)
    ranked = row_number(rows.join(groups, key).withColumn("down", -F.col(seq)).withColumn("seg", F.floor(share * (F.floor(F.col("copies") / 4096) + 1))),
                        keys=[page, group], segment="seg", order=["down"], name="rank")
    return cut_lineage(ranked.select(*key, group, F.col(seq).alias("member"), "rank"))


def _match_copies(gt: DataFrame, pred: DataFrame, iou_threshold: float, same_class: bool, page: str) -> DataFrame:
    """Greedy matching of groups of copies with a capacity.

    Copies have equal overlaps, so a group gives away its members in order of their sequence. Two groups
    that are each other's best, without a rival of equal overlap, match as many members as the smaller
    one has left; with such a rival they match one member per round, as the walk over rows would.
    """
    g, p = _members(gt, "gt_seq", "gid", page), _members(pred, "det_seq", "pid", page)
    reps = [m.groupBy(page, "class_id", *Box._fields, c).agg(F.max("rank").alias("size")) for m, c in ((g, "gid"), (p, "pid"))]
    pairs = cut_lineage(iou_pairs(reps[0].withColumnRenamed("gid", "gt_seq"), reps[1].withColumnRenamed("pid", "det_seq"),
                                  iou_threshold=iou_threshold, same_class=same_class, page=page)
                        .withColumnRenamed("gt_seq", "gid").withColumnRenamed("pred_seq", "pid"))
    used = [cut_lineage(r.select(page, c, "size", F.lit(0).cast("long").alias("used"))) for r, c in zip(reps, ("gid", "pid"))]
    done: list[DataFrame] = []
    while True:
        ends = []
        for state, members, c, s in ((used[0], g, "gid", "g"), (used[1], p, "pid", "p")):
            top = members.select(page, c, F.col("member").alias(f"{s}_top"), (F.col("rank") - 1).alias("used"))
            ends.append(state.join(top, [page, c, "used"]).select(page, c, f"{s}_top", F.col("used").alias(f"{s}_used"),
                                                                  (F.col("size") - F.col("used")).alias(f"{s}_left")))
        live = cut_lineage(pairs.join(ends[0], [page, "gid"]).join(ends[1], [page, "pid"]).withColumn(
            "prio", F.struct(-F.col("iou"), -F.col("g_top"), -F.col("p_top"))))
        if live.isEmpty():
            break
        for c in ("gid", "pid"):
            best = live.groupBy(page, c).agg(F.min("prio").alias(f"{c}_best"), F.max("iou").alias("top_iou"))
            tied = live.join(best.select(page, c, "top_iou"), [page, c]).filter("iou = top_iou").groupBy(page, c).agg(
                F.count("*").alias(f"{c}_ties"))
            best = best.join(tied, [page, c]).drop("top_iou")
            live = live.join(best, [page, c])
        take = F.when((F.col("gid_ties") == 1) & (F.col("pid_ties") == 1), F.least("g_left", "p_left")).otherwise(1)
        chosen = cut_lineage(live.filter((F.col("prio") == F.col("gid_best")) & (F.col("prio") == F.col("pid_best"))).select(
            page, "gid", "pid", "gt_class", "pred_class", "iou", "g_used", "p_used", take.alias("take")))
        done.append(chosen)
        used = [cut_lineage(state.join(chosen.groupBy(page, c).agg(F.sum("take").alias("more")), [page, c], "left").select(
            page, c, "size", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used"))) for state, c in zip(used, ("gid", "pid"))]
    if not done:
        return _match_rows(gt, pred, iou_threshold, same_class, page, MAX_GROUP)
    matched = done[0]
    for part in done[1:]:
        matched = matched.unionByName(part)

    def spell(members: DataFrame, c: str, start: str, name: str) -> DataFrame:
        rows = members.select(page, c, "rank", F.col("member").alias(name)).join(matched, [page, c])
        inside = (F.col("rank") > F.col(start)) & (F.col("rank") <= F.col(start) + F.col("take"))
        return rows.filter(inside).select(page, "gid", "pid", "g_used", "gt_class", "pred_class", "iou", (F.col("rank") - F.col(start)).alias("k"), name)

    left, right = spell(g, "gid", "g_used", "gt_seq"), spell(p, "pid", "p_used", "pred_seq")
    return left.join(right.select(page, "gid", "pid", "g_used", "k", "pred_seq"), [page, "gid", "pid", "g_used", "k"]).select(
        page, "gt_seq", "pred_seq", "gt_class", "pred_class", "iou")


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 when the denominator is 0."""
    return F.coalesce(numerator / F.nullif(denominator, F.lit(0)), F.lit(0.0))


def with_prf(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to columns tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = counts.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def outcome_counts(gt: DataFrame, pred: DataFrame, matches: DataFrame, by: Sequence[str] = ("class_id",)) -> DataFrame:
    """tp, fp, fn per class (or per page and class) from the three tables, in one aggregation."""
    by = list(by)
    page = [c for c in by if c != "class_id"]
    zero = F.lit(0)
    parts = [
        (gt.select(*page, "class_id"), 1, 0, 0),
        (pred.select(*page, "class_id"), 0, 1, 0),
        (matches.select(*page, F.col("gt_class").alias("class_id")), 0, 0, 1),
    ]
    rows = None
    for frame, g, p, t in parts:
        part = frame.select(*by, (zero + g).alias("g"), (zero + p).alias("p"), (zero + t).alias("t"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*by).agg(F.sum("t").alias("tp"), (F.sum("p") - F.sum("t")).alias("fp"),
                                 (F.sum("g") - F.sum("t")).alias("fn"))


def prf_per_class(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    return with_prf(outcome_counts(gt, pred, matches))


def prf_overall(per_class: DataFrame) -> DataFrame:
    return with_prf(per_class.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def prf_semantic(per_class: DataFrame, class_map: DataFrame) -> DataFrame:
    """Counts summed over the classes of a semantic name, ratios from the sums."""
    return with_prf(per_class.join(class_map, "class_id").groupBy("class_name").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def confusion_matrix(gt: DataFrame, pred: DataFrame, matches: DataFrame, *, background: int,
                     page: str = "page_id") -> DataFrame:
    """Long form (gt_class, pred_class, n); unmatched rows go to the background class."""
    matches = cut_lineage(matches.select(page, "gt_seq", "pred_seq", "gt_class", "pred_class"))  # read three times
    missed = gt.join(matches.select(page, "gt_seq"), [page, "gt_seq"], "left_anti").select(
        F.col("class_id").alias("gt_class"), F.lit(background).cast("long").alias("pred_class"))
    false = pred.join(matches.select(page, F.col("pred_seq").alias("det_seq")), [page, "det_seq"], "left_anti").select(
        F.lit(background).cast("long").alias("gt_class"), F.col("class_id").alias("pred_class"))
    rows = matches.select("gt_class", "pred_class").unionByName(missed).unionByName(false)
    return rows.groupBy("gt_class", "pred_class").agg(F.count("*").alias("n"))


def pivot_confusion(long_form: DataFrame, class_ids: Sequence[int]) -> DataFrame:
    """One column per predicted class, 0 where nothing was counted."""
    wide = long_form.groupBy("gt_class").pivot("pred_class", list(class_ids)).agg(F.sum("n"))
    return wide.fillna(0)


def side_confusion(matches: DataFrame, class_map: DataFrame) -> DataFrame:
    """Sides of class-free matches whose two classes have the same semantic name."""
    g = class_map.select(F.col("class_id").alias("gt_class"), F.col("class_name").alias("gt_name"), F.col("side").alias("side_gt"))
    p = class_map.select(F.col("class_id").alias("pred_class"), F.col("class_name").alias("pred_name"),
                         F.col("side").alias("side_pred"))
    return (matches.join(g, "gt_class").join(p, "pred_class").filter(F.col("gt_name") == F.col("pred_name"))
            .groupBy("side_gt", "side_pred").agg(F.count("*").alias("n")))


def size_bucket_recall(gt: DataFrame, matches: DataFrame, *, page: str = "page_id") -> DataFrame:
    hits = matches.select(page, "gt_seq", F.lit(1).alias("hit"))
    rows = gt.join(hits, [page, "gt_seq"], "left").withColumn("bucket", size_bucket(box().area))
    out = rows.groupBy("bucket").agg(F.count("*").alias("ground_truth"), F.count("hit").alias("true_positive"))
    return out.withColumn("recall", ratio(F.col("true_positive"), F.col("ground_truth")))


def worst_pages(gt: DataFrame, pred: DataFrame, matches: DataFrame, k: int = 30, *, page: str = "page_id") -> DataFrame:
    """The k pages (tiles) with most errors, lower id first on ties."""
    counts = outcome_counts(gt.withColumn("class_id", F.lit(0)), pred.withColumn("class_id", F.lit(0)),
                            matches.withColumn("gt_class", F.lit(0)), by=[page, "class_id"])
    return counts.select(page, "tp", "fp", "fn", (F.col("fp") + F.col("fn")).alias("errors")).orderBy(
        F.desc("errors"), page).limit(k)


def average_precision(gt: DataFrame, pred: DataFrame, matches: DataFrame, *, page: str = "page_id") -> DataFrame:
    """Area under the precision envelope per class, with detections ranked by confidence.

    Hits and misses are counted per (class, confidence) before any window, and the cumulative sums
    run in two levels over blocks of confidence. Detections of equal confidence form one step.
    """
    hits = matches.select(page, F.col("pred_seq").alias("det_seq"), F.lit(1).alias("hit"))
    steps = pred.join(hits, [page, "det_seq"], "left").groupBy("class_id", "confidence").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    area = _envelope_area(steps)
    total = gt.groupBy("class_id").agg(F.count("*").alias("n_gt"))
    return total.join(area, "class_id", "left").select(
        "class_id", "n_gt", F.coalesce(F.col("area") / F.col("n_gt"), F.lit(0.0)).alias("ap"))


def _envelope_area(steps: DataFrame, keys: Sequence[str] = ("class_id",)) -> DataFrame:
    """Sum of the precision envelope over the hits of steps `*keys, confidence, n, hits`."""
    keys = list(keys)
    steps = steps.withColumn("rank", -F.col("confidence")).withColumn("seg", F.floor(F.col("rank") * 1000))
    steps = running(steps, keys=keys, segment="seg", order=["rank"], how="sum", value="n", name="cum_n")
    steps = running(steps, keys=keys, segment="seg", order=["rank"], how="sum", value="hits", name="cum_hits")
    steps = steps.withColumn("precision", F.col("cum_hits") / F.col("cum_n"))
    steps = steps.withColumn("conf_seg", F.floor(F.col("confidence") * 1000))
    envelope = running(steps, keys=keys, segment="conf_seg", order=["confidence"], how="max", value="precision", name="envelope")
    return envelope.groupBy(*keys).agg(F.sum(F.col("envelope") * F.col("hits")).alias("area"))


def mean_average_precision(gt: DataFrame, pred: DataFrame, thresholds: Sequence[float], *,
                           page: str = "page_id") -> DataFrame:
    """AP per class averaged over IoU thresholds; the thresholds are a fixed short list.

    The walk takes pairs by falling IoU, so that the matches at a threshold are those at the lowest one that reach it: pairs are made and matched once.
    """
    found = greedy_match(gt, pred, iou_threshold=min(thresholds), page=page).select(page, F.col("pred_seq").alias("det_seq"), "iou")
    reached = F.array(*(F.count(F.when(F.col("iou") >= t, 1)) for t in thresholds))
    counts = pred.join(found, [page, "det_seq"], "left").groupBy("class_id", "confidence").agg(F.count("*").alias("n"), reached.alias("reached"))
    steps = cut_lineage(counts.select("class_id", "confidence", "n", F.posexplode("reached").alias("level", "hits")))
    area = _envelope_area(steps, ["class_id", "level"]).groupBy("class_id").agg(F.sum("area").alias("area"))
    total = gt.groupBy("class_id").agg(F.count("*").alias("n_gt"))
    return total.join(area, "class_id", "left").select(
        "class_id", F.coalesce(F.col("area") / F.col("n_gt") / len(thresholds), F.lit(0.0)).alias("map"))


def overlapping_predictions(gt: DataFrame, pred: DataFrame, *, iou_threshold: float = 0.5, page: str = "page_id") -> DataFrame:
    """Semi-join: predictions that overlap some label; copies of a label count once."""
    labels = collapse_copies(gt.withColumn("class_id", F.lit(0)), [page, "class_id"], "gt_seq")
    return iou_pairs(labels, pred, iou_threshold=iou_threshold, same_class=False, page=page).select(page, "pred_seq").distinct()
