"""Dynamic letters combined to dynamic marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import box
from scorelake.functions.vocabulary import DYNAMIC_PATTERN
from scorelake.operators.greedy_size import split_by_size
from scorelake.operators.prefix import islands, running

FIELDS = ("cy", "cx", "cand_seq", "letter", "x0", "y0", "x1", "y1", "confidence", "unit")


def _clusters(letters: DataFrame, keys: list[str]) -> DataFrame:
    rows = letters.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("rows"))

    def joins(previous: Column, letter: Column) -> Column:
        unit = F.greatest(previous["unit"], letter["unit"])
        gap = letter["x0"] - previous["x1"]
        return (gap >= -0.6 * unit) & (gap <= 1.8 * unit) & (F.abs(letter["cy"] - previous["cy"]) <= 1.3 * unit)

    # the accumulator holds open clusters; a letter goes to the latest cluster it fits
    def step(acc: Column, letter: Column) -> Column:
        fits = F.transform(acc, lambda c: F.coalesce(joins(F.element_at(c, -1), letter), F.lit(False)))
        from_end = F.array_position(F.reverse(fits), F.lit(True))
        target = F.size(acc) - from_end
        return F.when(from_end == 0, F.array_append(acc, F.array(letter))).otherwise(
            F.transform(acc, lambda c, i: F.when(i == target, F.array_append(c, letter)).otherwise(c)))

    empty = F.transform(F.filter("rows", lambda _: F.lit(False)), lambda r: F.array(r))
    return rows.select(*keys, F.explode(F.aggregate("rows", empty, step)).alias("cluster"))


def combine_letters(letters: DataFrame, *, max_group: int = 2048) -> DataFrame:
    """One row per cluster of letters with its text, box, mean confidence and validity.

    `letters` has `page_id, staff_index, unit, cand_seq, letter, box, confidence`. Letters of a staff
    are walked by (center y, center x). Oversized staffs are first cut at vertical gaps too wide to
    join, where no cluster can cross.
    """
    b = box()
    work = letters.withColumn("cx", b.cx * 1.0).withColumn("cy", b.cy * 1.0).withColumn(
        "staff_key", F.coalesce("staff_index", F.lit(-1)))
    keys = ["page_id", "staff_key"]
    small, large = split_by_size(work, keys, max_group)
    clusters = _clusters(small, keys).select(*keys, "cluster")
    if large is not None:
        cut = large.withColumn("seg", F.floor(F.col("cy") / 64))
        cut = running(cut, keys=keys, segment="seg", order=["cy", "cx", "cand_seq"], how="max", value="cy", name="above",
                      inclusive=False)
        cut = islands(cut, keys=keys, segment="seg", order=["cy", "cx", "cand_seq"],
                      starts=F.col("above").isNull() | (F.col("cy") - F.col("above") > 1.3 * F.col("unit")), name="part")
        clusters = clusters.unionByName(_clusters(cut, [*keys, "part"]).select(*keys, "cluster"))
    by_x = F.array_sort(F.transform("cluster", lambda c: F.struct(
        c["cx"].alias("cx"), c["cy"].alias("cy"), c["cand_seq"].alias("cand_seq"), c["letter"].alias("letter"),
        c["confidence"].alias("confidence"))))
    out = clusters.withColumn("ordered", by_x)
    text = F.array_join(F.transform("ordered", lambda c: c["letter"]), "")
    pick = lambda name: F.transform("cluster", lambda c: c[name])
    total = F.aggregate("ordered", F.lit(0.0), lambda a, c: a + c["confidence"])
    return out.select(
        "page_id", "staff_key", F.col("ordered")[0]["cand_seq"].alias("cand_seq"), text.alias("dynamic_text"),
        text.rlike(DYNAMIC_PATTERN).alias("valid"), F.size("ordered").alias("n_letters"),
        F.array_min(pick("x0")).alias("x0"), F.array_min(pick("y0")).alias("y0"),
        F.array_max(pick("x1")).alias("x1"), F.array_max(pick("y1")).alias("y1"),
        (total / F.size("ordered")).alias("confidence"),
        F.transform("ordered", lambda c: c["cand_seq"]).alias("source_seqs"))
