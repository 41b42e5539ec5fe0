"""Accidentals, dots and rests attached to notes; filters on boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import Box, box, intersection_area
from scorelake.operators.components import MAX_LINKS
from scorelake.operators.greedy_size import split_by_size
from scorelake.operators.ranking import quantiles
from scorelake.operators.spatial import collapse_copies, grid_join
from scorelake.session import cut_lineage, ship_package


def prefixed(df: DataFrame, prefix: str) -> tuple[DataFrame, Box]:
    """`df` with box columns renamed, and that box."""
    for n in Box._fields:
        df = df.withColumnRenamed(n, prefix + n)
    return df, Box(*(F.col(prefix + n) for n in Box._fields))


def accidental_probe(b: Box, shift: Column) -> Box:
    """Where the note of an accidental is looked for: one width to its right, at the middle third
    of sharps and naturals and the lower half of flats."""
    mid, sixth = F.floor((b.y0 + b.y1) / 2), F.floor((b.y1 - b.y0) / 6)
    return Box(b.x1, F.when(shift >= 0, mid - sixth).otherwise(mid), b.x1 + (b.x1 - b.x0),
               F.when(shift >= 0, mid + sixth).otherwise(b.y1))


def accidental_to_note(accidentals: DataFrame, heads: DataFrame) -> DataFrame:
    """The note with the largest overlap with the probe of each accidental (lower id on ties).

    All accidentals stay; those without a note are candidates for a key signature.
    `accidentals(page_id, acc_id, shift, box)`, `heads(page_id, ng, box)`.
    """
    heads = collapse_copies(heads, ["page_id"], "ng")
    right, hb = prefixed(heads, "h_")
    probe = accidental_probe(box(), F.col("shift"))
    area = intersection_area(probe, hb)
    pairs = grid_join(accidentals, right, keys=["page_id"], left_region=probe, right_region=hb, condition=area > 0, how="left")
    best = F.min(F.when(F.col("ng").isNotNull(), F.struct((-area).alias("a"), F.col("ng").alias("ng"))))
    return pairs.groupBy(*accidentals.columns).agg(best.alias("b")).select(
        *accidentals.columns, F.col("b.ng").alias("ng"), F.col("b").isNull().alias("maybe_key_signature"))


def next_accidental(accidentals: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The accidental that starts within half a width to the right at the same height: edges of chains, from the accidentals `of` (all)."""
    others = collapse_copies(accidentals.withColumnRenamed("acc_id", "next_id"), ["page_id"], "next_id")
    right, nb = prefixed(others, "n_")
    b = box()
    probe = Box(b.x1, b.y0, b.x1 + F.floor((b.x1 - b.x0) / 2), b.y1)
    pairs = grid_join(accidentals if of is None else of, right, keys=["page_id"], left_region=probe, right_region=nb,
                      condition=intersection_area(probe, nb) > 0)  # the probe starts right of its own box
    return pairs.groupBy("page_id", "acc_id").agg(F.min("next_id").alias("next_id"))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """End of each chain and the steps to it; edges come page by page."""
    def ends() -> pa.RecordBatch:
        known: dict = {}
        for start in ahead:
            path, at = [], start
            while at in ahead and at not in known:
                path.append(at)
                at = ahead[at]
            end, steps = known.get(at, (at, 0))
            for node in reversed(path):
                steps += 1
                known[node] = (end, steps)
        columns = ([page] * len(ahead), list(ahead), [known[a][0] for a in ahead], [known[a][1] for a in ahead])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["page_id", "acc_id", "end_id", "steps"])

    page, ahead, kinds = None, {}, ()
    for batch in batches:
        kinds = [*(batch.schema.field(c).type for c in ("page_id", "acc_id", "acc_id")), pa.int64()]
        for at, acc, following in zip(*(batch.column(c).to_pylist() for c in ("page_id", "acc_id", "next_id"))):
            if at != page:
                if ahead:
                    yield ends()
                page, ahead = at, {}
            ahead[acc] = following
    if ahead:
        yield ends()


def chain_ends(edges: DataFrame, *, max_links: int = MAX_LINKS) -> DataFrame:
    """The end of the chain each accidental is in, and the number of steps to it.

    `edges(page_id, acc_id, next_id)` has one row per accidental that is followed by another. The chains of a page are followed in one pass in the
    page's task; pages of more than `max_links` edges are ranked by pointer doubling. Edges lead to the right, so there are no rings.
    """
    ship_package(edges.sparkSession)
    small, large = split_by_size(cut_lineage(edges.select("page_id", "acc_id", "next_id")), ["page_id"], max_links)
    kind = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    out = small.repartition("page_id").sortWithinPartitions("page_id").mapInArrow(
        _followed, f"page_id {kind['page_id']}, acc_id {kind['acc_id']}, end_id {kind['acc_id']}, steps bigint")
    return out if large is None else out.unionByName(_doubled(large))


def _doubled(edges: DataFrame) -> DataFrame:
    """List ranking by pointer doubling: every round each pointer skips to where its target points, so that chains of n take log2(n) rounds."""
    state = cut_lineage(edges.select("page_id", "acc_id", F.col("next_id").alias("end_id"), F.lit(1).cast("long").alias("steps")))
    while True:
        ahead = state.select("page_id", F.col("acc_id").alias("end_id"), F.col("end_id").alias("further"), F.col("steps").alias("more"))
        moved = cut_lineage(state.join(ahead, ["page_id", "end_id"], "left").select(
            "page_id", "acc_id", F.coalesce("further", "end_id").alias("end_id"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("further").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return state


def accidental_chains(attached: DataFrame, heads: DataFrame) -> DataFrame:
    """What every accidental belongs to: `page_id, acc_id, end_id, steps, role, ng`.

    `attached(page_id, acc_id, shift, box, ng)` is the outcome of `accidental_to_note`, `heads(page_id, ng, chord_id, box)` the heads of chords. An
    accidental without a note leads to the next one at its height; the last of the chain decides for all. Where that one has no note, the chain is a
    `key_signature`. Otherwise each of the others goes to the head of that chord that its own height covers most (`chord`, lower id on
    ties), unless the chord is a `single_head`, no head is at that height (`no_head`), or the head is `taken`: by its own accidental,
    or by the farther one in a chain.
    """
    attached = cut_lineage(attached)  # the join with the heads runs once for the five places that read its outcome
    boxes = ["page_id", "acc_id", *box()]
    ends = chain_ends(next_accidental(attached.select(*boxes), attached.filter("ng IS NULL").select(*boxes)))
    ending = attached.select("page_id", F.col("acc_id").alias("end_id"), F.col("ng").alias("end_ng"))
    probe = accidental_probe(box(), F.col("shift"))
    rows = attached.select("page_id", "acc_id", "ng", probe.y0.alias("py0"), probe.y1.alias("py1"))
    rows = rows.join(ends, ["page_id", "acc_id"], "left").withColumns({"end_id": F.coalesce("end_id", "acc_id"), "steps": F.coalesce("steps", F.lit(0))})
    rows = rows.join(ending, ["page_id", "end_id"])
    heads = collapse_copies(heads, ["page_id", "chord_id"], "ng")
    sizes = heads.groupBy("page_id", "chord_id").agg(F.count("*").alias("n_heads"))
    chord = heads.join(sizes, ["page_id", "chord_id"]).select("page_id", F.col("ng").alias("end_ng"), "chord_id", "n_heads")
    rows = cut_lineage(rows.join(chord, ["page_id", "end_ng"], "left"))

    reach = rows.filter("ng IS NULL AND n_heads > 1").select("page_id", "acc_id", "steps", "chord_id", "py0", "py1")
    shared = F.least("py1", "y1") - F.greatest("py0", "y0")
    met = reach.join(heads, ["page_id", "chord_id"]).filter(shared > 0)
    best = met.groupBy("page_id", "acc_id", "steps").agg(F.min(F.struct((-shared).alias("s"), F.col("ng").alias("ng")))["ng"].alias("head"))
    first = best.groupBy("page_id", "head").agg(F.min(F.struct((-F.col("steps")).alias("s"), "acc_id"))["acc_id"].alias("first"))
    own = attached.filter("ng IS NOT NULL").select("page_id", F.col("ng").alias("head"), F.lit(True).alias("owned")).distinct()
    won = best.join(first, ["page_id", "head"]).join(own, ["page_id", "head"], "left")
    won = won.select("page_id", "acc_id", "head", (F.col("owned").isNull() & (F.col("first") == F.col("acc_id"))).alias("won"))
    role = (F.when(F.col("ng").isNotNull(), "note").when(F.col("end_ng").isNull(), "key_signature").when(F.col("n_heads") == 1, "single_head")
            .when(F.col("head").isNull(), "no_head").when(F.col("won"), "chord").otherwise("taken"))
    out = rows.join(won, ["page_id", "acc_id"], "left").withColumn("role", role)
    return out.select("page_id", "acc_id", "end_id", "steps", "role", F.when(F.col("role") == "chord", F.col("head")).otherwise(F.col("ng")).alias("ng"))


def dot_window(b: Box, unit: Column, is_rest: Column) -> Box:
    """Right of a note from one unit above to one and a half below its top; right of a rest two units down."""
    return Box(b.x1, F.when(is_rest, b.y0).otherwise(F.greatest(F.lit(0), b.y0 - unit)), b.x1 + 2 * unit,
               b.y0 + F.when(is_rest, 2 * unit).otherwise(F.floor(unit * 1.5)))


def attach_dots(heads: DataFrame, dots: DataFrame) -> DataFrame:
    """Flag the heads and rests with a dot whose center lies in their window.

    `heads(page_id, head_id, unit, is_rest, box)`, `dots(page_id, box)`. Only distinct dot positions
    are joined and only distinct heads come back, so copies do not multiply.
    """
    centers = dots.select("page_id", box().cx.alias("d_x"), box().cy.alias("d_y")).distinct()
    window = dot_window(box(), F.col("unit"), F.col("is_rest"))
    at = Box(F.col("d_x"), F.col("d_y"), F.col("d_x"), F.col("d_y"))
    hit = grid_join(heads.select("page_id", "head_id", "unit", "is_rest", *box()), centers, keys=["page_id"], left_region=window,
                    right_region=at).select("page_id", "head_id").distinct().withColumn("has_dot", F.lit(True))
    return heads.join(hit, ["page_id", "head_id"], "left").fillna(False, ["has_dot"])


def absorb_rests(rests: DataFrame, groups: DataFrame) -> DataFrame:
    """Rests that share x with a note group of their staff, with the first such group.

    `rests(page_id, staff_index, rest_id, box)`, `groups(page_id, staff_index, ng, box)`.
    """
    spans = groups.groupBy("page_id", "staff_index", F.col("x0").alias("g0"), F.col("x1").alias("g1")).agg(F.min("ng").alias("ng"))
    zero = F.lit(0)
    pairs = grid_join(rests, spans, keys=["page_id", "staff_index"], left_region=Box(F.col("x0"), zero, F.col("x1"), zero),
                      right_region=Box(F.col("g0"), zero, F.col("g1"), zero), condition=(F.col("x0") < F.col("g1")) & (F.col("g0") < F.col("x1")))
    return pairs.groupBy("page_id", "rest_id").agg(F.min("ng").alias("ng"))


def drop_covered_by(boxes: DataFrame, covers: DataFrame, *, id_col: str, ratio: float = 0.5) -> DataFrame:
    """Boxes whose overlap with distinct covering boxes sums to at most `ratio` of their area."""
    right, cb = prefixed(covers.select("page_id", *box()).distinct(), "c_")
    shared = intersection_area(box(), cb)
    covered = grid_join(boxes, right, keys=["page_id"], left_region=box(), right_region=cb, condition=shared > 0)
    covered = covered.groupBy("page_id", id_col).agg(F.sum(shared).alias("shared"), F.max(box().area).alias("area"))
    return boxes.join(covered.filter(F.col("shared") > F.col("area") * ratio), ["page_id", id_col], "left_anti")


def median_band(boxes: DataFrame, *, value: Column, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Boxes whose measure lies within a band around the median of the page."""
    measured = boxes.withColumn("__m", value)
    medians = quantiles(measured, keys=["page_id"], value="__m", fractions={"median": 0.5})
    return measured.join(medians, "page_id").filter(
        F.col("__m").between(F.col("median") * low, F.col("median") * high)).drop("__m", "median")


def tall_lines(lines: DataFrame, *, min_height_units: float = 3.75) -> DataFrame:
    """Barline candidates of at least k units and more than half the mean of the page's five tallest.

    `lines(page_id, line_id, height, unit)`. The five tallest come from a bounded top-5.
    """
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("height"), "line_id"))
    top = lines.withColumn("__r", rank).filter(F.col("__r") <= 5).groupBy("page_id").agg(F.avg("height").alias("top"))
    return lines.join(top, "page_id").filter(
        (F.col("height") >= F.col("unit") * min_height_units) & (F.col("height") > 0.5 * F.col("top"))).drop("top")


def steep_lines(lines: DataFrame, min_degree: float = 75) -> DataFrame:
    """Lines at least `min_degree` from the horizontal."""
    b = box()
    return lines.filter(F.abs(F.degrees(F.atan2(b.y1 - b.y0, b.x1 - b.x0))) >= min_degree)


def inside_hull(lines: DataFrame, staff: DataFrame) -> DataFrame:
    """Lines inside the hull of the staves of their page."""
    hull = staff.groupBy("page_id").agg(F.min("left_x").alias("hx0"), F.max("right_x").alias("hx1"),
                                        F.min("y_top").alias("hy0"), F.max(F.col("y_top") + 4 * F.col("unit")).alias("hy1"))
    b = box()
    return lines.join(hull, "page_id").filter((b.x0 >= F.col("hx0")) & (b.x1 <= F.col("hx1")) & (b.cy >= F.col("hy0")) & (b.cy <= F.col("hy1"))).drop(
        "hx0", "hx1", "hy0", "hy1")


def size_filter(boxes: DataFrame, *, min_w: float = 0, min_h: float = 0, min_area: Column | float = 0, min_aspect: float = 0) -> DataFrame:
    """Boxes of at least the given width, height, area (which may depend on the unit) and aspect."""
    b = box()
    return boxes.filter((b.width >= min_w) & (b.height >= min_h) & (b.area >= min_area) & (b.width >= b.height * min_aspect))


def in_zones(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    """Boxes whose center lies in the horizontal range of the page's zones."""
    span = zones.groupBy("page_id").agg(F.min("x0").alias("zx0"), F.max("x1").alias("zx1"))
    return boxes.join(span, "page_id").filter(box().cx.between(F.col("zx0"), F.col("zx1"))).drop("zx0", "zx1")


def split_fused(boxes: DataFrame, *, unit: Column, head_w: float = 1.3, head_h: float = 1.0) -> DataFrame:
    """Cut boxes of several fused noteheads on a regular grid of about one head per part."""
    b = box()
    cols, rows = (F.greatest(F.lit(1), F.rint(b.width / (unit * head_w))).cast("long"),
                  F.greatest(F.lit(1), F.rint(b.height / (unit * head_h))).cast("long"))
    out = boxes.withColumn("__nx", cols).withColumn("__ny", rows)
    out = out.withColumn("part_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__nx") - 1))).withColumn(
        "part_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__ny") - 1)))
    cut = lambda low, size, i, n: low + F.floor(size * i / n)
    return out.withColumns({
        "x0": cut(b.x0, b.width, F.col("part_x"), F.col("__nx")), "x1": cut(b.x0, b.width, F.col("part_x") + 1, F.col("__nx")),
        "y0": cut(b.y0, b.height, F.col("part_y"), F.col("__ny")), "y1": cut(b.y0, b.height, F.col("part_y") + 1, F.col("__ny"))}).drop("__nx", "__ny")


def relabel_clefs(clefs: DataFrame) -> DataFrame:
    """Drop clefs lower than three units; an alto clef that starts a third of a unit above the staff is a tenor clef."""
    b = box()
    return clefs.filter(b.height >= 3 * F.col("unit")).withColumn("clef", F.when(
        (F.col("clef") == 0) & (b.y0 < F.col("y_top") - F.col("unit") / 3), -2).otherwise(F.col("clef")))


def staff_step(y: Column, y_top: Column, unit: Column) -> Column:
    """Diatonic step of a height: 0 on the middle line, positive upwards, by nearest line or space."""
    return F.rint((y_top + 2 * unit - y) / (unit / 2)).cast("long")


def barlines_in_range(barlines: DataFrame) -> DataFrame:
    """Barlines that start and end within the staff range widened by a tenth (`range_top`, `range_bottom`)."""
    slack = F.floor((F.col("range_bottom") - F.col("range_top")) / 10)
    low, high = F.col("range_top") - slack, F.col("range_bottom") + slack
    return barlines.filter((F.col("y0") >= low) & (F.col("y0") < high) & (F.col("y1") >= low) & (F.col("y1") < high))


def rests_in_range(rests: DataFrame) -> DataFrame:
    """Rests higher than two lines (fifths of the range) that start or end within the staff range."""
    inside = lambda c: F.col(c).between(F.col("range_top"), F.col("range_bottom"))
    line = F.floor((F.col("range_bottom") - F.col("range_top") + 1) / 5)
    return rests.filter((inside("y0") | inside("y1")) & (F.abs(F.col("y1") - F.col("y0")) > 2 * line))


def note_to_the_right(boxes: DataFrame, heads: DataFrame) -> DataFrame:
    """The first head within one unit to the right of each box at the height of its center.

    `boxes` has `unit`; heads at the same left edge give the lower id. All boxes stay.
    """
    first = heads.groupBy("page_id", *(F.col(n).alias("h_" + n) for n in Box._fields)).agg(F.min("ng").alias("ng"))
    b, hb = box(), Box(*(F.col("h_" + n) for n in Box._fields))
    cy = F.bround(b.cy, 0)
    probe = Box(b.x1, cy, b.x1 + F.bround("unit", 0) - 1, cy)
    reach = Box(hb.x0, hb.y0, hb.x1 - 1, hb.y1 - 1)
    pairs = grid_join(boxes, first, keys=["page_id"], left_region=probe, right_region=reach, how="left")
    best = F.min(F.when(F.col("ng").isNotNull(), F.struct(F.greatest(hb.x0, b.x1).alias("x"), F.col("ng").alias("ng"))))
    return pairs.groupBy(*boxes.columns).agg(best.alias("b")).select(*boxes.columns, F.col("b.ng").alias("ng"))


def staff_of_note(closest: DataFrame) -> Column:
    """Staff of a note between two staves: the first inside its lines, otherwise split at the midpoint."""
    a, b, y = F.col("first"), F.col("second"), F.col("y")
    inside = (a["center_y"] == b["center_y"]) | y.between(a["y_upper"], a["y_lower"])
    upper = F.when(a["center_y"] < b["center_y"], a).otherwise(b)
    lower = F.when(a["center_y"] < b["center_y"], b).otherwise(a)
    return F.when(inside, a["staff_index"]).when(y < (upper["center_y"] + lower["center_y"]) / 2, upper["staff_index"]).otherwise(lower["staff_index"])


def reassign_groups(groups: DataFrame, ranges: DataFrame) -> DataFrame:
    """Staff of a group whose top or bottom edge lies in one staff range and in no neighbouring one.

    `ranges(page_id, staff_index, range_top, range_bottom, next_top, prev_bottom)`. Distinct ranges and distinct edges of a
    page are compared, which its height bounds. Other groups keep their staff.
    """
    r = ranges.select("page_id", F.col("staff_index").alias("r_staff"), "range_top", "range_bottom", "next_top", "prev_bottom").distinct()
    edge = lambda c: F.col(c).between(F.col("range_top"), F.col("range_bottom"))
    fits = ((edge("y0") | edge("y1")) & (F.col("next_top").isNull() | (F.col("y1") < F.col("next_top")))
            & (F.col("prev_bottom").isNull() | (F.col("y0") > F.col("prev_bottom"))))
    edges = groups.select("page_id", "y0", "y1").distinct()
    hit = edges.join(r, "page_id").filter(fits).groupBy("page_id", "y0", "y1").agg(F.max("r_staff").alias("new_staff"))
    return groups.join(hit, ["page_id", "y0", "y1"], "left").select(groups.columns + ["new_staff"]).withColumn("staff_index", F.coalesce("new_staff", "staff_index")).drop("new_staff")


def bar_elements_only(groups: DataFrame) -> DataFrame:
    """Note groups that count in a bar: not ornaments only, and not beamed while all heads are quarters or longer.

    One row per head with `chunk`, `rhythm`, `is_ornament`; quarters have code 0.
    """
    kept = groups.groupBy("page_id", "ng").agg(F.min("is_ornament").alias("only_ornaments"), F.max("rhythm").alias("shortest"),
                                              F.max("chunk").alias("chunk"))
    ok = kept.filter(~F.col("only_ornaments") & ~(F.col("chunk").isNotNull() & (F.col("shortest") <= 0)))
    return groups.join(ok.select("page_id", "ng"), ["page_id", "ng"], "left_semi")
