"""Note lengths changed as little as possible so that bars add up.

Lengths are whole units (a power-of-two fraction of a whole note). Each element has a short list of
moves (new length, cost) and the cheapest combination with the wanted sum is searched. One bar is
one row of an Arrow batch; the search is a small helper on the arrays of the row, remembered for
repeated rhythms, and Spark spreads the bars.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, floor, inf, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.vocabulary import WHOLE_TICKS
from scorelake.session import cut_lineage, ship_package

REST, SINGLE, GROUP = 1, 0, 2


def _exponent(value: float) -> int | None:
    """k when the value is 2^k, otherwise None."""
    whole = int(value)
    return whole.bit_length() - 1 if whole == value and whole > 0 and whole & (whole - 1) == 0 else None


def note_moves(length: int, weight: float, target: int) -> dict[int, float]:
    """Moves of one element of a bar: halved or doubled, dotted kinds, or deleted."""
    plain, dotted = _exponent(length), _exponent(length * 2 / 3)
    if plain is not None and length <= target:
        moves = {2 ** k: abs(k - plain) * weight for k in range(target.bit_length())}
        moves[0] = max(1.0, plain * weight) * 4 if weight == 1 else 1.0
        return moves
    if dotted and 2 ** dotted <= target:
        moves = {length << k: k * weight for k in range(16) if (length << k) <= target and 2 ** (dotted + k) < target}
        moves |= {2 ** (dotted - k): k * weight for k in range(dotted)}
        return moves if weight == 1 else moves | {0: 1.0}
    return {0: 0.0}


def single_moves(length: int, target: int) -> dict[int, float]:
    """Moves of a single note or rest when whole groups are adjusted (half weight)."""
    plain, dotted = _exponent(length), _exponent(length * 2 / 3)
    if plain is not None and length <= target:
        moves = {2 ** k: abs(k - plain) / 2 for k in range(target.bit_length())}
        if length % 2 == 0 and length * 3 // 2 < target:
            moves[length * 3 // 2] = 1.0
        return moves | {0: max(1.0, plain / 2 // 2)}
    if dotted is not None and length % 3 == 0 and length <= target:
        moves = {length >> k: k / 2 for k in range(dotted)}
        moves |= {length << k: k / 2 for k in range(16) if (length << k) <= target}
        return moves | {2 ** dotted: 1.0, 0: 1.0}
    return {0: 1.0}


@lru_cache(maxsize=4096)
def group_values(target: int, unit: int, ts_num: int) -> np.ndarray:
    """Cost of each total as a beamed group: 0 for powers of two and triple-metre beats, more for odd factors."""
    values = np.arange(target + 1)
    odd = np.maximum(values // np.maximum(values & -values, 1), 1)
    cost = 3.0 * np.floor(np.log2(odd))
    cost[(values >= 2 ** floor(log2(target))) & (odd > 1)] = inf
    if ts_num % 3 == 0:
        cost[(values > 0) & (values % (3 * unit) == 0) & (values <= unit * ts_num)] = 0.0
    cost[:2] = cost[2:].max() if target >= 2 else 0.0
    return cost


def group_moves(length: int, target: int, unit: int, ts_num: int) -> dict[int, float]:
    """Moves of a beamed group: distance in halvings or doublings plus the cost of the total."""
    values = np.arange(target + 1)
    steps = ceil(target / length)
    cost = group_values(target, unit, ts_num) + steps
    for k in range(1, steps):
        cost = cost - ((values >= round(length / 2 ** k)) & (values < length * 2 ** k))
    if length < target:
        cost[length] = 0.0
    return {int(v): float(cost[v]) for v in values if cost[v] < inf}


def cheapest(moves: list[dict[int, float]], target: int, extra: list[np.ndarray | None]) -> list[int]:
    """One value per element with the wanted sum and the lowest cost; ties keep the smaller earlier sum.

    Sums that nothing reaches cost infinity, so a bar without solution still adds up.
    """
    best = np.full(target + 1, inf)
    for value, cost in moves[0].items():
        best[value] = cost
    backs = []
    for options, more in zip(moves[1:], extra[1:]):
        total, back = np.full(target + 1, inf), np.zeros(target + 1, dtype=int)
        for value, cost in sorted(options.items(), reverse=True):
            reached = best[: target + 1 - value] + cost
            at = np.flatnonzero(reached < total[value:])
            total[at + value], back[at + value] = reached[at], at
        best = total if more is None else total + more
        backs.append(back)
    sums = [target]
    for back in reversed(backs):
        sums.append(int(back[sums[-1]]))
    return np.diff([0, *reversed(sums)]).tolist()


@lru_cache(maxsize=65536)
def _bar(lengths: tuple, weights: tuple, target: int) -> list[int]:
    return cheapest([note_moves(v, w, target) for v, w in zip(lengths, weights)], target, [None] * len(lengths))


@lru_cache(maxsize=65536)
def _groups(lengths: tuple, types: tuple, target: int, unit: int, ts_num: int) -> list[int]:
    sums = np.arange(target + 1)
    uneven = np.ceil(unit / np.maximum(sums & -sums, 1)) - 1
    moves = [group_moves(v, target, unit, ts_num) if t == GROUP else single_moves(v, target) for v, t in zip(lengths, types)]
    return cheapest(moves, target, [uneven if t == GROUP else None for t in types])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _solve_bar(lengths: pd.Series, weights: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([_bar(tuple(v.tolist()), tuple(w.tolist()), int(t)) for v, w, t in zip(lengths, weights, target)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _solve_groups(lengths: pd.Series, types: pd.Series, target: pd.Series, unit: pd.Series, ts_num: pd.Series) -> pd.Series:
    rows = zip(lengths, types, target, unit, ts_num)
    return pd.Series([_groups(tuple(v.tolist()), tuple(k.tolist()), int(t), int(u), int(n)) for v, k, t, u, n in rows], dtype=object)


def calibrate_bars(bars: DataFrame, *, lengths: str = "lengths", weights: str = "weights", target: str = "target",
                   name: str = "calibrated") -> DataFrame:
    """New lengths of each bar (arrays of whole units, weights of 1 or 0.5, target sum)."""
    ship_package(bars.sparkSession)
    return bars.withColumn(name, _solve_bar(F.col(lengths).cast("array<int>"), F.col(weights).cast("array<double>"), F.col(target).cast("int")))


def calibrate_groups(bars: DataFrame, *, lengths: str = "lengths", types: str = "types", target: str = "target",
                     unit: str = "unit", ts_num: str = "ts_num", name: str = "calibrated") -> DataFrame:
    """The same for whole groups, single notes (0) and rests (1); groups (2) prefer metric sums."""
    ship_package(bars.sparkSession)
    return bars.withColumn(name, _solve_groups(
        F.col(lengths).cast("array<int>"), F.col(types).cast("array<int>"), F.col(target).cast("int"),
        F.col(unit).cast("int"), F.col(ts_num).cast("int")))


def denominator(ticks: Column) -> Column:
    """Power-of-two denominator (at least 32) in which every length of an array is whole."""
    out = F.lit(256)
    for d in (128, 64, 32):
        out = F.when(F.forall(ticks, lambda t: (t * d) % WHOLE_TICKS == 0), d).otherwise(out)
    return out


def fill_group_ids(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Elements between the first and the last member of a beam group join the group (`run_group`)."""
    spans = elements.filter("group_id > 0").groupBy(*keys, "group_id").agg(
        F.min("elem_seq").alias("first"), F.max("elem_seq").alias("last"))
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("group_id", "first", "last"))).alias("spans"))
    inside = F.filter("spans", lambda s: (F.col("elem_seq") >= s["first"]) & (F.col("elem_seq") < s["last"]))
    joined = elements.join(listed, keys, "left")
    return joined.withColumn("run_group", F.coalesce(F.element_at(F.when(F.size(inside) > 0, inside), -1)["group_id"],
                                                     F.col("group_id"))).drop("spans")


def group_runs(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Number the runs of a bar: a beam group is one run, every other element its own.

    A bar holds at most one element per pixel, so its window is small.
    """
    by_seq = W.partitionBy(*keys).orderBy("elem_seq")
    before = F.lag("run_group").over(by_seq)
    starts = before.isNull() | (F.col("run_group") <= 0) | (before != F.col("run_group"))
    return elements.withColumn("__s", F.when(starts, 1).otherwise(0)).withColumn("run", F.sum("__s").over(by_seq)).drop("__s")


def end_trust(elements: Column) -> Column:
    """Which beam slopes of a group agree: array of booleans (all false without usable geometry)."""
    n = F.size(elements)
    slopes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.atan(
        (F.get(elements, i)["beam_y"] - F.get(elements, i - 1)["beam_y"])
        / F.nullif(F.get(elements, i)["beam_x"] - F.get(elements, i - 1)["beam_x"], F.lit(0))))
    known = F.forall(elements, lambda e: (e["beam_x"] != -1) & (e["beam_y"] != -1)) & F.forall(slopes, lambda s: s.isNotNull())
    limit = F.pi() / 18
    ordered = F.array_sort(slopes)
    m = F.size(ordered)
    middle = (F.get(ordered, F.floor((m - 1) / 2).cast("int")) + F.get(ordered, F.floor(m / 2).cast("int"))) / 2
    near = F.transform(slopes, lambda s: F.coalesce(F.abs(s - middle) < limit, F.lit(False)))
    same = F.abs(F.get(slopes, F.lit(1)) - F.get(slopes, F.lit(0))) <= limit
    return (F.when(~known, F.array_repeat(F.lit(False), n)).when(n <= 2, F.array_repeat(F.lit(False), 2))
            .when(n == 3, F.array_repeat(same, 3)).otherwise(near))


def real_lengths(elements: Column) -> Column:
    """Beam length seen at each stem; 0 where left and right disagree with all neighbours."""
    def at(e: Column, i: Column) -> Column:
        left, right = e["beam_l"], e["beam_r"]
        longer = F.greatest(left, right)
        before, after = F.get(elements, i - 1), F.get(elements, i + 1)
        fits = ((F.abs(right - left) <= left / 4) | (F.abs(before["beam_r"] - left) <= left / 4)
                | (F.abs(after["beam_l"] - right) <= left / 4))
        return (F.when(i == 0, right).when(i == F.size(elements) - 1, left).when(fits, longer).otherwise(0)).cast("double")

    return F.transform(elements, at)


def calibrate_runs(runs: DataFrame) -> DataFrame:
    """New ticks of the elements of each run (`elements` array, `desired` ticks) as array `new_ticks`.

    Nothing desired: all 0. Regular beams or equal lengths: an even split (a tuplet; the last
    element takes what does not divide). Otherwise the cheapest change, trusting well-beamed notes.
    """
    e = F.col("elements")
    n = F.size(e)
    trust, real = end_trust(e), real_lengths(e)
    work = runs.select("*", F.explode(F.array(trust)).alias("__trust"), ).select("*", F.explode(F.array(real)).alias("__real"))
    mean = F.aggregate("__real", F.lit(0.0), lambda a, v: a + v) / n
    regular = F.forall("__trust", lambda t: t) & F.forall("__real", lambda v: F.abs(v - mean) < F.greatest(F.lit(3.0), mean / 4))
    equal = F.size(F.array_distinct(F.transform(e, lambda x: x["ticks"]))) == 1
    share = F.floor(F.col("desired") / n)
    even = F.transform(e, lambda x, i: F.when(i == n - 1, F.col("desired") - share * (n - 1)).otherwise(share))
    extended = F.concat(F.array(F.lit(True)), F.col("__trust"), F.array(F.lit(True)))
    weights = F.when(F.exists("__trust", lambda t: t), F.transform(e, lambda x, i: F.when(
        F.get(extended, i) & F.get(extended, i + 1), 1.0).otherwise(0.5))).otherwise(
        F.transform(e, lambda x: F.when(x["is_rest"], 0.5).otherwise(1.0)))
    denom = denominator(F.transform(e, lambda x: x["ticks"]))
    split = work.withColumn("even", (n > 1) & (regular | equal) & (F.col("desired") > 0)).withColumn("denom", denom).withColumn("weights", weights)
    split = split.withColumn("lengths", F.transform(e, lambda x: F.floor(x["ticks"] * F.col("denom") / WHOLE_TICKS).cast("int")))
    split = split.withColumn("target", F.floor(F.col("desired") * F.col("denom") / WHOLE_TICKS).cast("int"))
    keep = runs.columns
    simple = split.filter(F.col("even") | (F.col("desired") == 0)).select(
        *keep, F.when(F.col("desired") == 0, F.transform(e, lambda _: F.lit(0).cast("long"))).otherwise(even).alias("new_ticks"))
    hard = calibrate_bars(split.filter(~F.col("even") & (F.col("desired") > 0)))
    hard = hard.select(*keep, F.transform("calibrated", lambda v: (v * F.floor(F.lit(WHOLE_TICKS) / F.col("denom"))).cast("long")).alias("new_ticks"))
    return simple.unionByName(hard)


ELEMENT = ("elem_seq", "ticks", "is_rest", "beam_l", "beam_r", "beam_x", "beam_y")


def tune_bars(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Tuned ticks of every element of the bars whose total differs from the time signature.

    `elements`: keys, `elem_seq`, `ticks`, `is_rest`, `group_id` (> 0 beamed, 0 single note, -1 rest),
    `beam_l/r/x/y`, `ts_num`, `ts_den`. Adds `tuned_ticks` and the rule used (`tune_case`).
    """
    target = F.floor(F.lit(WHOLE_TICKS) * F.col("ts_num") / F.col("ts_den"))
    runs = cut_lineage(group_runs(fill_group_ids(elements, keys), keys))
    half_rest = (F.col("run_group") > 0) & F.col("is_rest") & (F.col("ticks") == WHOLE_TICKS // 2)
    runs = runs.withColumn("ticks", F.when(half_rest, 0).otherwise(F.col("ticks")))
    grouped = F.col("run_group") > 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("ticks"))), F.lit(0))
    facts = runs.groupBy(*keys, "ts_num", "ts_den").agg(
        F.sum("ticks").alias("total"), F.count_distinct(F.when(grouped, F.col("run"))).alias("n_groups"),
        F.count(F.when(grouped, 1)).alias("n_grouped"), F.count(F.when(F.col("run_group") == 0, 1)).alias("n_notes"),
        F.count(F.when(F.col("run_group") == -1, 1)).alias("n_rests"),
        total((grouped & ~F.col("is_rest")) | (F.col("run_group") == 0)).alias("note_ticks"),
        total(~grouped).alias("single_ticks")).withColumn("target_ticks", target)
    beat = F.floor(F.lit(WHOLE_TICKS) / F.col("ts_den"))
    alone = (F.col("n_notes") == 0) & (F.col("n_rests") == 0)
    case = (F.when((F.col("total") == F.col("target_ticks")) | (F.col("total") == 0), "unchanged")
            .when((F.col("n_groups") == F.col("ts_num")) & alone, "one_beat_per_group")
            .when((F.col("n_groups") > 0) & ((F.col("ts_num") % F.col("n_groups")) == 0) & alone, "even_groups")
            .when(((F.col("n_groups") == 0) | (F.col("n_grouped") == F.col("n_groups"))) & (F.col("n_notes") == 0), "only_rests")
            .when(F.col("note_ticks") == F.col("target_ticks"), "notes_fit")
            .when((F.col("n_groups") < F.col("ts_num")) & (F.col("single_ticks") + F.col("n_groups") * beat == F.col("target_ticks")),
                  "singles_and_beats").otherwise("calibrate_groups"))
    facts = facts.withColumn("tune_case", case).withColumn("beat", beat)
    listed = runs.groupBy(*keys, "run").agg(
        F.array_sort(F.collect_list(F.struct(*ELEMENT))).alias("elements"), F.max("run_group").alias("run_group"),
        F.sum("ticks").alias("run_ticks")).join(facts, keys)
    listed = cut_lineage(listed)  # the branches below read it
    n = F.size("elements")
    as_is = F.transform("elements", lambda e: e["ticks"].cast("long"))
    is_group = F.col("run_group") > 0
    # branches that need no search
    direct = listed.filter(F.col("tune_case").isin("unchanged", "only_rests", "notes_fit")).withColumn(
        "new_ticks", F.when(F.col("tune_case") == "only_rests", F.transform("elements", lambda e, i: F.when(
            (F.col("run") == 1) & (i == 0), F.col("target_ticks")).otherwise(0).cast("long")))
        .when(F.col("tune_case") == "notes_fit", F.transform("elements", lambda e: F.when(e["is_rest"], 0).otherwise(e["ticks"]).cast("long")))
        .otherwise(as_is))
    # one beat (or an equal share of the bar) per group
    share = F.when(F.col("tune_case") == "even_groups", F.floor(F.col("ts_num") / F.greatest(F.col("n_groups"), F.lit(1))) * F.col("beat")).otherwise(F.col("beat"))
    beats = listed.filter(F.col("tune_case").isin("one_beat_per_group", "even_groups", "singles_and_beats")).withColumn("desired", share)
    searched = is_group & ((n > 1) | (F.col("tune_case") == "one_beat_per_group"))
    kept = beats.filter(~searched).drop("desired").withColumn("new_ticks", as_is)
    wanted = beats.filter(searched)
    # groups, singles and rests adjusted together
    hard = listed.filter(F.col("tune_case") == "calibrate_groups")
    bars = hard.groupBy(*keys, "ts_num", "ts_den", "target_ticks").agg(F.array_sort(F.collect_list(F.struct(
        "run", F.col("run_ticks").alias("ticks"), F.when(is_group, GROUP).when(F.col("run_group") == -1, REST).otherwise(SINGLE).alias("type")))).alias("r"))
    bars = bars.withColumn("denom", denominator(F.transform("r", lambda x: x["ticks"])))
    units = lambda t: F.floor(t * F.col("denom") / WHOLE_TICKS).cast("int")
    bars = bars.select("*", F.transform("r", lambda x: F.greatest(units(x["ticks"]), F.lit(1))).alias("lengths"), F.transform("r", lambda x: x["type"]).alias("types"),
                       units(F.col("target_ticks")).alias("target"), F.floor(F.col("denom") / F.col("ts_den")).alias("unit"))
    solved = calibrate_groups(bars).select(*keys, "denom", F.explode(F.arrays_zip("r", "calibrated")).alias("z")).select(
        *keys, F.col("z.r.run").alias("run"), (F.col("z.calibrated") * F.floor(F.lit(WHOLE_TICKS) / F.col("denom"))).cast("long").alias("desired"))
    settled = cut_lineage(hard.join(solved, [*keys, "run"]))
    same = settled.filter(F.col("desired") == F.col("run_ticks")).drop("desired").withColumn("new_ticks", as_is)
    lone = settled.filter((F.col("desired") != F.col("run_ticks")) & (n == 1)).withColumn("new_ticks", F.array("desired")).drop("desired")
    more = settled.filter((F.col("desired") != F.col("run_ticks")) & (n > 1))
    calibrated = calibrate_runs(wanted.unionByName(more)).drop("desired")
    out = direct.unionByName(kept).unionByName(same).unionByName(lone).unionByName(calibrated)
    rows = out.select(*keys, "tune_case", "target_ticks", F.explode(F.arrays_zip("elements", "new_ticks")).alias("z"))
    return rows.select(*keys, "tune_case", "target_ticks", F.col("z.elements.elem_seq").alias("elem_seq"),
                       F.col("z.elements.ticks").alias("ticks"), F.col("z.new_ticks").alias("tuned_ticks"))
