"""Line dedup by winnowing over line hashes (built-in functions only).

Lines are hashed, GRAM neighbouring ones together, and of each WINDOW neighbouring grams the smallest is a fingerprint: every repeated
run of GRAM + WINDOW - 1 lines holds one. With a window of 1, the default, every gram is one, and a gram's lines are deleted if the gram has
any earlier place: a run of GRAM lines or more goes wherever its parts were seen before, and one line alone if it has LONG characters.

With larger windows a fingerprint is joined to the first place in the table that has it; the match is extended both ways along its diagonal
as long as lines are equal, and the later of two equal runs of at least GRAM lines is deleted. Runs that share only a fingerprint with that
first place, but more with a later one, stay in part; only a window of 1 finds them whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import join_copies, staged, text_or_empty

GRAM, WINDOW = 2, 1
#: Characters, without white space at the ends, from which a line that was seen before goes by itself.
LONG = 100
BLANKS = " \t\n\x0b\x0c\r"


def _fingerprints(lines: Column, gram: int, window: int) -> Column:
    """Places and hashes of the window minima, the last of equal ones; a text of fewer grams than a window has one."""
    grams = F.transform(F.sequence(F.lit(0), F.size(lines) - gram), lambda i: F.struct(F.xxhash64(F.slice(lines, i + 1, gram)).alias("g"), (-i).alias("m")))
    count = F.size(grams)
    last = F.greatest(count - window, F.lit(0))
    minima = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_min(F.slice(grams, i + 1, window)))
    return F.when(F.size(lines) >= gram, F.array_distinct(minima)).otherwise(F.slice(F.array(F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).alias("m"))), 1, 0))


def _seen_before(rows: DataFrame, gram: int) -> DataFrame:
    """`uid, places`: the lines of grams, and the long lines, that have an earlier place in the table."""
    grams = F.when(F.size("lines") >= gram, F.transform(F.sequence(F.lit(0), F.size("lines") - gram), lambda i: F.struct(
        F.xxhash64(F.slice("lines", i + 1, gram)).alias("g"), i.alias("at"), F.lit(gram).alias("n"))))
    alone = F.transform("long", lambda i: F.struct(F.xxhash64(F.slice("lines", i + 1, 1)).alias("g"), i.alias("at"), F.lit(1).alias("n")))
    marks = staged(rows.select("uid", "doc_id", F.explode(F.concat(F.coalesce(grams, F.slice(alone, 1, 0)), alone)).alias("m"))
                   .select("uid", "doc_id", "m.*"), "marks")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid", "at")
    firsts = staged(marks.groupBy("g").agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
                    .select("g", "copies", F.col("first.uid").alias("source"), F.col("first.at").alias("source_at")), "firsts")
    later = join_copies(marks.select("uid", "g", "at", "n"), firsts, "g", "copies").filter("uid <> source OR at <> source_at")
    places = later.select("uid", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("place"))
    return places.groupBy("uid").agg(F.sort_array(F.collect_set("place")).alias("places"))


def repeated_lines(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, long: int | None = None) -> DataFrame:
    """Staged rows `uid, doc_id, text, n_lines, removed`: the numbers of the lines (from 0) that are later parts of a repeated run.

    Blank lines are no part of runs and stay. Lines are equal without white space at their ends. Earlier means smaller `doc_id`
    (nulls last, then table order), or further up in the same document. Texts with fewer lines than a gram (or null) keep all, but for lines
    of `long` characters or more, which go without neighbours too; these need a window of 1.
    """
    if long is not None and window > 1:
        raise ValueError("long lines by themselves need a window of 1")
    parts = F.split(text_or_empty(), "\n", -1)
    hashed = F.transform(parts, lambda line, i: F.struct(F.trim(line, F.lit(BLANKS)).alias("t"), i.alias("i")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid"),
                       F.filter(hashed, lambda x: F.length(x["t"]) > 0).alias("filled"))
    far = F.filter(F.transform("filled", lambda x, k: F.when(F.length(x["t"]) >= (1 << 30 if long is None else long), k)), lambda k: k.isNotNull())
    rows = staged(rows.select(
        "doc_id", "text", "uid", F.size(F.split(text_or_empty(), "\n", -1)).alias("n_lines"),
        F.struct(F.col("doc_id").isNull(), "doc_id", "uid").alias("order"),
        F.transform("filled", lambda x: F.xxhash64(x["t"])).alias("lines"), F.transform("filled", lambda x: x["i"]).alias("numbers"), far.alias("long")), "lines")
    if window == 1:
        return _numbered(rows, _seen_before(rows, gram))

    marks = rows.select("uid", "order", F.explode(_fingerprints(F.col("lines"), gram, window)).alias("f")).select(
        "uid", "order", F.col("f.g").alias("g"), (-F.col("f.m")).alias("at"))
    marks = staged(marks, "marks")
    firsts = staged(marks.groupBy("g").agg(F.min(F.struct("order", "at", "uid")).alias("first"), F.count("*").alias("copies"))
                    .filter("copies > 1").select("g", "copies", F.col("first.uid").alias("source"), F.col("first.at").alias("source_at")), "firsts")
    matches = (join_copies(marks.select("uid", "g", "at"), firsts, "g", "copies")
               .filter("uid <> source OR at <> source_at").select("uid", "source", (F.col("at") - F.col("source_at")).alias("shift")).distinct())

    own = rows.select("uid", "lines")
    other = rows.select(F.col("uid").alias("source"), F.col("lines").alias("theirs"))
    pairs = matches.join(own, "uid").join(other, "source")
    low, high = F.greatest(F.lit(0), F.col("shift")), F.least(F.size("lines"), F.size("theirs") + F.col("shift"))
    equal = F.filter(F.sequence(low, high - 1), lambda i: F.get("lines", i) == F.get("theirs", i - F.col("shift")))
    # a place is in a run of `gram` if one of the windows of that length around it is all equal
    starts = F.filter("equal", lambda i: F.array_contains("equal", i + gram - 1)) if gram == 2 else F.filter(
        "equal", lambda i: F.forall(F.sequence(F.lit(0), F.lit(gram - 1)), lambda k: F.array_contains("equal", i + k)))
    run = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + gram - 1))))
    gone = (pairs.select("uid", equal.alias("equal")).select("uid", F.explode(run).alias("place")).distinct()
            .groupBy("uid").agg(F.sort_array(F.collect_list("place")).alias("places")))
    return _numbered(rows, gone)


def _numbered(rows: DataFrame, gone: DataFrame) -> DataFrame:
    found = rows.drop("lines", "order", "long").join(gone, "uid", "left")
    numbers = F.coalesce(F.transform("places", lambda p: F.get("numbers", p)), F.array().cast("array<int>"))
    return found.select("uid", "doc_id", "text", "n_lines", numbers.alias("removed"))


def without_repeats(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, long: int | None = None) -> DataFrame:
    """`doc_id, n_lines, removed, text` per document: the text without its repeated runs, a null text as it is."""
    found = repeated_lines(docs, gram=gram, window=window, long=long)
    rest = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("removed", i))
    return found.select("doc_id", "n_lines", "removed", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"))
