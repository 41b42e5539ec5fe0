"""Preconditions stop a job and name the offender."""

import pytest
from pyspark.sql import functions as F

from scorelake.operators import detect
from scorelake.operators.preconditions import require, require_columns, require_known, require_unique

DET = "page_id int, class_id bigint, x0 int, y0 int, x1 int, y1 int"


def failure(df):
    """Message of the failed job; a function is called first, as small tables are counted while a plan is made."""
    with pytest.raises(Exception) as error:
        (df() if callable(df) else df).collect()
    return str(error.value)


def test_an_unknown_class_stops_the_job(spark):
    names = spark.createDataFrame([(1, "accent", "above"), (2, "trill", None)], "class_id bigint, class_name string, side string")
    good = [(0, 1, 1, 2, 3, 4), (0, 2, 1, 2, 3, 4)]
    done = detect.export_candidates(spark.createDataFrame(good, DET), names)
    assert sorted((r["class_name"], r["side"] or "", r["association_status"], r["matched_ng"]) for r in done.collect()) == [
        ("accent", "above", "unmatched", None), ("trill", "", "unmatched", None)]
    bad = spark.createDataFrame([*good, (0, 77, 1, 2, 3, 4)], DET)
    assert "unknown class: 77" in failure(detect.export_candidates(bad, names))
    assert "unknown class: 77" in failure(detect.export_candidates(bad, names).groupBy("class_name").count())
    assert "unknown class: NULL" in failure(detect.export_candidates(spark.createDataFrame([(0, None, 1, 2, 3, 4)], DET), names))
    twice = names.union(names.limit(1))
    assert "repeated key: class_id 1" in failure(lambda: detect.export_candidates(spark.createDataFrame(good, DET), twice))
    with pytest.raises(ValueError, match="x1"):
        detect.export_candidates(spark.createDataFrame(good, DET).drop("x1"), names)


def test_conditions_keys_and_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert require(df, F.col("id") > 0, "never").count() == 3
    assert "small: 1" in failure(require(df, F.col("id") > 1, F.concat(F.lit("small: "), "id")))
    assert "null" in failure(require(df, F.lit(None).cast("boolean"), "null"))
    assert "repeated key: id 2" in failure(require_unique(df, "id"))
    assert sorted(tuple(r) for r in require_unique(df.distinct(), "id", "v").collect()) == [(1, "a"), (2, "b")]
    assert require_columns(df, "id") is df
    assert require_known(df, spark.createDataFrame([(1,), (2,)], "id int"), "id", "id").count() == 3
