"""Telling ordinary groups from oversized ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.session import cut_lineage


def split_by_size(df: DataFrame, keys: Sequence[str], max_group: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups up to `max_group`, and the rows of larger groups (None when there are none)."""
    large = df.groupBy(*keys).count().filter(F.col("count") > max_group).select(*keys)
    if large.isEmpty():
        return df, None
    large = cut_lineage(large)
    return df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")
