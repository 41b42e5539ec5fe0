"""Registered queries on repeated tables with shifted keys, against their SQL."""

import sys
from itertools import takewhile
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from compare import canonical  # noqa: E402

SF = "/root/testdata/sf0.001"


def compared(spark, sf_dir, name):
    """The rows of a query and of its SQL over a folder with `orders` and `lineitem`."""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return canonical(queries()[name](spark, str(sf_dir)).toArrow()), canonical(con.sql(oracle_sql()[name]).to_arrow_table())


@pytest.fixture(scope="module")
def far_pages(tmp_path_factory):
    """sf0.001 twice, the second time with page numbers from 100,000 on."""
    folder = tmp_path_factory.mktemp("far")
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        duckdb.sql(f"COPY (SELECT * REPLACE ({key} + c * 2500000 AS {key}) FROM (SELECT t.*, c FROM '{SF}/{t}.parquet' t, range(2) r(c))) TO '{folder}/{t}.parquet'")
    return folder


@pytest.mark.parametrize("name", ["box_issues", "source_issues", "reference_issues", "trace_issues"])
def test_foreign_annotations_beside_many_pages(spark, far_pages, name):
    """Page numbers reach those that stand for foreign images."""
    got, want = compared(spark, far_pages, name)
    assert got == want and got


def broadcast(df):
    """For each broadcast of a plan, its lines."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    parts = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [m for m in range(k + 1, len(lines)) if depth(lines[m]) <= depth(line)]
            parts.append(lines[k:below[0] if below else len(lines)])
    return parts


@pytest.mark.parametrize("name", ["manifest_issues", "zone_fill"])
def test_exploded_pages_are_not_broadcast(spark, name):
    """The planner sees the pages, not the rows that an `explode` makes of them, unless an aggregate follows."""
    for part in broadcast(queries()[name](spark, SF)):
        assert not any("Generate explode" in line for line in takewhile(lambda line: "Aggregate" not in line, part))
