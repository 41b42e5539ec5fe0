"""Page-like tables derived from the driver tables.

Every view is a projection of `lineitem` (or of the distinct pages of `orders`) in integer
arithmetic, without joins, windows or shuffles, and the same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.sources.tables import read_table

LINE = """SELECT CAST(floor(l_orderkey / 25) AS BIGINT) AS page_id,
  l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS qty, CAST(l_linenumber AS BIGINT) AS ln,
  ((((l_orderkey % 25) * 8 + l_linenumber) * 16777216 + l_partkey) * 1048576 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS uid,
  l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 + l_suppkey * 3 + CAST(l_quantity AS BIGINT) AS h
  FROM lineitem"""

OBJECT = """SELECT page_id, pk, sk, uid, h, h % 40 AS obj_class,
  100 + (h * 7919 + pk * 104729) % 1700 AS px, 60 + (h * 6151 + sk * 3571) % 2600 AS py,
  8 + (h * 13) % 24 AS pw, 6 + (h * 17) % 20 AS ph FROM li"""

COPY = "SELECT *, {unnest2} AS j FROM ob"

DET = """SELECT page_id, uid * 2 + j AS det_seq, uid AS obj, obj_class AS class_id,
  px + j * (pk % 5 - 2) AS x0, py + j * (sk % 3 - 1) AS y0,
  px + pw + j * (pk % 5 - 2) AS x1, py + ph + j * (sk % 3 - 1) AS y1,
  30 + (pk * 7 + sk * 3 + j * 11) % 70 AS conf_pct FROM dc"""

GT = """SELECT page_id, uid AS gt_seq, CASE WHEN h % 11 = 0 THEN (h + 1) % 40 ELSE obj_class END AS class_id,
  px AS x0, py AS y0, px + pw AS x1, py + ph AS y1 FROM ob WHERE h % 9 <> 0"""

NOTE_BASE = """SELECT page_id, uid AS ng, (pk + sk) % 8 AS staff_index, (pk * 5 + sk * 3 + ln * 7) % 16 AS slot,
  16 + (page_id % 5) * 2 AS unit, pk % 13 - 6 AS pitch, qty % 4 AS rhythm,
  CASE WHEN pk % 10 = 0 THEN 1 ELSE 0 END AS has_dot, CASE WHEN sk % 12 = 0 THEN 1 ELSE 0 END AS is_rest,
  CASE WHEN pk % 7 = 0 THEN sk % 3 - 1 END AS accidental, pk, sk, qty, h FROM li"""

NOTE = """SELECT page_id, ng, staff_index, staff_index % 4 AS track, CAST(floor(staff_index / 4) AS BIGINT) AS system_no,
  slot, CAST(floor(slot / 4) AS BIGINT) AS bar_in_line, pitch, rhythm, has_dot, is_rest, accidental, unit,
  150 + slot * 100 AS x0, 150 + 310 * staff_index + 2 * unit - CAST(floor((pitch + 6) * unit / 2) AS BIGINT) + 3 * unit AS y0,
  150 + slot * 100 + 12 AS x1, 150 + 310 * staff_index + 3 * unit - CAST(floor((pitch + 6) * unit / 2) AS BIGINT) + 3 * unit AS y1,
  pk, sk, qty, h FROM nb"""

PAGE = "SELECT DISTINCT CAST(floor(o_orderkey / 25) AS BIGINT) AS page_id FROM orders"

STAFF = """SELECT page_id, staff_index, CAST(floor(staff_index / 4) AS BIGINT) AS system_no, staff_index % 4 AS track,
  100 AS left_x, 1860 AS right_x, 150 + 310 * staff_index AS y_top, 16 + (page_id % 5) * 2 AS unit
  FROM (SELECT page_id, {unnest} AS staff_index FROM page)"""

CURVE = """SELECT page_id, ng AS candidate_id, staff_index, unit, x0 + 6 + (qty % 9 - 4) AS left_x, y0 - 10 AS left_y,
  x0 + 6 + (qty % 9 - 4) + 100 * (1 + h % 2) + sk % 7 AS right_x, y0 - 10 + (sk % 5) * 8 AS right_y, 60 + h % 40 AS conf_pct,
  CASE WHEN h % 3 = 0 THEN 'below' ELSE 'above' END AS curve_direction FROM note"""

CURVE_COLUMN = """SELECT page_id, uid AS component, px, py, h, pk, 12 + h % 16 AS n, {unnest28} AS i FROM ob"""

CURVE_PIXEL = """SELECT page_id, component, px + i AS x,
  py + CAST(floor((3 + pk % 9) * 4 * i * (n - 1 - i) / (n * n)) AS BIGINT) + (i * pk) % 2 + j AS y
  FROM (SELECT *, {unnest2} AS j FROM curve_column WHERE i < n AND (i * 7 + pk) % 11 <> 0)"""

LETTER = """SELECT page_id, ng * 2 + j AS cand_seq, staff_index, unit, substr('pmfszr', CAST((qty + j * sk) % 6 + 1 AS INT), 1) AS letter,
  x0 + j * 14 AS x0, 150 + 310 * staff_index + 5 * unit + sk % 9 AS y0, x0 + j * 14 + 12 AS x1, 150 + 310 * staff_index + 6 * unit + sk % 9 AS y1,
  40 + h % 60 AS conf_pct FROM (SELECT *, {unnest2} AS j FROM note)"""

VIEWS = {"li": LINE, "ob": OBJECT, "dc": COPY, "det": DET, "gt": GT, "nb": NOTE_BASE, "note": NOTE, "page": PAGE,
         "curve": CURVE}
NEEDS = {"li": (), "ob": ("li",), "dc": ("ob",), "det": ("dc",), "gt": ("ob",), "nb": ("li",), "note": ("nb",), "page": (),
         "staff": ("page",), "curve": ("note",), "curve_column": ("ob",), "curve_pixel": ("curve_column",),
         "letter": ("note",)}


def _chain(names: tuple[str, ...], engine: str) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    unnest = {"spark": "explode(sequence(0L, 7L))", "duckdb": "unnest(range(8))"}[engine]
    copies = {"spark": "explode(array(0, 1))", "duckdb": "unnest([0, 1])"}[engine]
    text = {**VIEWS, "staff": STAFF.format(unnest=unnest), "dc": COPY.format(unnest2=copies),
            "curve_column": CURVE_COLUMN.format(unnest28={"spark": "explode(sequence(0L, 27L))", "duckdb": "unnest(range(28))"}[engine]),
            "curve_pixel": CURVE_PIXEL.format(unnest2=copies), "letter": LETTER.format(unnest2=copies)}
    return [f"{name} AS ({text[name]})" for name in ordered]


def with_views(*names: str, then: str = "", recursive: bool = False) -> str:
    """DuckDB prefix `WITH view AS (…), …` followed by further CTEs in `then`."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(
        _chain(names, "duckdb") + ([then] if then else [])) + "\n"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the parquet files of `sf_dir`."""
    source = "orders" if name in ("page", "staff") else "lineitem"
    columns = {"orders": ["o_orderkey"],
               "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]}[source]
    files = {source: read_table(spark, sf_dir, source, columns)}
    body = ",\n".join(_chain((name,), "spark"))
    for table in files:
        body = body.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(f"WITH {body}\nSELECT * FROM {name}", **files)
