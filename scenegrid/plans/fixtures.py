"""Scenes derived from the driver's tables: each fixture is a projection that Spark and SQL read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenegrid.operators.tables import tasks

#: fixture -> (table, projection)
FIXTURES: dict[str, tuple[str, list[str]]] = {
    "boxes": (
        "part",
        [
            "CAST(floor(p_partkey / 100) AS BIGINT) AS scene_id",
            "p_partkey AS object_id",
            "CAST(p_partkey % 100 AS BIGINT) AS ordinal",
            "CAST(p_partkey * 37 % 1000 AS DOUBLE) AS x",
            "CAST(p_partkey * 91 % 1000 AS DOUBLE) AS y",
            "CAST(p_size AS DOUBLE) AS width",
            "CAST(p_size + 3 AS DOUBLE) AS height",
            "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size % 7 AS DOUBLE) END AS z_index",
            "CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'path' WHEN 1 THEN 'text' WHEN 2 THEN 'image' ELSE 'formula' END AS kind",
            "p_brand AS group_id",
            "CAST(p_partkey % 11 AS DOUBLE) / 10 AS opacity",
            "CASE WHEN p_partkey % 6 = 0 THEN 'none' ELSE '#102030' END AS fill",
            "CAST(p_partkey % 4 AS DOUBLE) / 2 AS stroke_width",
            "CAST(p_partkey * 15 % 360 AS DOUBLE) AS rotation",
            "p_name AS label",
        ],
    ),
    "commands": (
        "lineitem",
        [
            "l_orderkey AS path_id",
            "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS BIGINT) AS seq",
            "CAST(floor(l_quantity * 20) AS BIGINT) AS x",
            "CAST(floor(l_extendedprice / 100) AS BIGINT) AS y",
        ],
    ),
    "nodes": ("customer", ["CAST(c_nationkey AS BIGINT) AS scene_id", "c_custkey AS node_id", "c_name AS label", "CAST(c_custkey % 13 AS BIGINT) AS stage", "CAST(c_custkey % 17 AS BIGINT) AS lane2", "c_mktsegment AS kind", "c_acctbal AS value"]),
    "edges": (
        "orders",
        [
            "o_orderkey AS edge_id",
            "o_custkey AS from_id",
            "o_custkey + o_orderkey % 97 AS to_id",
            "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'flow' WHEN 1 THEN 'skip' WHEN 2 THEN 'feedback' ELSE 'training' END AS kind",
            "CASE o_orderstatus WHEN 'F' THEN 'left' WHEN 'O' THEN 'right' ELSE 'center' END AS from_site",
            "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' WHEN 2 THEN 'left' WHEN 3 THEN 'right' ELSE 'center' END AS to_site",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'straight' ELSE 'elbow' END AS route",
        ],
    ),
    "attachments": ("orders", ["o_orderkey AS child_id", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent_id", "CAST(o_custkey % 9 AS DOUBLE) AS dx", "CAST(o_custkey % 5 AS DOUBLE) AS dy"]),
    "log": (
        "events",
        [
            "user_id AS scene_id",
            "event_id",
            "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq",
            "event_type AS op",
            "user_id * 3 + event_id % 3 AS object_id",
            "CAST(floor(value) AS DOUBLE) AS dx",
            "CAST(event_id % 10 AS DOUBLE) AS dy",
        ],
    ),
}


#: fixture -> the key by which its rows are numbered. They are dealt by it to as many tasks as the table needs, which the windows and groups by that key after them
#: share: with a fixed number of tasks each would sort a fixed part of the table.
NUMBERED = {"commands": "l_orderkey"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = FIXTURES[name]
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    if name in NUMBERED:
        rows = rows.repartition(tasks(rows), NUMBERED[name])
    return rows.selectExpr(*columns)


def cte(*names: str) -> str:
    """The same fixtures for SQL: ``WITH a AS (...), b AS (...)``."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(FIXTURES[n][1])} FROM {FIXTURES[n][0]})" for n in names)
