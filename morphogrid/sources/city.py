"""A synthetic city derived from relational tables by integer arithmetic, so that areas are exact in any engine.

The texts are plain SQL of both Spark and the oracle's engine; `{W}` is the city's width in metres and grows with the square root of
the number of orders, so density doesn't depend on the scale.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

CELL = 100

TEXT = {
    "buildings": """
        SELECT o_orderkey AS part_id, cast(floor(o_orderkey / 2) AS bigint) AS feature_id, x0, y0, x0 + w AS x1, y0 + d AS y1,
        CASE WHEN f % 3 = 0 THEN NULL ELSE cast(3 + f % 40 AS double) END AS height,
        CASE WHEN p IN ('1', '2') THEN cast(p AS int) * 2 WHEN p = '3' THEN 0 ELSE NULL END AS num_floors,
        CASE p WHEN '1' THEN 'residential' WHEN '2' THEN 'industrial' WHEN '3' THEN 'commercial' WHEN '4' THEN 'Unknown' ELSE NULL END AS subtype,
        CASE WHEN f % 5 = 0 THEN 'warehouse' WHEN f % 7 = 0 THEN 'shed' WHEN f % 11 = 0 THEN 'industrial' ELSE NULL END AS class,
        CASE o_orderstatus WHEN 'F' THEN 'survey' WHEN 'O' THEN 'footprints' ELSE NULL END AS dataset
        FROM (SELECT *, cast(floor(o_orderkey / 2) AS bigint) AS f, substr(o_orderpriority, 1, 1) AS p, (o_orderkey * 7919) % ({W} - 50) AS x0,
              (o_custkey * 104729 + o_orderkey * 31) % ({W} - 50) AS y0, 5 + o_orderkey % 23 AS w, 5 + o_custkey % 17 AS d FROM {orders}) q""",
    "land_use": """
        SELECT p_partkey AS land_id, x0, y0, x0 + 10 + p_size AS x1, y0 + 10 + (p_partkey * 7) % 60 AS y1, p_size,
        CASE WHEN p_size % 4 = 0 THEN 'industrial' WHEN p_size % 4 = 1 THEN 'residential' WHEN p_size % 4 = 2 THEN 'commercial' ELSE NULL END AS class
        FROM (SELECT p_partkey, cast(p_size AS bigint) AS p_size, (p_partkey * 7907) % ({W} - 70) AS x0, (p_partkey * 104723) % ({W} - 70) AS y0 FROM {part}) q""",
    "streets": """
        SELECT s_suppkey AS street_id, CASE WHEN s_suppkey % 2 = 0 THEN 'h' ELSE 'v' END AS axis, (s_suppkey * 7901) % {W} AS fixed,
        (s_suppkey * 131) % 200 AS lo, (s_suppkey * 131) % 200 + 150 + (s_suppkey * 37) % 500 AS hi,
        CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE cast(6 + s_suppkey % 20 AS double) END AS width, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE cast(s_suppkey % 10 AS double) / 10 END AS openness
        FROM {supplier}""",
    "pixels": """
        SELECT px, py, CASE WHEN event_type = (SELECT min(event_type) FROM {events}) THEN 0 ELSE 10 * (1 + event_id % 6) END AS code
        FROM (SELECT event_id, event_type, event_id % cast({W} / 10 AS bigint) AS px, (event_id * 37) % cast({W} / 10 AS bigint) AS py,
              row_number() OVER (PARTITION BY event_id % cast({W} / 10 AS bigint), (event_id * 37) % cast({W} / 10 AS bigint) ORDER BY event_id DESC) AS k FROM {events}) q WHERE k = 1""",
    "labels2": """
        SELECT c_custkey AS unit, cast(1 + c_custkey % 17 AS int) AS predicted, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(1 + (c_custkey * c_nationkey) % 17 AS int) END AS reference,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE least(c_acctbal / 10000, 1.0) END AS coverage, cast(1 + c_custkey % 5 AS double) AS weight, c_acctbal AS measure, c_nationkey AS city,
        cast(10000 - 2500 * (c_custkey % 3) AS double) AS area, CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE cast(c_custkey % 10 AS double) / 8 END AS completeness
        FROM {customer}""",
}
NEEDS = {"buildings": "orders", "land_use": "part", "streets": "supplier", "pixels": "events", "labels2": "customer"}
WIDTH_SQL = f"(SELECT {CELL} * cast(ceil(sqrt(count(*) / 9.0)) AS bigint) FROM orders)"


def width(spark: SparkSession, sf_dir: str) -> int:
    return CELL * math.ceil(math.sqrt(spark.read.parquet(f"{sf_dir}/orders.parquet").count() / 9.0))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation of the city as a DataFrame."""
    source = NEEDS[name]
    text = TEXT[name]
    if "{W}" in text:
        text = text.replace("{W}", str(width(spark, sf_dir)))
    return spark.sql(text, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def oracle(name: str) -> str:
    """The same relation as text of the oracle's SQL."""
    return TEXT[name].replace("{W}", WIDTH_SQL).replace("{" + NEEDS[name] + "}", NEEDS[name])
