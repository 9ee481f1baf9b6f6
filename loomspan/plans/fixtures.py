"""Input shapes made of the driver's tables, as SQL that runs in Spark and in the SQL that results are held against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Names in braces are tables.
FX = {
    "fx_genome": "SELECT CAST(chr AS INT) AS chr, CAST(2592000 AS BIGINT) AS len FROM (VALUES (1),(2),(3),(4)) AS g(chr)",
    "fx_seg": """
SELECT event_id AS id, CAST(user_id % 4 + 1 AS INT) AS chr, sec + 1 AS start, sec + 30 + (event_id * 7919) % 3600 AS end_,
       CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_type AS type
FROM (SELECT event_id, user_id, event_type,
        CAST((extract(day FROM ts) - 1) * 86400 + extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS BIGINT) AS sec
      FROM {events}) AS x""",
    "fx_ts": """
SELECT g.user_id AS id, h.hour AS t, COALESCE(e.y, 0.0) AS y
FROM (SELECT DISTINCT user_id FROM {events}) AS g
CROSS JOIN (SELECT DISTINCT CAST(extract(hour FROM ts) AS INT) AS hour FROM {events}) AS h
LEFT JOIN (SELECT user_id, CAST(extract(hour FROM ts) AS INT) AS hour, sum(value) AS y FROM {events} GROUP BY user_id, CAST(extract(hour FROM ts) AS INT)) AS e
  ON e.user_id = g.user_id AND e.hour = h.hour""",
    "fx_cls": """
SELECT p_partkey AS id, p_brand AS query, p_type AS target, replace(p_name, ' ', ';') AS terms,
       concat('K:', CAST(p_size % 4 AS VARCHAR(20)), '_T:', p_type, '_N:fixed') AS segtype
FROM {part}""",
    "fx_profile": """
SELECT c_custkey AS id, c_mktsegment AS cluster, r_name AS region, c_acctbal AS x
FROM {customer} AS c JOIN {nation} AS n ON c_nationkey = n_nationkey JOIN {region} AS r ON n_regionkey = r_regionkey""",
    "fx_signal": """
SELECT CAST(user_id % 4 + 1 AS INT) AS chr,
       CAST((extract(day FROM ts) - 1) * 144 + extract(hour FROM ts) * 6 + floor(extract(minute FROM ts) / 10) + 1 AS BIGINT) AS coor,
       CAST(user_id % 24 AS INT) AS t, count(*) AS reads, sum(value) AS v
FROM {events}
GROUP BY CAST(user_id % 4 + 1 AS INT),
       CAST((extract(day FROM ts) - 1) * 144 + extract(hour FROM ts) * 6 + floor(extract(minute FROM ts) / 10) + 1 AS BIGINT), CAST(user_id % 24 AS INT)""",
    "fx_xy": "SELECT l_returnflag AS class, l_quantity AS x, l_extendedprice AS y FROM {lineitem}",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in FX[name]}
    df = spark.sql(FX[name], **found)
    return df.withColumnRenamed("end_", "end")


def quoted(sql: str) -> str:
    """The column named intersect in quotes, where the plain word would be a set operation."""
    return re.sub(r'(?<!")\bintersect\b(?!")', '"intersect"', sql)


def with_fixtures(sql: str, *names: str) -> str:
    """SQL with the fixtures it uses in front."""
    parts = [f"{n} AS ({FX[n].format(**{t: t for t in TABLES})})" for n in names]
    sql = quoted(sql)
    return "WITH " + ", ".join(parts) + ("," if sql.lstrip().startswith(",") else "") + sql.lstrip().removeprefix(",")
