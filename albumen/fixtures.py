"""Views that give the given tables the shapes of a media catalogue: the same SQL runs in
Spark and in the oracle (see FIXTURES.md, part C)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_assets": """SELECT doc_id AS asset_id,
  CASE WHEN doc_id % 7 = 0 THEN 'video' ELSE 'image' END AS media_type,
  CASE WHEN doc_id % 11 = 0 THEN NULL
       ELSE concat(CAST(1990 + (doc_id * 37) % 35 AS VARCHAR(4)), '-',
                   right(concat('0', CAST(1 + doc_id % 12 AS VARCHAR(2))), 2), '-',
                   right(concat('0', CAST(1 + (doc_id * 5) % 28 AS VARCHAR(2))), 2)) END AS date,
  CASE WHEN doc_id % 4 = 1 THEN NULL
       ELSE CAST(((doc_id % 40) * 40000 + CASE WHEN doc_id % 29 = 3 THEN 10000 + (doc_id * 97) % 20000 ELSE (doc_id * 13) % 20 END) AS DOUBLE) / 10000.0E0 - 80.0E0 END AS gps_lat,
  CASE WHEN doc_id % 4 = 1 THEN NULL
       ELSE CAST(((doc_id % 40) * 85000 + (doc_id * 17) % 20) AS DOUBLE) / 10000.0E0 - 170.0E0 END AS gps_lon,
  CASE WHEN doc_id % 3 = 0 THEN '[]'
       WHEN doc_id % 3 = 1 THEN concat('["Person ', CAST(doc_id % 23 AS VARCHAR(9)), '"]')
       ELSE concat('["person ', CAST(doc_id % 23 AS VARCHAR(9)), '", "Person ', CAST((doc_id + 1) % 23 AS VARCHAR(9)), '"]')
  END AS persons,
  concat('["', lang, '", "', source, '", "', CASE WHEN doc_id % 2 = 0 THEN 'outdoor' ELSE 'indoor' END, '"]') AS tags,
  text AS description,
  CASE WHEN doc_id % 7 = 0 AND doc_id % 5 = 3 THEN 2 WHEN doc_id % 7 = 0 AND doc_id % 5 = 4 THEN -1
       WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS state,
  CASE WHEN doc_id % 9 = 0 THEN '["description"]' ELSE '[]' END AS edited_fields,
  CASE WHEN doc_id % 6 < 3 THEN concat('Place ', CAST(doc_id % 40 AS VARCHAR(9))) END AS place_name,
  CASE WHEN doc_id % 6 = 0 THEN 'manual' WHEN doc_id % 6 = 1 THEN 'apple' WHEN doc_id % 6 = 2 THEN 'nearby' END AS place_source,
  CASE WHEN doc_id % 6 = 1 THEN concat('Area ', CAST(doc_id % 4 AS VARCHAR(9))) END AS place_aoi,
  CASE WHEN doc_id % 6 < 3 AND doc_id % 6 > 0 THEN concat('City ', CAST(doc_id % 20 AS VARCHAR(9))) END AS place_city,
  CASE WHEN doc_id % 6 = 2 THEN concat('State ', CAST(doc_id % 8 AS VARCHAR(9))) END AS place_state,
  CASE WHEN doc_id % 6 = 1 THEN concat('Country ', CAST(doc_id % 5 AS VARCHAR(9))) END AS place_country,
  CASE WHEN doc_id % 6 = 1 THEN concat('C', CAST(doc_id % 5 AS VARCHAR(9))) END AS place_country_code
FROM documents""",
    "fx_corrections": """SELECT doc_id AS asset_id,
  CASE WHEN doc_id % 8 = 1 THEN concat('["b","B"," ","  ', source, '   x "]') WHEN doc_id % 8 = 5 THEN '[]' END AS persons,
  CASE WHEN doc_id % 3 = 1 THEN concat('["', lang, '","new   tag","NEW tag"]') END AS tags,
  CASE WHEN doc_id % 5 = 0 THEN '   ' WHEN doc_id % 5 = 1 THEN concat('  ', text, ' ') END AS description,
  CASE WHEN doc_id % 4 = 1 THEN concat('  New   Place ', CAST(doc_id % 9 AS VARCHAR(9)), ' ') WHEN doc_id % 4 = 3 THEN '  ' END AS place_name
FROM documents WHERE doc_id % 2 = 1""",
    "fx_vocab": """SELECT DISTINCT concat('Person ', CAST(c_custkey % 15 AS VARCHAR(9))) AS name FROM customer""",
    "fx_cities": """SELECT n_nationkey AS city_id, n_name AS city, concat('C', CAST(n_regionkey AS VARCHAR(9))) AS cc,
  CAST((n_nationkey * 61) % 160 AS DOUBLE) - 80.0E0 AS lat,
  CAST((n_nationkey * 137) % 340 AS DOUBLE) - 170.0E0 AS lon
FROM nation""",
    "fx_places": """SELECT CASE WHEN doc_id % 50 = 0 THEN doc_id + 1000000 ELSE doc_id END AS asset_id,
  CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat('Venue ', CAST(doc_id % 40 AS VARCHAR(9))) END AS name,
  concat('C', CAST(doc_id % 5 AS VARCHAR(9))) AS cc,
  CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE concat(' Town ', CAST(doc_id % 30 AS VARCHAR(9))) END AS city,
  CASE WHEN doc_id % 5 > 1 THEN concat('Land ', CAST(doc_id % 5 AS VARCHAR(9))) END AS country
FROM documents WHERE doc_id % 2 = 0""",
    "fx_more_places": """SELECT doc_id AS asset_id, CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat('Spot ', CAST(doc_id % 40 AS VARCHAR(9))) END AS name,
  concat('D', CAST(doc_id % 5 AS VARCHAR(9))) AS cc, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE concat('Town ', CAST(doc_id % 30 AS VARCHAR(9))) END AS city,
  CASE WHEN doc_id % 5 > 1 THEN concat('Land ', CAST(doc_id % 5 AS VARCHAR(9))) END AS country
FROM documents WHERE doc_id % 7 < 5""",
    "fx_results": """SELECT doc_id AS asset_id, concat('new description ', CAST(doc_id AS VARCHAR(20))) AS description,
  '["x","y","x"]' AS tags FROM documents WHERE doc_id % 5 = 0""",
    "fx_edits": """SELECT doc_id AS asset_id,
  CASE WHEN doc_id % 2 = 0 THEN '2001-02-03' ELSE '2001-02-30' END AS date,
  CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'Typed place' END AS place_name
FROM documents WHERE doc_id % 10 = 1""",
    "fx_orders_old": """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate
FROM orders WHERE o_orderkey % 17 <> 0""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over one."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, source = re.subn(r"FROM (\w+)", r"FROM {\1}", VIEWS[name], count=1), re.search(r"FROM (\w+)", VIEWS[name])[1]
    return spark.sql(sql[0], **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names in front, as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
