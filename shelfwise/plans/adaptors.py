"""Catalog-shaped inputs made from the given tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.files import dealt

# Current, archived and master products: part keys by three bits, so every combination of the three sides occurs.
CURRENT = "SELECT concat(p_name, ' ', p_partkey) AS name, p_brand AS brand, cast(p_size AS STRING) AS price, p_type AS category FROM {part} WHERE (p_partkey & 1) <> 0"
ARCHIVE = "SELECT concat(p_name, ' ', p_partkey) AS name, p_brand AS brand, cast(p_size + 1 AS STRING) AS price, p_type AS category, '18-07-2025' AS snapshot_date FROM {part} WHERE (p_partkey & 2) <> 0"
MASTER = """SELECT concat(p_name, ' ', p_partkey) AS name, p_brand AS brand, cast(p_size + 2 AS STRING) AS price, p_type AS category,
  CASE p_partkey % 5 WHEN 0 THEN '01-07-2025' WHEN 1 THEN '2025-07-01' WHEN 2 THEN 'Unknown' WHEN 3 THEN '102343' END AS first_seen_date,
  CASE p_partkey % 3 WHEN 0 THEN '05-07-2025' WHEN 1 THEN '2025-07-06' END AS last_seen_date FROM {part} WHERE (p_partkey & 4) <> 0"""
# Products with several rows for a name.
DUPLICATES = """SELECT p_name AS name, p_partkey AS ord, concat(replace(p_name, ' ', '_'), CASE p_partkey % 3 WHEN 0 THEN 'dark' WHEN 1 THEN 'light' ELSE '' END) AS variant,
  p_type AS category, p_brand AS brand, concat('€ ', cast(p_size AS STRING), '.', cast(100 + p_partkey % 900 AS STRING), CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ',00' END) AS price,
  concat('https://shop.example/', replace(p_brand, '#', '-'), '/', cast(p_partkey % 400 AS STRING), '.html?v=', cast(p_partkey AS STRING)) AS url,
  cast(p_partkey AS STRING) AS sku, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS color, p_partkey % 4 AS n_images FROM {part}"""
# Files with time stamps in their names.
MANIFEST = """SELECT concat('b', cast(o_custkey % 5 AS STRING)) AS brand, concat('b', cast(o_custkey % 5 AS STRING), '_bikes_2025', CASE WHEN o_orderkey % 2 = 0 THEN '07' ELSE '08' END, '18_10', CASE WHEN o_orderkey % 3 = 0 THEN '23' ELSE '45' END, '43.csv') AS file_name,
  concat('/data/', cast(o_orderkey AS STRING)) AS path, o_orderdate AS mtime, o_custkey % 40 AS n_rows, o_orderkey % 9 AS n_cols FROM {orders}"""
# Dated sightings of products.
SNAPSHOTS = "SELECT event_type AS brand, user_id AS name, cast(ts AS date) AS snapshot_date FROM {events}"
# Texts of technical attributes.
SPECS = """SELECT p_partkey AS k, lower(p_name) AS name, p_type AS category,
  concat(CASE WHEN p_partkey % 4 = 0 THEN concat(cast(p_size AS STRING), ' - ') ELSE '' END, cast(p_size AS STRING), ',5 kg / ', cast(p_size * 2 AS STRING), '.1 lbs', CASE WHEN p_partkey % 3 = 0 THEN ' of 9 kg / 20 lbs' ELSE '' END) AS weight,
  CASE p_partkey % 3 WHEN 0 THEN concat('max ', cast(p_size + 100 AS STRING), ' kg total') WHEN 1 THEN concat('up to ', cast(p_size + 200 AS STRING), ' lbs') ELSE 'see manual' END AS weight_limit,
  concat('1', cast(p_partkey % 2 AS STRING), '-', cast(p_size + 20 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN ', 12-speed' WHEN p_partkey % 5 = 1 THEN ', 11-speed' ELSE '' END) AS cassette,
  concat(CASE p_partkey % 6 WHEN 0 THEN 'sram apex 1' WHEN 1 THEN 'sram rival' WHEN 2 THEN 'shimano 105' WHEN 3 THEN 'shimano cues gs' WHEN 4 THEN 'sram red xplr' ELSE 'sram eagle' END, '') AS rear,
  CASE p_partkey % 5 WHEN 0 THEN '50/34' WHEN 1 THEN '46x30' WHEN 2 THEN concat(cast(p_size AS STRING), 't ring') WHEN 3 THEN 'apex 1' ELSE 'crank' END AS crank,
  CASE p_partkey % 4 WHEN 0 THEN 'max 40t' WHEN 1 THEN '2x11' ELSE '' END AS chainring,
  CASE p_partkey % 5 WHEN 0 THEN 'Maat: 47, 50, 52 Shimano 105, 11-speed' WHEN 1 THEN 'Maat: XS, S, M SRAM AXS draadloze, links' WHEN 2 THEN 'Shimano Dura-Ace Di2' WHEN 3 THEN concat('Tiagra, ', cast(p_size AS STRING), ' speed, grey') ELSE 'Sora, 9 versnellingen, 9s' END AS shifter,
  CASE p_partkey % 5 WHEN 0 THEN '500 Series  OCLV carbon, tapered' WHEN 1 THEN 'Frame: light alloy, tapered' WHEN 2 THEN 'titanium 3al' WHEN 3 THEN 'Ultralicht 200 series Alpha Aluminium' ELSE 'Wood' END AS frame,
  CASE p_partkey % 5 WHEN 0 THEN '1.849 €' WHEN 1 THEN '€ 1.849,50' WHEN 2 THEN '999.00' WHEN 3 THEN 'on request' ELSE concat('€', cast(p_size AS STRING)) END AS price,
  CASE p_partkey % 5 WHEN 0 THEN '01-07-2025' WHEN 1 THEN '2025-07-01' WHEN 2 THEN 'Unknown' WHEN 3 THEN '102343' END AS seen,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand END AS front,
  concat('https://shop.example/', CASE p_partkey % 7 WHEN 0 THEN 'endurace/aero' WHEN 1 THEN 'ultimate' WHEN 2 THEN 'aeroad' WHEN 3 THEN 'speedmax' WHEN 4 THEN 'inflite' WHEN 5 THEN 'young-hero' ELSE 'news/frs' END, '/', cast(p_partkey AS STRING), '.html', CASE WHEN p_partkey % 2 = 0 THEN '?c=1' ELSE '' END) AS url,
  CASE p_partkey % 6 WHEN 0 THEN '//img.example/image/upload/w_1200,h_10/a b.jpg' WHEN 1 THEN 'u=https://img.example/image/upload/w_400/x' WHEN 2 THEN 'https://img.example/icon/w_1200/i.png?x=1' WHEN 3 THEN 'https://img.example/image/upload/Hero/y.webp' WHEN 4 THEN 'https://img.example/' ELSE 'https://other.example/z' END AS image,
  concat(' ', replace(p_name, ' ', '   '), CASE WHEN p_partkey % 2 = 0 THEN chr(10) ELSE chr(9) END, p_type, ' ') AS note,
  CASE p_partkey % 6 WHEN 0 THEN 'Framefit:' WHEN 1 THEN 'Weight-limit' WHEN 2 THEN 'Zadelpen' WHEN 3 THEN 'Rear hub' WHEN 4 THEN 'Schakel / Remhendel' ELSE p_type END AS spec_key,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS spec_a, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS spec_b, p_brand AS brand, p_size FROM {part}"""
# Bicycles whose names, categories and addresses take every branch of the rules on names; every 16th name is missing.
MODELS = """SELECT k, chainring, crank, cassette, rear, front,
  concat(CASE k % 16 WHEN 0 THEN 'domane slr 9' WHEN 1 THEN 'Domane AL 2' WHEN 2 THEN 'checkpoint alr 5' WHEN 3 THEN 'checkpoint sl 6' WHEN 4 THEN 'Madone sl 7' WHEN 5 THEN 'émonda sl 8'
    WHEN 6 THEN 'speed concept slr 7' WHEN 7 THEN 'boone 5' WHEN 8 THEN 'boone 6' WHEN 9 THEN 'fx sport 4' WHEN 10 THEN 'fx 2 disc' WHEN 11 THEN 'checkmate sl 9' WHEN 12 THEN 'verve al 4'
    WHEN 13 THEN 'track 1 al 5' WHEN 14 THEN 'marlin' END, CASE WHEN p_size % 2 = 0 THEN ' axs' ELSE '' END) AS name,
  CASE p_size % 7 WHEN 0 THEN 'Performance Bikes' WHEN 1 THEN 'gravel' WHEN 2 THEN 'Cyclocross' WHEN 3 THEN 'fitness' WHEN 4 THEN 'triathlon' WHEN 5 THEN 'city' END AS category,
  concat('https://shop.example/', CASE WHEN k % 11 = 0 THEN 'Track' ELSE 'road' END, '/', cast(k AS STRING)) AS url FROM (""" + SPECS + """) x"""
# Pages with listing JSON.
LISTING = """SELECT p_partkey AS page_id, concat('<html><script>dataLayer = {{"impressions": [', CASE WHEN p_partkey % 5 = 0 THEN '"skip", ' ELSE '' END, '{{"name": "', p_name, '", "id": "', cast(p_partkey AS STRING), '", "variant": "reddark"}}, {{"name": "", "id": "0"}}', CASE WHEN p_partkey % 4 = 1 THEN concat(', {{"name": "', p_type, '", "id": "', cast(p_partkey AS STRING), '-2", "price": "', cast(p_size AS STRING), ',00", "category": "', p_type, '", "brand": "', p_brand, '"}}') ELSE '' END, ']}};</script><img src="//cdn.example/image/upload/w_', cast(p_size AS STRING), '/a.jpg"><img data-src="/b.png"><img src="/b.png">', CASE WHEN p_partkey % 2 = 0 THEN '<img src="//cdn.example/image/upload/w_5/c.jpg">' ELSE '' END, '<link rel="canonical" href="https://shop.example/', cast(p_partkey AS STRING), '"><div class="price">€ ', cast(p_size AS STRING), ',50</div> "name":"', p_name, '","color":["c', cast(p_partkey AS STRING), '"]</html>') AS html FROM {part} WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey AS page_id, concat('<html><script>ecommerce: {{"items": [{{"item_name": "', p_name, '", "item_id": "', cast(p_partkey AS STRING), '", "item_variant": "green_greenlight"}}]}}</script></html>') AS html FROM {part} WHERE p_partkey % 3 = 0"""
# Product pages with a table, a definition list, a component, swatches and text blocks.
DETAIL_PAGES = """SELECT p_partkey AS page_id, concat('<html><h1>', p_name, '</h1><table><tr><td>* Frame:</td><td> Carbon <b>', cast(p_size AS STRING), '</b></td></tr><tr><td>Rem</td><td>Old</td></tr><tr><td>Rem</td><td>Disc ', p_type, '</td></tr><tr><td>same</td><td>same</td></tr></table>',
  CASE WHEN p_partkey % 2 = 0 THEN concat('<dl><dt>Rem</dt><dd>Hydraulic</dd><dt>Weight</dt><dd>', cast(p_size AS STRING), ' kg</dd><dt>alone</dt></dl>') ELSE '' END,
  '<div class="description">short</div><div class="description">A long enough description of this very good bicycle ', p_name, '.</div><ul><li class="component"><h4>Wiel</h4><span class="name">', p_brand, '</span><ul><li class="feature">', CASE WHEN p_partkey % 3 = 0 THEN '12x100' ELSE '12x142' END, '</li></ul></li></ul>',
  '<a class="color" data-color-id="', cast(p_partkey AS STRING), '" data-color-name="Red" href="/r"></a><a class="color" data-color-id="2" data-color-name="Members only"></a><p class="classification">Use: max ', cast(100 + p_size AS STRING), ' kg</p></html>') AS html FROM {part}"""


def frame(spark: SparkSession, sf_dir: str, sql: str, deal: bool = False) -> DataFrame:
    """The input of a query; with `deal`, for work that takes long over few bytes, the rows of small tables are dealt out to all cores first."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **{t: dealt(df) for t, df in tables.items()} if deal else tables)


def duck(sql: str) -> str:
    """The same input for DuckDB."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql).replace("{{", "{").replace("}}", "}") + ")"
