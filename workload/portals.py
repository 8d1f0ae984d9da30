"""Portal payloads built from the orders, and their normalisation.

The payload text is assembled row by row in the portals' shapes, with fields of
mixed type, gaps and oddities; the SQL states the expected listing directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglens.functions.text import clean_description, strip_html
from listinglens.functions.variant import digits_to_number
from listinglens.session import scratch_path
from listinglens.sources import portals as P
from listinglens.sources.boundaries import load_areas
from workload import fixtures as X
from workload.base import ORACLES, block, query


def _rows(spark, sf):
    """Orders with the numbers the payloads are written from."""
    return X.listings(spark, sf).selectExpr(
        "id",
        "id div 3 as g",
        "price",
        "coalesce(usable_area_m2, 70) as u",
        "coalesce(land_area_m2, 300) as l",
        "494000 + ((id div 3) * 7919) % 12000 + id % 3 as lat_i",
        "134000 + ((id div 3) * 104729) % 21000 as lng_i",
        "split(coalesce(locality_text, 'Kladno-0'), '-')[0] as town",
        "lower(coalesce(seller_type, '')) as seller",
    )


block(
    "src",
    """SELECT id, g, price, coalesce(usable_area_m2, 70) AS u, coalesce(land_area_m2, 300) AS l,
    494000 + (g * 7919) % 12000 + m AS lat_i, 134000 + (g * 104729) % 21000 AS lng_i,
    split_part(coalesce(locality_text, 'Kladno-0'), '-', 1) AS town, seller_type AS seller
  FROM lst""",
)

_DEGREES = "concat(cast({0} div 10000 as string), '.', lpad(cast({0} % 10000 as string), 4, '0'))"


def _pages(rows, source: str, region: str, wrap: str, per_page: int = 100, first: int = 1):
    """Group JSON items into page payloads of ``per_page`` rows, numbered from ``first``."""
    numbered = rows.selectExpr(
        f"{region} as region", f"cast(idx div {per_page} + {first} as int) as page_no", "idx", "item"
    )
    grouped = numbered.groupBy("region", "page_no").agg(
        F.sort_array(F.collect_list(F.struct("idx", "item"))).alias("entries")
    )
    head, tail = wrap.split("{items}")
    if region == "'all'":
        counted = grouped.withColumn("total", numbered.agg(F.count("*")).scalar())
    else:
        totals = numbered.groupBy("region").agg(F.count("*").alias("total"))
        counted = grouped.join(totals, "region")
    return counted.select(
        F.lit(1).cast("long").alias("run_id"),
        X.run_ts().alias("run_ts"),
        F.lit(source).alias("source"),
        F.col("region").cast("string").alias("region"),
        "page_no",
        F.lit(False).alias("failed"),
        F.concat(
            F.replace(F.lit(head), F.lit("{total}"), F.col("total").cast("string")),
            F.array_join(F.transform("entries", lambda e: e["item"]), ","),
            F.replace(F.lit(tail), F.lit("{total}"), F.col("total").cast("string")),
        ).alias("payload"),
    )


A_ITEM = f"""concat(
  '{{"hash_id":', case when id % 43 = 0 then 'null' when id % 5 = 0 then concat('"', cast(id as string), '"')
      else cast(id as string) end,
  ',"advert_name":"', case id % 4 when 0 then concat('Prodej rodinného domu ', cast(u as string), ' m², pozemek ', cast(l as string), ' m²')
      when 1 then concat('Prodej chaty ', cast(u as string), ' m2')
      when 2 then concat('Prodej vily 1 ', cast(100 + u as string), ' m²') else 'Usedlost' end,
  '","category_sub_cb":', case id % 6 when 0 then '{{"name":"Rodinný"}}' when 1 then '{{"name":"Vila"}}'
      when 2 then '{{"name":"Chata"}}' when 3 then '{{"name":"Chalupa"}}' when 4 then 'null' else '{{"name":5}}' end,
  ',"locality":{{', case when id % 8 <> 0 then concat('"district":"', town, '",') else '' end,
  '"citypart":"', case when id % 3 = 0 then '' else concat(town, '-', cast(g % 8 as string)) end,
  '","municipality":"Obec ', cast(g % 5 as string), '","city":"Mesto"',
  ',"gps_lat":', case when id % 11 = 0 then concat('"', {_DEGREES.format("lat_i")}, '"') else {_DEGREES.format("lat_i")} end,
  ',"gps_lon":', case when id % 13 = 0 then 'true' else {_DEGREES.format("lng_i")} end,
  case when id % 7 <> 0 then concat(',"city_seo_name":"', lower(town), '"') else '' end,
  ',"district_seo_name":"okres","municipality_seo_name":"obec-', cast(g % 5 as string),
  '","street_seo_name":"', case when id % 2 = 0 then '' else 'ulice' end, '"}}',
  ',"price_czk":', case when price is null or id % 5 = 1 then 'null' when id % 5 = 0 then concat('"', cast(price as string), ' Kč"')
      else concat(cast(price as string), '.5') end,
  ',"price":', coalesce(cast(price as string), 'null'),
  case id % 3 when 0 then case when id % 2 = 0 then ',"premise":{{"name":"x"}}' else '' end when 1 then ',"premise_id":0'
      else ',"premise_id":77' end,
  ',"advert_images_all":', case when id % 4 = 0 then '[]' else concat(
      '[{{"advert_image_sdn_url":"//d18.sdn.cz/a/', cast(id as string), '.jpg"}},{{"url":"https://x.example/', cast(id as string),
      '.jpg"}},{{"url":5}},"https://d18.sdn.cz/q/', cast(id as string), '.jpg?x=1"]') end,
  ',"advert_images":["//img.example/', cast(id as string), '.jpg"]}}') as item"""


def a_pages(spark, sf):
    rows = _rows(spark, sf).selectExpr("id % 2 + 10 as zone", "id div 2 as idx", A_ITEM)
    return _pages(
        rows, P.PORTAL_A.name, "zone", '{"results":[{items}],"pagination":{"total":{total}}}'
    )


A_KIND = """CASE id % 6 WHEN 0 THEN 'rodinny_dum' WHEN 1 THEN 'vila' WHEN 2 THEN 'recreational'
      WHEN 3 THEN 'recreational' ELSE CASE id % 4 WHEN 1 THEN 'recreational' WHEN 2 THEN 'vila' ELSE 'rodinny_dum' END END"""


@query(
    "normalize_search_json",
    f"""SELECT 10 + id % 2 AS region, CAST(id AS VARCHAR) AS source_id, id // 2 // 100 + 1 AS page_no,
      CASE WHEN id % 5 IN (0, 1) THEN price ELSE price + 1 END AS price, {A_KIND} AS property_kind,
      CASE id % 4 WHEN 2 THEN 1000 + 100 + u WHEN 3 THEN NULL ELSE u END AS usable_area_m2,
      CASE WHEN id % 4 = 0 THEN l END AS land_area_m2,
      CASE WHEN id % 11 = 0 THEN CAST(lat_i AS DOUBLE) ELSE CAST(lat_i AS DOUBLE) / 10000::DOUBLE END AS lat,
      CASE WHEN id % 13 <> 0 THEN CAST(lng_i AS DOUBLE) / 10000::DOUBLE END AS lng,
      CASE WHEN id % 3 <> 0 THEN town || '-' || CAST(g % 8 AS VARCHAR)
           WHEN id % 8 <> 0 THEN town || ' – Obec ' || CAST(g % 5 AS VARCHAR)
           ELSE 'Obec ' || CAST(g % 5 AS VARCHAR) END AS locality_text,
      CASE WHEN id % 3 = 2 OR (id % 3 = 0 AND id % 2 = 0) THEN 'agency' ELSE 'private' END AS seller_type,
      'https://www.sreality.cz/detail/prodej/dum/'
        || CASE {A_KIND} WHEN 'vila' THEN 'vila' WHEN 'recreational' THEN 'chata' ELSE 'rodinny' END || '/'
        || CASE WHEN id % 7 <> 0 THEN lower(town) ELSE 'okres' END || '-obec-' || CAST(g % 5 AS VARCHAR)
        || CASE WHEN id % 2 = 0 THEN '' ELSE '-ulice' END || '/' || CAST(id AS VARCHAR) AS url,
      CASE WHEN id % 4 = 0 THEN 'https://img.example/' || CAST(id AS VARCHAR) || '.jpg'
        ELSE 'https://d18.sdn.cz/a/' || CAST(id AS VARCHAR) || '.jpg?fl=res,100,100,1|jpg,80 https://x.example/'
          || CAST(id AS VARCHAR) || '.jpg https://d18.sdn.cz/q/' || CAST(id AS VARCHAR) || '.jpg?x=1' END AS photos
    FROM src WHERE id % 43 <> 0""",
)
def _(spark, sf):
    rows = P.normalize_search_json(a_pages(spark, sf))
    return rows.select(
        F.expr("10 + cast(source_id as bigint) % 2").alias("region"),
        "source_id",
        "page_no",
        "price",
        "property_kind",
        "usable_area_m2",
        "land_area_m2",
        "lat",
        "lng",
        "locality_text",
        "seller_type",
        "url",
        F.array_join("photos", " ").alias("photos"),
    )


DETAIL_ITEM = f"""concat('{{"result":{{"advert_description":"<p>Dům&nbsp;', cast(id as string), '</p> <br/>  text"',
  ',"usable_area":', case when id % 3 = 0 then concat('"', cast(u as string), ' m"') else cast(u as string) end,
  case when id % 4 = 0 then '' else concat(',"estate_area":', cast(l as string)) end, ',"garden_area":"', cast(l + 5 as string), '"',
  case when id % 5 = 0 then ',"floor_area":55' else ',"building_area":null,"floor_area":66' end,
  ',"room_count_cb":', case when id % 6 = 0 then '{{"name":7}}' else '{{"name":"4+kk"}}' end,
  ',"since":', case when id % 7 = 0 then '"not a date"' when id % 7 = 1 then 'null' else '"2001-07-30T10:00:00Z"' end,
  ',"beginning_date":"2001-06-01"',
  case id % 3 when 0 then '' when 1 then ',"premise":{{"seo_name":"rk-1","company":{{"company_ic":"123"}}}}'
      else ',"premise":{{"name":"RK Dva","company":{{"company_ic":""}}}}' end,
  ',"exclusively_at_rk":', case when id % 2 = 0 then 'true' else '1' end,
  ',"price_summary_old_czk":', case when id % 5 = 0 then 'null' else '"9 000 000 Kč"' end, ',"price_summary_old":100',
  ',"price_czk":', coalesce(cast(price as string), 'null'), '}}}}') as payload"""


@query(
    "normalize_detail_json",
    """SELECT CAST(id AS VARCHAR) AS source_id, 'Dům ' || CAST(id AS VARCHAR) || ' text' AS description,
      u AS usable_area_m2, CASE WHEN id % 4 = 0 THEN l + 5 ELSE l END AS land_area_m2,
      CASE WHEN id % 5 = 0 THEN 55 ELSE 66 END AS built_up_area_m2,
      CASE WHEN id % 6 <> 0 THEN '4+kk' END AS disposition,
      CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '2001-06-01' ELSE '2001-07-30' END AS posted,
      CASE WHEN id % 3 = 0 THEN 'private' ELSE 'agency' END AS seller_type, id % 3 = 1 AS has_ico,
      CASE id % 3 WHEN 1 THEN 'rk-1' WHEN 2 THEN 'RK Dva' END AS seller_name,
      concat_ws(',', CASE WHEN id % 2 = 0 THEN 'EXCLUSIVE' END,
        CASE WHEN price > 0 AND CASE WHEN id % 5 = 0 THEN 100 ELSE 9000000 END > price THEN 'LOWERED_PRICE' END) AS labels
    FROM src""",
)
def _(spark, sf):
    details = _rows(spark, sf).selectExpr(
        "'sreality' as source", "cast(id as string) as source_id", DETAIL_ITEM
    )
    return P.normalize_detail_json(details).select(
        "source_id",
        "description",
        "usable_area_m2",
        "land_area_m2",
        "built_up_area_m2",
        "disposition",
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted"),
        "seller_type",
        "has_ico",
        "seller_name",
        F.array_join("labels", ",").alias("labels"),
    )


B_ITEM = f"""concat('{{"id":', case when id % 43 = 0 then 'null' else concat('"b', cast(id as string), '"') end,
  ',"uri":', case when id % 9 = 0 then '""' else concat('"dum-', cast(id as string), '"') end,
  ',"title":"', case id % 4 when 0 then 'Vila a chata' when 1 then 'Rekreační objekt' when 2 then 'Dům' else '' end,
  '","description":"', case when id % 5 = 0 then '' else concat('Popis ', cast(id as string)) end,
  '","price":', case when id % 6 = 0 then concat('"', coalesce(cast(price as string), ''), '"') else coalesce(cast(price as string), 'null') end,
  ',"originalPrice":', case when id % 2 = 0 then '4000000' else 'null' end,
  ',"surface":', cast(u as string), ',"surfaceLand":"', cast(l as string), '"',
  ',"disposition":', case id % 5 when 0 then '"DISP_5_KK"' when 1 then '"DISP_3_1"' when 2 then '"DISP_6"' when 3 then '"OSTATNI"' else '4' end,
  ',"gps":', case when id % 8 = 0 then 'null' else concat('{{"lat":', {_DEGREES.format("lat_i")}, ',"lng":', {_DEGREES.format("lng_i")}, '}}') end,
  ',"cityDistrict":', case when id % 3 = 0 then '""' else concat('"', town, '"') end, ',"city":"Mesto","address":"Adresa"',
  ',"mainImage":', case when id % 7 = 0 then 'null' else concat('{{"url":"https://b.example/', cast(id as string), '/1.jpg"}}') end,
  ',"publicImages":[{{"url":"https://b.example/', cast(id as string), '/0.jpg"}},{{"url":null}},{{"url":"https://b.example/', cast(id as string),
  '/1.jpg"}},{{"url":"https://b.example/', cast(id as string), '/0.jpg"}}]',
  ',"broker":', case when id % 3 = 1 then '{{"id":"9"}}' else 'null' end, '}}') as item"""


def b_pages(spark, sf):
    rows = _rows(spark, sf).selectExpr("id", "id as idx", B_ITEM)
    return _pages(
        rows, P.PORTAL_B.name, "'all'", '{"data":{"listAdverts":{"totalCount":{total},"list":[{items}]}}}',
        first=P.PORTAL_B.first_page,
    )


@query(
    "normalize_adverts_json",
    """SELECT 'b' || CAST(id AS VARCHAR) AS source_id,
      CASE WHEN id % 9 <> 0 THEN 'https://www.bezrealitky.cz/nemovitosti-byty-domy/dum-' || CAST(id AS VARCHAR) END AS url,
      CASE WHEN id % 6 <> 0 THEN price END AS price,
      CASE id % 4 WHEN 0 THEN 'vila' WHEN 1 THEN 'recreational' ELSE 'rodinny_dum' END AS property_kind,
      u AS usable_area_m2, CAST(NULL AS BIGINT) AS land_area_m2,
      CASE id % 5 WHEN 0 THEN '5+kk' WHEN 1 THEN '3+1' WHEN 2 THEN '6' END AS disposition,
      CASE WHEN id % 8 <> 0 THEN CAST(lat_i AS DOUBLE) / 10000::DOUBLE END AS lat,
      CASE WHEN id % 8 <> 0 THEN CAST(lng_i AS DOUBLE) / 10000::DOUBLE END AS lng,
      CASE WHEN id % 3 = 0 THEN 'Mesto' ELSE town END AS locality_text,
      CASE WHEN id % 3 = 1 THEN 'agency' ELSE 'private' END AS seller_type, id % 3 = 1 AS has_ico,
      CASE WHEN id % 5 <> 0 THEN 'Popis ' || CAST(id AS VARCHAR) END AS description,
      CASE WHEN id % 7 <> 0 THEN 'https://b.example/' || CAST(id AS VARCHAR) || '/1.jpg https://b.example/' || CAST(id AS VARCHAR) || '/0.jpg'
        ELSE 'https://b.example/' || CAST(id AS VARCHAR) || '/0.jpg https://b.example/' || CAST(id AS VARCHAR) || '/1.jpg' END AS photos,
      CASE WHEN id % 2 = 0 AND id % 6 <> 0 AND price > 0 AND price < 4000000 THEN 'LOWERED_PRICE' ELSE '' END AS labels
    FROM src WHERE id % 43 <> 0""",
)
def _(spark, sf):
    return P.normalize_adverts_json(b_pages(spark, sf)).select(
        "source_id",
        "url",
        "price",
        "property_kind",
        "usable_area_m2",
        F.col("land_area_m2").cast("long").alias("land_area_m2"),
        "disposition",
        "lat",
        "lng",
        "locality_text",
        "seller_type",
        "has_ico",
        "description",
        F.array_join("photos", " ").alias("photos"),
        F.array_join("labels", ",").alias("labels"),
    )


# Cards 0..59 of a page; every sixth house repeats its first advert's card.
C_ITEM = """concat('<div class="card"><a href="/prodej/rodinne-domy/dum-v-obci-', cast(id as string),
  '.html" title="x" class="link i-estate__image-link"><img alt="',
  case id % 4 when 0 then 'Prodej chaty a vily ' when 1 then 'Prodej vily ' else 'Prodej rodinného domu ' end,
  case when id % 9 = 0 then '' else concat(cast(u as string), ' m² ') end, town,
  '" src="https://img-cache.ceskereality.cz/', case when id % 10 = 0 then concat(cast(id as string), '.png')
    else concat('foto/', cast(id as string), '.jpg') end, '"></a>',
  case when price is null then '<b>Cena na dotaz</b>' else concat('<span class="i-estate__footer-price-value" > ',
    cast(price div 1000 as string), ' ', lpad(cast(price % 1000 as string), 3, '0'), ' Kč</span>') end, '</div>')"""


def c_pages(spark, sf):
    rows = _rows(spark, sf).selectExpr("id", "id as idx", f"{C_ITEM} as card")
    item = F.expr("case when id % 6 = 0 then concat(card, replace(card, 'Kč', 'Kčs')) else card end")
    pages = _pages(
        rows.withColumn("item", item), P.PORTAL_C.name, "'all'", "<html><body>{items}</body></html>", 60
    )
    return pages


@query(
    "normalize_search_html",
    """SELECT CAST(id AS VARCHAR) AS source_id, id // 60 + 1 AS page_no,
      'https://stredo.ceskereality.cz/prodej/rodinne-domy/dum-v-obci-' || CAST(id AS VARCHAR) || '.html' AS url,
      price, CASE id % 4 WHEN 0 THEN 'recreational' WHEN 1 THEN 'vila' ELSE 'rodinny_dum' END AS property_kind,
      CASE WHEN id % 9 <> 0 THEN u END AS usable_area_m2, CASE WHEN id % 9 <> 0 THEN town END AS locality_text,
      'agency' AS seller_type, CAST(NULL AS BOOLEAN) AS has_ico,
      CASE WHEN id % 10 <> 0 THEN 'https://img-cache.ceskereality.cz/foto/' || CAST(id AS VARCHAR) || '.jpg' ELSE '' END AS photos
    FROM src""",
)
def _(spark, sf):
    return P.normalize_search_html(c_pages(spark, sf)).select(
        "source_id",
        "page_no",
        "url",
        "price",
        "property_kind",
        "usable_area_m2",
        "locality_text",
        "seller_type",
        "has_ico",
        F.array_join("photos", " ").alias("photos"),
    )


C_DETAIL = f"""concat('<script type="application/ld+json">{{"@type":"Organization"}}</script>',
  '<script type="application/ld+json">{{broken</script><script type="application/ld+json" id="p">{{"@type":"individualProduct","name":"Dům ',
  cast(u as string), ' m² v obci","image":"https://img-cache.ceskereality.cz/main/', cast(id as string), '.jpg","description":"Hezk&yacute; d&#x16F;m &amp; zahrada&#44; <b>',
  cast(id as string), '</b> &amp;lt; &foo;","offers":{{"price":', case when id % 2 = 0 then concat('"', cast(coalesce(price, 1) as string), ' Kč"') else cast(coalesce(price, 1) as string) end,
  ',"areaServed":{{"address":{{"addressLocality":"', case when id % 3 = 0 then '' else town end, '"}}}}}}}}</script>',
  '<div data-lat="', {_DEGREES.format("lat_i")}, '"', case when id % 5 = 0 then '' else concat(' data-LNG: "', {_DEGREES.format("lng_i")}, '"') end, '>',
  '<img src="https://img-cache.ceskereality.cz/g/100x80_jpg/', cast(id as string), '.jpg"><img src="https://img-cache.ceskereality.cz/g/640x640_jpg/', cast(id as string), '.jpg"></div>')
  as payload"""


@query(
    "normalize_detail_html",
    """SELECT CAST(id AS VARCHAR) AS source_id, coalesce(price, 1) AS price,
      'Hezký dům & zahrada, ' || CAST(id AS VARCHAR) || ' &lt; &foo;' AS description,
      CASE WHEN id % 3 <> 0 THEN town END AS locality_text, u AS usable_area_m2,
      CASE WHEN id % 5 <> 0 THEN CAST(lat_i AS DOUBLE) / 10000::DOUBLE END AS lat,
      CASE WHEN id % 5 <> 0 THEN CAST(lng_i AS DOUBLE) / 10000::DOUBLE END AS lng,
      'https://img-cache.ceskereality.cz/main/' || CAST(id AS VARCHAR) || '.jpg https://img-cache.ceskereality.cz/g/640x640_jpg/'
        || CAST(id AS VARCHAR) || '.jpg' AS photos
    FROM src""",
)
def _(spark, sf):
    details = _rows(spark, sf).selectExpr(
        "'ceskereality' as source", "cast(id as string) as source_id", C_DETAIL
    )
    return P.normalize_detail_html(details).select(
        "source_id",
        "price",
        "description",
        "locality_text",
        "usable_area_m2",
        "lat",
        "lng",
        F.array_join("photos", " ").alias("photos"),
    )


def all_pages(spark, sf):
    """All portals' pages of one crawl."""
    return a_pages(spark, sf).unionByName(b_pages(spark, sf)).unionByName(c_pages(spark, sf))


@query(
    "page_stats",
    """SELECT 'sreality' AS source, CAST(10 + id % 2 AS VARCHAR) AS region, id // 2 // 100 + 1 AS page_no,
         count(*) AS n, any_value(t) AS total
       FROM (SELECT *, count(*) OVER (PARTITION BY id % 2) AS t FROM src) GROUP BY ALL
       UNION ALL SELECT 'bezrealitky', 'all', id // 100, count(*), any_value(t)
       FROM (SELECT *, count(*) OVER () AS t FROM src) GROUP BY ALL
       UNION ALL SELECT 'ceskereality', 'all', id // 60 + 1, count(*) + count(*) FILTER (WHERE id % 6 = 0), NULL
       FROM src GROUP BY ALL""",
)
def _(spark, sf):
    return P.page_stats(all_pages(spark, sf)).select("source", "region", "page_no", "n", "total")


def broken_passes(spark, sf):
    """Run 1 as landed; run 2 loses its last pages; run 3 ends C with an empty page, run 4 with a failed one.

    Of run 5, which ends like run 3, the first pages never landed.
    """
    stats = P.page_stats(all_pages(spark, sf))
    last = stats.groupBy("source", "region").agg(F.max("page_no").alias("_last"))
    cut = stats.join(last, ["source", "region"]).filter("page_no < _last").drop("_last")
    ends = last.filter("source = 'ceskereality'").selectExpr(
        "cast(0 as bigint) as run_id", "source", "region", "cast(_last + 1 as int) as page_no",
        "true as failed", "cast(0 as bigint) as n", "cast(null as bigint) as total",
    )
    columns = stats.columns
    runs = [
        stats,
        cut.withColumn("run_id", F.lit(2).cast("long")).select(*columns),
        stats.withColumn("run_id", F.lit(3).cast("long")).unionByName(
            ends.withColumns({"run_id": F.lit(3).cast("long"), "failed": F.lit(False)})
        ),
        stats.withColumn("run_id", F.lit(4).cast("long")).unionByName(
            ends.withColumn("run_id", F.lit(4).cast("long"))
        ),
        stats.filter("page_no > 1").withColumn("run_id", F.lit(5).cast("long")).unionByName(
            ends.withColumns({"run_id": F.lit(5).cast("long"), "failed": F.lit(False)})
        ),
    ]
    out = runs[0]
    for df in runs[1:]:
        out = out.unionByName(df)
    return out


COMPLETE_SQL = """SELECT run_id, source, CASE source WHEN 'ceskereality' THEN run_id = 3 {extra} ELSE run_id NOT IN (2, 5) END AS completed
  FROM (SELECT unnest([1, 2, 3, 4, 5]) AS run_id), (SELECT unnest(['sreality', 'bezrealitky', 'ceskereality']) AS source)
  WHERE EXISTS (SELECT 1 FROM src)"""


@query("run_completeness", COMPLETE_SQL.format(extra=""))
def _(spark, sf):
    return P.run_completeness(broken_passes(spark, sf))


@query("run_completeness_strict", COMPLETE_SQL.format(extra="OR run_id = 4"))
def _(spark, sf):
    return P.run_completeness(broken_passes(spark, sf), strict=True)


RUN_COLUMNS = ["source_id", "url", "price", "property_kind", "usable_area_m2", "locality_text", "seller_type", "photos"]
RUN_SQL = "\nUNION ALL\n".join(
    f"SELECT '{portal.name}' AS source, {', '.join(RUN_COLUMNS)} FROM ({ORACLES[name]})"
    for portal, name in zip(
        P.PORTALS, ["normalize_search_json", "normalize_adverts_json", "normalize_search_html"], strict=True
    )
)


def run_rows(rows):
    return rows.select(
        "source", *[F.array_join("photos", " ").alias(c) if c == "photos" else c for c in RUN_COLUMNS]
    )


@query("normalize_pages", RUN_SQL)
def _(spark, sf):
    return run_rows(P.normalize_pages(all_pages(spark, sf)))


@query("parsed_run", RUN_SQL)
def _(spark, sf):
    """The same adverts from the stored run table, for which every page is parsed once."""
    return run_rows(P.normalize_pages(P.store_entries(all_pages(spark, sf))))


SQL_SPACE = "[\\s\\v\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


@query(
    "strip_html",
    f"""SELECT page_id, nullif(trim(regexp_replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '),
         '{SQL_SPACE}', ' ', 'g')), '') AS text FROM pages""",
)
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


@query(
    "clean_description",
    f"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(
         replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
           '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '{SQL_SPACE}', ' ', 'g')), '') AS text FROM pages""",
)
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", clean_description(F.col("html")).alias("text"))


@query(
    "digits_to_number",
    """SELECT doc_id, TRY_CAST(nullif(regexp_replace(text, '[^0-9]', '', 'g'), '') AS DOUBLE) AS digits FROM documents""",
)
def _(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", digits_to_number(F.col("text")).alias("digits")
    )


GEOJSON = """concat('{"type":"Feature","properties":',
  case k % 4 when 0 then concat('{"NAZEV":"', s_name, '","KOD":', cast(600000 + k div 8 as string), '}')
    when 1 then concat('{"name":"', s_name, '","code":""}') when 2 then 'null' else concat('{"NAZEV":"","TEXT":"', s_name, '"}') end,
  case when k % 3 = 1 then concat(',"id":"f', cast(k as string), '"') else '' end, ',"geometry":',
  case when k % 7 = 6 then 'null'
    when k % 2 = 0 then '{"type":"Polygon","coordinates":[[[14,50],[15,50],[15,51],[14,50]]]}'
    else '{"type":"MultiPolygon","coordinates":[[[[14,50],[15,50],[15,51],[14,50]]],[[[16,50],[17,50],[17,51],[16,50]]]]}' end, '}') as f"""
block(
    "feature",
    """SELECT *, CASE k % 4 WHEN 2 THEN 'r-' || CAST(index AS VARCHAR) ELSE s_name END AS name,
    CASE k % 4 WHEN 0 THEN CAST(600000 + k // 8 AS VARCHAR) END AS given,
    CASE WHEN k % 3 = 1 THEN 'f' || CAST(k AS VARCHAR) END AS fid
  FROM (SELECT s_suppkey AS k, s_name,
          row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) - 1 AS index FROM supplier)
  WHERE k % 7 <> 6""",
)


@query(
    "load_areas",
    """SELECT code, arg_max(name, k) AS name, arg_max(CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END, k) AS polygons,
         'obec' AS kind
       FROM (SELECT *, coalesce(given, fid, 'r:' || name || ':' || CAST(index AS VARCHAR)) AS code FROM feature)
       GROUP BY code""",
)
def _(spark, sf):
    """Feature collections of 50 suppliers each, written to files and loaded."""
    path = scratch_path(spark, "boundaries")
    features = X.table(spark, sf, "supplier").selectExpr(
        "s_suppkey as k", "s_name"
    ).selectExpr("k", "lpad(cast(k div 50 as string), 8, '0') as chunk", GEOJSON)
    collections = features.groupBy("chunk").agg(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("k", "f"))), lambda e: e["f"]), ","
            ),
            F.lit("]}"),
        ).alias("value")
    )
    collections.write.partitionBy("chunk").text(path)
    loaded = load_areas(spark, path, kind="obec", region="r")
    return loaded.select("code", "name", F.size("rings").alias("polygons"), "kind")
