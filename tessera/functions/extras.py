"""Further function families: time zones and epochs, formats, zipped arrays, text maps, JSON schemas, safe casts, places on a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import haversine_km
from tessera.operators.catalog import Tables, query


@query("""SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS unix, strftime(ts, '%Y/%m/%d %H:%M:%S') AS text, date_trunc('second', ts) AS back, CAST(minute(ts) AS INTEGER) AS mi, CAST(floor(second(ts)) AS INTEGER) AS se,
ts + INTERVAL 330 MINUTE AS kolkata, ts - INTERVAL 330 MINUTE AS utc, make_timestamp(2024, 2, 29, 12, 30, 0.0) AS made, CAST(ts AS DATE) + CAST((8 - isodow(ts)) % 7 + CASE WHEN isodow(ts) = 1 THEN 7 ELSE 0 END AS INTEGER) AS monday FROM events""")
def fn_time_zone(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    plain = lambda c: c.cast("timestamp_ntz")
    text = F.date_format(ts, "yyyy/MM/dd HH:mm:ss")
    return t.events.select(
        "event_id", F.unix_timestamp(ts).alias("unix"), F.from_unixtime(F.unix_timestamp(ts), "yyyy/MM/dd HH:mm:ss").alias("text"), plain(F.to_timestamp(text, "yyyy/MM/dd HH:mm:ss")).alias("back"),
        F.minute(ts).alias("mi"), F.second(ts).alias("se"), plain(F.from_utc_timestamp(ts, "Asia/Kolkata")).alias("kolkata"), plain(F.to_utc_timestamp(ts, "Asia/Kolkata")).alias("utc"),
        plain(F.make_timestamp(F.lit(2024), F.lit(2), F.lit(29), F.lit(12), F.lit(30), F.lit(0))).alias("made"), F.next_day(F.to_date(ts), "Mon").alias("monday"),
    )


@query("""SELECT o_orderkey, round(CASE WHEN day(a) = day(b) OR (a = last_day(a) AND b = last_day(b)) THEN m ELSE m + (day(a) - day(b)) / 31 END, 6) AS months
FROM (SELECT o_orderkey, a, b, (year(a) - year(b)) * 12 + month(a) - month(b) AS m FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, DATE '1994-05-31' AS b FROM orders))""")
def fn_months_between(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.months_between(F.to_date("o_orderdate"), F.lit("1994-05-31").cast("date")), 6).alias("months"))


@query("""SELECT p_partkey, printf('%05d|%s', p_partkey, p_brand) AS fs, format('{:,.2f}', p_retailprice) AS fn, substr(p_type, 1, 1) || '##' || substr(p_type, 4) AS ov, position('e' IN p_name) AS loc, CAST(position('a' IN substr(p_name, 4)) + CASE WHEN position('a' IN substr(p_name, 4)) > 0 THEN 3 ELSE 0 END AS INTEGER) AS loc4,
array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap, ltrim('  ' || p_brand) AS lt, rtrim(p_brand || '  ') AS rt, to_base64(encode(p_name)) AS b64, p_name AS plain, sha1(p_name) AS sha FROM part""")
def fn_format(t: Tables) -> DataFrame:
    n, b = F.col("p_name"), F.col("p_brand")
    return t.part.select(
        "p_partkey", F.format_string("%05d|%s", "p_partkey", b).alias("fs"), F.format_number("p_retailprice", 2).alias("fn"), F.overlay("p_type", F.lit("##"), 2).alias("ov"),
        F.locate("e", n).cast("long").alias("loc"), F.locate("a", n, 4).alias("loc4"), F.initcap(n).alias("cap"), F.ltrim(F.concat(F.lit("  "), b)).alias("lt"), F.rtrim(F.concat(b, F.lit("  "))).alias("rt"),
        F.base64(n.cast("binary")).alias("b64"), F.unbase64(F.base64(n.cast("binary"))).cast("string").alias("plain"), F.sha1(n).alias("sha"),
    )


@query("""SELECT p_partkey, list_transform(list_zip(w, [1, 2, 3][1:len(w)]), lambda x: x[1] || CAST(x[2] AS VARCHAR)) AS zipped, list_transform(range(1, len(w) + 1), lambda i: length(w[i]) * CAST(i AS INTEGER)) AS summed, [p_brand || '=1', p_type || '=2'] AS entries
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")
def fn_zip(t: Tables) -> DataFrame:
    w = t.part.withColumn("w", F.split("p_name", " ")).withColumn("k", F.sequence(F.lit(1), F.size("w")))
    pair = F.arrays_zip("w", "k")
    entries = F.map_entries(F.create_map("p_brand", F.lit(1), "p_type", F.lit(2)))
    return w.select(
        "p_partkey", F.transform(pair, lambda x: F.concat(x["w"], x["k"].cast("string"))).alias("zipped"), F.zip_with("w", "k", lambda a, b: (F.length(a) * b).cast("long")).alias("summed"),
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))).alias("entries"),
    )


@query("""SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, CAST(2 AS INTEGER) AS n FROM part""")
def fn_str_to_map(t: Tables) -> DataFrame:
    text = F.concat(F.lit("brand="), F.col("p_brand"), F.lit(";size="), F.col("p_size").cast("string"))
    return t.part.withColumn("m", F.str_to_map(text, F.lit(";"), F.lit("="))).select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size"), F.size("m").alias("n"))


@query("""SELECT 'STRUCT<a: BIGINT, b: ARRAY<DOUBLE>>' AS schema, CAST(NULL AS INTEGER) AS lost, -1 AS size_of_null""")
def fn_schema_of_json(t: Tables) -> DataFrame:
    sample = '{"a": 1, "b": [1.5]}'
    return t.spark.range(1).select(
        F.schema_of_json(F.lit(sample)).alias("schema"), F.from_json(F.lit("broken"), "x int")["x"].alias("lost"), F.coalesce(F.size(F.lit(None).cast("array<int>")), F.lit(-1)).alias("size_of_null")
    )


@query("""SELECT * FROM (VALUES ('$1,234.5', 1234.5::DOUBLE, 2, 1234), ('x', NULL, NULL, NULL), (NULL, NULL, NULL, NULL)) v(raw, number, half_even, whole)""")
def fn_try(t: Tables) -> DataFrame:
    raw = t.spark.createDataFrame([("$1,234.5",), ("x",), (None,)], "raw string")
    number = F.try_to_number("raw", F.lit("$9,999.9")).cast("double")
    even = F.when(number.isNotNull(), F.bround(F.lit(2.5), 0)).cast("int")
    return raw.select("raw", number.alias("number"), even.alias("half_even"), F.floor(number).cast("int").alias("whole"))


#: Places that ``nearest`` takes.
MAX_PLACES = 1000


def bounding_box(lat: Column, lon: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Whether a point lies in a box; one whose west edge lies east of the other crosses the date line."""
    inside = (lon >= low[1]) & (lon <= high[1]) if low[1] <= high[1] else (lon >= low[1]) | (lon <= high[1])
    return (lat >= low[0]) & (lat <= high[0]) & inside


def grid_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Name of the grid cell of a point."""
    return F.concat_ws(":", F.floor(lat / degrees).cast("string"), F.floor(lon / degrees).cast("string"))


def nearest(points: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, place, km) of the nearest of ``places`` (place, plat, plon), a small table, for each of ``points`` (key, lat, lon); ties go to the least place."""
    if places.count() > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} places; join by grid cells instead")
    met = points.crossJoin(F.broadcast(places))  # few places, counted
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return met.groupBy(key).agg(F.min(F.struct(km.alias("km"), "place")).alias("m")).select(key, F.col("m.place").alias("place"), F.col("m.km").alias("km"))


_PLACES = [("berlin", 52.52, 13.405), ("lima", -12.046, -77.043), ("osaka", 34.694, 135.502)]


@query("""WITH p AS (SELECT c_custkey, c_custkey * 37 % 170 - 85 AS lat, c_custkey * 91 % 350 - 175 AS lon FROM customer),
k AS (SELECT c_custkey, place, 2 * 6371 * asin(sqrt(least(1.0, power(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2)))) AS km
FROM p, (VALUES ('berlin', 52.52, 13.405), ('lima', -12.046, -77.043), ('osaka', 34.694, 135.502)) v(place, plat, plon))
SELECT c_custkey, arg_min(place, (km, place)) AS place, round(min(km), 4) AS km, any_value(lat BETWEEN 0 AND 60 AND (lon >= 100 OR lon <= -100)) AS boxed, any_value(CAST(floor(lat / 10.0) AS VARCHAR).split('.')[1] || ':' || CAST(floor(lon / 10.0) AS VARCHAR).split('.')[1]) AS cell FROM k JOIN p USING (c_custkey) GROUP BY 1""")
def geo_nearest(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    points = t.customer.select("c_custkey", (k * 37 % 170 - 85).cast("double").alias("lat"), (k * 91 % 350 - 175).cast("double").alias("lon"))
    found = nearest(points, t.spark.createDataFrame(_PLACES, "place string, plat double, plon double"), "c_custkey")
    boxed = points.select("c_custkey", bounding_box(F.col("lat"), F.col("lon"), (0, 100), (60, -100)).alias("boxed"), grid_cell(F.col("lat"), F.col("lon"), 10.0).alias("cell"))
    return found.join(boxed, "c_custkey").select("c_custkey", "place", F.round("km", 4).alias("km"), "boxed", "cell")
