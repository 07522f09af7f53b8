"""Scalar, array, map, struct, JSON and higher-order functions, a family a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import Tables, query


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


@query("""SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, reverse(p_brand) AS r, substr(p_type, 2, 4) AS sub, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS lp,
rpad(p_brand, 12, '*') AS rp, trim('  ' || p_brand || ' ') AS tr, replace(p_type, 'A', '_') AS re, repeat('ab', 2) AS rep, split_part(p_type, ' ', 1) AS head, concat_ws('-', p_brand, CAST(p_size AS VARCHAR)) AS cw,
instr(p_name, 'a') AS pos, translate(p_brand, '#1', '@I') AS tl, left(p_name, 3) AS le, right(p_name, 3) AS ri, ascii(p_name) AS asc_code FROM part""")
def fn_string(t: Tables) -> DataFrame:
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    size = F.col("p_size").cast("string")
    return t.part.select(
        "p_partkey", F.upper(n).alias("u"), F.lower(k).alias("l"), F.length(n).cast("long").alias("n"), F.reverse(b).alias("r"), F.substring(k, 2, 4).alias("sub"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("lp"), F.rpad(b, 12, "*").alias("rp"), F.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("tr"),
        F.replace(k, F.lit("A"), F.lit("_")).alias("re"), F.repeat(F.lit("ab"), 2).alias("rep"), F.substring_index(k, " ", 1).alias("head"), F.concat_ws("-", b, size).alias("cw"),
        F.instr(n, "a").cast("long").alias("pos"), F.translate(b, "#1", "@I").alias("tl"), F.left(n, F.lit(3)).alias("le"), F.right(n, F.lit(3)).alias("ri"), F.ascii(n).alias("asc_code"),
    )


@query("""SELECT p_partkey, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS x, regexp_replace(p_type, '[AEIOU]', '', 'g') AS r, regexp_extract_all(p_name, '[aeiou]') AS v, len(regexp_extract_all(p_name, '[a-z]')) AS c,
levenshtein(p_name, p_type) AS d, regexp_matches(p_type, 'A.*E') AS m FROM part""")
def fn_regex(t: Tables) -> DataFrame:
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.regexp_extract(b, "#([0-9])([0-9])", 2).alias("x"), F.regexp_replace(k, "[AEIOU]", "").alias("r"), F.regexp_extract_all(n, F.lit("[aeiou]"), F.lit(0)).alias("v"),
        F.regexp_count(n, F.lit("[a-z]")).cast("long").alias("c"), F.levenshtein(n, k).cast("long").alias("d"), k.rlike("A.*E").alias("m"),
    )


@query("""SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, CAST(quarter(d) AS INTEGER) AS q, CAST(month(d) AS INTEGER) AS m, CAST(day(d) AS INTEGER) AS dd, CAST(dayofweek(d) + 1 AS INTEGER) AS dw, CAST(dayofyear(d) AS INTEGER) AS dy,
CAST(weekofyear(d) AS INTEGER) AS w, last_day(d) AS ld, date_trunc('month', d)::DATE AS mo, strftime(d, '%Y-%m') AS f, CAST(hour(o_orderdate) AS INTEGER) AS h, monthname(d)[1:3] AS mn FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def fn_date_parts(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), F.dayofmonth(d).alias("dd"), F.dayofweek(d).alias("dw"), F.dayofyear(d).alias("dy"), F.weekofyear(d).alias("w"),
        F.last_day(d).alias("ld"), F.trunc(d, "month").alias("mo"), F.date_format(d, "yyyy-MM").alias("f"), F.hour("o_orderdate").alias("h"), F.monthname(d).alias("mn"),
    )


@query("""SELECT o_orderkey, CAST(d + 30 AS DATE) AS plus, CAST(d - 7 AS DATE) AS minus, CAST(date_diff('day', DATE '1995-01-01', d) AS INTEGER) AS days, CAST(d + INTERVAL 3 MONTH AS DATE) AS later, make_date(CAST(year(d) AS INTEGER), 1, 1) AS jan,
CAST(epoch(d) AS BIGINT) AS unix, CAST(strptime('2024-02-29', '%Y-%m-%d') AS DATE) AS leap, try_strptime(o_orderpriority, '%Y-%m-%d') IS NULL AS bad FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def fn_date_math(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.date_add(d, 30).alias("plus"), F.date_sub(d, 7).alias("minus"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"), F.add_months(d, 3).alias("later"),
        F.make_date(F.year(d), F.lit(1), F.lit(1)).alias("jan"), F.unix_seconds(d.cast("timestamp")).alias("unix"), F.to_date(F.lit("2024-02-29"), "yyyy-MM-dd").alias("leap"),
        F.try_to_date("o_orderpriority", "yyyy-MM-dd").isNull().alias("bad"),
    )


@query("""SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(sign(c_acctbal) AS DOUBLE) AS s, round(sqrt(abs(c_acctbal)), 6) AS q, round(cbrt(c_acctbal), 6) AS cb,
c_custkey % 7 AS m, greatest(c_acctbal, 100.0::DOUBLE) AS g, least(c_acctbal, 100.0::DOUBLE) AS l, CAST(factorial(CAST(c_custkey % 10 AS INTEGER)) AS BIGINT) AS fa, round(sin(c_custkey), 6) AS si, round(degrees(c_custkey), 4) AS de,
round(atan2(c_acctbal, c_custkey), 6) AS at FROM customer""")
def fn_math(t: Tables) -> DataFrame:
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return t.customer.select(
        k, F.abs(b).alias("a"), F.ceil(b).alias("c"), F.floor(b).alias("f"), F.signum(b).alias("s"), F.round(F.sqrt(F.abs(b)), 6).alias("q"), F.round(F.cbrt(b), 6).alias("cb"), (k % 7).alias("m"),
        F.greatest(b, F.lit(100.0)).alias("g"), F.least(b, F.lit(100.0)).alias("l"), F.factorial((k % 10).cast("int")).alias("fa"), F.round(F.sin(k), 6).alias("si"), F.round(F.degrees(k), 4).alias("de"), F.round(F.atan2(b, k), 6).alias("at"),
    )


@query("""SELECT p_partkey, round(ln(p_retailprice), 8) AS ln, round(log10(p_retailprice), 8) AS l10, round(log2(p_retailprice), 8) AS l2, round(log(3, p_retailprice), 8) AS l3, round(exp(p_size / 10.0), 6) AS e, round(pow(p_size, 1.5), 6) AS p,
round(ln(1 + p_size), 8) AS l1, upper(hex(p_partkey)) AS h, bin(p_partkey) AS b FROM part""")
def fn_log_power(t: Tables) -> DataFrame:
    r, s, k = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    return t.part.select(
        k, F.round(F.ln(r), 8).alias("ln"), F.round(F.log10(r), 8).alias("l10"), F.round(F.log2(r), 8).alias("l2"), F.round(F.log(3.0, r), 8).alias("l3"), F.round(F.exp(s / 10.0), 6).alias("e"), F.round(F.pow(s, F.lit(1.5)), 6).alias("p"),
        F.round(F.log1p(s), 8).alias("l1"), F.hex(k).alias("h"), F.conv(k.cast("string"), 10, 2).alias("b"),
    )


@query("""SELECT doc_id, coalesce(quality, -1) AS a, CASE WHEN quality IS NULL THEN 'none' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS b, nullif(quality, 0) AS c, CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END AS d, if(toxic = 1, 'toxic', 'clean') AS e,
TRY_CAST(source AS INTEGER) AS f, TRY_CAST(substr(source, 4) AS INTEGER) AS g, 10 / nullif(quality, 0) AS h FROM documents LEFT JOIN labels USING (doc_id)""")
def fn_conditional(t: Tables) -> DataFrame:
    q = F.col("quality")
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.coalesce(q, F.lit(-1)).alias("a"), F.when(q.isNull(), "none").when(q == 1, "good").otherwise("bad").alias("b"), F.nullif(q, F.lit(0)).alias("c"), F.nvl2(q, F.lit(1), F.lit(0)).alias("d"),
        F.expr("if(toxic = 1, 'toxic', 'clean')").alias("e"), F.col("source").try_cast("int").alias("f"), F.substring("source", 4, 9).try_cast("int").alias("g"), F.try_divide(F.lit(10), q).alias("h"),
    )


_AR = "(SELECT p_partkey, string_split(p_type, ' ') AS a, [p_size, p_size % 5, 7] AS b, [7, 8] AS c FROM part)"


@query(f"""SELECT p_partkey, len(a) AS n, list_contains(b, 7) AS has, coalesce(list_position(b, 7), 0) AS pos, list_sort(list_distinct(b)) AS d, list_sort(b) AS s, list_reverse(a) AS r, array_to_string(a, '|') AS j, list_min(b) AS lo, list_max(b) AS hi,
list_sort(list_distinct(list_concat(b, c))) AS u, list_sort(list_intersect(b, c)) AS i, list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(c, x)))) AS e, a[1] AS f, list_slice(b, 2, 3) AS sl,
flatten([b, c]) AS fl, CAST(range(1, 4) AS INTEGER[]) AS sq, list_has_any(b, c) AS o, list_filter(b, lambda x: x <> 7) AS rm FROM {_AR}""")
def fn_array(t: Tables) -> DataFrame:
    s = F.col("p_size")
    base = t.part.select("p_partkey", F.split("p_type", " ").alias("a"), F.array(s, s % 5, F.lit(7)).alias("b"), F.array(F.lit(7), F.lit(8)).alias("c"))
    return base.select(
        "p_partkey", F.size("a").cast("long").alias("n"), F.array_contains("b", 7).alias("has"), F.array_position("b", 7).cast("int").alias("pos"), F.sort_array(F.array_distinct("b")).alias("d"), F.array_sort("b").alias("s"),
        F.reverse("a").alias("r"), F.array_join("a", "|").alias("j"), F.array_min("b").alias("lo"), F.array_max("b").alias("hi"), F.sort_array(F.array_union("b", "c")).alias("u"), F.sort_array(F.array_intersect("b", "c")).alias("i"),
        F.sort_array(F.array_except("b", "c")).alias("e"), F.element_at("a", 1).alias("f"), F.slice("b", 2, 2).alias("sl"), F.flatten(F.array("b", "c")).alias("fl"), F.sequence(F.lit(1), F.lit(3)).alias("sq"),
        F.arrays_overlap("b", "c").alias("o"), F.array_remove("b", 7).alias("rm"),
    )


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS norm2, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE, 6) AS peak,
len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_large, len(list_filter(embedding, lambda x: abs(x) >= 2)) = 0 AS all_small FROM embeddings""")
def fn_higher_order(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select(
        "vec_id", F.round(F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 5).alias("norm2"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"),
        F.round(F.array_max(F.transform(e, lambda x: F.abs(x))), 6).alias("peak"), F.exists("embedding", lambda x: x > F.lit(0.3)).alias("any_large"), F.forall("embedding", lambda x: F.abs(x) < 2).alias("all_small"),
    )


@query("""SELECT p_partkey, list_sort(map_keys(m)) AS k, list_sort(map_values(m)) AS v, m['size'] AS s, list_contains(map_keys(m), 'none') AS has, len(map_keys(m)) AS n FROM (SELECT p_partkey, map(['size', 'fifth'], [p_size, p_size % 5]) AS m FROM part)""")
def fn_map(t: Tables) -> DataFrame:
    s = F.col("p_size")
    base = t.part.select("p_partkey", F.map_concat(F.create_map(F.lit("size"), s), F.map_from_arrays(F.array(F.lit("fifth")), F.array(s % 5))).alias("m"))
    return base.select(
        "p_partkey", F.sort_array(F.map_keys("m")).alias("k"), F.sort_array(F.map_values("m")).alias("v"), F.element_at("m", "size").alias("s"), F.map_contains_key("m", "none").alias("has"), F.size("m").cast("long").alias("n")
    )


@query("""SELECT p_partkey, p_size * 2 AS twice, upper('SIZE') AS name, p_size > 20 AS large, CASE WHEN p_size > 20 THEN p_size END AS only_large, p_size + 100 AS zipped FROM part""")
def fn_map_lambda(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("size"), F.col("p_size"))
    keyed = F.transform_keys(F.transform_values(m, lambda k, v: v * 2), lambda k, v: F.upper(k))
    kept = F.map_filter(m, lambda k, v: v > 20)
    zipped = F.map_zip_with(m, F.create_map(F.lit("size"), F.lit(100)), lambda k, a, b: a + b)
    return t.part.select(
        "p_partkey", F.element_at(keyed, "SIZE").alias("twice"), F.map_keys(keyed)[0].alias("name"), (F.size(kept) > 0).alias("large"), F.try_element_at(kept, F.lit("size")).alias("only_large"), F.element_at(zipped, "size").alias("zipped")
    )


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_acctbal > 0 AS positive FROM customer")
def fn_struct(t: Tables) -> DataFrame:
    s = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    changed = s.withField("positive", F.col("c_acctbal") > 0).dropFields("nation")
    return t.customer.select("c_custkey", changed.alias("s")).select("c_custkey", "s.*")


@query("""SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.missing') AS missing, CAST(json_valid(props) AS BOOLEAN) AS ok FROM events""")
def fn_json(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.try_element_at(parsed, F.lit("missing")).alias("missing"), F.get_json_object(F.to_json(F.struct(F.col("props").alias("p"))), "$.p").isNotNull().alias("ok"))


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha256(concat(c_name, '|', c_mktsegment)) AS k FROM customer")
def fn_hash(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"), F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("k"))


@query()
def fn_hash_native(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.hash("c_name").alias("h"), F.xxhash64("c_name").alias("x"), F.crc32("c_name").alias("c"), F.soundex("c_name").alias("s"))


@query()
def fn_nondeterministic(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.rand(7).alias("r"), F.randn(7).alias("n"), F.uuid().alias("u"), F.monotonically_increasing_id().alias("i"), F.spark_partition_id().alias("p"))


@query("""SELECT a.n_name AS a, b.n_name AS b, round(2 * 6371 * asin(sqrt(least(power(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2), 1.0))), 4) AS km
FROM (SELECT n_name, n_nationkey * 7.0 - 80 AS y, n_nationkey * 13.0 - 170 AS x FROM nation) a JOIN (SELECT n_name, n_nationkey * 7.0 - 80 AS y, n_nationkey * 13.0 - 170 AS x FROM nation) b ON a.n_name < b.n_name""")
def geo_haversine(t: Tables) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    at = t.nation.select("n_name", (k * 7.0 - 80).alias("y"), (k * 13.0 - 170).alias("x"))
    a, b = at.alias("a"), at.alias("b")
    met = a.join(b, F.col("a.n_name") < F.col("b.n_name"))  # 25 places
    return met.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.round(haversine_km(F.col("a.y"), F.col("a.x"), F.col("b.y"), F.col("b.x")), 4).alias("km"))
