"""Profiling, gates, expectations, cleaning, imputation, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.alike import set_join
from tessera.operators.catalog import Tables, query


def profile(df: DataFrame) -> DataFrame:
    """One row a column: rows, non-null, distinct, min and max (as text), mean and standard deviation; one pass for all."""
    parts, numeric = [], {"int", "bigint", "double", "float", "smallint", "tinyint"}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        number = kind in numeric or kind.startswith("decimal")
        nothing = F.lit(None).cast("double")
        parts.append(F.struct(
            F.lit(name).alias("column"), F.count("*").alias("rows"), F.count(c).alias("present"), F.approx_count_distinct(c).alias("distinct_approx"),
            F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
            (F.avg(c).cast("double") if number else nothing).alias("mean"), (F.stddev(c).cast("double") if number else nothing).alias("stddev"),
        ))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def profile_more(df: DataFrame, columns: Sequence[str], top: int = 1) -> DataFrame:
    """(column, present, distinct, top, top_n, skew, kurtosis, p25, p50, p75, score) of numeric columns.

    One pass for the moments and percentiles, which are approximate, and one grouping
    for the values; ``score`` is the share of values present, less that of the rows
    that repeat the commonest one, at least 0.
    """
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("present"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"),
            F.percentile_approx(c, [0.25, 0.5, 0.75], 10000).alias("q"), F.count("*").alias("rows"),
        )
        for c in columns
    ]
    moments = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v IS NOT NULL")
    counted = values.groupBy("column", "v").agg(F.count("*").alias("n"))
    common = counted.groupBy("column").agg(F.count("*").alias("distinct"), F.max(F.struct("n", -F.col("v"))).alias("m"))
    score = F.greatest((F.col("present") - F.coalesce(F.col("m.n"), F.lit(0)) + F.when(F.col("present") > 0, 1).otherwise(0)) / F.greatest("rows", F.lit(1)), F.lit(0.0))
    met = moments.join(common, "column", "left")
    return met.select(
        "column", "present", F.coalesce("distinct", F.lit(0)).alias("distinct"), (-F.col("m.col2")).alias("top"), F.col("m.n").alias("top_n"), "skew", "kurtosis",
        F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p75"), score.alias("score"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each two of ``columns``, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("p")).select(F.inline("p"))


class Gate:
    """Named row rules; a rule that is null for a row fails there."""

    def __init__(self, rules: dict[str, Column]) -> None:
        self.rules = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}

    def flagged(self, df: DataFrame) -> DataFrame:
        """``df`` with failed: the sorted names of its failed rules."""
        names = F.array(*[F.when(~v, F.lit(k)) for k, v in sorted(self.rules.items())])
        return df.withColumn("failed", F.array_compact(names))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(passed, failed): every row is in just one."""
        flagged = self.flagged(df)
        return flagged.where(F.size("failed") == 0).drop("failed"), flagged.where(F.size("failed") > 0)

    def rates(self, df: DataFrame, least: float = 0.95) -> DataFrame:
        """(rule, rate, ok): the share of rows that pass each rule, held against ``least``."""
        sums = df.agg(*[F.avg(v.cast("int")).alias(k) for k, v in self.rules.items()])
        long = sums.unpivot([], list(self.rules), "rule", "rate")
        return long.withColumn("ok", F.col("rate") >= least)


def expect(
    df: DataFrame, log: dict[str, Column] | None = None, drop: dict[str, Column] | None = None, fail: dict[str, Column] | None = None, seen: Observation | None = None
) -> DataFrame:
    """Expectations in one pass: counted, counted and dropped, or failing the query; null conditions do not hold.

    ``seen`` gives, after an action, the number of rows that broke each counted one.
    """
    every = {**(log or {}), **(drop or {})}
    held = {k: F.coalesce(v, F.lit(False)) for k, v in every.items()}
    for k, v in (fail or {}).items():
        broken = F.raise_error(F.lit(f"expectation {k} failed"))
        df = df.where(F.when(F.coalesce(v, F.lit(False)), F.lit(True)).otherwise(broken.cast("boolean")))
    if held and seen:
        df = df.observe(seen, *[F.sum((~v).cast("int")).alias(k) for k, v in held.items()])
    for k in drop or {}:
        df = df.where(held[k])
    return df


def number_of(text: Column) -> Column:
    """Number in a text with currency signs, thousands marks, percent (as a share) or parentheses (negative); else null."""
    t = F.trim(text)
    bare = F.regexp_replace(t, r"[$€£,\s()%]", "")
    value = bare.try_cast("double")
    signed = F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)
    return F.when(t.endswith("%"), signed / 100).otherwise(signed)


def boolean_of(text: Column) -> Column:
    """Yes and no in common spellings; else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "t", "yes", "y", "1", "on"), True).when(t.isin("false", "f", "no", "n", "0", "off"), False)


def date_of(text: Column, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd")) -> Column:
    """The first format that reads the text; else null."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in formats])


def tidy(text: Column) -> Column:
    """Control characters out, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", " "))


def _bounds(df: DataFrame, column: str, method: str, factor: float | None, by: Sequence[str], ends: tuple[float, float]) -> DataFrame:
    """(by, __low, __high): values outside are outliers; one row a group, nulls a group of their own."""
    c = F.col(column)
    if method == "zscore":
        reach = (factor or 3.0) * F.stddev(c)
        return df.groupBy(*by).agg((F.avg(c) - reach).alias("__low"), (F.avg(c) + reach).alias("__high"))
    if method == "iqr":
        q = df.groupBy(*by).agg(F.percentile(c, [0.25, 0.75]).alias("q"))
        reach = (factor or 1.5) * (F.col("q")[1] - F.col("q")[0])
        return q.select(*by, (F.col("q")[0] - reach).alias("__low"), (F.col("q")[1] + reach).alias("__high"))
    if method == "percentile":
        q = df.groupBy(*by).agg(F.percentile(c, list(ends)).alias("q"))
        return q.select(*by, F.col("q")[0].alias("__low"), F.col("q")[1].alias("__high"))
    if method == "mad":
        medians = df.groupBy(*by).agg(F.median(c).alias("__m"))
        off = joined_back(df, medians, by).withColumn("__d", F.abs(c - F.col("__m")))
        stats = off.groupBy(*by).agg(F.first("__m", True).alias("__m"), F.median("__d").alias("__s"))
        reach = F.when(F.col("__s") > 0, (factor or 3.5) / 0.6745 * F.col("__s"))  # without spread nothing stands out
        return stats.select(*by, (F.col("__m") - reach).alias("__low"), (F.col("__m") + reach).alias("__high"))
    raise ValueError(f"unknown method {method}")


def joined_back(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``stats``, one row a group; a null key is a group like others."""
    if not by:
        return df.crossJoin(F.broadcast(stats))  # one row
    renamed = stats.select(*[F.col(k).alias(f"__by_{k}") for k in by], *[c for c in stats.columns if c not in by])
    same = [F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by]
    return df.join(renamed, same, "left").drop(*[f"__by_{k}" for k in by])


def outliers(
    df: DataFrame, column: str, method: str = "iqr", factor: float | None = None, by: Sequence[str] = (), ends: tuple[float, float] = (0.01, 0.99),
    domain: tuple[float | None, float | None] | None = None,
) -> DataFrame:
    """``df`` with outlier (boolean) by z-score (3), IQR (1.5), MAD (3.5) or percentiles (``ends``), over all rows or within groups.

    ``domain`` is a range that holds whatever the spread is. Bounds are one aggregate
    row a group, joined back; a null value is no outlier, a null group is a group.
    """
    c = F.col(column)
    met = joined_back(df, _bounds(df, column, method, factor, by, ends), by)
    test = F.coalesce((c < F.col("__low")) | (c > F.col("__high")), F.lit(False))
    if domain:
        low, high = domain
        test = test | (F.lit(False) if low is None else F.coalesce(c < low, F.lit(False))) | (F.lit(False) if high is None else F.coalesce(c > high, F.lit(False)))
    return met.withColumn("outlier", test).drop("__low", "__high")


def treat_outliers(df: DataFrame, column: str, treatment: str, method: str = "iqr", factor: float | None = None, by: Sequence[str] = (), ends: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """``df`` with the outliers of ``column`` removed, capped at the bounds, made null, or put at the group's median; nulls stay."""
    c = F.col(column)
    met = joined_back(df, _bounds(df, column, method, factor, by, ends), by)
    out = F.coalesce((c < F.col("__low")) | (c > F.col("__high")), F.lit(False))
    if treatment == "remove":
        done = met.where(~out)
    elif treatment == "cap":
        done = met.withColumn(column, F.when(out, F.when(c < F.col("__low"), F.col("__low")).otherwise(F.col("__high"))).otherwise(c))
    elif treatment == "null":
        done = met.withColumn(column, F.when(~out, c))
    elif treatment == "median":
        middle = joined_back(met, df.groupBy(*by).agg(F.median(c).alias("__mid")), by)
        done = middle.withColumn(column, F.when(out, F.col("__mid")).otherwise(c)).drop("__mid")
    else:
        raise ValueError(f"unknown treatment {treatment}")
    return done.drop("__low", "__high")


def winsorize(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``column`` capped at its exact percentiles; nulls stay null."""
    ends = df.agg(F.percentile(column, [low, high]).alias("__q"))
    met = df.crossJoin(F.broadcast(ends))  # one row of percentiles
    capped = F.greatest(F.least(F.col(column), F.col("__q")[1]), F.col("__q")[0])  # these pass over nulls
    return met.withColumn(column, F.when(F.col(column).isNotNull(), capped)).drop("__q")


def impute(df: DataFrame, column: str, strategy: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the nulls of ``column`` filled by the mean, median or mode of all rows or of their group; ties of the mode go to the least value."""
    c = F.col(column)
    if strategy == "mode":
        counted = df.where(c.isNotNull()).groupBy(*by, c.alias("__v")).agg(F.count("*").alias("__n"))
        stats = counted.groupBy(*by).agg(F.min_by("__v", F.struct(-F.col("__n"), F.col("__v"))).alias("__fill"))
    elif strategy in ("mean", "median"):
        stats = df.groupBy(*by).agg((F.avg(c) if strategy == "mean" else F.median(c)).alias("__fill"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return joined_back(df, stats, by).withColumn(column, F.coalesce(c, "__fill")).drop("__fill")


_QL = "(SELECT doc_id, lang, quality, toxic, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE n_chars END AS n FROM documents LEFT JOIN labels USING (doc_id))"


def _labelled(t: Tables) -> DataFrame:
    n = F.when(F.col("n_chars") % 3 != 0, F.col("n_chars"))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic", n.alias("n"))


@query(f"SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, n FROM {_QL}")
def null_fill(t: Tables) -> DataFrame:
    return _labelled(t).na.fill({"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic", "n")


@query(f"SELECT doc_id FROM {_QL} WHERE (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (n IS NOT NULL)::INT >= 2")
def null_drop(t: Tables) -> DataFrame:
    return _labelled(t).na.drop(thresh=2, subset=["quality", "toxic", "n"]).select("doc_id")


@query(f"SELECT doc_id, coalesce(n, quality, 0) AS a, ifnull(quality, 9) AS b, nullif(lang, 'en') AS c, CASE WHEN n IS NULL THEN 'no' ELSE 'yes' END AS d, CASE WHEN isnan(x) THEN 0 ELSE x END AS e FROM (SELECT *, CASE WHEN n % 2 = 0 THEN 'NaN'::DOUBLE ELSE n END AS x FROM {_QL})")
def null_funcs(t: Tables) -> DataFrame:
    x = F.when(F.col("n") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("n").cast("double"))
    return _labelled(t).select(
        "doc_id", F.coalesce("n", "quality", F.lit(0)).alias("a"), F.ifnull("quality", F.lit(9)).alias("b"), F.nullif("lang", F.lit("en")).alias("c"), F.nvl2("n", F.lit("yes"), F.lit("no")).alias("d"), F.nanvl(x, F.lit(0.0)).alias("e")
    )


_GAPS = f"(SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang, n, CAST(quality AS DOUBLE) AS quality FROM {_QL})"


def _gaps(t: Tables) -> DataFrame:
    """Rows whose group is null in part."""
    return _labelled(t).select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"), F.col("n").cast("double").alias("n"), F.col("quality").cast("double").alias("quality"))


@query(f"SELECT doc_id, round(coalesce(n, avg(n) OVER (PARTITION BY lang)), 4) AS n FROM {_GAPS}")
def impute_mean(t: Tables) -> DataFrame:
    return impute(_gaps(t), "n", "mean", ["lang"]).select("doc_id", F.round("n", 4).alias("n"))


@query(f"SELECT doc_id, coalesce(n, median(n) OVER (PARTITION BY lang)) AS n FROM {_GAPS}")
def impute_median(t: Tables) -> DataFrame:
    return impute(_gaps(t), "n", "median", ["lang"]).select("doc_id", "n")


@query(f"""SELECT g.doc_id, coalesce(g.quality, m.quality) AS quality FROM {_GAPS} g LEFT JOIN (SELECT lang, arg_min(quality, (-c, quality)) AS quality FROM
(SELECT lang, quality, count(*) AS c FROM {_GAPS} WHERE quality IS NOT NULL GROUP BY 1, 2) GROUP BY 1) m ON m.lang IS NOT DISTINCT FROM g.lang""")
def impute_mode(t: Tables) -> DataFrame:
    return impute(_gaps(t), "quality", "mode", ["lang"]).select("doc_id", "quality")


@query(f"SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang, CASE WHEN quality = 0 THEN -1 ELSE quality END AS quality, coalesce(quality, 5) AS filled FROM {_QL}")
def null_replace(t: Tables) -> DataFrame:
    named = _labelled(t).select("doc_id", "lang", "quality", F.nvl("quality", F.lit(5)).alias("filled"))
    return named.na.replace({"en": "english", "de": "german"}, subset=["lang"]).na.replace(0, -1, subset=["quality"])


@query(f"SELECT round(count(quality) / count(*), 6) AS quality, round(count(toxic) / count(*), 6) AS toxic, round(count(n) / count(*), 6) AS n, round(avg(((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (n IS NOT NULL)::INT) / 3), 6) AS by_row FROM {_QL}")
def dq_completeness(t: Tables) -> DataFrame:
    full = sum((F.col(c).isNotNull().cast("int") for c in ("quality", "toxic", "n")), F.lit(0)) / 3
    share = [F.round(F.count(c) / F.count("*"), 6).alias(c) for c in ("quality", "toxic", "n")]
    return _labelled(t).agg(*share, F.round(F.avg(full), 6).alias("by_row"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS present, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))
def dq_profile(t: Tables) -> DataFrame:
    return profile(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).select("column", "rows", "present", "min", "max")


_LINE = ("l_quantity", "l_discount", "l_linenumber")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS present, count(DISTINCT {c}) AS "distinct", (SELECT arg_min({c}, (-n, {c})) FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY 1))::DOUBLE AS top,
(SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) AS top_n FROM lineitem""" for c in _LINE))
def dq_profile_more(t: Tables) -> DataFrame:
    return profile_more(t.lineitem, _LINE).select("column", "present", "distinct", "top", "top_n")


@query("SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_extendedprice', round(corr(l_discount, l_extendedprice), 6) FROM lineitem")
def dq_correlations(t: Tables) -> DataFrame:
    return correlations(t.lineitem, ["l_quantity", "l_discount", "l_extendedprice"]).withColumn("r", F.round("r", 6))


def _gate() -> Gate:
    return Gate({"labelled": F.col("quality").isNotNull(), "sized": F.col("n").between(100, 5000), "spoken": F.col("lang").rlike("^(en|de)$")})


@query(f"""SELECT doc_id, list_filter([CASE WHEN quality IS NULL THEN 'labelled' END, CASE WHEN NOT coalesce(n BETWEEN 100 AND 5000, false) THEN 'sized' END, CASE WHEN NOT regexp_matches(lang, '^(en|de)$') THEN 'spoken' END], lambda x: x IS NOT NULL) AS failed FROM {_QL}""")
def dq_gate(t: Tables) -> DataFrame:
    return _gate().flagged(_labelled(t)).select("doc_id", "failed")


@query(f"SELECT doc_id FROM {_QL} WHERE quality IS NOT NULL")
def dq_expect(t: Tables) -> DataFrame:
    kept = expect(_labelled(t), log={"sized": F.col("n") > 0}, drop={"labelled": F.col("quality").isNotNull()}, fail={"keyed": F.col("doc_id").isNotNull()})
    return kept.select("doc_id")


_RAW = "(VALUES ('$1,234.50', 'Yes', '2024-01-31'), ('(200)', 'n', '01/31/2024'), ('12%', 'TRUE', '31-01-2024'), ('abc', 'maybe', '20240131'), (' €7 ', '0', 'soon'), (NULL, NULL, NULL)) AS r(num, flag, day)"


@query(f"""SELECT num, CASE WHEN trim(num) LIKE '%\\%' ESCAPE '\\' THEN v / 100 ELSE v END AS value, CASE WHEN lower(trim(flag)) IN ('yes', 'true') THEN true WHEN lower(trim(flag)) IN ('n', '0') THEN false END AS flag,
CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y'), try_strptime(day, '%d-%m-%Y'), try_strptime(day, '%Y%m%d')) AS DATE) AS day FROM
(SELECT *, CASE WHEN trim(num) LIKE '(%)' THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(num, '[$€£,\\s()%]', '', 'g') AS DOUBLE) AS v FROM {_RAW})""")
def clean_types(t: Tables) -> DataFrame:
    raw = t.spark.sql(f"SELECT * FROM {_RAW}")
    return raw.select("num", number_of(F.col("num")).alias("value"), boolean_of(F.col("flag")).alias("flag"), date_of(F.col("day")).alias("day"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS text, translate(lower(lang), 'éèêç', 'eeec') AS lang FROM documents""")
def clean_strings(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tidy(F.col("text")).alias("text"), F.translate(F.lower("lang"), "éèêç", "eeec").alias("lang"))


@query("SELECT o_orderkey FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) > 1.5 * s")
def outlier_zscore(t: Tables) -> DataFrame:
    return outliers(t.orders, "o_totalprice", "zscore", 1.5).where("outlier").select("o_orderkey")


@query("SELECT p_partkey FROM part JOIN (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part GROUP BY 1) USING (p_brand) WHERE p_retailprice < a - 0.5 * (b - a) OR p_retailprice > b + 0.5 * (b - a)")
def outlier_iqr(t: Tables) -> DataFrame:
    return outliers(t.part, "p_retailprice", "iqr", 0.5, ["p_brand"]).where("outlier").select("p_partkey")


@query("SELECT event_id FROM events, (SELECT median(value) AS m FROM events), (SELECT mad(value) AS d FROM events) WHERE 0.6745 * abs(value - m) / d > 2.5")
def outlier_mad(t: Tables) -> DataFrame:
    return outliers(t.events, "value", "mad", 2.5).where("outlier").select("event_id")


_SOME = "(SELECT event_id, event_type, CASE WHEN event_id % 7 > 0 THEN value END AS value FROM events)"


def _some(t: Tables) -> DataFrame:
    """Events, some without a value."""
    return t.events.select("event_id", "event_type", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"))


@query(f"""SELECT event_id, round(CASE WHEN value IS NOT NULL THEN greatest(least(value, b), a) END, 8) AS value, round(ln(1 + abs(value)), 8) AS logged
FROM {_SOME}, (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM {_SOME})""")
def outlier_winsor(t: Tables) -> DataFrame:
    logged = _some(t).withColumn("logged", F.round(F.log1p(F.abs("value")), 8))
    return winsorize(logged, "value").select("event_id", F.round("value", 8).alias("value"), "logged")


@query(f"""SELECT e.event_id, round(CASE WHEN value < a THEN a WHEN value > b THEN b ELSE value END, 8) AS capped, CASE WHEN NOT (value < a OR value > b) THEN value END AS nulled
FROM {_SOME} e JOIN (SELECT event_type, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM {_SOME} GROUP BY 1) USING (event_type)""")
def outlier_treat(t: Tables) -> DataFrame:
    both = _some(t).withColumn("raw", F.col("value"))
    capped = treat_outliers(both, "value", "cap", "percentile", by=["event_type"], ends=(0.05, 0.95)).withColumnRenamed("value", "capped")
    nulled = treat_outliers(capped, "raw", "null", "percentile", by=["event_type"], ends=(0.05, 0.95))
    return nulled.select("event_id", F.round("capped", 8).alias("capped"), F.col("raw").alias("nulled"))


@query("SELECT event_id FROM events, (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM events) WHERE value < a OR value > b OR value > 40")
def outlier_domain(t: Tables) -> DataFrame:
    return outliers(t.events, "value", "percentile", ends=(0.02, 0.98), domain=(None, 40.0)).where("outlier").select("event_id")


@query("SELECT c_custkey, sha256(c_name) AS who, '***' || right(c_name, 3) AS name, CASE WHEN c_nationkey < 10 THEN c_acctbal END AS balance FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def gov_mask(t: Tables) -> DataFrame:
    seen = t.customer.where("c_mktsegment <> 'MACHINERY'")
    return seen.select("c_custkey", F.sha2("c_name", 256).alias("who"), F.concat(F.lit("***"), F.right("c_name", F.lit(3))).alias("name"), F.when(F.col("c_nationkey") < 10, F.col("c_acctbal")).alias("balance"))


def best_of(df: DataFrame, key: str, fields: Sequence[str], order: Column) -> DataFrame:
    """Golden record: for each field the first non-null value by ``order``."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields])


@query("""SELECT user_id, arg_max(page, (ts, event_id)) FILTER (page IS NOT NULL) AS page, arg_max(v, (ts, event_id)) FILTER (v IS NOT NULL) AS v FROM
(SELECT user_id, ts, event_id, json_extract_string(props, '$.page') AS page, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events) GROUP BY 1""")
def dedup_golden(t: Tables) -> DataFrame:
    from_json = F.get_json_object("props", "$.page")
    rows = t.events.select("user_id", "ts", "event_id", from_json.alias("page"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    order = F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id"))
    return best_of(rows, "user_id", ["page", "v"], order)


@query("SELECT key, name, n FROM (SELECT sha256(concat_ws('|', coalesce(p_brand, '∅'), coalesce(p_type, '∅'))) AS key, min(p_name) AS name, count(*) AS n FROM part GROUP BY 1)")
def dedup_exact(t: Tables) -> DataFrame:
    key = F.sha2(F.concat_ws("|", F.coalesce("p_brand", F.lit("∅")), F.coalesce("p_type", F.lit("∅"))), 256)
    return t.part.groupBy(key.alias("key")).agg(F.min("p_name").alias("name"), F.count("*").alias("n"))


@query("SELECT c_custkey, substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS key, c_custkey % 10 AS bucket FROM customer")
def key_bucket(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8).alias("key"), F.pmod("c_custkey", F.lit(10)).alias("bucket"))


def fuzzy_pairs(df: DataFrame, key: str, text: str, block: Column, least: float = 0.8) -> DataFrame:
    """(a, b, similarity) of pairs within a block with normalised Levenshtein similarity of ``least`` or more.

    Pairs are also matched on a band of lengths, outside which that similarity cannot be reached.
    Equal texts are merged first, so copies do not pair with one another; ``a`` and ``b`` are least keys of a text.
    """
    one = df.where(F.col(text).isNotNull()).groupBy(block.alias("block"), F.col(text).alias("t")).agg(F.min(key).alias("k"))
    width = 8
    a = one.select("block", F.col("t").alias("ta"), F.col("k").alias("a"), F.floor(F.length("t") / width).alias("band"))
    reach = F.explode(F.sequence(F.floor(F.length("t") * least / width), F.floor(F.length("t") / least / width)))
    b = one.select("block", F.col("t").alias("tb"), F.col("k").alias("b"), reach.alias("band"))
    longest = F.greatest(F.length("ta"), F.length("tb"))
    similarity = 1 - F.levenshtein("ta", "tb") / longest
    return a.join(b, ["block", "band"]).where((F.col("a") < F.col("b")) & (similarity >= least)).select("a", "b", similarity.alias("similarity"))


@query("""SELECT least(a.k, b.k) AS a, greatest(a.k, b.k) AS b, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) AS similarity FROM
(SELECT p_name AS t, p_brand AS g, min(p_partkey) AS k FROM part GROUP BY 1, 2) a JOIN (SELECT p_name AS t, p_brand AS g, min(p_partkey) AS k FROM part GROUP BY 1, 2) b
ON a.g = b.g AND a.k < b.k AND 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) >= 0.8""")
def fuzzy_levenshtein(t: Tables) -> DataFrame:
    return fuzzy_pairs(t.part, "p_partkey", "p_name", F.col("p_brand")).withColumn("similarity", F.round("similarity", 6))


@query("""WITH w AS (SELECT s, min(k) AS k FROM (SELECT conv_id * 10000 + turn AS k, list_sort(list_distinct(string_split(lower(text), ' '))) AS s FROM conversations) GROUP BY 1),
p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS u FROM w a JOIN w b ON a.k < b.k)
SELECT a, b, round(i / u, 6) AS similarity FROM p WHERE i / u >= 0.15""")
def fuzzy_jaccard(t: Tables) -> DataFrame:
    sets = t.conversations.select((F.col("conv_id") * 10000 + F.col("turn")).alias("k"), F.split(F.lower("text"), " ").alias("s"))
    return set_join(sets, "k", "s", 0.15).withColumn("similarity", F.round("similarity", 6))


def bands(score: Column, match: float = 0.85, review: float = 0.7) -> Column:
    """MATCH, REVIEW or NO_MATCH by a score."""
    return F.when(score >= match, "MATCH").when(score >= review, "REVIEW").otherwise("NO_MATCH")


def composite_pairs(part: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, score) of pairs with a weighted composite of name distance, word overlap and type of ``least`` or more, blocked by brand and size.

    Scores are taken once for each two values of (name, type) of a block, and the names are compared
    only where words, type and lengths leave the score within reach; then every pair of keys is listed.
    """
    value = ["p_brand", "p_size", "p_name", "p_type"]
    one = part.where("p_name IS NOT NULL AND p_partkey IS NOT NULL").groupBy(*value).agg(F.collect_list("p_partkey").alias("ks"), F.min("p_partkey").alias("k")).withColumn("w", F.split("p_name", " "))
    a, b = one.alias("a"), one.alias("b")
    x, y = F.struct("a.p_name", "a.p_type"), F.struct("b.p_name", "b.p_type")
    met = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & ((F.col("a.k") < F.col("b.k")) | ((F.col("a.k") == F.col("b.k")) & (x <= y))))
    longest = F.greatest(F.length("a.p_name"), F.length("b.p_name"))
    name = 1 - F.levenshtein("a.p_name", "b.p_name") / longest
    words = F.size(F.array_intersect("a.w", "b.w")) / F.least(F.size(F.array_distinct("a.w")), F.size(F.array_distinct("b.w")))
    kind = F.when(F.col("a.p_type") == F.col("b.p_type"), 1.0).otherwise(0.0)
    score = 0.5 * name + 0.3 * words + 0.2 * kind
    nearest = 1 - F.abs(F.length("a.p_name") - F.length("b.p_name")) / longest
    reach = F.when(0.5 * nearest + 0.3 + 0.2 * kind < least - 1e-9, False).otherwise(0.5 * nearest + 0.3 * words + 0.2 * kind >= least - 1e-9)
    scored = met.select(F.col("a.ks").alias("xs"), F.col("b.ks").alias("ys"), x.eqNullSafe(y).alias("same"), F.when(reach, score).alias("score")).where(F.col("score") >= least)
    pairs = scored.select("ys", "same", "score", F.explode("xs").alias("x")).select("same", "score", "x", F.explode("ys").alias("y"))
    return pairs.where("CASE WHEN same THEN x < y ELSE x <> y END").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


@query("""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS name,
len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / least(len(list_distinct(string_split(a.p_name, ' '))), len(list_distinct(string_split(b.p_name, ' ')))) AS words,
CASE WHEN a.p_type = b.p_type THEN 1.0 ELSE 0.0 END AS type FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
SELECT a, b, round(score, 6) AS score, CASE WHEN score >= 0.85 THEN 'MATCH' ELSE 'REVIEW' END AS verdict FROM (SELECT a, b, 0.5 * name + 0.3 * words + 0.2 * type AS score FROM p) WHERE score >= 0.7""")
def fuzzy_composite(t: Tables) -> DataFrame:
    return composite_pairs(t.part).select("a", "b", F.round("score", 6).alias("score"), bands(F.col("score")).alias("verdict"))


@query()
def fuzzy_soundex(t: Tables) -> DataFrame:
    """Names that sound alike, with their number: blocks for a finer comparison."""
    return t.part.groupBy(F.soundex("p_name").alias("sound")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("p_name")).alias("names"))
