"""Registered graph, machine-learning and pandas-API queries."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Imputer, OneHotEncoder, StandardScaler, StopWordsRemover, StringIndexer, Tokenizer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import Tables, query
from tessera.operators.graph import connected_components, pagerank, shortest_paths, triangles
from tessera.plans.storage import new_path


def _trade(t: Tables) -> DataFrame:
    """Suppliers that share a nation, as directed edges from the smaller key to the next two."""
    s = t.supplier.select("s_suppkey", "s_nationkey")
    return s.select(F.col("s_suppkey").alias("src"), F.explode(F.array(F.col("s_suppkey") + 1 + F.col("s_nationkey") % 5, F.col("s_suppkey") * 2)).alias("dst"))


_EDGES = "(SELECT s_suppkey AS src, unnest([s_suppkey + 1 + s_nationkey % 5, s_suppkey * 2]) AS dst FROM supplier)"


@query("""WITH e AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_nationkey < 12), n AS (SELECT a AS k FROM e UNION SELECT b FROM e),
s AS (SELECT k, CASE WHEN k - 1 IN (SELECT a FROM e) THEN NULL ELSE k END AS first FROM n) SELECT k AS node, max(first) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS root FROM s""")
def graph_cc(t: Tables) -> DataFrame:
    """Chains: a customer of one of twelve nations is linked to the next key, others to themselves."""
    k = F.col("c_custkey")
    return connected_components(t.customer.select(k.alias("src"), F.when(F.col("c_nationkey") < 12, k + 1).otherwise(k).alias("dst")))


_RANKS = "".join(
    f", r{k} AS (SELECT n.id, 0.15 + 0.85 * coalesce(s.got, 0) AS rank FROM nodes n LEFT JOIN (SELECT dst, sum(rank / n) AS got FROM e JOIN r{k - 1} ON src = id JOIN o USING (src) GROUP BY 1) s ON n.id = s.dst)"
    for k in range(1, 11)
)


@query(f"""WITH e AS MATERIALIZED (SELECT * FROM {_EDGES}), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM nodes){_RANKS}
SELECT id, round(rank, 6) AS rank FROM r10""")
def graph_pagerank(t: Tables) -> DataFrame:
    return pagerank(_trade(t)).select("id", F.round("rank", 6).alias("rank"))


@query(f"""WITH RECURSIVE r(id, hops) AS (SELECT CAST(90 AS BIGINT), 0 UNION SELECT e.src, hops + 1 FROM r JOIN {_EDGES} e ON e.dst = r.id WHERE hops < 60) SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1""")
def graph_sssp(t: Tables) -> DataFrame:
    return shortest_paths(_trade(t), 90)


@query(f"""WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_EDGES} WHERE src <> dst), f AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b)
SELECT id, count(*) AS triangles FROM f, LATERAL (VALUES (p), (q), (r)) v(id) GROUP BY 1""")
def graph_triangles(t: Tables) -> DataFrame:
    return triangles(_trade(t))


def _labelled(t: Tables) -> DataFrame:
    counted = t.documents.select("doc_id", "text", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>!]")).cast("double").alias("signs"))
    return counted.join(t.labels, "doc_id").withColumn("label", F.col("quality").cast("double"))


@query()
def ml_features(t: Tables) -> DataFrame:
    raw = t.customer.withColumn("gap", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    stages = [
        Imputer(inputCols=["gap"], outputCols=["filled"]), StringIndexer(inputCol="c_mktsegment", outputCol="segment"), OneHotEncoder(inputCols=["segment"], outputCols=["one_hot"]),
        VectorAssembler(inputCols=["filled", "one_hot"], outputCol="vector"), StandardScaler(inputCol="vector", outputCol="scaled", withMean=True),
    ]
    return Pipeline(stages=stages).fit(raw).transform(raw).select("c_custkey", vector_to_array("scaled").alias("features"))


@query()
def ml_tfidf(t: Tables) -> DataFrame:
    stages = [Tokenizer(inputCol="text", outputCol="words"), StopWordsRemover(inputCol="words", outputCol="kept"), CountVectorizer(inputCol="kept", outputCol="tf", vocabSize=2000, minDF=2), IDF(inputCol="tf", outputCol="tfidf")]
    docs = t.conversations.select("conv_id", "turn", "text")
    return Pipeline(stages=stages).fit(docs).transform(docs).select("conv_id", "turn", F.size(F.filter(vector_to_array("tfidf"), lambda x: x > 0)).alias("terms"))


def _classified(t: Tables, model) -> DataFrame:
    rows = VectorAssembler(inputCols=["n_chars", "signs"], outputCol="features").transform(_labelled(t))
    train, test = rows.randomSplit([0.7, 0.3], seed=42)
    found = model.fit(train).transform(test)
    auc = BinaryClassificationEvaluator().evaluate(found)
    return t.spark.createDataFrame([(float(auc),)], "auc double")


@query()
def ml_classify(t: Tables) -> DataFrame:
    return _classified(t, LogisticRegression(maxIter=20))


@query()
def ml_forest(t: Tables) -> DataFrame:
    return _classified(t, RandomForestClassifier(numTrees=10, seed=42))


@query()
def ml_regress(t: Tables) -> DataFrame:
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(t.lineitem.withColumnRenamed("l_extendedprice", "label"))
    found = LinearRegression(maxIter=10).fit(rows).transform(rows)
    scores = [float(RegressionEvaluator(metricName=m).evaluate(found)) for m in ("rmse", "r2")]
    return t.spark.createDataFrame([tuple(scores)], "rmse double, r2 double")


@query()
def ml_kmeans(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features"))
    found = KMeans(k=4, seed=42, maxIter=10).fit(rows).transform(rows)
    silhouette = ClusteringEvaluator().evaluate(found)
    return found.groupBy("prediction").agg(F.count("*").alias("n")).withColumn("silhouette", F.lit(float(silhouette)))


@query()
def ml_tuning(t: Tables) -> DataFrame:
    rows = VectorAssembler(inputCols=["n_chars", "signs"], outputCol="features").transform(_labelled(t))
    lr = LogisticRegression(maxIter=5)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()
    best = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=2, seed=42, parallelism=2).fit(rows)
    return t.spark.createDataFrame([(i, float(m)) for i, m in enumerate(best.avgMetrics)], "candidate int, auc double")


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY 1")
def ps_groupby(t: Tables) -> DataFrame:
    frame = t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice").pandas_api()
    by = frame.groupby("o_orderstatus").agg({"o_orderkey": "count", "o_totalprice": "mean"})
    return by.to_spark(index_col="o_orderstatus").select("o_orderstatus", F.col("o_orderkey").alias("n"), F.round("o_totalprice", 3).alias("mean"))


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = VectorAssembler(inputCols=["n_chars", "signs"], outputCol="features").transform(_labelled(t))
    train, test = rows.randomSplit([0.7, 0.3], seed=42)
    return train, test


def _holds(t: Tables, **tests: bool) -> DataFrame:
    return t.spark.createDataFrame([(k, bool(v)) for k, v in tests.items()], "name string, holds boolean")


@query("SELECT * FROM (VALUES ('auc', true), ('accuracy', true), ('saved', true), ('chosen', true)) v(name, holds)")
def ml_classify_bounds(t: Tables) -> DataFrame:
    """Held-out AUC and accuracy above floors; a saved model scores as before; a validation split prefers a candidate."""
    train, test = _split(t)
    lr = LogisticRegression(maxIter=20)
    model = Pipeline(stages=[lr]).fit(train)
    found = model.transform(test)
    path = new_path(t.spark, "model")
    model.write().save(path)
    again = PipelineModel.load(path).transform(test)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 100.0]).build()
    tuned = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(metricName="areaUnderPR"), trainRatio=0.75, seed=42).fit(train)
    differ = found.select("doc_id", "prediction").exceptAll(again.select("doc_id", "prediction")).isEmpty()
    return _holds(
        t, auc=BinaryClassificationEvaluator().evaluate(found) > 0.8, accuracy=MulticlassClassificationEvaluator(metricName="accuracy").evaluate(found) > 0.7, saved=differ,
        chosen=len(tuned.validationMetrics) == 2,
    )


@query("SELECT count(*) AS rows, 5 AS candidates, true AS falling FROM embeddings")
def ml_kmeans_sweep(t: Tables) -> DataFrame:
    """Cost for two to six clusters: it falls from the first to the last."""
    rows = t.embeddings.select("vec_id", array_to_vector("embedding").alias("features")).cache()
    try:
        costs = [KMeans(k=k, seed=42, maxIter=10).fit(rows).summary.trainingCost for k in range(2, 7)]
        n = rows.count()
    finally:
        rows.unpersist()
    return t.spark.createDataFrame([(n, len(costs), costs[-1] < costs[0])], "rows long, candidates int, falling boolean")


@query("SELECT count(*) AS n, 8 AS size FROM conversations")
def ml_word2vec(t: Tables) -> DataFrame:
    """A vector of eight numbers for each message."""
    rows = Tokenizer(inputCol="text", outputCol="words").transform(t.conversations.select("text"))
    vectors = Word2Vec(vectorSize=8, minCount=2, maxIter=1, seed=42, inputCol="words", outputCol="vector").fit(rows).transform(rows)
    return vectors.select(F.size(vector_to_array("vector")).alias("size")).groupBy("size").agg(F.count("*").alias("n")).select("n", "size")


@query("SELECT c_custkey, round((coalesce(gap, m) - avg(coalesce(gap, m)) OVER ()) / stddev_samp(coalesce(gap, m)) OVER (), 6) AS filled FROM (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS gap FROM customer), (SELECT avg(c_acctbal) AS m FROM customer WHERE c_custkey % 5 <> 0)")
def ml_scaled(t: Tables) -> DataFrame:
    """The imputed, scaled number of ``ml_features``."""
    return ml_features(t).select("c_custkey", F.round(F.get("features", F.lit(0)), 6).alias("filled"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1")
def agg_approx_bounds(t: Tables) -> DataFrame:
    """Approximate distinct counts within three times the stated error, approximate medians within 1 % of the ranks."""
    by = t.lineitem.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.05).alias("a"), F.count_distinct("l_partkey").alias("e"),
        F.percentile_approx("l_extendedprice", 0.5, 1000).alias("m"), F.percentile("l_extendedprice", [0.49, 0.51]).alias("q"),
    )
    return by.select("l_returnflag", ((F.abs(F.col("a") - F.col("e")) <= 0.15 * F.col("e")) & F.col("m").between(F.col("q")[0], F.col("q")[1])).alias("near"))


@query("SELECT 'bernoulli' AS name, true AS holds UNION ALL SELECT 'split', true UNION ALL SELECT 'take', true UNION ALL SELECT 'stratified', true UNION ALL SELECT 'frequent', true UNION ALL SELECT 'quantile', true")
def sample_bounds(t: Tables) -> DataFrame:
    """Sizes of samples within five standard deviations; splits cover all rows once; takeSample gives so many distinct rows; frequent items hold all frequent ones."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    n = rows.count()
    near = lambda k, share: abs(k - share * n) <= 5 * (n * share * (1 - share)) ** 0.5
    a, b = rows.randomSplit([0.3, 0.7], seed=7)
    taken = rows.rdd.takeSample(False, 10, seed=3)
    strata = rows.sampleBy("o_orderstatus", {"F": 0.5}, seed=3).groupBy("o_orderstatus").count().collect()
    filled = rows.where("o_orderstatus = 'F'").count()
    frequent = set(rows.stat.freqItems(["o_orderstatus"], 0.2).first()[0])
    common = {r[0] for r in rows.groupBy("o_orderstatus").count().where(F.col("count") > 0.2 * n).collect()}
    low, high = rows.stat.approxQuantile("o_totalprice", [0.5], 0.01)[0], rows.agg(F.percentile("o_totalprice", [0.48, 0.52])).first()[0]
    return _holds(
        t, bernoulli=near(rows.sample(0.2, seed=5).count(), 0.2), split=a.count() + b.count() == n and near(a.count(), 0.3), take=len({r.o_orderkey for r in taken}) == 10,
        stratified=[r.o_orderstatus for r in strata] == ["F"] and abs(strata[0]["count"] - filled / 2) <= 5 * (filled / 4) ** 0.5, frequent=common <= frequent, quantile=high[0] <= low <= high[1],
    )
