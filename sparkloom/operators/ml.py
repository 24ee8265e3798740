"""Feature pipelines, clustering, reduction, topics and model search on pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, PCA, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import scale
from sparkloom.operators.reshape import with_row_number


def assemble(df: DataFrame, columns: list[str], standardise: bool = True, name: str = "features") -> DataFrame:
    """A vector column, z-scored with the population deviation if asked. Rows with a null are left out."""
    rows = df.na.drop("any", subset=columns)
    work = rows.withColumns({f"_z{i}": F.col(c).cast("double") for i, c in enumerate(columns)})
    names = [f"_z{i}" for i in range(len(columns))]
    if standardise:
        work = scale.standard(work, names).apply(work)
    return VectorAssembler(inputCols=names, outputCol=name).transform(work).drop(*names)


def kmeans(df: DataFrame, k: int, seed: int = 42, max_iter: int = 300, features: str = "features"):
    """(model, df with ``cluster``)."""
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=features, predictionCol="cluster").fit(df)
    return model, model.transform(df)


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster", squared: bool = True) -> float:
    """Mean silhouette; Spark's is over squared Euclidean distances, the cosine one is offered beside it."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster, distanceMeasure="squaredEuclidean" if squared else "cosine").evaluate(df)


def davies_bouldin(df: DataFrame, centres: list[np.ndarray], features: str = "features", cluster: str = "cluster") -> float:
    """Davies-Bouldin index from the mean distance to the centre of each cluster (one aggregation)."""
    table = F.array(*[F.array(*map(F.lit, map(float, c))) for c in centres])
    x = vector_to_array(features)
    centre = table[F.col(cluster)]
    d = F.sqrt(F.aggregate(F.zip_with(x, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    spread = {r.c: r.s for r in df.groupBy(F.col(cluster).alias("c")).agg(F.avg(d).alias("s")).collect()}  # one row per cluster
    ids = sorted(spread)
    if len(ids) < 2:
        return 0.0
    worst = [max((spread[i] + spread[j]) / (np.linalg.norm(centres[i] - centres[j]) or 1e-12) for j in ids if j != i) for i in ids]
    return float(np.mean(worst))


def search_k(df: DataFrame, ks: Iterable[int], seed: int = 42, best: int = 2) -> list[tuple[int, float]]:
    """The best numbers of clusters by silhouette (two decimals), best first, ties by fewer clusters."""
    scores = [(k, round(silhouette(kmeans(df, k, seed)[1]), 2)) for k in ks]
    return sorted(scores, key=lambda s: (-s[1], s[0]))[:best]


def search_features(df: DataFrame, columns: list[str], ks: Iterable[int], start: int = 3) -> list[dict]:
    """Greedy feature search in column order: the first ``start`` columns, then one more at a time; a column that lowers the best
    silhouette is left out. Returns the accepted rounds."""
    ks = list(ks)
    chosen, rounds, best = columns[:start], [], -1.0
    for column in [None, *columns[start:]]:
        trial = chosen + ([column] if column else [])
        k, score = search_k(assemble(df, trial), ks, best=1)[0]
        if score >= best:
            chosen, best = trial, score
            rounds.append({"features": list(trial), "k": k, "silhouette": score})
    return rounds


def stability(df: DataFrame, k: int, seeds: Iterable[int] = range(5)) -> list[tuple[int, float]]:
    """(seed, silhouette) of runs with different seeds, best first."""
    return sorted(((s, silhouette(kmeans(df, k, s)[1])) for s in seeds), key=lambda x: -x[1])


WARD_LIMIT = 5000


def ward(points: np.ndarray, clusters: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Exact Ward linkage of (weighted) points by the nearest-neighbour chain, cut to so many clusters; labels by first row.

    Quadratic in time and linear in memory. ValueError above WARD_LIMIT points: see ``hierarchical``.
    """
    n = len(points)
    if n > WARD_LIMIT:
        raise ValueError(f"more than {WARD_LIMIT} points")
    centre, size = points.astype(float).copy(), np.ones(n) if weights is None else weights.astype(float).copy()
    alive = np.ones(n, bool)
    chain: list[int] = []
    merges = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        top = chain[-1]
        cost = ((centre - centre[top]) ** 2).sum(1) * (size * size[top] / (size + size[top]))
        cost[~alive] = np.inf
        cost[top] = np.inf
        near = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
            near = chain[-2]
            merges.append((float(cost[near]), min(top, near), max(top, near)))
            a, b = merges[-1][1:]
            centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            del chain[-2:]
        else:
            chain.append(near)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for _, a, b in sorted(merges)[: max(0, n - clusters)]:  # heights never fall along the hierarchy
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1] if n else np.zeros(0, int)


def hierarchical(df: DataFrame, k: int, seed: int = 42, features: str = "features", leaves: int = 500) -> DataFrame:
    """df with ``cluster``, a cut of a Ward hierarchy into k clusters, at any size.

    Rows are first put into at most ``leaves`` small clusters by k-means; Ward linkage then joins these, weighted by their sizes, on the driver. With
    no more distinct rows than leaves the small clusters are the rows themselves, and the hierarchy is exact.
    """
    arrays = df.withColumn("_x", vector_to_array(features))
    distinct = arrays.groupBy("_x").agg(F.count(F.lit(1)).alias("n")).limit(leaves + 1).collect()
    if len(distinct) <= leaves:
        distinct = sorted((r._x, r.n) for r in distinct)
        labels = ward(np.array([x for x, _ in distinct]), k, np.array([n for _, n in distinct])) if distinct else []
        known = df.sparkSession.createDataFrame([(x, int(c)) for (x, _), c in zip(distinct, labels)], "_x array<double>, cluster int")
        return arrays.join(known, "_x").drop("_x")
    model = KMeans(k=leaves, seed=seed, maxIter=10, initSteps=1, featuresCol=features, predictionCol="_leaf").fit(df)
    placed = model.transform(df)
    sizes = {r._leaf: r.n for r in placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per leaf
    centres = model.clusterCenters()
    labels = ward(np.array(centres), k, np.array([max(1, sizes.get(i, 0)) for i in range(len(centres))]))
    return placed.withColumn("cluster", F.array(*[F.lit(int(c)) for c in labels])[F.col("_leaf")]).drop("_leaf")


def pca(df: DataFrame, columns: list[str], k: int | None = None):
    """(model, projected df with array column ``components``) on z-scored columns; k at most min(columns, rows - 1)."""
    vectors = assemble(df, columns)
    model = PCA(k=k or len(columns), inputCol="features", outputCol="_pc").fit(vectors)
    return model, model.transform(vectors).withColumn("components", vector_to_array("_pc")).drop("_pc", "features")


def max_components(columns: int, rows: int) -> int:
    """The most components that so many columns and rows allow."""
    return min(columns, rows - 1)


def topic_of(shares: Column) -> Column:
    """The most likely topic of an array of topic shares, from 1; ties the first."""
    return F.array_position(shares, F.array_max(shares)).cast("int")


def explained(spark, model) -> DataFrame:
    """component, ratio, cumulative of a PCA model."""
    ratios = [float(x) for x in model.explainedVariance]
    return spark.createDataFrame([(i + 1, r, float(sum(ratios[: i + 1]))) for i, r in enumerate(ratios)], "component int, ratio double, cumulative double")


def tfidf(df: DataFrame, tokens: str, min_df: int = 1, vocabulary: int = 1 << 30):
    """(pipeline model, df with ``features``): counts times smooth idf ln((1 + n) / (1 + df)) + 1, rows of length one.

    Spark's idf is ln((n + 1) / (df + 1)); the + 1 is the count itself, added before the rows are normalised.
    """
    counts = CountVectorizer(inputCol=tokens, outputCol="_tf", vocabSize=vocabulary, minDF=min_df)
    model = Pipeline(stages=[counts, IDF(inputCol="_tf", outputCol="_idf")]).fit(df)
    work = model.transform(df)
    added = work.withColumn("_sum", _add_vectors("_tf", "_idf"))
    out = Normalizer(inputCol="_sum", outputCol="features").transform(added)
    return model, out.drop("_tf", "_idf", "_sum")


def tfidf_entries(df: DataFrame, key: str, tokens: str, min_df: int = 1) -> DataFrame:
    """key, term, weight: the entries of ``tfidf`` vectors that are not 0, of all terms that at least ``min_df`` rows hold."""
    rows = df.filter(F.col(tokens).isNotNull()).agg(F.count(F.lit(1)).alias("rows"))
    counts = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    known = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    idf = F.ln((F.lit(1.0) + F.col("rows")) / (F.lit(1.0) + F.col("df"))) + 1
    raw = counts.join(known.join(F.broadcast(rows)), "term").select(key, "term", (F.col("tf") * idf).alias("w"))  # one row
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def _add_vectors(a: str, b: str) -> Column:
    return array_to_vector(F.zip_with(vector_to_array(a), vector_to_array(b), lambda x, y: x + y))


def word2vec(df: DataFrame, tokens: str, size: int = 100, seed: int = 42, min_count: int = 5):
    model = Word2Vec(vectorSize=size, seed=seed, minCount=min_count, inputCol=tokens, outputCol="features").fit(df)
    return model, model.transform(df)


def low_idf_words(df: DataFrame, tokens: str, threshold: float = 0.95, keep: Iterable[str] = ()) -> DataFrame:
    """term, df: the share 1 - threshold of terms that most rows hold (lowest idf), ties by term, without the words to keep."""
    counts = df.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = counts.count()
    return counts.orderBy(F.desc("df"), "term").limit(round(n - n * threshold)).filter(~F.col("term").isin(*keep) if keep else F.lit(True))


def vocabulary_ranks(df: DataFrame, tokens: str) -> DataFrame:
    """term, index: every term by falling frequency from 1, ties by term; numbered by range partitions, without a global window."""
    counts = df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return with_row_number(counts, "index", [F.desc("n"), F.col("term")]).select("term", (F.col("index") + 1).cast("long").alias("index"))


def to_sequences(df: DataFrame, key: str, tokens: str, ranks: DataFrame, length: int) -> DataFrame:
    """key, sequence: word indexes in order, unknown words left out, cut to the last ``length`` and padded in front with 0."""
    rows = df.select(key, F.posexplode(tokens).alias("pos", "term")).join(ranks, "term")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "index"))).alias("s"))
    index = F.coalesce(F.transform("s", lambda x: x["index"]), F.array().cast("array<bigint>"))
    cut = F.slice(index, F.greatest(F.size(index) - length + 1, F.lit(1)), F.lit(length))
    return df.select(key).join(lists, key, "left").select(key, F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(cut)), cut).alias("sequence"))


def topics(df: DataFrame, tokens: str, k: int = 10, max_iter: int = 10, seed: int = 42, vocabulary: int = 1 << 30, min_df: int = 2):
    """(vectoriser, LDA model, df with topic): topic is the most likely one, from 1."""
    counts = CountVectorizer(inputCol=tokens, outputCol="features", vocabSize=vocabulary, minDF=min_df).fit(df)
    x = counts.transform(df)
    model = LDA(k=k, maxIter=max_iter, seed=seed, optimizer="online").fit(x)
    return counts, model, model.transform(x).withColumn("topic", topic_of(vector_to_array("topicDistribution"))).drop("features", "topicDistribution")


def topic_words(vectoriser, model, n: int = 10) -> DataFrame:
    """topic (from 1), rank, word, weight."""
    words = vectoriser.vocabulary
    spark = model.describeTopics(n).sparkSession
    rows = [(r.topic + 1, i + 1, words[t], float(w)) for r in model.describeTopics(n).collect() for i, (t, w) in enumerate(zip(r.termIndices, r.termWeights))]
    return spark.createDataFrame(rows, "topic int, rank int, word string, weight double")


def topic_word_shares(model) -> np.ndarray:
    """Topic by word matrix with rows that add to one."""
    m: DenseMatrix = model.topicsMatrix()
    table = m.toArray().T
    return table / table.sum(1, keepdims=True)


def search_topics(df: DataFrame, tokens: str, ks: Iterable[int], seed: int = 42) -> list[tuple[int, float]]:
    """(k, log perplexity) of topic counts, best (least) first."""
    out = []
    counts = CountVectorizer(inputCol=tokens, outputCol="features", minDF=2, vocabSize=1 << 30).fit(df)
    x = counts.transform(df).persist()
    for k in ks:
        out.append((k, float(LDA(k=k, maxIter=10, seed=seed).fit(x).logPerplexity(x))))
    x.unpersist()
    return sorted(out, key=lambda s: s[1])


def grid_search(df: DataFrame, estimator, grid: dict, evaluator, folds: int = 10, seed: int = 42, parallelism: int = 3):
    """(best model, [(parameters, mean score)] of every grid point, best score) by cross-validation."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(estimator.getParam(param), values)
    model = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=folds, seed=seed, parallelism=parallelism).fit(df)
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    best = (max if evaluator.isLargerBetter() else min)(model.avgMetrics)
    return model.bestModel, [(p, float(m)) for p, m in zip(points, model.avgMetrics)], float(best)


def learning_curve(df: DataFrame, estimator, evaluator, key: str, sizes: Iterable[float] = (0.1, 0.25, 0.5, 1.0), seed: int = 42) -> list[tuple[float, float, float]]:
    """(share, training score, test score): a fifth of the rows, by a hash of the key, is held out."""
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    test, train = df.filter(drawn < 0.2).persist(), df.filter(drawn >= 0.2)
    out = []
    for share in sizes:
        part = train.filter(drawn < 0.2 + 0.8 * share)
        model = estimator.fit(part)
        out.append((share, evaluator.evaluate(model.transform(part)), evaluator.evaluate(model.transform(test))))
    test.unpersist()
    return out


def validation_curve(df: DataFrame, estimator, evaluator, param: str, values: Iterable, folds: int = 5, seed: int = 42) -> list[tuple]:
    return [(p[param], s) for p, s in grid_search(df, estimator, {param: list(values)}, evaluator, folds, seed)[1]]


def select_by_importance(names: list[str], importances: Iterable[float], threshold: str | float = "median") -> list[str]:
    """Names whose importance reaches the median or a number."""
    values = np.array(list(importances))
    limit = float(np.median(values)) if threshold == "median" else float(threshold)
    return [n for n, v in zip(names, values) if v >= limit]


def rbf_gram(df: DataFrame, key: str, features: str, gamma: float, landmarks: DataFrame) -> DataFrame:
    """key, other, k = exp(-gamma |x - y|^2) of all rows against a stated landmark set (landmarks are checked to be few: 10,000)."""
    few = landmarks.limit(10_001)
    if few.count() > 10_000:
        raise ValueError("more than 10,000 landmarks")
    other = landmarks.select(F.col(key).alias("other"), F.col(features).alias("_y"))
    square = F.aggregate(F.zip_with(features, "_y", lambda a, b: (a - b).cast("double") * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.select(key, features).join(F.broadcast(other)).select(key, "other", F.exp(-gamma * square).alias("k"))


def rbf_kernel(df: DataFrame, key: str, features: str, gamma: float, block: int = 512) -> DataFrame:
    """key, other, k = exp(-gamma |x - y|^2) of all rows with all rows; rows with null features are left out.

    Rows are packed into blocks of about ``block``; blocks meet pairwise, one pair at a time in a task, so no task holds more than
    two blocks. The result has the square of the number of rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x")).filter("x is not null")
    count = max(1, -(-rows.count() // block))
    packed = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(count)).alias("b")).agg(F.collect_list(F.struct("key", "x")).alias("r"))
    pairs = packed.select(F.col("r").alias("l")).crossJoin(packed.select(F.col("r").alias("m"))).repartition(count)
    both = pairs.select(F.explode("l").alias("p"), "m").select("p", F.explode("m").alias("q"))
    square = F.aggregate(F.zip_with("p.x", "q.x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.select(F.col("p.key").alias(key), F.col("q.key").alias("other"), F.exp(-gamma * square).alias("k"))


def regression_evaluator(label: str, metric: str = "rmse") -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, metricName=metric)
