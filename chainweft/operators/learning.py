"""Scaling, class checks, models and neighbours on feature rows.

Statistics over rows are single aggregations. Models that Spark lacks are fitted on a sample of stated size and scored
by vectorised functions on all rows. Neighbour search compares a stated query set, in blocks of bounded size that are
broadcast, with all rows.

Defined cases: null features are left out of statistics and count as 0 in vectors and models; NaN counts as null.
Constant columns scale to 0, a constant score normalises to 0.5. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweft.functions.scalars import finite
from chainweft.operators.distribution import threshold_metrics, value_statistics
from chainweft.session import WrittenTables

#: Rows that an isolation forest is fitted on, and rows of each of its trees.
FOREST_SAMPLE, TREE_ROWS = 50_000, 256
#: Query vectors that are broadcast at once.
QUERY_BLOCK = 2_000


def _known(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, std, low, high), the deviation that of the population, from one pass."""
    parts = [F.struct(F.lit(c).alias("feature"), F.count(_known(c)).alias("n"), F.avg(_known(c)).alias("mean"), F.stddev_pop(_known(c)).alias("std"), F.min(_known(c)).alias("low"), F.max(_known(c)).alias("high")) for c in columns]
    return rows.agg(F.array(*parts).alias("m")).select(F.inline("m"))


def class_separation(rows: DataFrame, label: Column, columns: list[str], limit: float = 2.5) -> DataFrame:
    """(feature, mean_true, mean_false, separation, suspicious): the distance of the class means in deviations."""
    apart = lambda c: F.abs(F.avg(F.when(label, _known(c))) - F.avg(F.when(~label, _known(c)))) / (F.stddev_pop(_known(c)) + 1e-9)
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(F.when(label, _known(c))).alias("mean_true"), F.avg(F.when(~label, _known(c))).alias("mean_false"), apart(c).alias("separation"), (apart(c) > limit).alias("suspicious")) for c in columns]
    return rows.agg(F.array(*parts).alias("m")).select(F.inline("m"))


def standardised(rows: DataFrame, columns: list[str], train: DataFrame | None = None) -> DataFrame:
    """``rows`` with each column less the mean of the training rows, divided by their population deviation.

    Without ``train`` all rows are. A null is the mean, thus 0; a column that is null in all training rows is 0.
    """
    parts = [(F.avg(_known(c)).alias(f"m{k}"), F.stddev_pop(_known(c)).alias(f"s{k}")) for k, c in enumerate(columns)]
    fit = (rows if train is None else train).agg(*(x for pair in parts for x in pair)).first()
    scale = {}
    for k, c in enumerate(columns):
        mean, deviation = fit[f"m{k}"], fit[f"s{k}"]
        scale[c] = F.lit(0.0) if mean is None else (F.coalesce(_known(c), F.lit(mean)) - F.lit(mean)) / F.lit(deviation or 1.0)
    return rows.withColumns(scale)


def min_max(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the column scaled to [0, 1] by its extremes."""
    low, high = rows.agg(F.min(_known(column)), F.max(_known(column))).first()
    if low is None or low == high:
        return rows.withColumn(name, F.when(_known(column).isNotNull(), F.lit(0.5)))
    return rows.withColumn(name, (_known(column) - F.lit(low)) / F.lit(high - low))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weights inverse to the classes' sizes."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row for each class
    return counts.select(label, "n", (counts.agg(F.sum("n")).scalar() / (counts.agg(F.count(F.lit(1))).scalar() * F.col("n"))).alias("weight"))


def seeded(ident: str, seed: int = 0) -> Column:
    """A repeatable place of an identifier in a shuffled order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")), 256)


def stratified_split(rows: DataFrame, ident: str, label: str, test_share: float, seed: int = 0) -> DataFrame:
    """``rows`` with ``split`` test for the given share of each class, rounded to whole rows, else train.

    Of each class the first rows in the seeded order of their identifiers, which should be unique, are for the test.
    Rows are dealt to 4096 ranges of that order by class; counts of those tell in which range a class's share ends, and
    only that range is ranked.
    """
    placed = rows.withColumn("__order", seeded(ident, seed)).withColumn("__range", F.conv(F.substring("__order", 1, 3), 16, 10).cast("int")).withColumn("__class", F.col(label))
    counts = placed.groupBy("__class", "__range").agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy("__class")
    upto = F.sum("__n").over(by.orderBy("__range"))
    wanted = F.floor(F.sum("__n").over(by) * test_share + 0.5)
    edge = counts.select("__class", "__range", "__n", upto.alias("__upto"), wanted.alias("__wanted")).where(F.col("__upto") > F.col("__wanted"))
    edge = edge.groupBy("__class").agg(F.min(F.struct("__range", (F.col("__wanted") - F.col("__upto") + F.col("__n")).alias("__left"))).alias("e")).select(F.col("__class").alias("__c"), F.col("e.__range").alias("__last"), "e.__left")
    joined = placed.join(F.broadcast(edge), F.col("__class").eqNullSafe(F.col("__c")), "left")  # one row for each class
    inside = Window.partitionBy("__class", "__range").orderBy("__order")
    ranked = joined.where(F.col("__range") == F.col("__last")).withColumn("__test", F.row_number().over(inside) <= F.col("__left"))
    others = joined.where(~F.coalesce(F.col("__range") == F.col("__last"), F.lit(False))).withColumn("__test", F.coalesce(F.col("__range") < F.col("__last"), F.lit(True)))
    return others.unionByName(ranked).withColumn("split", F.when(F.col("__test"), "test").otherwise("train")).select(*rows.columns, "split")


def folds(rows: DataFrame, ident: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``rows`` with ``fold`` 0 to k - 1 by the seeded order of their identifiers."""
    return rows.withColumn("fold", (F.conv(F.substring(seeded(ident, seed), 1, 8), 16, 10).cast("long") % k).cast("int"))


def cross_validated(rows: DataFrame, ident: str, columns: list[str], label: str, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(fold, rows, precision, recall, f1): the logistic model fitted, scaling included, on all other folds."""
    dealt, _ = WrittenTables(rows.sparkSession, "folds").write(folds(rows, ident, k).select(*columns, label, "fold"))
    parts = []
    for fold in range(k):
        model = logistic_model(dealt.where(F.col("fold") != fold), columns, label)
        metrics = threshold_metrics(predicted(model, dealt.where(F.col("fold") == fold), columns), "probability", F.col(label) == 1.0, [threshold])
        parts.append(metrics.select(F.lit(fold).alias("fold"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows"), "precision", "recall", "f1"))
    return reduce(DataFrame.unionByName, parts)


def logistic_model(train: DataFrame, columns: list[str], label: str) -> PipelineModel:
    """Standardised features and a class-balanced L2 logistic regression; ``label`` is 0.0 or 1.0."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1.0, total / (2.0 * max(1, counts.get(1.0, 0)))).otherwise(total / (2.0 * max(1, counts.get(0.0, 0))))
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / max(1, total), maxIter=60)]
    filled = train.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    return Pipeline(stages=stages).fit(filled.withColumn("weight", weight))


def predicted(model: PipelineModel, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``probability`` of class 1 and ``contributions``: what each feature adds to the log-odds."""
    filled = rows.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    weights = [float(w) for w in model.stages[-1].coefficients]
    out = model.transform(filled)
    parts = F.zip_with(vector_to_array("features"), F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return out.withColumn("contributions", parts).withColumn("probability", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "prediction")


def reconstruction_error(train: DataFrame, rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """``rows`` with ``error``: the mean squared distance from the plane of the first ``k`` principal components."""
    fill = lambda df: df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), PCA(k=k, inputCol="scaled", outputCol="plane")]
    model = Pipeline(stages=stages).fit(fill(train))
    axes = model.stages[-1].pc.toArray()
    rest = np.eye(len(columns)) - axes @ axes.T

    @F.pandas_udf("double")
    def error(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_list()) if len(vectors) else np.zeros((0, len(columns)))
        return pd.Series(((x @ rest) ** 2).mean(axis=1))

    return model.transform(fill(rows)).withColumn("error", error(vector_to_array("scaled"))).drop("raw", "scaled", "plane")


@dataclass
class IsolationForest:
    """Trees of random cuts as arrays; a row's score is high if few cuts set it apart."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    rows: int

    @staticmethod
    def _path(n: np.ndarray | float) -> np.ndarray:
        """Mean depth of an unsuccessful search among n rows."""
        n = np.asarray(n, float)
        m = np.maximum(n, 2.0)
        return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 200, seed: int = 42, tree_rows: int = TREE_ROWS) -> "IsolationForest":
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(x))
        deepest = int(np.ceil(np.log2(max(size, 2))))
        feature, cut, left, depth, roots = [], [], [], [], []

        def add(f: int, c: float, d: float) -> int:
            feature.append(f), cut.append(c), left.append(0), depth.append(d)
            return len(feature) - 1

        for _ in range(trees):
            roots.append(add(-1, 0.0, 0.0))
            todo = [(roots[-1], rng.choice(len(x), size, replace=False), 0)]
            while todo:
                node, rows, d = todo.pop()
                spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 else []
                if d >= deepest or not len(spread):
                    depth[node] = d + float(cls._path(len(rows)))
                    continue
                f = int(rng.choice(spread))
                c = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
                feature[node], cut[node] = f, c
                left[node] = add(-1, 0.0, 0.0)
                add(-1, 0.0, 0.0)
                below = x[rows, f] <= c
                todo += [(left[node], rows[below], d + 1), (left[node] + 1, rows[~below], d + 1)]
        return cls(*map(np.array, (feature, cut, left, depth, roots)), size)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                go = every[inner]
                node = at[go]
                at[go] = self.left[node] + (x[go, self.feature[node]] > self.cut[node])
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / max(float(self._path(self.rows)), 1e-9))


def isolation_scores(rows: DataFrame, ident: str, columns: list[str], trees: int = 200, seed: int = 42, sample: int = FOREST_SAMPLE) -> DataFrame:
    """``rows`` with ``score`` in (0, 1), high for rows that are easily set apart.

    The forest is fitted on the ``sample`` rows with the smallest seeded hash of the identifier; all rows are scored.
    """
    filled = rows.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    drawn = filled.orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident).limit(sample).select(*columns).toPandas().to_numpy(float)
    if not len(drawn):
        return rows.withColumn("score", F.lit(None).cast("double"))
    # as plain arrays, so executors need not know the class to read it
    forest = rows.sparkSession.sparkContext.broadcast(tuple(vars(IsolationForest.fit(drawn, trees, seed)).values()))

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        return pd.Series(IsolationForest(*forest.value).score(np.column_stack([f.to_numpy(float) for f in features])))

    return filled.withColumn("score", score(*(F.col(c) for c in columns)))


def flagged_outliers(scored: DataFrame, score: str, share: float = 0.05) -> DataFrame:
    """``scored`` with ``scaled`` (min-max of the score) and ``outlier`` for about the given share of highest scores.

    The limit is the percentile by Spark's sketch, exact to a ten-thousandth of the ranks.
    """
    limit = scored.agg(F.percentile_approx(score, 1 - share, 10_000).alias("limit")).first()["limit"]
    return min_max(scored, score, "scaled").withColumn("outlier", F.col(score) > F.lit(limit))


def error_threshold(scored: DataFrame, error: str, known_good: Column, rank: float = 0.95) -> DataFrame:
    """(threshold, scaled): the exact percentile of the error over the rows known to be good, and by min-max of all."""
    good = value_statistics(scored.where(known_good).select(error), [], error, {"threshold": rank})
    ends = scored.agg(F.min(_known(error)).alias("low"), F.max(_known(error)).alias("high"))
    both = good.select("threshold").crossJoin(ends)  # one row each
    return both.select("threshold", F.coalesce(F.try_divide(F.col("threshold") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5)).alias("scaled"))


def nearest(rows: DataFrame, queries: DataFrame, ident: str, vector: str, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, neighbour, similarity): for each query the other row with the largest cosine, the smaller one on ties.

    Queries are compared block by block: a block's vectors are broadcast, its neighbours are written, and the broadcast
    is destroyed before the next. Each task reduces its rows to one candidate for each query, so what is shuffled is
    queries times tasks.
    """
    spark = rows.sparkSession
    tables = WrittenTables(spark, "nearest")
    kind = rows.schema[ident].dataType.simpleString()
    schema = f"query {kind}, neighbour {kind}, similarity double"
    paths, held = [], []

    def compare(own: list) -> None:
        names = [r[0] for r in own]
        shared = spark.sparkContext.broadcast((names, _unit(np.array([r[1] for r in own], float))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, units = shared.value
            top: dict[int, tuple] = {}
            for batch in batches:
                batch = batch.sort_values(ident, kind="stable")
                if not len(batch):
                    continue
                ids = batch[ident].to_numpy()
                near = np.round(units @ _unit(np.stack(batch[vector].to_list()).astype(float)).T, 12)
                near[np.array(asked)[:, None] == ids[None, :]] = -np.inf
                for q, k in enumerate(near.argmax(axis=1)):
                    if near[q, k] > -np.inf:
                        mine = (near[q, k], ids[k])
                        held = top.get(q)
                        if held is None or mine[0] > held[0] or mine[0] == held[0] and mine[1] < held[1]:
                            top[q] = mine
            if top:
                yield pd.DataFrame([(asked[q], i, s) for q, (s, i) in top.items()], columns=["query", "neighbour", "similarity"])

        found = rows.where(F.col(vector).isNotNull()).select(ident, vector).mapInPandas(run, schema)
        paths.append(tables.write(best(found))[1])
        shared.destroy()

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("query").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "neighbour")).alias("b")).select("query", "b.neighbour", (-F.col("b.s")).alias("similarity"))

    for r in queries.where(F.col(vector).isNotNull()).select(ident, vector).toLocalIterator():
        held.append(r)
        if len(held) >= block:
            compare(held)
            held = []
    if held:
        compare(held)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
