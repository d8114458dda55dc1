import numpy as np
import pytest
from pyspark.sql import functions as F

from chainweft.operators import distribution, learning

RNG = np.random.default_rng(7)
X = np.vstack([RNG.normal(0, 1, (500, 5)), RNG.normal(5, 2, (50, 5))])
Y = [0.0] * 500 + [1.0] * 50
COLUMNS = [f"f{k}" for k in range(5)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"r{i}", *map(float, x), y) for i, (x, y) in enumerate(zip(X, Y))]
    return spark.createDataFrame(data, "id string, " + ", ".join(f"{c} double" for c in COLUMNS) + ", y double").repartition(4).cache()


def auc(rows, score):
    return distribution.ranked_quality(rows, score, F.col("y") == 1.0).first().roc_auc


def test_isolation_forest_sets_outliers_apart(rows):
    scored = learning.isolation_scores(rows, "id", COLUMNS)
    assert auc(scored, "score") > 0.95
    assert scored.select("id", "score").exceptAll(learning.isolation_scores(rows.repartition(7), "id", COLUMNS).select("id", "score")).count() == 0


def test_logistic_model_on_held_out_rows(rows):
    split = learning.stratified_split(rows, "id", "y", 0.25)
    assert {r.y: r["count"] for r in split.where("split = 'test'").groupBy("y").count().collect()} == {0.0: 125, 1.0: 13}
    assert split.count() == 550 and split.exceptAll(learning.stratified_split(rows.repartition(3), "id", "y", 0.25)).count() == 0
    model = learning.logistic_model(split.where("split = 'train'"), COLUMNS, "y")
    out = learning.predicted(model, split.where("split = 'test'"), COLUMNS)
    assert auc(out, "probability") > 0.97
    r = out.first()
    odds = sum(r.contributions) + model.stages[-1].intercept
    assert r.probability == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-6)


def test_saved_model_gives_the_same(rows, tmp_path):
    from pyspark.ml import PipelineModel

    model = learning.logistic_model(rows, COLUMNS, "y")
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    one, two = (learning.predicted(m, rows, COLUMNS).select("id", F.round("probability", 12)) for m in (model, again))
    assert one.exceptAll(two).count() == 0


def test_reconstruction_error(rows):
    assert auc(learning.reconstruction_error(rows.where("y = 0"), rows, COLUMNS, 2), "error") > 0.9


def test_statistics(spark, rows):
    m = {r.feature: r for r in learning.moments(rows, COLUMNS).collect()}
    assert [(m[c]["mean"], m[c]["std"]) for c in COLUMNS] == [(pytest.approx(X[:, k].mean()), pytest.approx(X[:, k].std())) for k, c in enumerate(COLUMNS)]
    s = {r.feature: r for r in learning.class_separation(rows, F.col("y") == 1.0, COLUMNS).collect()}
    assert s["f0"].separation == pytest.approx(abs(X[500:, 0].mean() - X[:500, 0].mean()) / (X[:, 0].std() + 1e-9))
    scaled = learning.standardised(rows, ["f0"]).agg(F.avg("f0"), F.stddev_pop("f0")).first()
    assert tuple(scaled) == (pytest.approx(0, abs=1e-9), pytest.approx(1))
    assert learning.min_max(rows, "f1", "s").agg(F.min("s"), F.max("s")).first() == (0.0, 1.0)
    assert learning.min_max(rows.limit(1), "f1", "s").first().s == 0.5
    assert {r.y: r.weight for r in learning.class_weights(rows, "y").collect()} == {0.0: pytest.approx(0.55), 1.0: pytest.approx(5.5)}
    odd = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert learning.moments(odd, ["x"]).first().n == 1 and learning.standardised(odd, ["x"]).count() == 3
    assert learning.standardised(odd.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_equals_brute_force(spark, block):
    vectors = np.vstack([RNG.normal(size=(60, 8)), np.ones((3, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, v array<double>").repartition(5)
    got = {r.query: (r.neighbour, r.similarity) for r in learning.nearest(df, df.where("id % 5 = 0 or id = 62"), "id", "v", block).collect()}
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-8)
    for q, (n, s) in got.items():
        near = np.round(unit @ unit[q], 12)
        near[q] = -2
        assert n == int(np.flatnonzero(near == near.max())[0]) and s == pytest.approx(near.max())
    assert len(got) == 14
    assert learning.nearest(df, df.limit(0), "id", "v").count() == 0


def test_scaling_fits_on_training_rows_and_skips_empty_columns(spark):
    df = spark.createDataFrame([(None, 1.0, "train"), (None, 3.0, "train"), (None, 9.0, "test")], "a double, b double, s string")
    out = learning.standardised(df, ["a", "b"], df.where("s = 'train'"))
    assert [(r.a, r.b) for r in out.orderBy("b").collect()] == [(0.0, -1.0), (0.0, 1.0), (0.0, 7.0)]


def test_split_of_small_and_null_classes(spark):
    df = spark.createDataFrame([(str(k), None if k % 4 == 0 else float(k % 2)) for k in range(40)] + [("z", 7.0)], "id string, y double")
    got = {(r.y, r.split): r["count"] for r in learning.stratified_split(df, "id", "y", 0.3).groupBy("y", "split").count().collect()}
    assert got == {(None, "test"): 3, (None, "train"): 7, (0.0, "test"): 3, (0.0, "train"): 7, (1.0, "test"): 6, (1.0, "train"): 14, (7.0, "train"): 1}
    assert learning.stratified_split(df.limit(0), "id", "y", 0.3).count() == 0


def test_folds_outliers_and_error_thresholds(rows):
    out = learning.cross_validated(rows, "id", COLUMNS, "y", 3).collect()
    assert sum(r.rows for r in out) == 550 and all(r.f1 > 0.8 for r in out)
    flagged = learning.flagged_outliers(learning.isolation_scores(rows, "id", COLUMNS, trees=50), "score", 0.05)
    assert 20 <= flagged.where("outlier").count() <= 28 and flagged.agg(F.min("scaled"), F.max("scaled")).first() == (0.0, 1.0)
    scored = learning.reconstruction_error(rows.where("y = 0"), rows, COLUMNS, 2)
    r = learning.error_threshold(scored, "error", F.col("y") == 0.0).first()
    errors = np.array([x.error for x in scored.where("y = 0").collect()])
    assert r.threshold == pytest.approx(np.percentile(errors, 95)) and 0 < r.scaled < 1
