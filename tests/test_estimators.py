import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from arborlake.functions import metrics
from arborlake.plans.estimators import BoostedClassifier, BoostedRanker, BoostedRegressor
from tests.test_boosting import table


def test_regressor_in_a_pipeline(spark):
    df = table(spark).drop("id")
    fitted = Pipeline(stages=[BoostedRegressor("y", n_estimators=4, max_depth=2, learning_rate=0.5)]).fit(df)
    assert metrics.rmse(fitted.transform(df), "y", "prediction").first()[0] < 0.9
    by_gain, by_shap = fitted.stages[0].feature_importances(), fitted.stages[0].feature_importances(df)
    assert max(by_gain, key=by_gain.get) == max(by_shap, key=by_shap.get) == "a"


@pytest.mark.parametrize("classes", [2, 3])
def test_classifier(spark, classes):
    df = table(spark).select("a", "b", F.floor(F.col("a") * classes).cast("int").alias("k"))
    out = BoostedClassifier("k", n_estimators=6, max_depth=3, learning_rate=0.5).fit(df).transform(df)
    assert metrics.accuracy(out, "k", "prediction").first()[0] > 0.95
    assert len(out.first().probability) == classes


def test_ranker_and_factors(spark):
    df = table(spark).withColumn("q", F.col("id") % 20).withColumn("rel", F.floor(F.col("a") * 4).cast("int"))
    out = BoostedRanker("rel", ["a", "b"], group="q", n_estimators=4, max_depth=2, learning_rate=0.5).fit(df).transform(df)
    assert metrics.ndcg(out, "rel", "prediction", "q", "id").first()[0] > 0.9
    plain = table(spark).na.drop()
    m = BoostedRegressor("y", ["b"], factors=["a"], n_estimators=2, max_depth=2).fit(plain)
    assert m.model.binner.features == ["b"]


def test_wrong_settings_are_refused(spark):
    for make in (lambda: BoostedRegressor("y", objective="binary"), lambda: BoostedRanker("y"), lambda: BoostedClassifier("y", objective="gamma")):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(ValueError):
        BoostedClassifier("y").fit(table(spark).select("a", F.lit(3).alias("y")))
