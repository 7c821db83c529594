"""Estimators for Spark ML pipelines: ``fit`` gives a transformer, and both work with ``Pipeline`` and its tuning tools."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import metrics
from arborlake.operators import encoders, neutralize
from arborlake.plans import boosting, explain, joint, model_files, policy
from arborlake.sources.frames import categorical_columns, check_group, check_roles

REGRESSION = ("squared_error", "poisson", "gamma", "tweedie", "quantile")
#: Classes that a classifier may find in its label column.
MOST_CLASSES = 1000


class Fitted(Model):
    """A fitted model as a transformer; columns that were target encoded before training are encoded first."""

    def __init__(self, model: boosting.Model, label: str = "label", encoders: dict[str, dict] | None = None):
        super().__init__()
        self.model, self.label, self.encoders = model, label, encoders or {}

    def encoded(self, dataset: DataFrame) -> DataFrame:
        for c, table in self.encoders.items():
            dataset = dataset.withColumn(c, _lookup(F.col(c).cast("string"), table))
        return dataset

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.encoders:
            return self.model.transform(dataset)
        kept = {c: f"__raw_{c}" for c in self.encoders}
        out = self.model.transform(self.encoded(dataset.withColumns({k: F.col(c) for c, k in kept.items()})))
        return out.withColumns({c: F.col(k) for c, k in kept.items()}).drop(*kept.values())

    @property
    def best_iteration_(self) -> int:
        return self.model.best_iteration

    @property
    def best_score_(self) -> float | None:
        return self.model.best_score

    @property
    def diagnostics_per_round_(self) -> list[dict]:
        return self.model.history

    @property
    def feature_names_in_(self) -> list[str]:
        return self.model.binner.features

    @property
    def classes_(self) -> list | None:
        return self.model.classes

    def predict_log_proba(self, df: DataFrame, out: str = "log_probability") -> DataFrame:
        """Adds the logarithm of each class's probability, none below that of 1e-15."""
        if self.model.classes is None:
            raise ValueError("only classifiers give probabilities")
        return self.transform(df).withColumn(out, F.transform("probability", lambda p: F.ln(F.greatest(p, F.lit(metrics.CLIP)))))

    def score(self, df: DataFrame) -> float:
        """R squared, or the accuracy of a classifier."""
        out = self.transform(df)
        make = metrics.accuracy if self.model.classes is not None else metrics.r2_score
        return float(make(out, self.label, "prediction").first()[0])

    def shap_values(self, df: DataFrame, pairs: bool = False) -> DataFrame:
        return explain.shap_values(self.model, df, pairs)

    def feature_importances(self, df: DataFrame | None = None) -> dict[str, float]:
        """Split gains, or mean absolute Shapley values over ``df``."""
        return self.model.importances() if df is None else {r.feature: r.importance for r in explain.importance(self.model, df).collect()}  # a row a feature

    def save_model(self, spark, path: str, overwrite: bool = False) -> None:
        model_files.save(self.model, spark, path, overwrite)


class _Boosting(Estimator):
    objective = "squared_error"

    def __init__(self, label: str, features: list[str] | None = None, categorical: list[str] | None = None, weight: str | None = None, group: str | None = None,
                 factors: list[str] | None = None, evaluate: Callable | None = None, warm: Fitted | None = None, valid: DataFrame | None = None, row_id: str | None = None,
                 encode: list[str] | None = None, smoothing: float = 20.0, policy: str = "manual", **params):
        """``params`` are those of ``boosting.Params``.

        Without ``features`` all other columns are used. ``factors`` neutralise
        the target first, or the gradients or splits if ``neutralization`` says
        so. ``valid`` is a table to stop early by. ``encode`` lists columns of
        too many categories for splits: they become target encodings. With
        ``policy`` "auto" controls that were left alone follow the table.
        """
        super().__init__()
        self.label, self.features, self.categorical, self.weight, self.group = label, features, categorical, weight, group
        self.factors, self.evaluate, self.warm, self.settings = factors, evaluate, warm, boosting.Params(**({"objective": self.objective} | params)).check()
        self.valid, self.row_id, self.encode, self.smoothing, self.policy = valid, row_id, encode or [], smoothing, policy
        if policy not in ("manual", "auto"):
            raise ValueError("policy is manual or auto")
        if self.settings.early_stopping_rounds and valid is None and evaluate is None:
            raise ValueError("early stopping needs a validation table or an evaluation")
        if valid is not None and factors and self.settings.neutralization == "none":
            raise ValueError("a neutralised target cannot be validated on a table of its own")
        self.accept()

    @property
    def objective_name(self) -> str:
        return "custom" if callable(self.settings.options.get("custom")) else self.settings.objective

    def accept(self) -> None:
        if self.settings.objective not in REGRESSION and not self.settings.options.get("custom"):
            raise ValueError(f"{self.settings.objective} is not a regression objective")

    def settle(self, df: DataFrame) -> tuple[boosting.Params, list | None]:
        return self.settings, None

    def _fit(self, dataset: DataFrame) -> Fitted:
        check_roles(dataset, self.label, self.weight)
        if self.group:
            check_group(dataset, self.group)
        roles = {self.label, self.weight, self.group, self.row_id, *(self.factors or [])}
        features = self.features or [c for c in dataset.columns if c not in roles]
        params, classes = self.settle(dataset)
        valid, tables = self.valid, {}
        for c in self.encode:
            tables[c] = _fit_table(dataset, c, self.label, self.smoothing)
            dataset = dataset.withColumn(c, _lookup(F.col(c).cast("string"), tables[c]))
            valid = valid.withColumn(c, _lookup(F.col(c).cast("string"), tables[c])) if valid is not None else None
        categorical = self.categorical if self.categorical is not None else [c for c in categorical_columns(dataset) if c in features]
        factors = self.factors if params.neutralization != "none" else None
        if self.factors and factors is None:
            if params.objective != "squared_error":
                raise ValueError("targets are neutralised for squared_error only")
            rest = neutralize.residual(dataset, F.col(self.label), self.factors, F.col(self.weight) if self.weight else None)
            dataset = dataset.withColumn(self.label, rest)
        warm = self.warm.model if self.warm else None
        if self.policy == "auto":
            binner = warm.binner if warm else boosting.fit_binner(dataset, features, categorical, params)
            params = policy.resolve(dataset, binner, self.label, self.weight, params)
        model = boosting.fit(dataset, features, self.label, params, self.weight, self.group, categorical, classes, self.evaluate, warm, valid, self.row_id, factors)
        return Fitted(model, self.label, tables)


#: Categories of a column whose encodings a model carries.
MOST_ENCODED = 1_000_000


def _fit_table(df: DataFrame, column: str, label: str, smoothing: float) -> dict:
    """Encodings of a column's categories, as the model carries them."""
    rows = encoders.fit_target(df.withColumn(column, F.col(column).cast("string")), column, label, smoothing).limit(MOST_ENCODED + 1).collect()
    if len(rows) > MOST_ENCODED:
        raise ValueError(f"{column} has more than {MOST_ENCODED} categories; encode it with operators.encoders, which joins")
    return {"prior": rows[0].prior if rows else 0.0, "of": {r.category: r.encoding for r in rows if r.category is not None}}


def _lookup(column: Column, table: dict) -> Column:
    """The encoding of a category, the prior for others, in Arrow batches."""
    known, prior = table["of"], table["prior"]

    @F.pandas_udf("double")
    def get(x: pd.Series) -> pd.Series:
        return x.map(known).astype(float).fillna(prior)

    return get(column)


class BoostedRegressor(_Boosting):
    """Squared error, Poisson, gamma, Tweedie, quantile or a custom objective."""


class BoostedClassifier(_Boosting):
    """Two or more classes, labelled 0, 1, ... without gaps."""

    objective = "binary"

    def accept(self) -> None:
        if self.settings.objective not in ("binary", "softmax"):
            raise ValueError(f"{self.settings.objective} is not a classification objective")

    def settle(self, df: DataFrame) -> tuple[boosting.Params, list | None]:
        found = [r[0] for r in df.select(self.label).distinct().orderBy(self.label).limit(MOST_CLASSES + 1).collect()]
        if not 2 <= len(found) <= MOST_CLASSES:
            raise ValueError(f"labels must have 2 to {MOST_CLASSES} values")
        if found not in ([0, 1], list(range(len(found)))):
            raise ValueError("labels must be 0, 1, ... without gaps; number them first")
        return boosting.replace(self.settings, objective="binary" if len(found) == 2 else "softmax"), found


class BoostedRanker(_Boosting):
    """Ranking objectives over the rows of each group."""

    objective = "rank:ndcg"

    def accept(self) -> None:
        if not self.settings.objective.startswith("rank:"):
            raise ValueError(f"{self.settings.objective} is not a ranking objective")
        if not self.group:
            raise ValueError("a ranker needs a group column")


class MultiLabelRanker(Estimator):
    """Several labels at once: a model for each (``independent``) or one with an output for each (``joint``)."""

    def __init__(self, labels: list[str], features: list[str], objectives: list[str] | str = "rank:ndcg", mode: str = "independent", group: str | None = None, categorical: list[str] | None = None, factors: list[str] | None = None, row_id: str | None = None, **params):
        super().__init__()
        self.labels, self.features, self.mode, self.group, self.categorical, self.factors, self.row_id = labels, features, mode, group, categorical, factors, row_id
        self.objectives = [objectives] * len(labels) if isinstance(objectives, str) else objectives
        self.settings = boosting.Params(**params).check()
        if mode not in ("independent", "joint") or len(self.objectives) != len(labels) or not labels:
            raise ValueError("mode is independent or joint, with an objective for each label")

    def _fit(self, dataset: DataFrame) -> FittedLabels:
        if self.mode == "joint":
            return FittedLabels(joint.fit(dataset, self.features, self.labels, self.objectives, self.settings, self.group, self.categorical, self.factors, row_id=self.row_id))
        return FittedLabels(joint.fit_independent(dataset, self.features, self.labels, self.objectives, self.settings, self.group, self.categorical, row_id=self.row_id, factors=self.factors))


class FittedLabels(Model):
    """Adds ``prediction``, an array by label."""

    def __init__(self, model: joint.JointModel | list[boosting.Model]):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not isinstance(self.model, list):
            return self.model.transform(dataset)
        names = [f"__p{k}" for k in range(len(self.model))]
        for m, name in zip(self.model, names):
            dataset = m.transform(dataset, name)
        return dataset.withColumn("prediction", F.array(*names)).drop(*names)

    def shap_values(self, df: DataFrame, output: int) -> DataFrame:
        """Shapley values of one output."""
        return explain.shap_values(self.model[output] if isinstance(self.model, list) else self.model.unroll()[output], df)
