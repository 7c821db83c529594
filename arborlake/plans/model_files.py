"""Model files: one line of JSON in a folder that every Spark reader can open."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import SparkSession

from arborlake.plans.boosting import Binner, Model, Params, Tree, params_dict
from arborlake.plans.joint import JointModel, JointTree
from arborlake.plans.morph import Morph

FORMAT = 1


def dumps(model: Model) -> str:
    b = model.binner
    if any(callable(v) for v in model.params.options.values()):
        raise ValueError("a custom objective is code and cannot be saved")
    return json.dumps({
        "format": FORMAT, "params": params_dict(model.params), "base": model.base, "classes": model.classes, "history": model.history,
        "binner": {"features": b.features, "cuts": [np.asarray(c, float).tolist() for c in b.cuts], "categories": b.categories, "means": b.means, "scales": b.scales}, "trees": [asdict(t) for t in model.trees],
    }, default=lambda x: x.item())


#: Parts that a model file must have, and those that it may have.
REQUIRED, OPTIONAL = {"format", "params", "base", "binner", "trees"}, {"classes", "history", "joint"}


def compatibility(d: dict, strict: bool = True) -> list[str]:
    """What keeps a file's parts from being read: missing ones, and in strict mode unknown ones."""
    wrong = [f"{k} is missing" for k in sorted(REQUIRED - d.keys())]
    if d.get("format") != FORMAT:
        wrong.append(f"unknown model format {d.get('format')}")
    return wrong + [f"{k} is unknown" for k in sorted(d.keys() - REQUIRED - OPTIONAL)] * strict


def scoring_only(model: Model) -> Model:
    """The model without what scores do not need."""
    return Model(model.params, model.binner, model.base, model.trees, model.classes, [])


def dumps_joint(model: JointModel) -> str:
    d = json.loads(dumps(Model(model.params, model.binner, model.base, [], None, model.history)))
    return json.dumps(d | {"joint": model.objectives, "trees": [asdict(t) for t in model.trees]}, default=lambda x: x.item())


def loads_joint(text: str) -> JointModel:
    d = json.loads(text)
    shell = loads(json.dumps(d | {"trees": []}))
    return JointModel(shell.params, shell.binner, d["joint"], shell.base, [JointTree(**t) for t in d["trees"]], shell.history)


def loads(text: str) -> Model:
    d = json.loads(text)
    wrong = compatibility(d)
    if wrong:
        raise ValueError("; ".join(wrong))
    p = d["params"]
    p["monotone"] = {int(k): v for k, v in p["monotone"].items()}
    p["interactions"] = tuple(tuple(g) for g in p["interactions"])
    p["morph"] = Morph(**p["morph"]) if p.get("morph") else None
    b = d["binner"]
    binner = Binner(b["features"], [np.array(c, float) for c in b["cuts"]], b["categories"], b.get("means", []), b.get("scales", []))
    p["feature_weights"] = tuple(p.get("feature_weights", ()))
    trees = [Tree(**(t | {"linear": {int(k): (v[0], v[1]) for k, v in t.get("linear", {}).items()}})) for t in d["trees"]]
    return Model(Params(**p).check(), binner, d["base"], trees, d["classes"], d["history"])


def save(model: Model, spark: SparkSession, path: str, overwrite: bool = False) -> None:
    frame = spark.createDataFrame([(dumps(model),)], "value string").coalesce(1)
    frame.write.mode("overwrite" if overwrite else "error").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return loads(spark.read.text(path).filter("value <> ''").first()[0])
