"""Model and label files, and records from Python.

Record tables come from any Spark source.  Labels and models are JSON, in any
file system that Spark can read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.predicates import from_config as predicate_from
from concord.plans.model import Logistic
from concord.plans.variables import from_config as variable_from


def to_json(value):
    """JSON of a record's value; tuples and sets are tagged."""
    if isinstance(value, tuple):
        return {"__class__": "tuple", "__value__": [to_json(v) for v in value]}
    if isinstance(value, (set, frozenset)):
        return {"__class__": "frozenset", "__value__": sorted((to_json(v) for v in value), key=json.dumps)}
    if isinstance(value, list):
        return [to_json(v) for v in value]
    if isinstance(value, dict):
        return {str(k): to_json(v) for k, v in value.items()}
    return value


def from_json(value):
    if isinstance(value, dict):
        if value.get("__class__") == "tuple":
            return tuple(from_json(v) for v in value["__value__"])
        if value.get("__class__") == "frozenset":
            return frozenset(from_json(v) for v in value["__value__"])
        if "__class__" in value:
            return []
        return {k: from_json(v) for k, v in value.items()}
    return [from_json(v) for v in value] if isinstance(value, list) else value


def write_training(training: dict, path: str) -> None:
    """Labelled pairs {match: [(record, record)], distinct: [...]} to a file; records are dicts."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: [[to_json(dict(a)), to_json(dict(b))] for a, b in training.get(k, [])] for k in ("distinct", "match")}, f)


def read_training(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return {k: [(from_json(a), from_json(b)) for a, b in found.get(k, [])] for k in ("match", "distinct")}


def settings(variables: list, predicates: list, model: Logistic) -> dict:
    return {"version": 1, "variables": [v.config() for v in variables], "predicates": [p.config() for p in predicates], "classifier": {"coef": list(model.weights), "intercept": model.intercept, "c": model.penalty}}


def write_settings(path: str, variables: list, predicates: list, model: Logistic) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings(variables, predicates, model), f, sort_keys=True)


def read_settings(path: str) -> tuple[list, list, Logistic]:
    """Variables, predicates and match model of a stored model."""
    found = settings_dict(path)
    if found.get("version") != 1:
        raise ValueError("the model file is of another version")
    c = found["classifier"]
    return [variable_from(v) for v in found["variables"]], [predicate_from(p) for p in found["predicates"]], Logistic(list(c["coef"]), c["intercept"], c["c"])


def settings_dict(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def records_from_dict(spark: SparkSession, data: dict, schema: str, id_col: str = "id") -> DataFrame:
    """A record table of {id: {field: value}}; absent fields are null.  ``schema`` names the fields' types, the id first."""
    names = [part.split()[0] for part in schema.split(",")]
    rows = [(key, *[sorted(r[c]) if isinstance(r.get(c), (set, frozenset)) else r.get(c) for c in names[1:]]) for key, r in data.items()]
    del id_col
    return spark.createDataFrame(rows, schema)


def clusters_to_python(clusters: DataFrame) -> list[tuple[tuple, tuple]]:
    """[(ids, confidences)] in the order of the smallest ids; for results that fit the driver."""
    rows = clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("id", "confidence"))).alias("m")).orderBy("cluster_id").collect()
    return [(tuple(m["id"] for m in r["m"]), tuple(m["confidence"] for m in r["m"])) for r in rows]
