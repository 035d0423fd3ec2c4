"""Model bundles (S21, S22): fitted converters + candidate + settings, reusable on another table.

A bundle is a folder: ``metadata.json`` (settings without catalog/table/mode, labels,
candidate codes, feature columns) and the fitted Spark ML stages saved with their own
writers.  Composed models keep class-sized parameters, stored as JSON.
"""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.operators.additive import ClosedForm

STATE = "kind string, name string, shape array<int>, values array<double>"
METADATA = "metadata.json"


def save_model(spark: SparkSession, path: str, settings: dict, labels: list[str], candidate: tuple[str, str, str],
               stages: dict) -> None:
    """Write metadata and every stage that has a Spark ML writer."""
    meta = {k: v for k, v in settings.items() if k not in ("catalog", "table", "train", "predict")}
    meta.update({"labels": labels, "candidate": list(candidate), "stages": sorted(stages)})
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(os.path.join(path, METADATA)), True)
    out.write(bytearray(json.dumps(meta, indent=2, default=str), "utf-8"))
    out.close()
    for name, stage in stages.items():
        if hasattr(stage, "write"):
            stage.write().overwrite().save(os.path.join(path, name))


def load_metadata(spark: SparkSession, path: str) -> dict:
    """Read the settings back; the caller re-applies the current run's table and mode."""
    text = spark.sparkContext.wholeTextFiles(os.path.join(path, METADATA)).first()[1]
    return json.loads(text)


def save_closed_form(spark: SparkSession, path: str, name: str, model: ClosedForm) -> None:
    """A closed-form learner (A1, A14, A15, A17-A19, with its scaler) as a table of typed rows
    (kind, name, shape, values): one row an array, class- and feature-sized."""
    rows = [(model.algorithm, n, list(a.shape), a.ravel().tolist()) for n, a in sorted(model.arrays.items())]
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, name))


def load_closed_form(spark: SparkSession, path: str, name: str) -> ClosedForm:
    """The learner that ``save_closed_form`` wrote.  An incomplete or mixed table is an error."""
    rows = spark.read.schema(STATE).parquet(os.path.join(path, name)).collect()
    kinds = {r["kind"] for r in rows}
    arrays = {r["name"]: np.array(r["values"], float).reshape(r["shape"]) for r in rows}
    if len(kinds) != 1 or set(arrays) not in ({"b", "W"}, {"b", "W", "mu", "w"}):
        raise ValueError(f"{os.path.join(path, name)} holds no learner: kinds {sorted(kinds)}, arrays {sorted(arrays)}")
    return ClosedForm(kinds.pop(), arrays)


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles under a folder (directories holding a metadata file)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(p):
        for st in fs.listStatus(p):
            if st.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), METADATA)):
                rows.append((st.getPath().getName(), st.getPath().toString(), int(st.getModificationTime())))
    return spark.createDataFrame(rows, "model_name string, path string, modified_ms long").orderBy("model_name")


__all__ = ["save_model", "load_metadata", "save_closed_form", "load_closed_form", "list_models", "F"]
