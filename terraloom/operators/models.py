"""User functions and models applied to rows, images and tiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DataType


def map_rows(fn: Callable[..., pd.Series], returns: DataType, *cols: Column | str) -> Column:
    """A user's vectorized function over whole batches; use built-in columns where possible."""

    @pandas_udf(returns)
    def run(*series: pd.Series) -> pd.Series:
        return fn(*series)

    return run(*cols)


def map_images(px: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply image functions to a whole collection, one lazy plan."""
    for step in steps:
        px = px.transform(step)
    return px


def score_tiles(px: DataFrame, value: str, size: int, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Run ``fn`` on every ``size`` x ``size`` tile (missing pixels are NaN).

    Tiles have a fixed size, so a group is bounded; the function is shipped with the task.
    """
    tiles = px.withColumns({"_ty": F.floor(F.col("r") / size), "_tx": F.floor(F.col("c") / size)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["_ty"].iloc[0]) * size, int(pdf["_tx"].iloc[0]) * size
        a = np.full((size, size), np.nan)
        i, j = pdf["r"].to_numpy() - y0, pdf["c"].to_numpy() - x0
        a[i, j] = pdf[value].to_numpy(float)
        out = fn(a)
        return pd.DataFrame({"scene": pdf["scene"], "r": pdf["r"], "c": pdf["c"], "score": out[i, j]})

    return tiles.select("scene", "_ty", "_tx", "r", "c", value).groupBy("scene", "_ty", "_tx").applyInPandas(
        run, "scene bigint, r bigint, c bigint, score double")


def train_forest(df: DataFrame, label: str, features: Sequence[str], trees: int = 150, seed: int = 42):
    """Random-forest regression; returns the fitted model.  Rows with a null feature or label are not fitted."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df.dropna(subset=[label, *features]))
    return RandomForestRegressor(featuresCol="_features", labelCol=label, predictionCol="prediction", numTrees=trees, seed=seed).fit(rows)


def apply_model(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``prediction``; rows with a null feature stay, their prediction is null."""
    named = {f"_f_{i}": F.coalesce(F.col(f).cast("double"), F.lit(0e0)) for i, f in enumerate(features)}
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    rows = VectorAssembler(inputCols=list(named), outputCol="_features").transform(df.withColumns(named))
    return model.transform(rows).withColumn("prediction", F.when(known, F.col("prediction"))).drop("_features", *named)
