"""Trend, baseline and model artifacts on a shared file system."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.operators.features import baselines, state_trend


def trend_artifact(df: DataFrame) -> DataFrame:
    """One row per crop and state with a line: [intercept, slope]."""
    return state_trend(df).filter(F.col("slope").isNotNull()).select("commodity", "state_abbr", F.array("intercept", "slope").alias("line"))


def baseline_artifact(df: DataFrame) -> DataFrame:
    """State and county medians in one tidy table: level, key, value."""
    state, county = baselines(df)
    return state.select(
        "commodity", F.lit("state").alias("level"), F.col("state_abbr").alias("key"), F.col("state_baseline").alias("value")
    ).unionAll(county.select(
        "commodity", F.lit("county"), F.concat_ws("-", F.col("state_fips").cast("string"), F.col("county_fips").cast("string")),
        "county_baseline",
    ))


def write_artifacts(df: DataFrame, directory: str, crops=("Corn", "Soybeans")) -> None:
    """Trends and baselines of each crop as JSON lines under new folders."""
    rows = df.filter(F.trim("commodity").isin(list(crops)) & F.col("yield_amount").isNotNull()).withColumns(
        {"commodity": F.trim("commodity"), "state_abbr": F.trim("state_abbr")}
    )
    trend_artifact(rows).write.partitionBy("commodity").json(f"{directory}/trend")
    baseline_artifact(rows).write.partitionBy("commodity").json(f"{directory}/baselines")


def _model_path(directory: str, crop: str, region: str, part: str) -> str:
    return f"{directory}/{crop.lower()}_{region.lower()}/{part}"


def save_models(
    spark: SparkSession, models: Mapping[tuple[str, str], Mapping[str, PipelineModel]], directory: str,
    features, weights, metrics: Mapping[str, float] | None = None,
) -> None:
    """Save each (crop, region) model set with a manifest of features and weights, which hold for all or are given by (crop, region)."""
    rows = []
    for (crop, region), parts in models.items():
        own_features = features[crop, region] if isinstance(features, Mapping) else features
        own_weights = weights.get((crop, region), weights)
        for part, model in parts.items():
            model.write().save(_model_path(directory, crop, region, part))
            rows.append((crop, region, part, float(own_weights[part]), list(own_features), dict(metrics or {})))
    schema = "crop string, region string, part string, weight double, features array<string>, metrics map<string,double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{directory}/manifest")


def load_models(spark: SparkSession, directory: str):
    """(models, features, weights) as saved, each by (crop, region)."""
    schema = "crop string, region string, part string, weight double, features array<string>, metrics map<string,double>"
    models, features, weights = {}, {}, {}
    for r in spark.read.schema(schema).json(f"{directory}/manifest").collect():
        model = PipelineModel.load(_model_path(directory, r.crop, r.region, r.part))
        cell = (r.crop, r.region)
        models.setdefault(cell, {})[r.part] = model
        weights.setdefault(cell, {})[r.part] = r.weight
        features[cell] = list(r.features)
    return models, features, weights
