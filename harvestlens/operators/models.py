"""Yield models with Spark ML. Loops run over a handful of crop × region groups or folds; every fit, transform
and metric is a distributed job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T, Window

from harvestlens.functions import labels
from harvestlens.functions.numeric import blend
from harvestlens.operators import anomalies, features as feats, metrics, splits
from harvestlens.operators.boosting import BoostFit, kept_to_best
from harvestlens.session import materialize

# Model settings and blend weights. The row bounds are defaults of parameters.
MIN_TRAIN_ROWS = 200
MIN_ROWS = 50
MIN_GROUP_ROWS = 30
BLEND = {"gbt": 0.6, "rf": 0.4}
VALIDATION_SHARE = 0.15
SEED = 42
SHUFFLE_BUCKETS = 64


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 100
    depth: int = 8
    min_rows: int = 1
    feature_share: str = "auto"


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 100
    depth: int = 6
    step: float = 0.05
    min_rows: int = 20
    row_share: float = 0.8
    feature_share: str = "0.6"
    patience: int = 50


def _texts(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [c for c in features if not isinstance(df.schema[c].dataType, T.NumericType)]


def prepare(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Numeric feature columns, rows with a label only; other columns ride along."""
    rows, texts = df.filter(F.col(label).isNotNull()), _texts(df, features)
    return rows.withColumns({c: F.col(c).try_cast("double") for c in texts}) if texts else rows


def _stages(features: Sequence[str]) -> list:
    filled = [f"__f_{c}" for c in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__features", handleInvalid="keep"),
    ]


def fit_rf(df: DataFrame, features, label="yield_amount", s: ForestSettings = ForestSettings()) -> PipelineModel:
    """Random forest; gaps in the features take the training median."""
    forest = RandomForestRegressor(
        featuresCol="__features", labelCol=label, predictionCol="prediction", numTrees=s.trees, maxDepth=s.depth,
        minInstancesPerNode=s.min_rows, featureSubsetStrategy=s.feature_share, seed=SEED,
    )
    return Pipeline(stages=[*_stages(features), forest]).fit(prepare(df, features, label))


def fit_boosted(
    df: DataFrame, features, label="yield_amount", row_key=("state_fips", "county_fips", "year", "irrigation"),
    s: BoostSettings = BoostSettings(),
) -> BoostFit:
    """Boosted trees fitted without a fixed share of held-out rows, cut to the round that is best on those."""
    boost = GBTRegressor(
        featuresCol="__features", labelCol=label, predictionCol="prediction", maxIter=s.rounds, maxDepth=s.depth,
        stepSize=s.step, minInstancesPerNode=s.min_rows, subsamplingRate=s.row_share, featureSubsetStrategy=s.feature_share, seed=SEED,
    )
    rows = materialize(splits.validation_rows(prepare(df, features, label), VALIDATION_SHARE, row_key, "__validation"))
    learned = rows.filter("NOT __validation")
    if not learned.head(1):
        learned = rows  # too few rows to hold any out
    return kept_to_best(Pipeline(stages=[*_stages(features), boost]).fit(learned), rows.filter("__validation"), s.patience)


def fit_gbt(
    df: DataFrame, features, label="yield_amount", row_key=("state_fips", "county_fips", "year", "irrigation"),
    s: BoostSettings = BoostSettings(),
) -> PipelineModel:
    """The model of `fit_boosted`."""
    return fit_boosted(df, features, label, row_key, s).model


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """Predictions under a given name; input columns keep their types."""
    texts = _texts(df, features)
    if not texts:
        return model.transform(df).select(*df.columns, F.col("prediction").alias(name))
    kept = df.withColumns({f"__in_{c}": F.col(c) for c in texts})
    out = model.transform(kept.withColumns({c: F.col(c).try_cast("double") for c in texts}))
    return out.select(*[F.col(f"__in_{c}").alias(c) if c in texts else F.col(c) for c in df.columns],
                      F.col("prediction").alias(name))


def importances(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """One row per feature; the vector has as many entries as there are features."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double")


def importance_rank(
    df: DataFrame, features, label="yield_amount", s: ForestSettings = ForestSettings(), min_rows: int = MIN_ROWS
) -> DataFrame:
    """Forest importance per feature, and whether a forest was fitted: below `min_rows` labelled rows all are zero."""
    if df.filter(F.col(label).isNotNull()).count() < min_rows:
        return df.sparkSession.createDataFrame([(f, 0.0, False) for f in features], "feature string, importance double, fitted boolean")
    return importances(fit_rf(df, features, label, s), features, df.sparkSession).withColumn("fitted", F.lit(True))


def importance_by_group(df: DataFrame, groups: Sequence[str], by: str, features, label="yield_amount", digits=4, **kw):
    """Forest importance per feature within each given group."""
    out = None
    for g in groups:
        part = importances(fit_rf(df.filter(F.col(by) == g), features, label, **kw), features, df.sparkSession)
        part = part.select(F.lit(g).alias(by), "feature", F.round("importance", digits).alias("importance"))
        out = part if out is None else out.unionAll(part)
    return out


def weighted_importance(parts: DataFrame) -> DataFrame:
    """Mean importance over models weighted by their training rows, scaled to sum to 1.

    Input: one row per (model, feature) with importance and n_train.
    """
    mean = parts.groupBy("feature").agg(
        F.try_divide(F.sum(F.col("importance") * F.col("n_train")), F.sum("n_train")).alias("w")
    )
    total = mean.agg(F.sum("w").alias("t")).scalar()
    return mean.select("feature", F.try_divide(F.col("w"), total).alias("importance"))


def fit_ensemble(df, features, label="yield_amount", forest=ForestSettings(), boost=BoostSettings()) -> dict:
    """Boosted trees and a forest on the same rows, to be blended."""
    return {"gbt": fit_gbt(df, features, label, s=boost), "rf": fit_rf(df, features, label, forest)}


def predict_blend(models: Mapping, df, features, name="pred_yield", weights: Mapping[str, float] = BLEND) -> DataFrame:
    out = df
    for part, model in models.items():
        out = predict(model, out, features, f"__p_{part}")
    names = list(models)
    mixed = blend([f"__p_{n}" for n in names], [weights[n] for n in names])
    return out.withColumn(name, mixed).drop(*[f"__p_{n}" for n in names])


def group_counts(df: DataFrame, crops: Sequence[str], regions: Sequence[str]) -> dict[tuple[str, str], int]:
    """Training rows of each listed crop × region cell."""
    rows = df.filter(F.col("commodity").isin(list(crops)) & F.col("region").isin(list(regions))).groupBy(
        "commodity", "region").count().collect()
    return {(r["commodity"], r["region"]): r["count"] for r in rows}


@dataclass
class GroupModels:
    """Fitted crop × region models with what is needed to score with them."""

    models: dict
    features: list[str]
    train_rows: dict

    def importance(self, spark: SparkSession, part: str = "gbt") -> DataFrame:
        out = None
        for key, parts in self.models.items():
            one = importances(parts[part], self.features, spark).withColumn("n_train", F.lit(self.train_rows[key]))
            out = one if out is None else out.unionAll(one)
        return weighted_importance(out)


def _cell(df: DataFrame, crop: str, region: str) -> DataFrame:
    return df.filter((F.col("commodity") == crop) & (F.col("region") == region))


def side_by_side(spark: SparkSession, tasks: Sequence[Callable], parallelism: int) -> list:
    """Run a few independent job sequences at once, so that small fits do not leave the cluster idle."""
    if not tasks:
        return []
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda f: inheritable_thread_target(spark)(f)(), tasks)


def fit_by_group(
    train: DataFrame, test: DataFrame, crops: Sequence[str], regions: Sequence[str], features=None,
    min_rows: int = MIN_TRAIN_ROWS, forest=ForestSettings(), boost=BoostSettings(), parallelism: int = 4,
) -> tuple[GroupModels, DataFrame]:
    """One blended model per crop × region with `min_rows` training rows or more; returns the models and the test predictions.

    Every test row is predicted: rows of other cells, crops and regions by one model of all training rows, or by none (NULL) where there
    are no training rows; `model` says cell, pooled or none. Baselines are learned within each cell, or from all training rows.
    """
    features = list(features or feats.CORE_FEATURES)
    used = features + feats.BASELINE_FEATURES
    counts = group_counts(train, crops, regions)
    found, scored = GroupModels({}, used, {}), None
    covered = F.lit(False)
    cells = [(c, r) for c in crops for r in regions if counts.get((c, r), 0) >= min_rows]

    def fit(cell):
        rows = _cell(train, *cell)
        return fit_ensemble(feats.with_baselines(rows, rows), used, forest=forest, boost=boost)

    for cell, fitted in zip(cells, side_by_side(train.sparkSession, [partial(fit, c) for c in cells], parallelism)):
        found.models[cell], found.train_rows[cell] = fitted, counts[cell]
        part = predict_blend(fitted, feats.with_baselines(_cell(test, *cell), _cell(train, *cell)), used).withColumn("model", F.lit("cell"))
        scored = part if scored is None else scored.unionByName(part)
        covered = covered | F.coalesce((F.col("commodity") == cell[0]) & (F.col("region") == cell[1]), F.lit(False))
    rest = feats.with_baselines(test.filter(~covered), train)
    if not rest.head(1):
        rest = rest.withColumns({"pred_yield": F.lit(None).cast("double"), "model": F.lit("none")})
    elif train.filter(F.col("yield_amount").isNotNull()).head(1):
        pooled = fit_ensemble(feats.with_baselines(train, train), used, forest=forest, boost=boost)
        rest = predict_blend(pooled, rest, used).withColumn("model", F.lit("pooled"))
    else:
        rest = rest.withColumns({"pred_yield": F.lit(None).cast("double"), "model": F.lit("none")})
    return found, rest if scored is None else scored.unionByName(rest)


def fit_stratified(
    train: DataFrame, df: DataFrame, features, groups: Sequence[str], by="commodity", label="yield_amount",
    forest=ForestSettings(), boost=BoostSettings(rounds=100, depth=6, step=0.1), min_rows: int = MIN_GROUP_ROWS,
) -> DataFrame:
    """Mean of two models per group, with the pooled model for rows whose group is unseen or has fewer than `min_rows` training rows;
    `model` says own or pooled."""
    half = {"gbt": 0.5, "rf": 0.5}
    pooled = fit_ensemble(train, features, label, forest, boost)
    sizes = {r[by]: r["count"] for r in train.filter(F.col(by).isin(list(groups))).groupBy(by).count().collect()}
    big = [g for g in groups if sizes.get(g, 0) >= min_rows]
    rest = df.filter(~F.coalesce(F.col(by).isin(big), F.lit(False))) if big else df
    out = predict_blend(pooled, rest, features, "yield_predicted", half).withColumn("model", F.lit("pooled"))
    for g in big:
        own = fit_ensemble(train.filter(F.col(by) == g), features, label, forest, boost)
        out = out.unionByName(predict_blend(own, df.filter(F.col(by) == g), features, "yield_predicted", half).withColumn("model", F.lit("own")))
    return out.withColumn("yield_residual", F.col(label) - F.col("yield_predicted"))


def attach_predictions(df: DataFrame, preds: DataFrame, key: Sequence[str], name: str = "pred_yield") -> DataFrame:
    """Write predictions back by row key, so that each value lands on its own row."""
    return df.drop(name).join(preds.select(*key, name), list(key), "left")


def oof_predictions(df: DataFrame, features, k: int = 5, keys=splits.COUNTY_KEY, label="yield_amount", number=None,
                    forest=ForestSettings(), parallelism: int = 4) -> DataFrame:
    """Each row predicted by a model that saw no row of its county."""
    folded = materialize(splits.group_kfold(df.filter(F.col(label).isNotNull()), keys, k, number))
    fits = [partial(fit_rf, folded.filter(F.col("fold") != f), features, label, forest) for f in range(k)]
    out = None
    for fold, model in enumerate(side_by_side(df.sparkSession, fits, parallelism)):
        part = predict(model, folded.filter(F.col("fold") == fold), features, "yield_predicted")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("yield_residual", F.col(label) - F.col("yield_predicted"))


def oof_anomalies(df: DataFrame, features, k: int = 5, **kw) -> DataFrame:
    """Out-of-fold predictions with overall z flags."""
    return anomalies.oof_flags(oof_predictions(df, features, k, **kw))


def holdout_anomalies(df: DataFrame, features, label="yield_amount", split="split", forest=ForestSettings()) -> DataFrame:
    """Model trained on training counties; flags only on held-out counties, by the training residual spread."""
    model = fit_rf(df.filter(F.col(split) == "train"), features, label, forest)
    out = predict(model, df, features, "yield_predicted").withColumn(
        "yield_residual", F.col(label) - F.col("yield_predicted"))
    return anomalies.holdout_flags(out, split)


def walk_forward_cv(
    df: DataFrame, first_test_year: int, crops, regions, folds: int = 5, min_rows: int = MIN_TRAIN_ROWS, **kw
) -> tuple[DataFrame, DataFrame]:
    """(predictions of the sliding folds, R² per fold). The fold list has at most `folds` entries."""
    plan = splits.walk_forward(df, first_test_year, folds).groupBy("fold", "cutoff").agg(
        F.sort_array(F.collect_list("test_year")).alias("years")).orderBy("fold").collect()
    rows = materialize(df)
    out = None
    for f in plan:
        _, part = fit_by_group(rows.filter(F.col("year") < f.cutoff), rows.filter(F.col("year").isin(f.years)), crops,
                               regions, min_rows=min_rows, **kw)
        part = part.withColumn("fold", F.lit(f.fold))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("too few years for a fold")
    scores = metrics.regression_metrics(out, ["fold"]).select("fold", "r2", "mae", "rmse", "n")
    return out, scores


def last_fold_prediction(preds: DataFrame, key: Sequence[str], name: str = "pred_yield") -> DataFrame:
    """Overlapping folds predict a row several times; the latest fold counts."""
    return preds.groupBy(*key).agg(F.max_by(name, "fold").alias(name))


def permute(df: DataFrame, col: str, row_key: Sequence[str], buckets: int = SHUFFLE_BUCKETS, seed: int = SEED) -> DataFrame:
    """Shuffle one column among rows. Rows are dealt into random buckets and shuffled within them, so no single
    task orders the whole table. Raise `buckets` with the table; another number gives another shuffle."""
    placed = df.withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), *row_key), F.lit(buckets)))

    def order(i):
        return F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(F.lit(seed + i), *row_key), *row_key))

    takers = placed.withColumn("__n", order(1)).drop(col)
    givers = placed.select("__b", order(2).alias("__n"), col)
    return takers.join(givers, ["__b", "__n"]).select(*df.columns)


def permutation_importance(model, df: DataFrame, features, row_key, label="yield_amount", seed=SEED, buckets: int = SHUFFLE_BUCKETS):
    """Rise of the mean squared error when a feature is shuffled, one row per feature."""
    base = materialize(df)

    def mse(rows, feature):
        p = predict(model, rows, features, "__p")
        gap = F.col(label) - F.col("__p")
        return p.agg(F.lit(feature).alias("feature"), F.avg(gap * gap).alias("mse"))

    whole = mse(base, "").select("mse").scalar()
    out = None
    for f in features:
        part = mse(permute(base, f, row_key, buckets, seed), f)
        out = part if out is None else out.unionAll(part)
    return out.select("feature", (F.col("mse") - whole).alias("importance"))


def _of(given, cell):
    """What holds for a cell: an entry by cell, or one value for all."""
    return given[cell] if isinstance(given, Mapping) and cell in given else given


def score(df: DataFrame, models: Mapping, features, weights=BLEND) -> DataFrame:
    """Predicted yield and its class: the blended model of the row's crop and region, else the rule-based estimate.

    `features` and `weights` hold for all models, or are given by (crop, region). Expects trend and baseline columns; absent feature
    columns count as 0. The rows are written by crop and region once, so that each model reads its own part only.
    """
    wanted = {f for cell in models for f in _of(features, cell)}
    rows = materialize(df.withColumns({f: F.lit(0.0) for f in sorted(wanted - set(df.columns))}), ("commodity", "region"))
    out, covered = None, F.lit(False)
    for (crop, region), parts in models.items():
        mine = F.coalesce((F.col("commodity") == crop) & (F.col("region") == region), F.lit(False))
        covered = covered | mine
        part = predict_blend(parts, _cell(rows, crop, region), _of(features, (crop, region)), "__raw", _of(weights, (crop, region)))
        part = part.withColumn("predicted_yield", F.bround("__raw", 1)).drop("__raw").withColumn("source", F.lit("model"))
        out = part if out is None else out.unionByName(part)
    rest = feats.heuristic_yield(rows.filter(~covered)).withColumn("source", F.lit("estimate"))
    out = rest if out is None else out.unionByName(rest)
    return out.withColumn("yield_category", labels.yield_category_abs("predicted_yield", "commodity"))
