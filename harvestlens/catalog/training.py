"""Model queries. A fitted number has no SQL twin; the twins hold what is certain about the result: its rows, splits, regions and counts,
that every row has a prediction, that importances are shares of one, and that flags follow from their z-scores."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from harvestlens.catalog.base import TEST_FROM, check_table, region_sql
from harvestlens.catalog.counties import KEY, KEYS, estimate_inputs
from harvestlens.catalog.registry import query
from harvestlens.functions.regions import DRIVER_GROUPS, REGION_SETS, region_table
from harvestlens.operators import attributions, features, models, reports, splits
from harvestlens.plans import studies
from harvestlens.session import fresh_folder, materialize
from harvestlens.sources import artifacts

CROPS = ("Corn", "Soybeans")
REGIONS = tuple(r for r in REGION_SETS["training"] if r != "default") + ("Other",)
ROW = ["state_fips", "county_fips", "year", "commodity", "irrigation"]
USED = features.WEATHER_FEATURES
# All rounds are fitted before the best is picked, so the many fits of these queries take fewer and longer steps.
BOOST = models.BoostSettings(rounds=25, step=0.2, patience=10)

_REGION = region_sql("training")
# the side of a county, from a whole number of its key as both engines compute it
_SIDE = "CASE WHEN (state_fips * 10 + county_fips) * 37 % 1000 < 200 THEN 'test' ELSE 'train' END"
check_table("regional", f"SELECT *, {_REGION} AS region FROM merged")
check_table("cells", f"SELECT commodity, region, count(*) AS n FROM regional WHERE year < {TEST_FROM} GROUP BY commodity, region")
_MODEL = f"CASE WHEN n >= {models.MIN_TRAIN_ROWS} THEN 'cell' ELSE 'pooled' END"


def number():
    return (F.col("state_fips") * 10 + F.col("county_fips")) * 37


def rows(b):
    clean = features.impute(b.merged)
    return features.with_region(features.features_core(clean), region_table(b.spark, "training"), "Other")


def known(name: str) -> Column:
    """Whether a prediction is there and a finite number."""
    c = F.col(name)
    return (c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)).alias("known")


def varies(df, name: str, by: list[str] = ()):
    """The rows with whether the predictions differ among them (of a group), which those of a constant model do not."""
    spread = df.groupBy(*by).agg((F.max(name) - F.min(name) > 1e-6).alias("varies"))
    return df.join(spread, list(by)) if by else df.withColumn("varies", spread.scalar())


def fits(df, rows: Column, name: str, label: str = "yield_amount"):
    """The rows with whether the predictions are nearer to the labels of the rows that were learned from than those labels' mean is."""
    gap = F.avg(F.when(rows, F.pow(F.col(label) - F.col(name), 2)))
    return df.withColumn("fits", df.agg((gap < 0.98 * F.var_pop(F.when(rows, F.col(label)))).alias("fits")).scalar())


def flag_holds(z: Column, flag: Column) -> Column:
    """Whether a two-sided flag says what its z-score says."""
    want = F.when(z > 2, "high_yield_vs_weather").when(z < -2, "low_yield_vs_weather").otherwise("")
    return (F.coalesce(flag, F.lit("")) == want).alias("flag_holds")


def shares(ranks, by: list[str] = ()):
    """Each feature with whether its importance is a share, and the sum over all."""
    total = ranks.groupBy(*by).agg(F.round(F.sum("importance"), 2).alias("total"))
    joined = ranks.join(total, list(by)) if by else ranks.withColumn("total", total.scalar())
    return joined.withColumn("is_share", F.col("importance").between(0, 1))


def _values(names) -> str:
    return ", ".join(f"('{n}')" for n in names)


_CROP_FEATURES = f"SELECT commodity, feature, true AS is_share, 1e0 AS total FROM (VALUES {_values(CROPS)}) c(commodity), (VALUES {{}}) f(feature)"


@query("m06_forest_importance_by_crop", "commodity:s feature:s is_share:b total:d1", _CROP_FEATURES.format(_values(USED)))
def _(b):
    return shares(models.importance_by_group(b.merged, CROPS, "commodity", USED, digits=9), ["commodity"])


@query("q05_forest_importance_in_drivers_report", "commodity:s feature:s is_share:b total:d1", _CROP_FEATURES.format(_values(studies.FOREST_FEATURES)))
def _(b):
    report = studies.drivers_report(b.signals, only=["forest_importance"])
    return shares(report["forest_importance"], ["commodity"])


@query("m07_boosted_predictions", KEY + "yield_amount:d known:b varies:b", f"SELECT {KEYS}, yield_amount, true AS known, true AS varies FROM merged WHERE year >= {TEST_FROM}")
def _(b):
    data = b.merged
    model = models.fit_gbt(data.filter(F.col("year") < TEST_FROM), USED, s=BOOST)
    return varies(models.predict(model, data.filter(F.col("year") >= TEST_FROM), USED, "pred_yield"), "pred_yield").select("*", known("pred_yield"))


# The rounds are numbers of a fit; certain is that the kept ones are some of those fitted, that no round looked at has a smaller loss, and what the model was
# fitted on and held against.
@query("m07_best_round", "rounds_fitted:i is_least:b no_worse_than_all:b beats_mean:b keeps_its_rounds:b n:i",
       "SELECT 60 AS rounds_fitted, true AS is_least, true AS no_worse_than_all, true AS beats_mean, true AS keeps_its_rounds, count(*) AS n FROM merged")
def _(b):
    data = materialize(b.merged)
    fit = models.fit_boosted(data, USED, s=models.BoostSettings(rounds=60, step=0.2, patience=20))
    held = splits.validation_rows(data, models.VALIDATION_SHARE, ("state_fips", "county_fips", "year", "irrigation"), "held")
    held = models.predict(fit.model, held, USED, "p")
    learned = ~F.col("held")
    trees = fit.model.stages[-1].getNumTrees
    table = fit.table(b.spark).agg(
        F.count(F.lit(1)).alias("rounds_fitted"), F.min_by("kept", "loss").alias("is_least_of_all"),
        (F.min(F.when(F.col("round") <= fit.looked_at, F.col("loss"))) == F.max(F.when(F.col("round") == fit.best, F.col("loss")))).alias("is_least"),
        (F.max(F.when(F.col("round") == fit.best, F.col("loss"))) <= F.max_by("loss", "round")).alias("no_worse_than_all"),
        F.sum(F.col("kept").cast("int")).alias("kept"),
    )
    gap = lambda rows: F.avg(F.when(rows, F.pow(F.col("yield_amount") - F.col("p"), 2)))
    errors = held.agg(F.count(F.lit(1)).alias("n"), (gap(learned) < F.var_pop(F.when(learned, F.col("yield_amount")))).alias("beats_mean"),
                      F.abs(gap(F.col("held")) - fit.losses[fit.best - 1]).alias("off"))
    return table.join(errors).select("rounds_fitted", "is_least", "no_worse_than_all", "beats_mean", ((F.col("kept") == trees) & (F.col("off") < 1e-6)).alias("keeps_its_rounds"), "n")


@query("m08_m09_models_by_crop_and_region", KEY + "region:s model:s yield_amount:d known:b varies:b",
       f"SELECT {KEYS}, region, {_MODEL} AS model, yield_amount, true AS known, true AS varies FROM regional LEFT JOIN cells USING (commodity, region) WHERE year >= {TEST_FROM}")
def _(b):
    data = materialize(rows(b))
    _, scored = models.fit_by_group(data.filter(F.col("year") < TEST_FROM), data.filter(F.col("year") >= TEST_FROM), CROPS, REGIONS, boost=BOOST)
    return varies(scored, "pred_yield", ["commodity", "model"]).select("*", known("pred_yield"))


@query("m10_stratified_models", KEY + "split:s model:s known:b varies:b fits:b", f"""SELECT {KEYS}, split, CASE WHEN n >= {models.MIN_GROUP_ROWS} THEN 'own' ELSE 'pooled' END AS model, true AS known, true AS varies, true AS fits
  FROM (SELECT *, {_SIDE} AS split FROM merged) m LEFT JOIN (SELECT commodity, count(*) AS n FROM merged WHERE {_SIDE} = 'train' GROUP BY commodity) c USING (commodity)""")
def _(b):
    data = materialize(splits.entity_split(b.merged, number=number()))
    out = materialize(models.fit_stratified(data.filter("split = 'train'"), data, USED, CROPS, boost=BOOST))
    return fits(varies(out, "yield_predicted", ["commodity"]), F.col("split") == "train", "yield_predicted").select("*", known("yield_predicted"))


@query("m11_j12_out_of_fold_flags", KEY + "yield_amount:d known:b flag_holds:b one_fold:b varies:b", f"SELECT {KEYS}, yield_amount, true AS known, true AS flag_holds, true AS one_fold, true AS varies FROM merged")
def _(b):
    flagged = materialize(models.oof_anomalies(b.merged, USED, 5))
    folds = flagged.groupBy("state_fips", "county_fips").agg((F.count_distinct("fold") == 1).alias("one_fold"))
    flagged = varies(flagged, "yield_predicted", ["fold"])
    kept = models.attach_predictions(b.merged, flagged, ROW, "yield_predicted").join(flagged.select(*ROW, "yield_residual_z", "anomaly_flag", "varies"), ROW, "left")
    return kept.join(folds, ["state_fips", "county_fips"]).select("*", known("yield_predicted"), flag_holds(F.col("yield_residual_z"), F.col("anomaly_flag")))


@query("m12_holdout_anomalies", KEY + "split:s known:b only_test:b varies:b fits:b", f"SELECT {KEYS}, {_SIDE} AS split, true AS known, true AS only_test, true AS varies, true AS fits FROM merged")
def _(b):
    data = materialize(splits.entity_split(b.merged, number=number()))
    out = fits(varies(materialize(models.holdout_anomalies(data, USED)), "yield_predicted"), F.col("split") == "train", "yield_predicted")
    return out.select("*", known("yield_predicted"), ((F.col("split") == "test") | (F.col("anomaly_flag") == "")).alias("only_test"))


@query("m13_walk_forward_scores", "fold:i n:i known:b varies:b", """WITH ys AS (SELECT list(DISTINCT year ORDER BY year) AS ys FROM merged),
  cut AS (SELECT list_filter(ys, lambda y: y < 2000) AS train, ys, len(list_filter(ys, lambda y: y >= 2000)) AS w FROM ys),
  starts AS (SELECT ys, w, greatest(len(train) - w + 1 - 5, 0) AS first, len(train) - w + 1 AS stop FROM cut),
  folds AS (SELECT i - first + 1 AS fold, ys[i + 1] AS cutoff, ys[i + 1:i + w] AS years, ys[1] AS earliest FROM (SELECT *, unnest(range(first, stop)) AS i FROM starts) s)
  SELECT fold, count(*) AS n, true AS known, true AS varies FROM folds JOIN merged ON list_contains(years, year) WHERE cutoff > earliest GROUP BY fold""")
def _(b):
    preds, scores = models.walk_forward_cv(rows(b), 2000, CROPS, REGIONS, boost=BOOST)
    spread = preds.groupBy("fold").agg((F.max("pred_yield") - F.min("pred_yield") > 1e-6).alias("varies"))
    return scores.filter("n > 0").join(spread, "fold").select("*", known("rmse"))


@query("m14_weighted_importance", "feature:s is_share:b total:d1", f"SELECT feature, true AS is_share, 1e0 AS total FROM (VALUES {_values([*features.CORE_FEATURES, *features.BASELINE_FEATURES])}) f(feature)")
def _(b):
    data = materialize(rows(b))
    fitted, _ = models.fit_by_group(data.filter(F.col("year") < TEST_FROM), data.filter(F.col("year") >= TEST_FROM), CROPS, REGIONS, min_rows=models.MIN_ROWS, boost=BOOST)
    return shares(fitted.importance(b.spark))


@query("m19_s28_score_with_saved_models", KEY + "region:s source:s known:b varies:b",
       f"""SELECT {KEYS}, region, CASE WHEN n >= {models.MIN_ROWS} THEN 'model' ELSE 'estimate' END AS source, true AS known, true AS varies
  FROM regional LEFT JOIN cells USING (commodity, region) WHERE year >= {TEST_FROM}""")
def _(b):
    data = rows(b).drop("region").join(estimate_inputs(b).select(*ROW, "trend"), ROW)
    data = materialize(features.with_region(data, region_table(b.spark, "training"), "Other"))
    train, test = data.filter(F.col("year") < TEST_FROM), data.filter(F.col("year") >= TEST_FROM)
    fitted, _ = models.fit_by_group(train, test, CROPS, REGIONS, min_rows=models.MIN_ROWS, boost=BOOST)
    place = fresh_folder(b.spark, "models")
    artifacts.save_models(b.spark, fitted.models, place, fitted.features, models.BLEND)
    loaded, used, weights = artifacts.load_models(b.spark, place)
    based = features.with_baselines(test, train, by=["commodity"])
    out = materialize(models.score(based, loaded, used, weights))
    return varies(out, "predicted_yield", ["source"]).select("*", known("predicted_yield"))


@query("m20_permutation_importance", "feature:s known:b some_matter:b", f"SELECT feature, true AS known, true AS some_matter FROM (VALUES {_values(USED)}) f(feature)")
def _(b):
    data = materialize(b.merged)
    model = models.fit_rf(data, USED)
    out = materialize(models.permutation_importance(model, data, USED, ROW))
    return out.withColumn("some_matter", out.agg((F.max("importance") > 0).alias("m")).scalar()).select("*", known("importance"))


@query("m20_row_attributions", KEY + "yield_amount:d adds_up:b n_features:i some_matter:b",
       f"SELECT {KEYS}, yield_amount, true AS adds_up, {len(USED)} AS n_features, true AS some_matter FROM merged")
def _(b):
    data = materialize(b.merged)
    model = models.fit_rf(data, USED, s=models.ForestSettings(trees=20, depth=6))
    out = materialize(attributions.attributions(model, data, USED))
    total = F.aggregate(F.map_values("attributions"), F.lit(0.0), lambda a, x: a + x)
    some = out.agg((F.max(F.array_max(F.transform(F.map_values("attributions"), F.abs))) > 0).alias("m")).scalar()
    return out.select("*", (F.abs(total + F.col("base_value") - F.col("prediction")) < 1e-9).alias("adds_up"), F.size("attributions").alias("n_features"), some.alias("some_matter"))


@query("m20_worst_row_explained", "position:i n:i is_worst:b adds_up:b", f"SELECT unnest(range(1, {len(USED) + 1})) AS position, {len(USED)} AS n, true AS is_worst, true AS adds_up")
def _(b):
    data = materialize(b.merged)
    boost = models.fit_boosted(data, USED, s=models.BoostSettings(rounds=20, step=0.2, depth=4))
    out = materialize(attributions.attributions(boost.model, data, USED))
    worst = materialize(attributions.worst_row(out, "yield_amount", ROW))
    gap = F.abs(F.col("yield_amount") - F.col("prediction"))
    most = out.agg(F.max(gap).alias("m")).scalar()
    total = worst.agg(F.sum("value").alias("t")).scalar()
    # the one row's features: as many rows as there are features
    place = F.row_number().over(Window.orderBy(F.abs("value").desc(), "feature"))
    return worst.select(place.alias("position"), F.lit(len(USED)).alias("n"), (gap == most).alias("is_worst"), (F.abs(total + F.col("base_value") - F.col("prediction")) < 1e-9).alias("adds_up"))


@query("m20_permuted_column", "column_sum:d3 n:i", "SELECT sum(gdd) AS column_sum, count(*) AS n FROM merged")
def _(b):
    return models.permute(b.merged, "gdd", ROW).agg(F.sum("gdd").alias("column_sum"), F.count(F.lit(1)).alias("n"))


@query("m14_weighted_importance_by_crop_correlation", "feature:s importance:d", """WITH p AS (SELECT commodity, count(*) AS n, abs(corr(yield_amount, gdd)) AS a, abs(corr(yield_amount, dry_days)) AS b FROM merged GROUP BY commodity),
  w AS (SELECT sum(a * n) / sum(n) AS a, sum(b * n) / sum(n) AS b FROM p) SELECT 'gdd' AS feature, a / (a + b) AS importance FROM w UNION ALL SELECT 'dry_days', b / (a + b) FROM w""")
def _(b):
    from harvestlens.operators.correlations import corr_rank

    ranks = corr_rank(b.merged, "yield_amount", ["gdd", "dry_days"], ["commodity"], None)
    sizes = b.merged.groupBy("commodity").agg(F.count(F.lit(1)).alias("n_train"))
    return models.weighted_importance(ranks.join(sizes, "commodity").withColumnRenamed("abs_correlation", "importance"))


_Z = """(yield_amount - avg(yield_amount) OVER c) / nullif(stddev_samp(yield_amount) OVER c, 0)"""


@query("q13_anomaly_study", KEY + "split:s yield_zscore:d anomaly_flag_zscore:s known:b flag_holds:b varies:b", f"""SELECT *, CASE WHEN yield_zscore > 2 THEN 'high_z' WHEN yield_zscore < -2 THEN 'low_z' ELSE '' END AS anomaly_flag_zscore
  FROM (SELECT {KEYS}, {_SIDE} AS split, {_Z} AS yield_zscore, true AS known, true AS flag_holds, true AS varies FROM merged WINDOW c AS (PARTITION BY state_fips, county_fips, commodity)) q""")
def _(b):
    rows_ = studies.anomaly_study(b.merged, USED, 5, number=number())["rows"]
    return varies(materialize(rows_), "yield_predicted").select("*", known("yield_predicted"), flag_holds(F.col("yield_residual_z"), F.col("anomaly_flag")))


_GROUP_OF = " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in DRIVER_GROUPS.items())


@query("q13_explainer", "driver_group:s position:i known:b", f"""SELECT driver_group, unnest(range(1, least(n, 3) + 1)) AS position, true AS known FROM (
  SELECT CASE {_GROUP_OF} ELSE 'Other' END AS driver_group, count(*) AS n FROM (VALUES {_values(USED)}) f(feature) GROUP BY 1) q""")
def _(b):
    study = studies.anomaly_study(b.merged, USED, 5, number=number())
    return studies.explainer(study)["drivers"].select("*", known("importance"))


@query("q14_train_and_export", "train_rows:i test_rows:i test_year_min:i test_year_max:i known:b stored:b varies:b models:i",
       f"""SELECT sum(n) FILTER (n >= {models.MIN_ROWS}) AS train_rows, any_value(t) AS test_rows, any_value(a) AS test_year_min, any_value(z) AS test_year_max, true AS known, true AS stored, true AS varies,
  2 * count(*) FILTER (n >= {models.MIN_ROWS}) AS models FROM cells, (SELECT count(*) AS t, min(year) AS a, max(year) AS z FROM merged WHERE year >= {TEST_FROM}) q""")
def _(b):
    import uuid

    mark, place = uuid.uuid4().hex[:12], fresh_folder(b.spark, "models")
    out = studies.train_and_export(b.merged, TEST_FROM, CROPS, REGIONS, min_rows=models.MIN_ROWS, boost=BOOST, predictions_name=f"predictions_{mark}", stats_name=f"stats_{mark}", models_folder=place)
    # the row as written, the written predictions and the manifest of the written models
    rows_ = b.spark.table(f"predictions_{mark}").agg(F.count("pred_yield").alias("n_stored")).select("n_stored").scalar()
    spread = b.spark.table(f"predictions_{mark}").agg((F.max("pred_yield") - F.min("pred_yield") > 1e-6).alias("varies")).scalar()
    parts = b.spark.read.json(f"{place}/manifest").agg(F.count(F.lit(1)).alias("n_parts")).select("n_parts").scalar()
    stats = b.spark.table(f"stats_{mark}").select("*", known("test_rmse"))
    return stats.withColumns({"stored": rows_ == F.col("test_rows"), "varies": spread, "models": parts})


@query("a40_flag_counts_after_study", "variable:s n:i known:b", """SELECT 'yield_residual' AS variable, count(*) AS n, true AS known FROM merged UNION ALL SELECT 'yield_residual_z', count(*), true FROM merged""")
def _(b):
    return reports.residual_diag(models.oof_anomalies(b.merged, USED, 5)).select("*", known("mean"))


# ---- the hashed splits as a user takes them: what must hold whatever the hash

@query("m01_entity_split_by_hash", "one_side:b same_again:b share_near:b n_counties:i", "SELECT true AS one_side, true AS same_again, true AS share_near, count(*) AS n_counties FROM (SELECT DISTINCT state_fips, county_fips FROM merged) q")
def _(b):
    once = splits.entity_split(b.merged)
    again = splits.entity_split(once, name="again")
    sides = again.groupBy("state_fips", "county_fips").agg(F.count_distinct("split").alias("sides"), F.bool_and(F.col("split") == F.col("again")).alias("same"), F.max("split").alias("split"))
    return sides.agg(
        F.bool_and(F.col("sides") == 1).alias("one_side"), F.bool_and("same").alias("same_again"),
        F.avg((F.col("split") == "test").cast("double")).between(0.02, 0.5).alias("share_near"), F.count(F.lit(1)).alias("n_counties"))


@query("m03_group_kfold_by_hash", "one_fold:b in_range:b same_again:b n_counties:i", "SELECT true AS one_fold, true AS in_range, true AS same_again, count(*) AS n_counties FROM (SELECT DISTINCT state_fips, county_fips FROM merged) q")
def _(b):
    again = splits.group_kfold(splits.group_kfold(b.merged), name="again")
    folds = again.groupBy("state_fips", "county_fips").agg(F.count_distinct("fold").alias("folds"), F.bool_and(F.col("fold") == F.col("again")).alias("same"), F.max("fold").alias("fold"))
    return folds.agg(F.bool_and(F.col("folds") == 1).alias("one_fold"), F.bool_and(F.col("fold").between(0, 4)).alias("in_range"), F.bool_and("same").alias("same_again"), F.count(F.lit(1)).alias("n_counties"))


# longest first, each to the fold with the fewest rows so far
@query("m03_balanced_folds", "fold:i n_rows:i n_counties:i one_fold:b within_largest:b", """WITH RECURSIVE sizes AS (
    SELECT n, row_number() OVER (ORDER BY n DESC) AS place FROM (SELECT count(*) AS n FROM merged GROUP BY state_fips, county_fips) g),
  deal AS (SELECT 0::BIGINT AS place, [0::BIGINT, 0, 0, 0, 0] AS loads, [0::BIGINT, 0, 0, 0, 0] AS counts
    UNION ALL SELECT s.place, list_transform(range(5), lambda f: loads[f + 1] + CASE WHEN f + 1 = list_position(loads, list_min(loads)) THEN n ELSE 0 END),
      list_transform(range(5), lambda f: counts[f + 1] + CASE WHEN f + 1 = list_position(loads, list_min(loads)) THEN 1 ELSE 0 END)
    FROM deal d JOIN sizes s ON s.place = d.place + 1)
  SELECT f AS fold, loads[f + 1] AS n_rows, counts[f + 1] AS n_counties, true AS one_fold, true AS within_largest
  FROM (SELECT *, unnest(range(5)) AS f FROM deal WHERE place = (SELECT max(place) FROM sizes)) q""")
def _(b):
    out = materialize(splits.balanced_folds(b.merged))
    counties = out.groupBy("state_fips", "county_fips").agg(F.count_distinct("fold").alias("folds"), F.first("fold").alias("fold"), F.count(F.lit(1)).alias("n"))
    loads = counties.groupBy("fold").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_counties"), F.bool_and(F.col("folds") == 1).alias("one_fold"))
    apart = loads.agg((F.max("n_rows") - F.min("n_rows")).alias("d")).scalar()
    return loads.withColumn("within_largest", apart <= counties.agg(F.max("n").alias("m")).scalar())
