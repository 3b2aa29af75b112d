"""Boosted trees that keep the rounds up to the best one on held-out rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class BoostFit:
    """The model cut to its best round; the loss of every fitted round on the held-out rows; how many rounds were looked at before patience ended."""

    model: PipelineModel
    losses: list[float]
    best: int
    looked_at: int

    def table(self, spark: SparkSession) -> DataFrame:
        """(round, loss, kept) of every fitted round."""
        rows = [(i, loss, i <= self.best) for i, loss in enumerate(self.losses, 1)]
        return spark.createDataFrame(rows, "round int, loss double, kept boolean")


def best_round(losses: Sequence[float], patience: int) -> tuple[int, int]:
    """(best, looked_at), counted from 1: the first round with the least loss before `patience` rounds brought no smaller one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        if i - best >= patience:
            return best + 1, i + 1
    return (best + 1 if losses else 0), len(losses)


def first_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The boosted model of the first `rounds` trees: rounds build on the ones before, so what a shorter run would have fitted."""
    if not 1 <= rounds <= model.getNumTrees:
        raise ValueError(f"{rounds} of {model.getNumTrees} rounds")
    spark = SparkSession.active()
    gateway, given = spark.sparkContext._gateway, model._java_obj
    learned = gateway.jvm.org.apache.spark.ml.regression
    trees, weights = gateway.new_array(learned.DecisionTreeRegressionModel, rounds), gateway.new_array(gateway.jvm.double, rounds)
    all_trees, all_weights = given.trees(), given.treeWeights()
    for i in range(rounds):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    cut = GBTRegressionModel(learned.GBTRegressionModel(given.uid(), trees, weights, given.numFeatures()))
    # a model that is put together anew has none of the names its columns were given
    for p, value in model.extractParamMap().items():
        if model.isSet(p) and cut.hasParam(p.name):
            cut.set(cut.getParam(p.name), value)
    return cut


def kept_to_best(model: PipelineModel, held_out: DataFrame, patience: int) -> BoostFit:
    """Cut the boosted last stage of a fitted pipeline to its best round on `held_out`; without such rows all rounds stay.

    The losses of all rounds come from one pass over the held-out rows."""
    boosted, prepared = model.stages[-1], held_out
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    if not held_out.head(1):
        return BoostFit(model, [], boosted.getNumTrees, boosted.getNumTrees)
    losses = list(boosted.evaluateEachIteration(prepared, boosted.getLossType()))
    best, looked_at = best_round(losses, patience)
    return BoostFit(PipelineModel([*model.stages[:-1], first_rounds(boosted, best)]), losses, best, looked_at)
