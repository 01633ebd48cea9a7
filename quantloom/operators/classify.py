"""Classifiers that Spark fits and scores: a fit is an aggregate over all rows or a pyspark.ml model, a score a projection.

``fit`` returns a model whose ``predict`` adds the column ``prediction`` to any DataFrame with the features. Folds are
taken one after the other, each as jobs over all executors, so no fold has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.scalars import max_features
from .series import checkpointed

#: Classes of a label at most: a model holds a row for each.
MAX_CLASSES = 10_000
#: Rows within which values of a feature are exchanged, on average.
SHUFFLE_ROWS = 100_000


class Model(Protocol):
    def predict(self, df: DataFrame) -> DataFrame: ...


class Classifier(Protocol):
    def fit(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> Model: ...


def classes(df: DataFrame, label: str) -> list:
    """The labels in order, without null."""
    found = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise InvalidParameter(f"{label} has over {MAX_CLASSES} classes")
    return sorted(found)


@dataclass(frozen=True)
class CentroidModel:
    features: tuple[str, ...]
    centroids: tuple[tuple, ...]  # (label, means)

    def predict(self, df: DataFrame) -> DataFrame:
        """The label of the nearest centroid, the lowest of several; null where a feature is null."""
        distance = lambda means: sum((F.pow(F.col(f) - F.lit(m), 2) for f, m in zip(self.features, means, strict=True)), F.lit(0.0))
        near = F.array_min(F.array(*[F.struct(distance(means).alias("d"), F.lit(label).alias("label")) for label, means in self.centroids]))
        return df.withColumn("prediction", F.when(near["d"].isNotNull(), near["label"]))


@dataclass(frozen=True)
class NearestCentroid:
    """The plainest classifier: the (weighted) mean of each class is one aggregate."""

    def fit(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> CentroidModel:
        names, w = classes(df, label), F.col(weight).cast("double") if weight else F.lit(1.0)
        means = df.groupBy(label).agg(*[(F.sum(w * F.col(f)) / F.sum(w)).alias(f"m{i}") for i, f in enumerate(features)])
        found = {r[0]: tuple(r)[1:] for r in means.where(F.col(label).isNotNull()).collect()}  # MAX_CLASSES rows at most
        return CentroidModel(tuple(features), tuple((n, found[n]) for n in names))


@dataclass(frozen=True)
class RandomForestConfig:
    """Trees, features a split looks at (kind and value of ``max_features``), share of rows a tree is grown on, least share of weight in a leaf."""

    n_estimators: int = 1000
    features: tuple[str, float] = ("sqrt", 0)
    max_samples: float = 1.0
    min_weight_fraction_leaf: float = 0.0

    def parameters(self, n_features: int) -> dict:
        """For ``pyspark.ml.classification.RandomForestClassifier``."""
        return {
            "numTrees": self.n_estimators, "featureSubsetStrategy": str(max_features(self.features[0], n_features, self.features[1])), "subsamplingRate": self.max_samples,
            "minWeightFractionPerNode": self.min_weight_fraction_leaf,
        }


def rf_setup_1() -> RandomForestConfig:
    """Many trees on few features each."""
    return RandomForestConfig(1000, ("sqrt", 0))


def rf_setup_2() -> RandomForestConfig:
    """More trees on fewer features, with leaves of 5 % of the weight."""
    return RandomForestConfig(5000, ("log2", 0), 1.0, 0.05)


def rf_setup_3(n_features: int) -> RandomForestConfig:
    """Bagged trees on all features."""
    return RandomForestConfig(1000, ("fixed", n_features))


@dataclass(frozen=True)
class ForestModel:
    model: object
    features: tuple[str, ...]
    labels: tuple

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=list(self.features), outputCol="__features", handleInvalid="keep").transform(df)

    def predict(self, df: DataFrame) -> DataFrame:
        """The label, and ``probability``, an array over the labels in order."""
        from pyspark.ml.functions import vector_to_array

        made = self.model.transform(self._assembled(df))
        label = F.element_at(F.array(*map(F.lit, self.labels)), F.col("__class").cast("int") + 1)
        return made.withColumns({"prediction": label, "probability": vector_to_array("__p")}).drop("__features", "__raw", "__p", "__class")

    def tree_importances(self) -> DataFrame:
        """(tree, feature, importance): each tree's loss of impurity by feature, which add up to 1 in a tree."""
        from pyspark.sql import SparkSession

        rows = [(t, f, float(tree.featureImportances[i])) for t, tree in enumerate(self.model.trees) for i, f in enumerate(self.features)]
        return SparkSession.getActiveSession().createDataFrame(rows, "tree int, feature string, importance double")


@dataclass(frozen=True)
class Forest:
    """A random forest of pyspark.ml. ``order`` names columns that order the rows: with them a seed gives the same trees for the same rows."""

    config: RandomForestConfig = RandomForestConfig()
    seed: int = 0
    max_depth: int = 5
    order: tuple[str, ...] = ()
    partitions: int = 8

    def fit(self, df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> ForestModel:
        from pyspark.ml.classification import RandomForestClassifier

        labels = classes(df, label)
        place = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
        rows = df.where(F.col(label).isNotNull()).withColumn("__y", place.cast("double").alias("__y", metadata={"ml_attr": {"type": "nominal", "num_vals": len(labels)}}))
        if self.order:
            rows = rows.repartition(self.partitions, F.xxhash64(*self.order)).sortWithinPartitions(*self.order)
        model = ForestModel(None, tuple(features), tuple(labels))
        made = RandomForestClassifier(featuresCol="__features", labelCol="__y", predictionCol="__class", probabilityCol="__p", rawPredictionCol="__raw", seed=self.seed, maxDepth=self.max_depth, **self.config.parameters(len(features)))
        made = made.setWeightCol(weight) if weight else made
        return ForestModel(made.fit(model._assembled(rows)), tuple(features), tuple(labels))


def accuracy(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


Scoring = Callable[[Column, Column], Column]


def with_roles(df: DataFrame, folds: DataFrame, idx: str) -> tuple[DataFrame, list]:
    """The rows with the folds that train and test on them (``__train``, ``__test``), checkpointed, and the folds that have both."""
    of = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("fold"))).alias(f"__{role}")
    roles = folds.groupBy(F.col("idx").alias("__idx")).agg(of("train"), of("test"))
    met = checkpointed(df.join(roles, df[idx] == F.col("__idx")).drop("__idx"))
    names = [{r[0] for r in met.select(F.explode(c)).distinct().collect()} for c in ("__train", "__test")]  # one for each fold at most
    return met, sorted(names[0] & names[1])


def fold_scores(met: DataFrame, names: Sequence, features: Sequence[str], label: str, classifier: Classifier, weight: str | None, scoring: Scoring) -> DataFrame:
    made = []
    for fold in names:
        of = lambda role: met.where(F.array_contains(f"__{role}", fold)).drop("__train", "__test")  # noqa: B023, E731
        tested = classifier.fit(of("train"), features, label, weight).predict(of("test"))
        made.append(tested.agg(scoring(F.col(label), F.col("prediction")).alias("score")).select(F.lit(fold).alias("fold"), "score"))
    return reduce(DataFrame.unionByName, made)


def cv_scores(df: DataFrame, features: Sequence[str], label: str, folds: DataFrame, idx: str, classifier: Classifier, weight: str | None = None, scoring: Scoring = accuracy) -> DataFrame:
    """(fold, score): the classifier fitted on each fold's training rows and scored on its test rows.

    folds: fold, idx and role (train or test), as ``PurgedKFold.split`` gives; folds without one of them are left out. Rows
    meet their folds once; all fits and scores read what that made.
    """
    met, names = with_roles(df, folds, idx)
    return fold_scores(met, names, features, label, classifier, weight, scoring) if names else folds.where("false").select("fold", F.lit(0.0).alias("score"))


def single_feature_importance(df: DataFrame, features: Sequence[str], label: str, folds: DataFrame, idx: str, classifier: Classifier, scoring: Scoring = accuracy) -> DataFrame:
    """(feature, score): the mean score over the folds of the classifier on each feature alone; 0 without folds."""
    met, names = with_roles(df, folds, idx)
    scores = lambda f: fold_scores(met, names, [f], label, classifier, None, scoring) if names else df.sparkSession.createDataFrame([], "score double")
    made = [scores(f).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score")).select(F.lit(f).alias("feature"), "score") for f in features]
    return reduce(DataFrame.unionByName, made)


def exchanged(df: DataFrame, features: Sequence[str], idx: str, seed: int) -> DataFrame:
    """Each row once for every feature, which ``__feature`` numbers, with the value of another row in it.

    A row's donor is found by its place in an order by hash, so the same seed and rows give the same exchange. Rows are
    dealt by hash to groups of about SHUFFLE_ROWS, within which values are exchanged.
    """
    groups = -(-df.count() // SHUFFLE_ROWS) or 1
    of = lambda k: F.md5(F.concat_ws(":", F.lit(seed), k, F.col(idx).cast("string")))
    group = F.pmod(F.xxhash64(idx), F.lit(groups))
    each = df.withColumns({"__group": group, "__x": F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("x")) for i, f in enumerate(features)]))}) if features else df
    each = each.withColumns({"__feature": F.col("__x.i"), "__x": F.col("__x.x")})
    place = lambda *by: F.row_number().over(Window.partitionBy("__feature", "__group").orderBy(*by))
    each = each.withColumns({"__own": place(idx), "__given": place(of(F.col("__feature").cast("string")), idx)})
    donors = each.select("__feature", "__group", F.col("__given").alias("__own"), F.col("__x").alias("__other"))
    met = each.join(donors, ["__feature", "__group", "__own"])
    return met.withColumns({f: F.when(F.col("__feature") == i, F.col("__other")).otherwise(F.col(f)) for i, f in enumerate(features)}).drop("__group", "__x", "__own", "__given", "__other")


def mean_decrease_accuracy(df: DataFrame, features: Sequence[str], label: str, idx: str, model: Model, seed: int = 0, scoring: Scoring = accuracy) -> DataFrame:
    """(feature, importance): by how much a fitted model's score falls when the values of one feature are exchanged between rows."""
    score = scoring(F.col(label), F.col("prediction"))
    base = model.predict(df).agg(score).first()[0]
    without = model.predict(exchanged(df, features, idx, seed)).groupBy("__feature").agg(score.alias("score"))
    name = F.element_at(F.array(*map(F.lit, features)), F.col("__feature") + 1)
    return without.select(name.alias("feature"), (F.lit(base) - F.col("score")).alias("importance"))
