"""Sensor modality by random forests, and anomaly scores by PCA reconstruction, over feature tables (Spark ML)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vibrata.functions.draws import uniform
from vibrata.operators.extract import Families, FeatureExtractor
from vibrata.operators.faults import FAULT_TYPES, injected
from vibrata.operators.joins import looked_up
from vibrata.operators.signals import with_length

LEAST = 200  # samples of a signal whose modality can be told


def filled(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing features (null, NaN) as 0, which is what the models are trained on."""
    return features.select(*(c for c in features.columns if c not in names), *(F.coalesce(F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")), F.lit(0.0)).alias(n) for n in names))


def label_codes(labelled: DataFrame, label: str) -> DataFrame:
    """(label, code): the labels that occur, numbered from 0 in the order of their text; null is no label.

    Labels are few, so one task ranks them.
    """
    known = labelled.select(label).where(F.col(label).isNotNull()).distinct()
    return known.withColumn("code", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(label).cast("string"))) - 1).cast("int"))


def encoded(table: DataFrame, codes: DataFrame, label: str, unseen: int = -1) -> DataFrame:
    """``table`` with ``code``; ``unseen`` for labels without one and for null."""
    return looked_up(table, codes, [label], "left").withColumn("code", F.coalesce("code", F.lit(unseen)))


def decoded(table: DataFrame, codes: DataFrame, label: str) -> DataFrame:
    """``table`` with the label of its ``code``; null for numbers that are no code."""
    return looked_up(table, codes.select("code", label), ["code"], "left")


def forest(names: Sequence[str], label: str, trees: int = 100, depth: int = 10, scale: bool = True, seed: int = 42) -> Pipeline:
    """Assembling, scaling, indexing of the label, the forest, and the label back as ``predicted``."""
    indexer = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="keep")
    stages = [VectorAssembler(inputCols=list(names), outputCol="__raw"), indexer]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True))
    stages.append(RandomForestClassifier(featuresCol="__features" if scale else "__raw", labelCol="__label", numTrees=trees, maxDepth=depth, seed=seed))
    return Pipeline(stages=stages)


def fit_modality(features: DataFrame, names: Sequence[str], label: str, **options) -> PipelineModel:
    return forest(names, label, **options).fit(filled(features, names))


def classes(model: PipelineModel) -> list[str]:
    return list(next(s for s in model.stages if hasattr(s, "labels")).labels)


def window_predictions(model: PipelineModel, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """``features`` with ``predicted`` and ``probabilities`` (class -> number)."""
    known = classes(model)
    source = filled(features, names)
    label = next(s for s in model.stages if hasattr(s, "labels")).getInputCol()
    scored = PipelineModel([s for s in model.stages if not hasattr(s, "labels")]).transform(source)
    told = IndexToString(inputCol="prediction", outputCol="predicted", labels=known).transform(scored)
    p = vector_to_array("probability")
    return told.withColumn("probabilities", F.map_from_arrays(F.array(*(F.lit(c) for c in known)), F.slice(p, 1, len(known)))).select(*features.columns, "predicted", "probabilities") if label else told


def signal_predictions(windows: DataFrame, keys: Sequence[str], order: str = "window_start_sample") -> DataFrame:
    """(keys, modality, confidence, probabilities, n_windows): a vote of a signal's windows.

    Of equal votes the class that was seen first wins; confidence is its share, probabilities are means over windows.
    """
    votes = windows.groupBy(*keys, "predicted").agg(F.count(F.lit(1)).alias("v"), F.min(order).alias("first"))
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(whole.orderBy(F.desc("v"), "first"))
    won = votes.withColumn("place", place).withColumn("n_windows", F.sum("v").over(whole)).where("place = 1")
    means = windows.select(*keys, F.explode("probabilities").alias("c", "p")).groupBy(*keys, "c").agg(F.avg("p").alias("p"))
    maps = means.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c", "p")))).alias("probabilities"))
    return won.select(*keys, F.col("predicted").alias("modality"), (F.col("v") / F.col("n_windows")).alias("confidence"), "n_windows").join(maps, list(keys))


@dataclass(frozen=True)
class ModalityPredictor:
    """A fitted pipeline (scaling, forest, labels) with the features it reads; it can be saved and loaded."""

    model: PipelineModel
    names: tuple[str, ...]
    families: Families = Families()

    def save(self, path: str) -> None:
        """The pipeline as Spark ML writes it, with the feature names in the assembler; an older model there is replaced."""
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, families: Families = Families()) -> ModalityPredictor:
        model = PipelineModel.load(path)
        return cls(model, tuple(model.stages[0].getInputCols()), families)

    def predict(self, samples: DataFrame, keys: Sequence[str], fs: float = 100.0, window_sec: float = 2.0, step_sec: float = 1.0) -> DataFrame:
        """(keys, modality, confidence, probabilities, n_windows, error) for every signal of long samples.

        A signal of fewer than LEAST samples, or without a whole window, has no modality, and ``error`` says so. The
        empty table gives an empty result.
        """
        lengths = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        long_enough = with_length(samples, keys).where(F.col("__n") >= LEAST).drop("__n")
        features = FeatureExtractor(fs, self.families).process(long_enough, keys, window_sec, step_sec)
        told = signal_predictions(window_predictions(self.model, features, self.names), keys)
        error = F.when(F.col("__n") < LEAST, F.lit(f"under {LEAST} samples")).when(F.col("modality").isNull(), F.lit("no whole window"))
        return lengths.join(told, list(keys), "left").withColumn("error", error).drop("__n")


# Shares of the subjects that are trained on and validated on; the rest are for tests.
SPLITS = (0.7, 0.15)


def subject_splits(windows: DataFrame, subject: str) -> DataFrame:
    """``windows`` with ``split`` (train, val, test): whole subjects in their order, 70, 15 and 15 per cent of them.

    Subjects are few, so one task ranks them.
    """
    subjects = windows.select(subject).where(F.col(subject).isNotNull()).distinct()
    every = Window.partitionBy(F.lit(0))
    place = subjects.withColumn("__k", F.row_number().over(every.orderBy(subject)) - 1).withColumn("__n", F.count(F.lit(1)).over(every))
    cut = lambda share: F.floor(F.lit(share) * F.col("__n") + 1e-9)
    split = F.when(F.col("__k") < cut(SPLITS[0]), "train").when(F.col("__k") < cut(sum(SPLITS)), "val").otherwise("test")
    return looked_up(windows, place.select(subject, split.alias("split")), [subject])


def degraded_share(windows: DataFrame, keys: Sequence[str], share: float = 0.5, severities: tuple[float, float] = (0.8, 2.0), grid: int = 13, seed: int = 42, w: str = "value") -> DataFrame:
    """``windows`` with ``label``: 1 for about ``share`` of them, drawn by hashes of ``keys``, which get a random fault.

    A drawn window's fault type and severity (one of ``grid`` between the two ends) are hashes too. A window is an array,
    so it is laid out as a short signal of its own, hurt and put together again.
    """
    own = [F.col(k) for k in keys]
    drawn = windows.withColumn("label", (uniform(seed, own, "degraded") < share).cast("int"))
    kinds = F.array(*(F.lit(f) for f in FAULT_TYPES))
    fault = F.get(kinds, F.floor(uniform(seed, own, "type") * len(FAULT_TYPES)).cast("int"))
    low, high = severities
    severity = low + (high - low) * F.floor(uniform(seed, own, "severity") * grid) / (grid - 1)
    bad = drawn.where("label = 1").select(*keys, fault.alias("__kind"), severity.alias("__severity"), F.posexplode(w).alias("idx", "value"))
    hurt = injected(bad, keys, F.col("__kind"), F.col("__severity"), seed, older=True)
    again = hurt.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda r: r["value"]).alias("__hurt"))
    joined = drawn.join(again, list(keys), "left")
    return joined.select(*(F.when(F.col("label") == 1, F.col("__hurt")).otherwise(F.col(w)).alias(w) if c == w else F.col(c) for c in windows.columns), "label")


def scaled_windows(windows: DataFrame, reference: DataFrame, w: str = "value") -> DataFrame:
    """Windows as deviations from the mean of all samples of ``reference``'s windows; a deviation of 0 counts as 1."""
    stats = reference.select(F.explode(w).alias("x")).agg(F.avg("x").alias("__m"), F.stddev_pop("x").alias("__s"))
    scale = F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return looked_up(windows, stats, []).withColumn(w, F.transform(w, lambda x: (x - F.col("__m")) / scale)).drop("__m", "__s")


def cross_validated(features: DataFrame, names: Sequence[str], label: str, folds: int = 5, seed: int = 42, **options) -> float:
    """Mean accuracy over folds."""
    evaluator = MulticlassClassificationEvaluator(labelCol="__label", metricName="accuracy")
    search = CrossValidator(estimator=forest(names, label, seed=seed, **options), estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator, numFolds=folds, seed=seed)
    return search.fit(filled(features, names)).avgMetrics[0]


def importances(model: PipelineModel, names: Sequence[str], top: int = 15) -> list[tuple[str, float]]:
    weights = next(s for s in model.stages if hasattr(s, "featureImportances")).featureImportances.toArray()
    return sorted(((n, float(w)) for n, w in zip(names, weights, strict=True)), key=lambda x: (-x[1], x[0]))[:top]


def fit_pca(features: DataFrame, names: Sequence[str], k: int = 2) -> PipelineModel:
    stages = [VectorAssembler(inputCols=list(names), outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True), PCA(k=k, inputCol="__features", outputCol="pca")]
    return Pipeline(stages=stages).fit(filled(features, names))


def explained_variance(model: PipelineModel) -> list[float]:
    return [float(x) for x in model.stages[-1].explainedVariance]


def projected(model: PipelineModel, features: DataFrame, names: Sequence[str]) -> DataFrame:
    """``features`` with ``pca``, an array of the components."""
    return model.transform(filled(features, names)).withColumn("pca", vector_to_array("pca")).select(*features.columns, "pca")


def fit_window_pca(windows: DataFrame, w: str = "value", k: int = 8) -> PipelineModel:
    """Components of healthy windows themselves; what they can't rebuild is the anomaly score."""
    stages = [StandardScaler(inputCol="__w", outputCol="__features", withMean=True, withStd=True), PCA(k=k, inputCol="__features", outputCol="pca")]
    return Pipeline(stages=stages).fit(windows.where(F.col(w).isNotNull()).select(array_to_vector(w).alias("__w")))


def reconstruction_error(model: PipelineModel, windows: DataFrame, w: str = "value", error: str = "error") -> DataFrame:
    """``windows`` with the mean squared error of rebuilding the scaled window from its components.

    Components are orthonormal, so the error is what the projection leaves of the squared length.
    """
    scored = model.transform(windows.where(F.col(w).isNotNull()).withColumn("__w", array_to_vector(w)))
    squares = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, x: s + x * x)
    return scored.withColumn(error, F.greatest(squares("__features") - squares("pca"), F.lit(0.0)) / F.size(w)).select(*windows.columns, error)
