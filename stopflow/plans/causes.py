"""Cause of disruption: labels, models with stacking, transfer to other countries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.operators import metrics as M
from stopflow.operators.explain import winner
from stopflow.operators.profiling import mode_per_key
from stopflow.operators.splits import class_weights, label_index, scale, scaler_statistics
from stopflow.session import dealt, written


def label_causes(stops: DataFrame, faults: DataFrame, country: str | None = "NL") -> DataFrame:
    """Disrupted stops with the most frequent cause group of their station and day."""
    groups = faults.withColumn("cause_group", C.cause_group("description")).where("cause_group <> ''")
    causes = mode_per_key(groups, ["station_id", "date"], "cause_group")
    disrupted = stops.where("y_stop = 1")
    if country is not None:
        disrupted = disrupted.where(C.country_of("station_id") == country)
    return disrupted.join(causes, ["station_id", "date"])


def label_coverage(stops: DataFrame, faults: DataFrame) -> DataFrame:
    """Share of disrupted stops that found a cause."""
    groups = faults.withColumn("cause_group", C.cause_group("description")).where("cause_group <> ''")
    causes = mode_per_key(groups, ["station_id", "date"], "cause_group")
    joined = stops.where("y_stop = 1").join(causes, ["station_id", "date"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_disrupted"), F.count("cause_group").alias("n_labelled"),
                      F.avg(F.col("cause_group").isNotNull().cast("int")).alias("coverage"))


def transfer_summary(scored: DataFrame, group: str = "country", pred: str = "pred_cause_group", p: str = "pred_max_proba") -> DataFrame:
    """Predicted causes per country: rows, share, mean confidence."""
    per = scored.groupBy(group, pred).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_confidence"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def overall_confidence(scored: DataFrame, group: str = "country", p: str = "pred_max_proba") -> DataFrame:
    return scored.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("overall_mean_confidence"))


@dataclass
class CauseModels:
    """Fitted models by name with what scoring needs."""

    columns: list[str]
    classes: list[str]
    models: dict[str, Transformer]
    statistics: DataFrame

    def prepare(self, df: DataFrame) -> DataFrame:
        clean = df.withColumns({c: C.finite_or_zero(F.col(c).cast("double")) for c in self.columns})
        scaled = scale(clean, self.statistics, self.columns)
        out = VectorAssembler(inputCols=self.columns, outputCol="features").transform(scaled)
        return VectorAssembler(inputCols=[f"{c}_scaled" for c in self.columns], outputCol="features_scaled").transform(out)

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Rows with the predicted group and its probability."""
        return self._judged(self.prepare(df), name)

    def _judged(self, prepared: DataFrame, name: str) -> DataFrame:
        raw = self.models[name].transform(prepared)
        names = F.array(*[F.lit(c) for c in self.classes])
        out = raw.withColumn("pred_cause_group", F.get(names, F.col("prediction").cast("int")))
        if "probability" in raw.columns:
            out = out.withColumn("pred_max_proba", F.array_max(vector_to_array("probability")))
        else:
            margins = vector_to_array("rawPrediction")
            total = F.aggregate(F.transform(margins, lambda x: F.exp(x)), F.lit(0.0), lambda a, x: a + x)
            out = out.withColumn("pred_max_proba", F.exp(F.array_max(margins)) / total)
        drop = ["features", "features_scaled", "rawPrediction", "probability", "prediction"]
        return out.drop(*drop, *[f"{c}_scaled" for c in self.columns])


def fit_models(labelled: DataFrame, columns: Sequence[str], rounds: int = 20, trees: int = 20, depth: int = 5,
               seed: int = 42, names: Sequence[str] = ("logreg", "gbt", "gbt_deep", "rf", "mlp")) -> CauseModels:
    """The first generation: logistic, two kinds of boosted trees (one class against
    the rest; shallow with a large step, deep with a small one), random forest,
    perceptron. Class weights balance all but the last, which takes none. The
    training rows are written once as vectors and dealt into parts by their number."""
    train = labelled.where("split = 'train'")
    index = label_index(train, "cause_group", "y_cause")
    classes = [r["cause_group"] for r in index.orderBy("y_cause").collect()]  # a handful of classes
    stats = scaler_statistics(train.select(*[C.finite_or_zero(F.col(c).cast("double")).alias(c) for c in columns]), columns, floor=1e-6)
    out = CauseModels(list(columns), classes, {}, written(stats, "scaler"))
    weights = class_weights(train, "cause_group").select("cause_group", "weight")
    # both tables have a row per class; a shuffle by class would gather whole classes
    rows = out.prepare(train.join(F.broadcast(index), "cause_group").join(F.broadcast(weights), "cause_group").withColumn("y_cause", F.col("y_cause").cast("double")))
    rows = dealt(rows.select("features", "features_scaled", "y_cause", "weight"), "cause-rows")
    common = {"labelCol": "y_cause", "featuresCol": "features"}
    makers = {
        "logreg": lambda: LogisticRegression(labelCol="y_cause", featuresCol="features_scaled", weightCol="weight", maxIter=rounds * 5, family="multinomial"),
        "gbt": lambda: OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed), weightCol="weight", parallelism=8, **common),
        "gbt_deep": lambda: OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth + 2, stepSize=0.05, subsamplingRate=0.8, seed=seed + 1), weightCol="weight", parallelism=8, **common),
        "rf": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth * 2, minInstancesPerNode=10, weightCol="weight", seed=seed, **common),
        "mlp": lambda: MultilayerPerceptronClassifier(labelCol="y_cause", featuresCol="features_scaled", layers=[len(columns), 128, 64, len(classes)], maxIter=rounds, blockSize=256, seed=seed),
    }
    for name in names:
        fitted = makers[name]().fit(rows)
        out.models[name] = _OneAgainstRest(fitted.models) if isinstance(fitted, OneVsRestModel) else fitted
    rows.unpersist()
    return out


class _OneAgainstRest(Transformer):
    """The binary models of a one-against-rest fit: `rawPrediction` holds the margin of
    each, `prediction` is the first largest. PySpark's own transformer passes every
    row through a Python function per class; this one is a projection."""

    def __init__(self, models: Sequence[Model], out: str = "prediction"):
        super().__init__()
        self.models, self.out = list(models), out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own, raw = dataset.columns, [f"_margin_{i}" for i in range(len(self.models))]
        for m, c in zip(self.models, raw):
            dataset = m.copy({m.rawPredictionCol: c, m.probabilityCol: "", m.predictionCol: ""}).transform(dataset)
        margins = F.array(*[vector_to_array(c)[1] for c in raw])
        dataset = dataset.select(*[F.col(f"`{c}`") for c in own], margins.alias("_margins"))
        first = F.array_position("_margins", F.array_max("_margins")) - 1
        return dataset.withColumns({"rawPrediction": array_to_vector("_margins"), self.out: first.cast("double")}).drop("_margins")


class _Softmax(Transformer):
    """Turns the margins of one-against-rest models into probabilities."""

    def __init__(self, out: str):
        super().__init__()
        self.out = out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        powers = F.transform(vector_to_array("rawPrediction"), F.exp)
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        return dataset.withColumn(self.out, array_to_vector(F.transform(powers, lambda x: x / total))).drop("rawPrediction")


def fit_stack(models: CauseModels, labelled: DataFrame, bases: Sequence[str] | None = None, rounds: int = 50) -> PipelineModel:
    """Second generation: a meta-learner over the base models' probability
    vectors on the validation rows, as one chain of transformers. All fitted
    models are bases unless some are named."""
    bases = list(bases or models.models)
    index = F.array(*[F.lit(c) for c in models.classes])
    rows = models.prepare(labelled.where("split = 'val'")).withColumn(
        "y_cause", (F.array_position(index, F.col("cause_group")) - 1).cast("double")).where("y_cause >= 0")
    rows = rows.select("features", "features_scaled", "y_cause")
    stages: list[Transformer] = []
    for name in bases:
        base = models.models[name]
        if isinstance(base, _OneAgainstRest):
            stages += [_OneAgainstRest(base.models, f"pred_{name}"), _Softmax(f"prob_{name}")]
        else:
            stages.append(base.copy()._set(probabilityCol=f"prob_{name}", rawPredictionCol=f"raw_{name}", predictionCol=f"pred_{name}"))
    stages.append(VectorAssembler(inputCols=[f"prob_{n}" for n in bases], outputCol="stacked"))
    chained = rows
    for s in stages:
        chained = s.transform(chained)
    # the meta-learner's jobs read the stacked rows, not the models that made them
    stacked = dealt(chained.select("stacked", "y_cause"), "stacked")
    meta = LogisticRegression(labelCol="y_cause", featuresCol="stacked", maxIter=rounds, family="multinomial").fit(stacked)
    stacked.unpersist()
    return PipelineModel([*stages, meta])


def score_stack(models: CauseModels, stack: PipelineModel, df: DataFrame) -> DataFrame:
    return _judged_by_stack(models, stack, models.prepare(df))


def _judged_by_stack(models: CauseModels, stack: PipelineModel, prepared: DataFrame) -> DataFrame:
    raw = stack.transform(prepared)
    names = F.array(*[F.lit(c) for c in models.classes])
    return raw.withColumns({"pred_cause_group": F.get(names, F.col("prediction").cast("int")),
                            "pred_max_proba": F.array_max(vector_to_array("probability"))})


def benchmark(models: CauseModels, labelled: DataFrame, stack: PipelineModel | None = None) -> DataFrame:
    """Accuracy and macro F1 of every model on validation and test rows, which are
    prepared and written once for all models."""
    parts = None
    rows = models.prepare(labelled.where("split IN ('val', 'test')"))
    rows = written(rows.select("split", "cause_group", "features", "features_scaled"), "judged")
    scored = {n: models._judged(rows, n) for n in models.models}
    if stack is not None:
        scored["stack"] = _judged_by_stack(models, stack, rows)
    for name, df in scored.items():
        one = M.multiclass_summary(df, ["split"], "cause_group", "pred_cause_group").withColumn("model", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts.select("model", "split", "accuracy", "macro_f1")


def pick_for_transfer(table: DataFrame) -> str:
    """Best validation macro F1; the perceptron never transfers. Without labelled
    validation rows the first model by name."""
    found = winner(table.where("split = 'val'"), [], "macro_f1", exclude=["mlp"]).first()
    if found is not None and found["model"] is not None:
        return found["model"]
    return table.where("model <> 'mlp'").agg(F.min("model")).first()[0]
