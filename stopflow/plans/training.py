"""Disruption models: fit, score, calibrate, compare, ablate.

Every model is an ML pipeline (imputation as SQL, assembler, classifier), so it
is saved and loaded with the pipeline itself.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopflow.operators import calibration, guards
from stopflow.operators import metrics as M
from stopflow.operators.graph import neighbour_means
from stopflow.operators.impute import train_medians
from stopflow.operators.splits import positive_weight
from stopflow.session import fit_rows, written
from stopflow.sources.sinks import save_predictions, scored

log = logging.getLogger("stopflow")

LABEL = "y_stop"
STATION_FEATURES = ["lat", "lon", "degree", "avg_historical_delay", "betweenness_centrality"]
ECE_LIMIT = 0.05
# Rows that a leaf of a boosted tree needs, whatever the size of the input.
MIN_PER_NODE = 20


def _logistic(n_rows: int, settings: dict):
    # The penalty of a summed loss with C = 1, on the scale of a mean loss.
    return LogisticRegression(labelCol=LABEL, weightCol="_weight", maxIter=settings.get("rounds", 100),
                              tol=settings.get("tol", 1e-6), regParam=1.0 / max(1, n_rows), elasticNetParam=0.0)


def _boosted(depth: int, step: float):
    def make(n_rows: int, settings: dict):
        stop = {"validationIndicatorCol": "_is_val"} if settings.get("early_stop", True) else {}
        share = settings.get("share", 0.8)
        return GBTClassifier(
            labelCol=LABEL, weightCol="_weight", maxIter=settings.get("rounds", 100), maxDepth=settings.get("depth", depth), stepSize=step,
            subsamplingRate=share, featureSubsetStrategy=str(share) if share < 1 else "all", minInstancesPerNode=MIN_PER_NODE,
            seed=settings.get("seed", 42), **stop)
    return make


MODELS: dict[str, Callable] = {
    "logreg": _logistic,
    "boost_shallow": _boosted(5, 0.1),
    "boost_deep": _boosted(7, 0.05),
}


@dataclass
class StopModel:
    name: str
    scenario: str
    columns: list[str]
    pipeline: PipelineModel
    threshold: float = 0.5
    settings: dict = field(default_factory=dict)

    def score(self, df: DataFrame, out: str = "p_disrupted") -> DataFrame:
        """Probability and decision next to the input columns."""
        p = vector_to_array("probability")[1]
        return self.pipeline.transform(df).select(*df.columns, p.alias(out)).withColumn(
            "y_pred", (F.col(out) >= self.threshold).cast("int"))

    def save(self, path: str) -> str:
        spark = SparkSession.active()
        self.pipeline.write().save(f"{path}/pipeline")
        meta = json.dumps({"name": self.name, "scenario": self.scenario, "columns": self.columns, "threshold": self.threshold})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
        return path

    @classmethod
    def load(cls, path: str) -> StopModel:
        meta = json.loads(SparkSession.active().read.text(f"{path}/meta").first()["value"])
        return cls(pipeline=PipelineModel.load(f"{path}/pipeline"), **meta)


@dataclass(frozen=True)
class TrainFacts:
    """What fits need to know of the train rows: taken once, it serves every model and
    scenario over the same frame."""

    medians: dict[str, float]
    weight: float
    n_rows: int

    @classmethod
    def of(cls, data: DataFrame, columns: Iterable[str]) -> TrainFacts:
        train, columns = data.where("split = 'train'"), list(dict.fromkeys(columns))
        return cls(train_medians(train, columns).first().asDict(), positive_weight(train, LABEL).first()[0], train.count())


def shared_facts(data: DataFrame, scenarios: Iterable[str]) -> TrainFacts:
    return TrainFacts.of(data, [c for s in scenarios for c in guards.model_columns(data, s)])


def _imputer(medians: dict[str, float], columns: Sequence[str]) -> SQLTransformer:
    """Train medians as literals of a statement."""
    filled = ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), {float(medians[c])!r}D) AS `{c}__in`" for c in columns)
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def fit(name: str, data: DataFrame, scenario: str, columns: Sequence[str] | None = None, facts: TrainFacts | None = None, **settings) -> StopModel:
    """Fit on `split = 'train'`; `split = 'val'` stops boosting early and tunes
    the threshold. Positives weigh max(1, negatives / positives). The rows of the
    fit are written once as vectors, in parts by their number, and go with it. `facts`
    are those of the same frame, if they are known."""
    columns = list(columns or guards.model_columns(data, scenario))
    guards.check_no_leak(columns, scenario)
    facts = facts or TrainFacts.of(data, columns)
    steps = [_imputer(facts.medians, columns),
             VectorAssembler(inputCols=[f"{c}__in" for c in columns], outputCol="features")]
    maker = MODELS[name]
    classifier = maker(facts.n_rows, settings)
    validated = maker is not _logistic and settings.get("early_stop", True)
    rows = data.where("split IN ('train', 'val')" if validated else "split = 'train'").withColumns({
        "_weight": F.when(F.col(LABEL) == 1, facts.weight).otherwise(F.lit(1.0)),
        "_is_val": F.col("split") == "val"})
    for step in steps:
        rows = step.transform(rows)
    with fit_rows(rows.select("features", LABEL, "_weight", "_is_val"), "fit-rows") as vectors:
        fitted = classifier.fit(vectors)
    pipeline = PipelineModel([*steps, fitted])
    model = StopModel(name, scenario, columns, pipeline, settings=settings)
    best = M.tune_threshold(model.score(data.where("split = 'val'")), [], "p_disrupted", LABEL).first()
    model.threshold = float(best["threshold"]) if best else 0.5
    return model


def with_station_context(data: DataFrame, stations: DataFrame, edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """Replace the static station columns by two layers of neighbour means."""
    have = [c for c in STATION_FEATURES if c in stations.columns]
    context = neighbour_means(stations, edges, have)
    added = [c for c in context.columns if c != "station_id"]
    return data.drop(*[c for c in STATION_FEATURES if c in data.columns]).join(context, "station_id", "left").na.fill(0.0, added), added


def fit_graph_model(data: DataFrame, stations: DataFrame, edges: DataFrame, scenario: str, **settings) -> tuple[StopModel, DataFrame]:
    """Boosted trees over neighbour means of the stations and the other columns."""
    return fit_graph_models(data, stations, edges, [scenario], **settings)[0]


def fit_graph_models(data: DataFrame, stations: DataFrame, edges: DataFrame, scenarios: Sequence[str], **settings) -> list[tuple[StopModel, DataFrame]]:
    """The graph models of several scenarios over one frame, written once."""
    joined = written(with_station_context(data, stations, edges)[0], "graph-rows")
    facts = shared_facts(joined, scenarios)
    models = [fit("boost_shallow", joined, s, facts=facts, **settings) for s in scenarios]
    for model in models:
        model.name = "graph"
    return [(m, joined) for m in models]


def run_matrix(data: DataFrame, path: str, names: Sequence[str] = tuple(MODELS), scenarios: Sequence[str] = ("A", "B"), **settings) -> DataFrame:
    """All models in both scenarios over one stored frame: one row per run with its
    `status` ('ok' or the error) and, where it worked, the metrics of the test
    split. Each run replaces its own part of the prediction table."""
    runs = []
    facts = None
    for scenario in scenarios:
        for name in names:
            try:
                facts = facts or shared_facts(data, scenarios)
                model = fit(name, data, scenario, facts=facts, **settings)
                rows = model.score(data.where("split IN ('val', 'test')"))
                save_predictions(scored(rows.drop("y_pred"), "p_disrupted", model.threshold, name, scenario, extra=["split"]), path)
                runs.append((name, scenario, "ok"))
            except Exception as e:  # noqa: BLE001  (one failed run must not end the others)
                log.error("run %s/%s failed: %s", name, scenario, e)
                runs.append((name, scenario, f"{type(e).__name__}: {e}"))
    spark = data.sparkSession
    status = spark.createDataFrame(runs, "model string, scenario string, status string")
    if not any(s == "ok" for _, _, s in runs):
        return status
    preds = spark.read.parquet(path)
    return status.join(M.full_metrics(preds.where("split = 'test'"), ["model", "scenario"]), ["model", "scenario"], "left")


# -- calibration --------------------------------------------------------------------

def calibrate(val: DataFrame, test: DataFrame, score: str = "p_disrupted", label: str = LABEL, limit: float = ECE_LIMIT) -> tuple[DataFrame, dict]:
    """Calibrate when the validation error is above the limit: the score is
    replaced (the raw one kept) and the threshold tuned again."""
    raw = M.ece(val, [], score, label).first()["ece"]
    info = {"ece_val_raw": raw, "applied": False}
    if raw <= limit:
        return test, info
    fitted = calibration.blocks(val, score, label)

    def apply(df: DataFrame) -> DataFrame:
        out = calibration.apply(df, score, fitted, "calibrated")
        return out.withColumns({f"{score}_raw": F.col(score), score: F.col("calibrated")}).drop("calibrated")

    threshold = M.tune_threshold(apply(val), [], score, label).first()["threshold"]
    info.update(applied=True, threshold=threshold)
    return apply(test).withColumn("y_pred", (F.col(score) >= threshold).cast("int")), info


# -- explanation of fitted models -------------------------------------------------------

def exchanged(df: DataFrame, columns: Sequence[str], ids: Sequence[str], seed: int = 7, bucket_rows: int = 10_000) -> DataFrame:
    """Each row as it is (`_moved` is empty) and once per column with this column's
    value from the next row of its hash bucket, the last row's from the first: a
    permutation in even buckets, the same for all columns."""
    n_buckets = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / bucket_rows))).scalar()
    h = F.xxhash64(*[F.col(i) for i in ids], F.lit(seed))
    bucket = Window.partitionBy("_bucket")
    order = bucket.orderBy("_h", *ids)
    values = F.struct(*columns)
    first = F.first(values).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = df.withColumn("_h", h).withColumn("_bucket", F.pmod("_h", n_buckets)).withColumn("_next", F.coalesce(F.lead(values).over(order), first))
    each = near.withColumn("_moved", F.explode(F.array(F.lit(""), *[F.lit(c) for c in columns])))
    return each.withColumns({c: F.when(F.col("_moved") == c, F.col(f"_next.{c}")).otherwise(F.col(c)) for c in columns}).drop("_h", "_bucket", "_next")


def permutation_importance(model: StopModel, df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Loss of PR-AUC when one column is permuted. Every row is scored once with its
    own values and once for each column with that one exchanged, in one pass; the
    curves of all columns come from one aggregate."""
    columns = list(columns or model.columns)
    rows = exchanged(df, columns, ids)
    scored = model.score(rows)
    auc = M.pr_auc(M.score_points(scored, ["_moved"], "p_disrupted", LABEL), ["_moved"])
    base = auc.where("_moved = ''").select("pr_auc").scalar()
    return auc.where("_moved <> ''").select(F.col("_moved").alias("feature"), (base - F.col("pr_auc")).alias("drop"))


def lag_ablation(data: DataFrame, scenario: str, name: str = "boost_shallow", facts: TrainFacts | None = None, **settings) -> DataFrame:
    """PR-AUC with all columns and without history columns."""
    columns = guards.model_columns(data, scenario)
    without = [c for c in columns if not guards.is_history_column(c)]
    test = data.where("split = 'test'")
    parts, facts = None, facts or TrainFacts.of(data, columns)
    for variant, used in (("all", columns), ("without history", without)):
        model = fit(name, data, scenario, used, facts, **settings)
        points = M.score_points(model.score(test), [], "p_disrupted", LABEL)
        one = M.pr_auc(points, []).select(
            F.lit(scenario).alias("scenario"), F.lit(variant).alias("variant"), F.lit(len(used)).alias("n_columns"), "pr_auc")
        parts = one if parts is None else parts.unionByName(one)
    return parts
