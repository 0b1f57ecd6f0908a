"""Phases after ingestion: feature store, evaluation report, explanation report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.functions import columns as C
from stopflow.functions import constants as K
from stopflow.operators import explain as X
from stopflow.operators import features, guards, graph, relate
from stopflow.operators import metrics as M
from stopflow.operators import splits as S
from stopflow.session import checkpointed
from stopflow.sources import sinks

HELPER_COLUMNS = {"seq": "_meta_seq"}


@dataclass(frozen=True)
class FeatureStore:
    """A written store: the rows with raw columns, the model columns per
    scenario, the train-only scaler row and the station index."""

    path: str
    rows: DataFrame
    columns: dict[str, list[str]]
    scaler: DataFrame
    stations: DataFrame
    edges: DataFrame

    def scaled(self, scenario: str = "B") -> DataFrame:
        return S.scale(self.rows, self.scaler, self.columns[scenario])


def build(tables: dict[str, DataFrame], path: str, splits: dict = K.SPLITS) -> FeatureStore:
    """Join, features, split, checks, scaler fitted on train rows; written to `path`."""
    spark = tables["edges_stops_at"].sparkSession
    stops = relate.stop_grain(tables["edges_stops_at"], tables["nodes_service"])
    between = graph.betweenness(tables["edges_adjacent"], tables["nodes_station"])
    assembled = features.assemble(stops, tables["nodes_service"], tables["nodes_station"], tables["edges_adjacent"],
                                  tables["nodes_fault"], between)
    sinks.save_features(S.with_split(assembled, splits=splits).withColumnsRenamed(HELPER_COLUMNS), f"{path}/stops")
    rows = spark.read.parquet(f"{path}/stops")
    guards.check_disjoint(rows)
    columns = {s: guards.model_columns(rows, s) for s in ("A", "B")}
    extra = set(columns["A"]) - set(columns["B"])
    if extra:
        raise AssertionError(f"columns only in scenario A: {sorted(extra)}")
    S.scaler_statistics(rows.where("split = 'train'"), columns["B"]).write.parquet(f"{path}/scaler")
    index = S.dense_index(tables["nodes_station"], "station_id", "idx")
    index.write.parquet(f"{path}/station_index")
    graph.edge_index(tables["edges_adjacent"], index).write.parquet(f"{path}/edge_index")
    sinks.save_json(sinks.manifest(rows), f"{path}/manifest")
    return FeatureStore(path, rows, columns, spark.read.parquet(f"{path}/scaler"),
                        spark.read.parquet(f"{path}/station_index"), spark.read.parquet(f"{path}/edge_index"))


RUN = ["model", "scenario"]


def evaluation_report(preds: DataFrame) -> DataFrame:
    """One nested row per run: metrics, precision at recall, and PR-AUC and F1
    by country, train class and position.

    Every part is a handful of rows; each is computed once and written before
    the parts are joined, which keeps the final plan small.
    """
    out = M.full_metrics(preds, RUN)
    names = [c for c in out.columns if c not in (*RUN, "n")]
    out = checkpointed(out.select(*RUN, F.col("n").alias("n_test"), F.struct(*names).alias("test")))
    at_recall = checkpointed(M.precision_at_recall(M.score_points(preds, RUN, "p_disrupted", "y_stop"), RUN))
    out = out.join(at_recall.select(*RUN, F.struct(*[c for c in at_recall.columns if c not in RUN]).alias("p_at_r")), RUN, "left")
    placed = preds.withColumn("position", C.position_bucket("position_norm"))
    for name in ("country", "train_class_code", "position"):
        # One entry per country, class or bucket: small by definition.
        per = M.metrics_by_group(placed, [*RUN, name])
        entry = F.struct(F.col(name).cast("string").alias("group"), "n", "pr_auc", "f1")
        nested = checkpointed(per.groupBy(*RUN).agg(F.sort_array(F.collect_list(entry)).alias(f"by_{name}")))
        out = out.join(nested, RUN, "left")
    return out


def explanation_report(rows: DataFrame, weights: dict[str, float], ids: list[str], keep: list[str]) -> dict[str, DataFrame]:
    """Attribution tables of a linear score: global, per group, dependence."""
    attributions = X.linear_attributions(rows, ids, weights, keep)
    out = {"global": X.top_features(attributions), "dependence": X.dependence(attributions)}
    for group in keep:
        out[f"by_{group}"] = X.top_per_group(attributions, group)
    return out
