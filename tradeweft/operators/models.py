"""Sell models per liquidity bucket, with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.operators.backtest import sell_signals
from tradeweft.operators.labels import drawdown_labels
from tradeweft.operators.metrics import METADATA, binary_metrics, feature_columns, feature_matrix, regression_metrics
from tradeweft.session import written_table

MIN_UPSIDE_ROWS = 1000
MIN_DRAWDOWN_ROWS = 500
#: Bounds of the boosting rounds. With held-out rows, boosting ends with the first round that improves their
#: loss by less than this share.
UPSIDE_ROUNDS, DRAWDOWN_ROUNDS, LEAST_GAIN = 1000, 500, 0.002


def _with_held(train: DataFrame, held: DataFrame | None) -> DataFrame:
    """Training rows and held-out rows in one frame, told apart by ``_held``."""
    rows = train.withColumn("_held", F.lit(False))
    return rows if held is None else rows.unionByName(held.select(*train.columns).withColumn("_held", F.lit(True)))


def _stops(booster, held: DataFrame | None):
    """The booster, stopping early where there are held-out rows."""
    return booster if held is None else booster.setValidationIndicatorCol("_held")


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


@dataclass
class SellModels:
    """Fitted models by bucket and the figures of their training."""

    features: list[str]
    upside: dict[str, PipelineModel] = field(default_factory=dict)
    drawdown: dict[str, PipelineModel] = field(default_factory=dict)
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with ``upside_pred`` (mean of both regressors) and ``drawdown_prob`` (0
        without a model). Rows of buckets without an upside model are left out."""
        parts = []
        for bucket, model in self.upside.items():
            rows = model.transform(feature_matrix(df.filter(F.col("bucket") == bucket)))
            rows = rows.withColumn("upside_pred", (F.col("_deep") + F.col("_shallow")) / 2)
            risk = self.drawdown.get(bucket)
            if risk is None:
                rows = rows.withColumn("drawdown_prob", F.lit(0.0))
            else:
                rows = risk.stages[-1].transform(rows).withColumn(
                    "drawdown_prob", vector_to_array("_proba")[1])
            parts.append(rows.select(*df.columns, "upside_pred", "drawdown_prob"))
        none = F.lit(None).cast("double")
        out = df.filter("false").withColumns({"upside_pred": none, "drawdown_prob": none})
        for p in parts:
            out = out.unionByName(p)
        return out

    def should_sell(self, df: DataFrame) -> DataFrame:
        return sell_signals(self.predict(df))

    def importance(self, bucket: str) -> list[tuple[str, float]]:
        """Feature importance of the deep upside model, largest first."""
        weights = self.upside[bucket].stages[1].featureImportances.toArray()
        return sorted(zip(self.features, map(float, weights)), key=lambda x: -x[1])

    def save(self, path: str) -> None:
        for kind, models in (("upside", self.upside), ("drawdown", self.drawdown)):
            for bucket, model in models.items():
                model.write().overwrite().save(f"{path}/{kind}/{bucket}")

    @classmethod
    def load(cls, path: str, buckets: dict[str, list[str]]) -> "SellModels":
        """``buckets``: kind -> bucket names that were saved."""
        out = cls([])
        for kind in ("upside", "drawdown"):
            for bucket in buckets.get(kind, []):
                getattr(out, kind)[bucket] = PipelineModel.load(f"{path}/{kind}/{bucket}")
        for model in out.upside.values():
            out.features = model.stages[0].getInputCols()
        return out


def fit_upside(train: DataFrame, validation: DataFrame | None = None, rounds: int = UPSIDE_ROUNDS,
               min_rows: int = MIN_UPSIDE_ROWS, models: SellModels | None = None) -> SellModels:
    """Two boosted regressors per bucket of enough rows; their mean is the prediction.

    ``rounds`` bounds the trees of a regressor. Rows of ``validation`` are never learned from: they end the
    boosting early and give the metrics. A bucket without such rows is boosted for all rounds.
    """
    out = models or SellModels(feature_columns(train))
    # Boosting makes many passes over its input.
    train = written_table(train, "train")
    validation = None if validation is None else written_table(validation, "validation")
    held_buckets = set() if validation is None else {r["bucket"] for r in validation.select("bucket").distinct().collect()}
    counts = {r["bucket"]: r["count"] for r in train.groupBy("bucket").count().collect()}
    for bucket in K.HORIZON_HOURS:
        if counts.get(bucket, 0) < min_rows:
            continue
        own = F.col("bucket") == bucket
        held = validation.filter(own) if bucket in held_buckets else None
        rows = feature_matrix(_with_held(train.filter(own), held), [*METADATA, "_held"]).fillna(0, ["upside_left"])
        stages = [_assembler(out.features),
                  _stops(GBTRegressor(labelCol="upside_left", predictionCol="_deep", maxDepth=5, maxIter=rounds,
                               stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="onethird", seed=7,
                               validationTol=LEAST_GAIN), held),
                  _stops(GBTRegressor(labelCol="upside_left", predictionCol="_shallow", maxDepth=3, maxIter=rounds,
                               stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=10, seed=11, validationTol=LEAST_GAIN), held)]
        out.upside[bucket] = Pipeline(stages=stages).fit(rows)
        if held is not None:
            scored = out.upside[bucket].transform(feature_matrix(held))
            m = regression_metrics(scored.select(F.col("upside_left").alias("label"),
                                               ((F.col("_deep") + F.col("_shallow")) / 2).alias("prediction"))).first()
            out.metrics.setdefault(bucket, {}).update(rmse=m["rmse"], mae=m["mae"])
    return out


def fit_drawdown(train: DataFrame, rounds: int = DRAWDOWN_ROUNDS, min_rows: int = MIN_DRAWDOWN_ROWS,
                 models: SellModels | None = None, validation: DataFrame | None = None) -> SellModels:
    """A boosted classifier per bucket of enough rows and balance, with class weights; rows of ``validation``
    end the boosting early. Accuracy and area under the curve are those of the training rows."""
    def labels(df: DataFrame) -> DataFrame:
        return df if "drawdown_label" in df.columns else drawdown_labels(df)

    labelled = written_table(labels(train), "labelled")
    validation = None if validation is None else written_table(labels(validation), "validation")
    held_buckets = set() if validation is None else {r["bucket"] for r in validation.select("bucket").distinct().collect()}
    out = models or SellModels(feature_columns(train))
    stats = {r["bucket"]: r for r in labelled.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("drawdown_label").alias("share")).collect()}
    for bucket in K.HORIZON_HOURS:
        s = stats.get(bucket)
        if s is None or s["n"] < min_rows or not 0.05 <= s["share"] <= 0.95:
            continue
        weight = F.when(F.col("drawdown_label") == 1, (1 - s["share"]) / s["share"]).otherwise(1.0)
        own = F.col("bucket") == bucket
        held = validation.filter(own) if bucket in held_buckets else None
        rows = feature_matrix(_with_held(labelled.filter(own), held), [*METADATA, "_held"]).withColumn("_weight", weight)
        gbt = GBTClassifier(labelCol="drawdown_label", weightCol="_weight", predictionCol="_class",
                            maxDepth=5, maxIter=rounds, stepSize=0.05, seed=13, validationTol=LEAST_GAIN)
        gbt = _stops(gbt, held).setProbabilityCol("_proba").setRawPredictionCol("_raw")
        out.drawdown[bucket] = Pipeline(stages=[_assembler(out.features), gbt]).fit(rows)
        scored = out.drawdown[bucket].transform(rows.filter(~F.col("_held"))).select(
            F.col("drawdown_label").alias("label"), vector_to_array("_proba")[1].alias("score"))
        m = binary_metrics(scored).first()
        out.metrics.setdefault(bucket, {}).update(accuracy=m["accuracy"], auc=m["auc"])
    return out
