"""Model metrics as aggregates, and feature scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft.functions.num import safe_div
from tradeweft.operators.ordered import Scan, chunk, percentiles, scan

# The quantile levels of the distributional model.
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

#: Columns that are no features.
METADATA = ("timestamp", "entry_time", "signal_id", "token", "pool", "bucket", "dex", "upside_left",
            "net_return_current", "entry_price", "current_price", "drawdown_label", "max_future_drawdown")


def regression_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    e = F.col(prediction) - F.col(label)
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score",
                   cut: float = 0.5) -> DataFrame:
    """Accuracy and AUC. The AUC is the rank-sum over distinct scores, ties at half."""
    y, s = F.col(label), F.col(score)
    per = df.groupBy(s.alias("_s")).agg(
        F.sum(y).cast("double").alias("_ones"), F.sum(1 - y).cast("double").alias("_zeros"),
        F.sum(F.when((s > cut).cast("int") == y, 1).otherwise(0)).alias("_right"))
    run = scan(chunk(per, [], ["_s"]), Scan("_below", "sum", F.col("_zeros"), strict=True)).rows()
    below = F.coalesce(F.col("_below"), F.lit(0.0))
    return run.agg(
        safe_div(F.sum("_right"), F.sum(F.col("_ones") + F.col("_zeros"))).alias("accuracy"),
        safe_div(F.sum(F.col("_ones") * (below + F.col("_zeros") / 2)),
                 F.sum("_ones") * F.sum("_zeros")).alias("auc"))


def pinball_loss(df: DataFrame, label: str = "label", predictions: str = "quantiles",
                 levels: Sequence[float] = QUANTILES) -> DataFrame:
    """Mean pinball loss of an array of predicted quantiles."""
    terms = []
    for i, q in enumerate(levels):
        e = F.col(label) - F.get(predictions, F.lit(i))
        terms.append(F.greatest(q * e, (q - 1) * e))
    return df.agg((F.avg(sum(terms[1:], terms[0])) / len(levels)).alias("pinball_loss"))


def quantile_point(df: DataFrame, predictions: str = "quantiles") -> DataFrame:
    """Median as the point prediction; spread between the 0.3 and 0.7 quantiles."""
    at = lambda i: F.get(predictions, F.lit(i))
    return df.withColumns({"point": at(4), "spread_q30_q70": at(6) - at(2)})


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / IQR with missing values as 0 first; a constant column keeps scale 1."""
    filled = df.fillna(0, list(columns))
    # One scan for all columns: their values are counted and ranked as groups of one table.
    values = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)])
    found = percentiles(filled.select(F.inline(values)), "_x", [0.25, 0.5, 0.75], ["_i"])
    one_row = found.agg(*[F.first(F.when(F.col("_i") == i, F.col("q")), ignorenulls=True).alias(f"_q_{c}")
                          for i, c in enumerate(columns)])
    out, scaled = filled.crossJoin(F.broadcast(one_row)), {}
    for c in columns:
        q = F.col(f"_q_{c}")
        iqr = q[2] - q[0]
        scaled[c] = (F.col(c) - q[1]) / F.when(iqr == 0, 1.0).otherwise(iqr)
    return out.withColumns(scaled).drop(*[f"_q_{c}" for c in columns])


def feature_columns(df: DataFrame, exclude: Sequence[str] = METADATA) -> list[str]:
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint", "boolean"}
    return [c for c, t in df.dtypes if c not in exclude and (t in numeric or t.startswith("decimal"))]


def feature_matrix(df: DataFrame, exclude: Sequence[str] = METADATA) -> DataFrame:
    """Features as doubles with missing values as 0; metadata columns stay as they are."""
    cols = feature_columns(df, exclude)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
