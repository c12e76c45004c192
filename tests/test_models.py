"""Models: training gates, decisions, save and load."""

import random

from pyspark.sql import functions as F

from tradeweft.operators import models as M


def test_fit_save_load(spark, folder):
    rng = random.Random(2)
    rows = [(i // 6, f"2024-01-01 00:{i % 6:02d}:00", "new_tokens" if i % 5 else "blue_chip", rng.random(), rng.random(),
             rng.uniform(-0.1, 0.1), rng.random() / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "signal_id int, timestamp string, bucket string, f1 double, f2 double, net_return_current double, upside_left double") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    models = M.fit_upside(df, df, rounds=2, min_rows=100)
    models = M.fit_drawdown(df, rounds=2, min_rows=100, models=models)
    assert set(models.upside) == {"new_tokens"} and models.features == ["f1", "f2"]
    assert set(models.metrics["new_tokens"]) >= {"rmse", "mae"}
    out = models.should_sell(df)
    assert out.count() == sum(1 for r in rows if r[2] == "new_tokens")
    assert {r.sell for r in out.select("sell").distinct().collect()} <= {0, 1}
    assert [n for n, _ in models.importance("new_tokens")]
    models.save(folder)
    again = M.SellModels.load(folder, {"upside": list(models.upside), "drawdown": list(models.drawdown)})
    a = models.predict(df).agg(F.sum("upside_pred"), F.sum("drawdown_prob")).first()
    b = again.predict(df).agg(F.sum("upside_pred"), F.sum("drawdown_prob")).first()
    assert [round(x, 9) for x in a] == [round(x, 9) for x in b]


def test_held_out_rows_end_the_boosting(spark):
    """Noise as the target: the held-out loss stops falling at once. No held-out row is learned from."""
    rng = random.Random(5)
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "new_tokens", rng.random(), rng.random(), rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "signal_id int, timestamp string, bucket string, f1 double, f2 double, upside_left double") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    train, held = df.filter("signal_id < 300"), df.filter("signal_id >= 300")
    models = M.fit_upside(train, held, min_rows=100)
    deep, shallow = models.upside["new_tokens"].stages[1:]
    assert 1 <= deep.getNumTrees < 100 and 1 <= shallow.getNumTrees < 100
    other = M.fit_upside(train, held.withColumn("upside_left", F.col("upside_left") + 0.0), rounds=1, min_rows=100)
    flipped = M.fit_upside(train, held.withColumn("upside_left", -F.col("upside_left")), rounds=1, min_rows=100)
    first = [m.predict(df).agg(F.sum("upside_pred")).first()[0] for m in (other, flipped)]
    assert first[0] == first[1]
    assert set(M.fit_upside(train, held.filter("bucket = 'none'"), rounds=2, min_rows=100).upside) == {"new_tokens"}
