"""Stored roll-ups after corrections equal a rebuild."""

from pyspark.sql import functions as F

from tradeweft.plans import retract as RT
from tradeweft.plans.rollups import rebuild
from tradeweft.sources import fixture as X


def same(a, b):
    cols = sorted(b.columns)
    flat = lambda df: sorted(map(repr, ([round(v, 6) if isinstance(v, float) else v for v in r] for r in df.select(*cols).collect())))
    return flat(a) == flat(b)


def test_roll_back_and_replay(spark, tables, folder):
    rows = X.swaps(spark, tables).withColumns({"token_a_symbol": F.concat(F.lit("S_"), "token_a"), "token_a_creation_date": F.lit("2023-01-01").cast("timestamp")})
    RT.store(rows, folder, 1, X.QUOTES)
    replay = rows.filter("block_number >= 600 AND block_number % 3 = 0").withColumn("token_a_usdc_price", F.col("token_a_usdc_price") * 3)
    now = RT.roll_back(rows, folder, 600, replay, 1, X.QUOTES)
    for name, want in rebuild(now, 1, X.QUOTES).items():
        assert same(RT.stored(spark, folder, name), want), name
    # repeated, nothing changes; with all late rows gone, days without rows have no part any more
    RT.refresh(now, replay, folder, 1, X.QUOTES)
    last = rows.filter(F.col("timestamp") < "2024-01-10")
    RT.refresh(last, now.filter(F.col("timestamp") >= "2024-01-10"), folder, 1, X.QUOTES)
    for name, want in rebuild(last, 1, X.QUOTES).items():
        assert same(RT.stored(spark, folder, name), want), name
