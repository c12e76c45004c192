"""Prices read their swaps once."""

from pyspark.sql import functions as F

from tradeweft.functions.market import list_rank
from tradeweft.operators import pricing as PR

REFS = [("USDC", "none"), ("SOL", "p0"), ("T2", "p2")]


def test_swaps_are_worked_out_once(spark):
    rows = [(n, "p0", "SOL", "USDC", 1.0, -2.0 - n % 3) if n % 3 else (n, "p1", "T1", "SOL", 4.0, -1.0) for n in range(60)]
    swaps = spark.createDataFrame(rows, "block_number long, pool_address string, token_a string, token_b string, amount_a double, amount_b double")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    priced = PR.price_evm(swaps.mapInArrow(run, swaps.schema), REFS, "USDC", order=["block_number"])
    got = {r.block_number: r.token_b_usdc_price for r in priced.collect()}
    assert len(got) == 60 and got[0] == 0 and got[1] == 1 and got[57] == 3.5 and seen.value == 60


def test_ranks_are_compiled(spark):
    tokens = spark.createDataFrame([("SOL",), ("USDC",), ("X",), (None,)], "t string")
    ranked = tokens.select("t", list_rank(F.col("t"), ["USDC", "SOL"]).alias("r"))
    assert {r.t: r.r for r in ranked.collect()} == {"USDC": 0, "SOL": 1, "X": 10**9, None: 10**9}
    assert "element_at" not in ranked._jdf.queryExecution().optimizedPlan().toString()
