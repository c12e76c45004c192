"""Wide integers against Python's."""

import random

from pyspark.sql import functions as F

from tradeweft.functions import wide as W


def test_sums_signs_and_texts(spark):
    rng = random.Random(1)
    values = [0, 1, -1, 10**27, -10**27, 10**27 - 1, 2**256 - 1, 1 - 2**256, 10**54, -10**54, 10**18]
    pairs = [(a, b) for a in values for b in values] + [
        (rng.randint(-10**k, 10**k), rng.randint(-10**k, 10**k)) for k in range(1, 77, 3)]
    df = spark.createDataFrame([(str(a), str(b), str(a + b), (a + b > 0) - (a + b < 0)) for a, b in pairs], "a string, b string, s string, sign int")
    both = [x + y for x, y in zip(W.limbs(F.col("a"), 3), W.limbs(F.col("b"), 3))]
    rows = df.select("s", "sign", W.text(both).alias("t"), W.sign(both).alias("g"), W.to_double(both).alias("d")).collect()
    assert all(r.s == r.t and r.sign == r.g for r in rows)
    assert all(abs(r.d - float(int(r.s))) <= 1e-12 * max(abs(float(int(r.s))), 1e54) for r in rows)
    totals = df.select(*[F.sum(x).alias(f"l{i}") for i, x in enumerate(W.limbs(F.col("a"), 3))])
    assert totals.select(W.text([F.col(f"l{i}") for i in range(3)])).first()[0] == str(sum(a for a, _ in pairs))


def test_issuance_of_any_width(spark):
    from tradeweft.operators.tokens import issuance, issuance_history
    rows = [("a", "mint", 10**40 + 1, 1), ("a", "burn", 10**40, 2), ("b", "burn", 25, 1), ("c", "mint", 2**256 - 1, 1), ("d", "mint", 7 * 10**6, 1)]
    events = spark.createDataFrame([(m, k, str(a), n) for m, k, a, n in rows], "mint string, kind string, amount string, n int")
    decimals = spark.createDataFrame([("a", 18), ("b", 3), ("c", 0), ("d", 6)], "mint string, decimals int")
    got = {r.mint: r.issuance for r in issuance(events, decimals, exact=True).collect()}
    assert got == {"a": "0.000000000000000001", "b": "-0.025", "c": str(2**256 - 1), "d": "7"}
    history = {(r.mint, r.n): r.issuance for r in issuance_history(events, decimals, ["n"], exact=True).collect()}
    assert history["a", 1] == "10000000000000000000000.000000000000000001" and history["a", 2] == got["a"]
    plain = {r.mint: r.issuance for r in issuance(events, decimals).collect()}
    assert plain["c"] is None and float(plain["b"]) == -0.025


def test_limbs_and_signs_are_compiled(spark):
    """Arithmetic instead of functions on arrays, which Spark interprets row by row."""
    for kind, count in (("decimal(38,0)", 2), ("string", 3)):
        parts = W.limbs(F.col("a").cast(kind), count)
        plan = spark.range(3).selectExpr("id AS a").select(W.sign(parts).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f in plan for f in ("transform", "aggregate", "lambda", "regexp")), plan


def test_plain_digits(spark):
    values = [0, 5, -5, 10**27, -10**27, 10**38 - 1, 1 - 10**38]
    two = spark.createDataFrame([(str(v),) for v in values], "t string").withColumn("a", F.col("t").cast("decimal(38,0)"))
    for value, count in (("a", 2), ("t", 3)):
        rows = two.select("t", W.digits(W.limbs(F.col(value), count)).alias("d"), W.sign(W.limbs(F.col(value), count)).alias("s")).collect()
        assert all(int(r.d) == int(r.t) and r.s == (int(r.t) > 0) - (int(r.t) < 0) for r in rows)
