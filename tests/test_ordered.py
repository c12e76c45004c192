"""Running values over several chunks equal a plain sequential pass, hot keys included."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tradeweft.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data, n = [], 0
    for _ in range(600):
        n += 1
        key = "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 40)}"
        data.append((key, n, rng.randint(-5, 9), rng.choice([None, rng.randint(0, 99)])))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, n int, v int, w int").persist()


def _sequential(data, reverse=False, strict=False):
    out, state = {}, {}
    for k, n, v, w in sorted(data, key=lambda r: r[1], reverse=reverse):
        s = state.setdefault(k, dict(total=None, peak=None, top=None, last=None))
        if strict:
            out[n] = dict(s)
        s["total"] = (s["total"] or 0) + v
        s["peak"] = s["total"] if s["peak"] is None else max(s["peak"], s["total"])
        s["top"] = v if s["top"] is None else max(s["top"], v)
        s["last"] = s["last"] if w is None else w
        if not strict:
            out[n] = dict(s)
    return out


@pytest.mark.parametrize("reverse,strict", [(False, False), (False, True), (True, False), (True, True)])
def test_scan_matches_sequential(rows, reverse, strict):
    data, df = rows
    specs = [O.Scan(name, kind, F.col(c), reverse=reverse, strict=strict) for name, kind, c in (
        ("total", "sum", "v"), ("peak", "peak", "v"), ("top", "max", "v"), ("last", "last", "w"))]
    got = O.scan(O.chunk(df, ["k"], ["n"], 7), *specs).rows().collect()
    want = _sequential(data, reverse, strict)
    assert len(got) == len(data)
    for r in got:
        assert {c: r[c] for c in ("total", "peak", "top", "last")} == want[r.n]


def test_hot_key_is_spread_over_chunks(rows):
    _, df = rows
    ch = O.chunk(df, ["k"], ["n"], 7)
    spread = ch.df.filter("k = 'hot'").select("_chunk").distinct().count()
    largest = ch.df.groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert spread >= 3 and largest < 250
    assert ch.border.count() <= 6


def test_scan_without_keys_and_single_chunk(rows):
    data, df = rows
    want = np.cumsum([v for _, n, v, _ in sorted(data, key=lambda r: r[1])])
    for chunks in (1, 5):
        got = O.scan(O.chunk(df, [], ["n"], chunks), O.Scan("t", "sum", F.col("v"))).df.orderBy("n").collect()
        assert [r.t for r in got] == list(want)


def test_peers_see_each_other(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("a", 3, 4)], "k string, n int, v int")
    got = O.scan(O.chunk(df, ["k"], ["n"], 3), O.Scan("t", "sum", F.col("v"), peers=True),
                 O.Scan("back", "sum", F.col("v"), reverse=True, peers=True)).df.collect()
    assert {(r.n, r.v): (r.t, r.back) for r in got} == {(1, 1): (1, 10), (2, 2): (6, 9), (2, 3): (6, 9), (3, 4): (10, 4)}


@pytest.mark.parametrize("chunks", [1, 4, 60])
def test_history_feeds_row_frames(rows, chunks):
    _, df = rows
    ch = O.with_history(O.chunk(df, ["k"], ["n"], chunks), 4)
    w = Window.partitionBy("k", "_chunk").orderBy("n").rowsBetween(-4, 0)
    got = ch.df.withColumn("s", F.sum("v").over(w)).filter("not _halo").select("n", "s")
    plain = Window.partitionBy("k").orderBy("n").rowsBetween(-4, 0)
    want = df.select("n", F.sum("v").over(plain).alias("s"))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join(spark, rows, strict):
    data, df = rows
    right = [(k, n, v) for k, n, v, w in data if w is not None]
    got = O.asof_join(df.select("k", "n"), spark.createDataFrame(right, "k string, n int, v int"),
                      ["n"], ["k"], ["v"], strict=strict).collect()
    for r in got:
        seen = [(n, v) for k, n, v in right if k == r.k and (n < r.n if strict else n <= r.n)]
        assert r.v == (max(seen)[1] if seen else None)


def test_percentiles_match_numpy(rows):
    data, df = rows
    got = {r.k: r.q for r in O.percentiles(df, "v", [0.05, 0.5, 0.9], ["k"]).collect()}
    for k, q in got.items():
        np.testing.assert_allclose(q, np.percentile([v for kk, _, v, _ in data if kk == k], [5, 50, 90]))


def test_downsample(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i) for i in range(40)], "n int, v int")
    kept = [i for i in range(40) if i % 4]
    assert sorted(r.n for r in O.downsample(df, 6, ["n"], ["v"]).collect()) == kept[::6]


def test_usual_keys_fill_tasks_of_bounded_size(spark):
    """More rows make more tasks, not larger ones; a bucket of more rows than a chunk goes into chunks."""
    df = spark.range(20_000).selectExpr("id % 5000 AS k", "id AS n").union(spark.range(3000).selectExpr("-1L AS k", "id AS n"))
    spark.conf.set("tradeweft.chunk.bytes", str(1000 * O.ROW_BYTES))
    try:
        parts = {t.whole: t for t in O.by_size(df, ["k"], ["n"])}
    finally:
        spark.conf.unset("tradeweft.chunk.bytes")
    assert {t.df.count() for t in parts.values()} == {20_000, 3000} and parts[False].df.filter("k <> -1").isEmpty()
    sizes = [r["count"] for r in parts[True].df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 1000
    largest = parts[False].df.groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert parts[False].n == 3 and largest < 1500
