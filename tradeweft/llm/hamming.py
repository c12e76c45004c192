"""Exact top-k by Hamming distance: incremental multi-index hashing.

A code of ``BITS`` bits is cut into ``SEGMENTS`` segments. Two codes at distance d agree in some
segment up to d // SEGMENTS bits, so the codes found within radius r of the query in any segment
include all at distance SEGMENTS * (r + 1) - 1 or less. The radius grows by one; a query is done when
its kth verified distance is covered that way. Each round looks up only the segment values at exactly
the new radius. Equal codes are one entry of the index with their k + 1 smallest ids, which is
all that ties by id can use; equal codes in any number are no hot key. A code that is further from the query
than its kth id found in earlier rounds leaves the join at once.

Defined results: vectors that are null, empty or hold a null or NaN component take no part, rows
without vec_id neither; repeated rows with one vec_id are one; ties go to the smaller vec_id; with
fewer candidates than asked for all are returned.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweft.session import written_table

BITS, SEGMENTS = 64, 8
WIDTH = BITS // SEGMENTS


def codes(embeddings: DataFrame) -> DataFrame:
    """vec_id and code: the signs of the first 64 components, the first in the lowest bit."""
    v = F.slice(F.col("embedding").cast("array<double>"), 1, BITS)
    sound = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    return rows.select("vec_id", code.alias("code")).groupBy("vec_id").agg(F.min("code").alias("code"))


def _segments(code) -> object:
    return F.array(*[F.shiftrightunsigned(code, WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int") for s in range(SEGMENTS)])


def _masks(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)]


def _smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """code, vec_id of the n smallest ids of each code, first within hash parts of a code."""
    part = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["code", "part"], ["code"]):
        at = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        part = part.withColumn("at", at).where(F.col("at") <= n)
    return part.select("code", "vec_id")


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest of each vec_id divisible by ``every``."""
    rows = written_table(codes(embeddings), "codes")
    ids = written_table(_smallest_ids(rows, k + 1), "code-ids")
    sizes = ids.groupBy("code").agg(F.count("*").alias("ids"))
    index = written_table(sizes.select("code", "ids", F.posexplode(_segments(F.col("code"))).alias("segment", "value")), "index")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("code").alias("query"), F.lit(BITS).alias("bound")).distinct()
    open_, found = written_table(asked, "asked"), None
    tasks = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
    for radius in range(WIDTH + 1):
        masks = F.array(*[F.lit(m) for m in _masks(radius)])
        probes = (open_.select("query", "bound", F.posexplode(_segments(F.col("query"))).alias("segment", "own"))
                  .select("query", "bound", F.col("segment").alias("at"), F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("probe")))
        # a code beyond the kth id found so far leaves the join at once; the count keeps its tasks, as a few probes meet many codes
        near = (probes.repartition(tasks, "at", "probe")
                .join(index, (F.col("at") == F.col("segment")) & (F.col("probe") == F.col("value")) & (distance <= F.col("bound")))
                .select("query", "code", "ids", distance.alias("distance")))
        found = (near if found is None else found.union(near)).distinct()
        # only what can still be among the k nearest ids is kept: codes up to the kth id's distance
        order = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        closer = F.coalesce(F.sum("ids").over(order), F.lit(0))
        found = written_table(found.withColumn("closer", closer).where(F.col("closer") <= k).drop("closer"), "found")
        held = found.groupBy("query").agg(
            F.sum(F.when(F.col("distance") <= SEGMENTS * (radius + 1) - 1, F.col("ids"))).alias("sure"),
            F.when(F.sum("ids") >= k + 1, F.max("distance")).otherwise(BITS).alias("bound"))
        open_ = written_table(open_.drop("bound").join(held, "query", "left").where("sure IS NULL OR sure < " + str(k + 1))
                              .select("query", F.coalesce("bound", F.lit(BITS)).alias("bound")), "asked")
        if open_.isEmpty():
            break
    found = found.drop("ids")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
    pairs = queries.join(found, "query").join(ids, "code").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return (pairs.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance")))
