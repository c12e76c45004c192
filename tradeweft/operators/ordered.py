"""Running values, as-of values and short histories over one order, safe under key skew.

A plain window puts every row of a key into one task. Here rows are range-partitioned by
``(keys, order)`` and written once, so each chunk holds about the same number of rows
however they spread over keys. Then

1. a window inside ``(keys, chunk)`` gives the local running value,
2. only keys that cross a chunk border get a carry: one partial aggregate per
   ``(key, chunk)``, combined over the chunks in order,
3. the carry is broadcast back. At most two keys per chunk cross a border, so it has at
   most ``2 * chunks`` rows whatever the size of the data.

The chunk of a row depends on where the range shuffle put it, which is why the rows are
written before they are used twice. Input files smaller than one chunk
(``tradeweft.chunk.bytes``, 64 MB) stay in one chunk and need none of this.

Where most keys are small (accounts), :func:`by_size` leaves only the rows of large keys to chunks: all
others are partitioned by key, a bounded number of rows to a task, and never written.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweft.session import written_table

CHUNK = "_chunk"
POS = "_pos"
#: Hash buckets in which the rows of keys are counted, and the bytes that a row stands for against ``tradeweft.chunk.bytes``.
BUCKETS, ROW_BYTES = 1 << 14, 1 << 8


@dataclass(frozen=True)
class Chunks:
    """Rows with ``_chunk`` and ``_pos`` (their place in the global order).

    ``border`` holds the keys that occur in more than one chunk (None: there are none,
    or there are no keys and every chunk continues the one before).
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    border: DataFrame | None
    whole: bool = False
    n: int = 1

    @property
    def sort(self) -> tuple[str, ...]:
        return self.order if self.whole else (POS,)

    def map(self, df: DataFrame) -> "Chunks":
        """The same chunks with other columns."""
        return replace(self, df=df)

    def local(self, order: Sequence[str | Column]):
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*order)

    def rows(self) -> DataFrame:
        return self.df.drop(CHUNK, POS)

    def border_rows(self) -> DataFrame | None:
        """Rows whose key goes over a chunk border."""
        if self.whole:
            return None
        if not self.keys:
            return self.df
        if self.border is None:
            return None
        cond = _same([F.col(k) for k in self.keys], [F.col(f"_b{i}") for i in range(len(self.keys))])
        return self.df.join(F.broadcast(self.border), cond, "left_semi")


@dataclass(frozen=True)
class Scan:
    """One running value.

    ``kind`` is sum, max, min, last (the latest non-NULL value) or peak (the highest
    running sum so far, starting at the first row). ``reverse`` runs from the end. ``strict`` leaves the current row out. ``peers`` lets rows that are equal in
    the order see each other.
    """

    name: str
    kind: str
    value: Column
    reverse: bool = False
    strict: bool = False
    peers: bool = False


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str],
          chunks: int | None = None) -> Chunks:
    """Range-partition ``df`` by ``(keys, order)`` and write it with its chunk numbers."""
    n = chunks or _chunk_count(df)
    if n == 1:
        one = df.withColumn(POS, F.lit(0).cast("long")).withColumn(CHUNK, F.lit(0))
        return Chunks(one, tuple(keys), tuple(order), None, whole=True)
    cols = [*keys, *order]
    placed = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn(POS, F.monotonically_increasing_id())
              .withColumn(CHUNK, F.shiftright(F.col(POS), 33).cast("int")))
    rows = written_table(placed, "chunks")
    border = _local(_border_keys(rows, keys)) if keys else None
    return Chunks(rows, tuple(keys), tuple(order), border, n=n)


def by_size(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[Chunks]:
    """``df`` as one whole chunk that is partitioned by key, and as chunks of the keys that are too large for that.

    Rows are counted by hash buckets of their keys. A bucket of more rows than a chunk holds goes into chunks
    with all its keys. No task gets much more than the rows of a chunk, however large the input.
    """
    conf = df.sparkSession.conf
    most = max(1, int(conf.get("tradeweft.chunk.bytes", str(64 << 20))) // ROW_BYTES)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    sizes = df.groupBy(bucket.alias("_bucket")).count()
    large = F.col("count") > most
    found = sizes.agg(F.sum(F.when(~large, F.col("count"))).alias("few"), F.sum(F.when(large, F.col("count"))).alias("many"),
                      F.collect_list(F.when(large, F.col("_bucket"))).alias("large")).first()
    few, many, parts, rest = found["few"] or 0, found["many"] or 0, [], df
    if many:
        hot = F.broadcast(df.sparkSession.createDataFrame([(b,) for b in found["large"]], "_hot int"))
        parts.append(chunk(df.join(hot, bucket == F.col("_hot"), "left_semi"), keys, order, max(2, -(-many // most))))
        rest = df.join(hot, bucket == F.col("_hot"), "left_anti")
    if few or not many:
        tasks = max(1, -(-few // max(1, most // 2)), min(int(conf.get("spark.sql.shuffle.partitions")), few >> 12))
        parts.append(chunk(rest.repartition(tasks, *keys), keys, order, 1))
    return parts


def _chunk_count(df: DataFrame) -> int:
    """Chunks for the size of the input files; more than the shuffle partitions where that is needed.

    The sizes of the leaves are added up: the estimate of a join is the product of its
    sides, which says nothing. With a leaf of unknown size, the shuffle partitions it is.
    """
    conf = df.sparkSession.conf
    per_chunk = int(conf.get("tradeweft.chunk.bytes", str(64 << 20)))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= int(conf.get("spark.sql.defaultSizeInBytes", str(2 ** 63 - 1))):
        return int(conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // per_chunk))


def _local(df: DataFrame) -> DataFrame | None:
    """A summary of at most two rows per chunk as a local relation; None when empty."""
    table = df.toArrow()
    return df.sparkSession.createDataFrame(table, df.schema) if table.num_rows else None


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & a.eqNullSafe(b)
    return cond


def _border_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are first or last in their chunk and occur in more than one chunk."""
    ends = (rows.groupBy(CHUNK).agg(F.min(POS).alias("lo"), F.max(POS).alias("hi"))
            .select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_end")))
    hits = rows.select(*keys, CHUNK, POS).join(
        F.broadcast(ends), F.col(POS) == F.col("_end"), "left_semi")
    return (hits.groupBy(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)])
            .agg(F.count_distinct(CHUNK).alias("_n")).filter("_n > 1").drop("_n"))


def scan(ch: Chunks, *specs: Scan) -> Chunks:
    """Add the running values to the chunks."""
    names = [F.col(c) for c in ch.df.columns]
    inside = [(s, _frame(ch, s)) for s in specs]
    peaks = [(s, w) for s, w in inside if s.kind == "peak"]
    if peaks:  # the running sum first, then its maximum
        ch = ch.map(ch.df.select("*", *[
            F.sum(s.value).over(_frame(ch, replace(s, strict=False))).alias(f"_r_{s.name}")
            for s, _ in peaks]))
    carried = _carry(ch, specs)
    local = [_local_value(s, w) for s, w in inside]
    if carried is None:
        return ch.map(ch.df.select(*names, *[c.alias(s.name) for c, s in zip(local, specs)]))
    main = ch.df.select("*", *[c.alias(f"_l_{s.name}") for c, s in zip(local, specs)])
    cond = _same([F.col(k) for k in ch.keys], [F.col(f"_k{i}") for i in range(len(ch.keys))])
    joined = main.join(F.broadcast(carried), cond & (F.col(CHUNK) == F.col("_kc")), "left")
    out = [_combine(s, F.col(f"_l_{s.name}"), F.col(f"_c_{s.name}")).alias(s.name) for s in specs]
    return ch.map(joined.select(*names, *out))


def _frame(ch: Chunks, s: Scan):
    """Window inside ``(keys, chunk)``."""
    w = ch.local([F.col(c).desc() if s.reverse else F.col(c).asc()
                  for c in (ch.order if s.peers else ch.sort)])
    if s.peers:
        return w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return w.rowsBetween(Window.unboundedPreceding, -1 if s.strict else 0)


def _local_value(s: Scan, w) -> Column:
    if s.kind == "last":
        return F.last(s.value, ignorenulls=True).over(w)
    if s.kind == "peak":
        return F.max(F.col(f"_r_{s.name}")).over(w)
    return _AGG[s.kind](s.value).over(w)


def _carry(ch: Chunks, specs: Sequence[Scan]) -> DataFrame | None:
    """What the earlier chunks of a border key hand on to each of its chunks."""
    border = ch.border_rows()
    if border is None:
        return None
    partial, step, carry = [], [], []
    for s in specs:
        n, part = s.name, F.col(f"_p_{s.name}")
        by = Window.partitionBy(*ch.keys).orderBy(
            F.col(CHUNK).desc() if s.reverse else F.col(CHUNK).asc())
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        if s.kind == "last":
            pick = F.min_by if s.reverse else F.max_by
            partial.append(pick(s.value, F.when(s.value.isNotNull(), F.col(POS))).alias(f"_p_{n}"))
            carry.append(F.last(part, ignorenulls=True).over(before).alias(f"_c_{n}"))
        elif s.kind == "peak":
            partial += [F.sum(s.value).alias(f"_p_{n}"), F.max(f"_r_{n}").alias(f"_m_{n}")]
            step.append(F.sum(part).over(before).alias(f"_s_{n}"))
            base = F.coalesce(F.col(f"_s_{n}"), F.lit(0))
            carry.append(F.struct(base.alias("base"), F.max(base + F.col(f"_m_{n}"))
                                  .over(before).alias("peak")).alias(f"_c_{n}"))
        else:
            agg = _AGG[s.kind]
            partial.append(agg(s.value).alias(f"_p_{n}"))
            carry.append(agg(part).over(before).alias(f"_c_{n}"))
    parts = border.groupBy(*ch.keys, CHUNK).agg(*partial).select("*", *step)
    return _local(parts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(ch.keys)], F.col(CHUNK).alias("_kc"), *carry))


def _combine(s: Scan, local: Column, carry: Column) -> Column:
    if s.kind == "sum":
        # + keeps both precise; NULL only where there is no row on either side
        return F.when(local.isNull(), carry).when(carry.isNull(), local).otherwise(local + carry)
    if s.kind == "peak":
        return F.greatest(carry["peak"], local + F.coalesce(carry["base"], F.lit(0)))
    if s.kind == "max":
        return F.greatest(local, carry)
    if s.kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def with_history(ch: Chunks, rows: int) -> Chunks:
    """Add to each chunk copies (``_halo`` = true) of the ``rows`` rows before its first
    row of a key, so that a frame of up to ``rows`` preceding rows can be evaluated inside
    ``(keys, _chunk)``. Only border keys need copies: at most ``2 * chunks * rows``.
    """
    border = ch.border_rows()
    if border is None:
        return ch.map(ch.df.withColumn("_halo", F.lit(False)))
    sizes = border.groupBy(*ch.keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*ch.keys).orderBy(CHUNK)
    sizes = sizes.select(
        *ch.keys, F.col(CHUNK).alias("_c"), F.row_number().over(by_key).alias("_i"),
        F.sum("_n").over(by_key).alias("_end"))
    sizes = sizes.withColumn("_start", F.lag("_end", 1, 0).over(
        Window.partitionBy(*ch.keys).orderBy("_i")))
    tail_rank = F.row_number().over(ch.local([F.col(c).desc() for c in ch.sort]))
    tails = (border.withColumn("_r", tail_rank).filter(F.col("_r") <= rows))
    ks = [f"_k{i}" for i in range(len(ch.keys))]
    keyed = sizes.select(*[F.col(k).alias(a) for k, a in zip(ch.keys, ks)], "_c", "_i", "_start", "_end")
    cond = _same([F.col(k) for k in ch.keys], [F.col(a) for a in ks])
    src = tails.join(F.broadcast(keyed), cond & (F.col(CHUNK) == F.col("_c")), "inner")
    src = src.select(*[F.col(c) for c in ch.df.columns], "_r", F.col("_end").alias("_src_end"),
                     F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + rows)).alias("_ti"))
    target = keyed.select(*ks, F.col("_i").alias("_ti2"), F.col("_c").alias("_tc"),
                          F.col("_start").alias("_tstart"))
    halo = src.join(F.broadcast(target), cond & (F.col("_ti") == F.col("_ti2"))
                    & (F.col("_tstart") - F.col("_src_end") + F.col("_r") <= rows), "inner")
    cols = [F.col("_tc").alias(CHUNK) if c == CHUNK else F.col(c) for c in ch.df.columns]
    halo = written_table(halo.select(*cols, F.lit(True).alias("_halo")), "halo")
    return ch.map(ch.df.withColumn("_halo", F.lit(False)).unionByName(halo))


def cumulative(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str],
               name: str = "total") -> DataFrame:
    """Running sum from the first row to the current one."""
    return scan(chunk(df, by, order), Scan(name, "sum", F.col(value))).rows()


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str],
              values: Sequence[str], strict: bool = True, prefix: str = "") -> DataFrame:
    """Latest ``right`` row before each ``left`` row (``strict``: not at the same key).

    ``on`` and ``by`` columns exist on both sides. ``values`` come from ``right``; left
    columns of the same name need a ``prefix``. Skew in ``by`` is harmless: see above.
    """
    payload = [c for c in left.columns if c not in {*by, *on}]
    lstruct = F.struct(*[F.col(c) for c in payload]) if payload else F.struct(F.lit(1).alias("_"))
    rstruct = F.struct(*[F.col(c) for c in values])
    lt = left.select(*by, *on, F.lit(0 if strict else 1).alias("_side"), lstruct.alias("_l"),
                     F.lit(True).alias("_is_left"))
    rt = right.select(*by, *on, F.lit(1 if strict else 0).alias("_side"), rstruct.alias("_v"),
                      F.lit(False).alias("_is_left"))
    both = lt.unionByName(rt, allowMissingColumns=True)
    out = scan(chunk(both, by, [*on, "_side"]), Scan("_hit", "last", F.col("_v"))).df
    return out.filter("_is_left").select(
        *by, *on, *[F.col(f"_l.{c}").alias(c) for c in payload],
        *[F.col(f"_hit.{c}").alias(prefix + c) for c in values])


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` latest rows of each key. Spark cuts each map task to ``n`` rows per key
    before the shuffle, so a large key does not reach one task whole."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def nth_row(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n``-th row of each (small) group, such as a log inside one instruction."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == n).drop("_rn")


def downsample(df: DataFrame, n: int, order: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Every ``n``-th row in ``order`` after dropping rows with a missing required value."""
    rows = chunk(df.dropna(subset=list(required)), [], order)
    numbered = scan(rows, Scan("_rn", "sum", F.lit(1)))
    return numbered.map(numbered.df.filter(F.pmod(F.col("_rn"), F.lit(n)) == 1 % n).drop("_rn")).rows()


def percentiles(df: DataFrame, column: str, levels: Sequence[float],
                by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated percentiles per group as array column ``q``.

    Values are counted first and ranked by a scan, so a group of any size is spread over
    all tasks (the built-in exact percentile keeps the values of a group in one).
    """
    per = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    ranked = scan(chunk(per, by, ["_v"]), Scan("_hi", "sum", F.col("_n"))).rows()
    total = per.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(by)]).agg(F.sum("_n").alias("_total"))
    on = _same([F.col(k) for k in by], [F.col(f"_t{i}") for i in range(len(by))])
    rows = ranked.join(total, on) if by else ranked.crossJoin(F.broadcast(total))
    picks = []
    for i, p in enumerate(levels):
        at = (F.col("_total") - 1) * F.lit(float(p))  # 0-based position
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_hi") > k) & (F.col("_hi") - F.col("_n") <= k)
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_f{i}"))
    found = rows.groupBy(*by).agg(*picks)
    q = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}") for i in range(len(levels))]
    return found.select(*by, F.array(*q).alias("q"))
