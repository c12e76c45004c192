"""Trade simulation, performance and reports.

A trade ends at its first exit row. The exit conditions of a row do not depend on earlier
ones, so the exit is a ``min_by``, not a loop. A trade has at most 24 hours of candles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.functions.market import dex_fee
from tradeweft.functions.num import net_return, safe_div
from tradeweft.operators.labels import signal_windows
from tradeweft.operators.ordered import Scan, asof_join, chunk, percentiles, scan
from tradeweft.session import written_table

_ID = ("signal_id",)


def sell_signals(pred: DataFrame) -> DataFrame:
    """1 where the expected upside is low and the drawdown likely."""
    hit = (F.col("upside_pred") < K.UPSIDE_THRESHOLD) & (F.col("drawdown_prob") > K.DRAWDOWN_PROB_THRESHOLD)
    return pred.withColumn("sell", F.coalesce(hit, F.lit(False)).cast("int"))


def simulate_trades(signals: DataFrame, candles: DataFrame, preds: DataFrame | None = None,
                    slippage: float = 0.01, by: Sequence[str] = _ID, ts: str = "bucket_ts") -> DataFrame:
    """One row per signal with at least two price points in its horizon.

    ``signals``: signal_id, token, pool, dex, timestamp, entry_price, size_usdc, bucket.
    ``candles``: token, pool, bucket_ts, close_price, atr_20. ``preds``: the ``by`` columns,
    bucket_ts, upside_pred, drawdown_prob; without them a model never says sell. ``by`` may
    hold a model column next to signal_id.
    """
    rows = signal_windows(signals, candles, ts=ts)
    if preds is not None:
        rows = rows.join(preds.select(*by, ts, "upside_pred", "drawdown_prob"), [*by, ts], "left")
    else:
        rows = rows.withColumns({"upside_pred": F.lit(0.0), "drawdown_prob": F.lit(0.0)})
    c = F.col
    price, entry = c("close_price"), c("entry_price")
    upto = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.greatest(F.max(price).over(upto), entry))
    rows = rows.withColumn("_dd", safe_div(c("_peak") - price, c("_peak")))
    model = ((F.coalesce(c("upside_pred"), F.lit(0.0)) < K.UPSIDE_THRESHOLD)
             & (F.coalesce(c("drawdown_prob"), F.lit(0.0)) > K.DRAWDOWN_PROB_THRESHOLD))
    trail = (c("atr_20") > 0) & (price <= c("_peak") - K.ATR_STOP_MULTIPLE * c("atr_20"))
    stop = F.coalesce(trail, F.lit(False)) | (safe_div(price, entry) - 1 < K.HARD_STOP)
    rows = rows.withColumn("_why", F.when(stop, "stop_loss").when(model, "model"))
    exit_row = F.struct(F.col(ts).alias("t"), price.alias("p"), F.col("_why").alias("why"))
    first_exit = F.min(F.when(c("_why").isNotNull(), c(ts))).over(Window.partitionBy(*by))
    kept = rows.withColumn("_exit", first_exit).withColumn("_points", F.count(F.lit(1)).over(Window.partitionBy(*by))) \
        .filter((c("_points") >= 2) & (c("_exit").isNull() | (c(ts) <= c("_exit"))))
    same = ["token", "pool", "dex", "bucket", "timestamp", "entry_price", "size_usdc"]
    out = kept.groupBy(*by).agg(*[F.first(x).alias(x) for x in same],
                                F.max_by(exit_row, c(ts)).alias("_e"), F.max("_dd").alias("max_drawdown"))
    fee = dex_fee(c("dex"), default=0.0025)
    slip = F.lit(slippage)
    hours = (F.unix_micros(c("_e.t")) - F.unix_micros(c("timestamp"))) / 3.6e9
    return out.select(
        *by, c("timestamp").alias("entry_time"), c("_e.t").alias("exit_time"), "token", "pool", "bucket",
        "entry_price", c("_e.p").alias("exit_price"), c("size_usdc").alias("trade_size_usdc"),
        fee.alias("dex_fee"), slip.alias("slippage"),
        (safe_div(c("_e.p"), entry) - 1).alias("gross_return"),
        net_return(c("_e.p"), entry, fee, slip).alias("net_return"),
        hours.alias("holding_time_hours"), "max_drawdown",
        F.coalesce(c("_e.why"), F.lit("timeout")).alias("exit_reason"))


def performance(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The 21 figures of a set of trades, per ``by`` group or overall."""
    # Several passes follow; the simulation behind the trades should run once.
    trades = written_table(trades.select(*by, "net_return", "max_drawdown", "holding_time_hours",
                                         "exit_reason"), "trades")
    r, dd = F.col("net_return"), F.col("max_drawdown")
    n = F.count(F.lit(1)).cast("double")
    neg, pos = F.when(r < 0, r), F.when(r > 0, r)
    log_growth = F.sum(F.when(r > -1, F.log1p(r)))
    zero = F.lit(0.0)
    agg = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"), safe_div(F.count_if(r > 0), n).alias("win_rate"),
        F.avg(r).alias("avg_return"),
        F.when(F.count_if(r <= -1) > 0, F.lit(-1.0)).otherwise(F.expm1(log_growth)).alias("total_return"),
        F.stddev_samp(r).alias("_std"), F.max(dd).alias("max_drawdown"), F.avg(dd).alias("avg_drawdown"),
        F.coalesce(F.avg(pos), zero).alias("avg_win"), F.coalesce(F.avg(neg), zero).alias("avg_loss"),
        F.coalesce(F.max(pos), zero).alias("best_win"), F.coalesce(F.min(neg), zero).alias("worst_loss"),
        F.coalesce(F.sum(pos), zero).alias("_wins"),
        F.coalesce(F.abs(F.sum(neg)), F.lit(0.001)).alias("_losses"),
        F.avg("holding_time_hours").alias("avg_holding_time_hours"),
        *[(safe_div(F.count_if(F.col("exit_reason") == why), n) * 100).alias(name) for why, name in
          (("model", "model_exit_pct"), ("stop_loss", "stop_exit_pct"), ("timeout", "timeout_exit_pct"))])
    agg = agg.withColumns({
        "sharpe_ratio": F.when(F.col("_std") > 0, F.col("avg_return") / F.col("_std")).otherwise(0.0),
        "calmar_ratio": F.when(F.col("max_drawdown") > 0, F.col("total_return") / F.col("max_drawdown")).otherwise(0.0),
        "profit_factor": F.col("_wins") / F.col("_losses")}).drop("_std", "_wins", "_losses")
    join = (lambda a, b: a.join(b, list(by))) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))
    returns = percentiles(trades, "net_return", [0.5, 0.05], by).select(
        *by, F.col("q")[0].alias("median_return"), F.col("q")[1].alias("var_95"))
    holding = percentiles(trades, "holding_time_hours", [0.5], by).select(
        *by, F.col("q")[0].alias("median_holding_time_hours"))
    agg = join(join(agg, returns), holding)
    # Expected shortfall needs the quantile first: one row per group, joined back.
    tail = join(trades, returns.select(*by, "var_95"))
    return join(agg, tail.filter(r <= F.col("var_95")).groupBy(*by).agg(F.avg(r).alias("cvar_95")))


def compare(trades: DataFrame, by: str = "model") -> DataFrame:
    return performance(trades, [by])


def fixed_time_exits(signals: DataFrame, candles: DataFrame, hours: Sequence[int] = (1, 2, 4, 8, 12, 24),
                     fee: float = 0.0025, slippage: float = 0.01, ts: str = "bucket_ts") -> DataFrame:
    """Return of selling at the last price known ``h`` hours after entry."""
    h = F.explode(F.array(*[F.lit(x) for x in hours])).alias("hours")
    want = signals.select("signal_id", "token", "pool", "entry_price", F.col("timestamp").alias("_entry"), h)
    # Micros keep the sub-second part of the entry time.
    want = want.withColumn(ts, F.timestamp_micros(F.unix_micros("_entry") + F.col("hours").cast("long") * 3_600_000_000))
    hit = asof_join(want, candles.select("token", "pool", ts, "close_price", F.col(ts).alias("_seen")),
                    on=[ts], by=["token", "pool"], values=["close_price", "_seen"], strict=False)
    return hit.filter(F.col("_seen") >= F.col("_entry")).select(
        "signal_id", "hours", F.col("close_price").alias("exit_price"),
        net_return(F.col("close_price"), F.col("entry_price"), F.lit(fee), F.lit(slippage)).alias("net_return"))


def take_profit_exits(signals: DataFrame, candles: DataFrame, percents: Sequence[int] = (2, 5, 10, 15),
                      fee: float = 0.0025, slippage: float = 0.01, horizon: Column | None = None,
                      ts: str = "bucket_ts") -> DataFrame:
    """Return of selling at the first price ``p`` percent above entry, else at the end."""
    rows = signal_windows(signals, candles, horizon, ts)
    gain = safe_div(F.col("close_price"), F.col("entry_price")) - 1
    p = F.explode(F.array(*[F.lit(x) for x in percents])).alias("pct")
    rows = rows.select("signal_id", "entry_price", ts, "close_price", gain.alias("_gain"), p)
    hit = F.col("_gain") >= F.col("pct") / 100.0
    out = rows.groupBy("signal_id", "pct").agg(
        F.first("entry_price").alias("entry_price"),
        F.coalesce(F.min_by("close_price", F.when(hit, F.col(ts))), F.max_by("close_price", ts)).alias("exit_price"),
        F.max(hit).alias("hit"))
    return out.withColumn("net_return", net_return(F.col("exit_price"), F.col("entry_price"), F.lit(fee), F.lit(slippage)))


def baseline_summary(exits: DataFrame, by: str) -> DataFrame:
    r = F.col("net_return")
    return exits.groupBy(by).agg(
        F.avg(r).alias("avg_return"),
        F.when(F.stddev_pop(r) > 0, F.avg(r) / F.stddev_pop(r)).otherwise(0.0).alias("sharpe_ratio"),
        safe_div(F.count_if(r > 0), F.count(F.lit(1))).alias("win_rate"))


def walk_forward(df: DataFrame, train_days: int = 30, step_days: int = 7, test_days: int = 7,
                 ts: str = "timestamp") -> DataFrame:
    """Rows tagged with the walk-forward windows they are in: ``window_no`` and ``part``.

    Window ``k`` trains on ``train_days`` from day ``k * step_days`` and tests on the
    ``test_days`` after. The windows of a row follow from its day by arithmetic, so there
    is no join with the window list.
    """
    start = df.agg(F.date_trunc("day", F.min(ts)).alias("_t0"))
    span = train_days + test_days
    day = ((F.unix_seconds(F.date_trunc("day", F.col(ts))) - F.unix_seconds("_t0")) / 86400).cast("int")
    first = F.greatest(F.ceil((F.col("_day") - span + 1) / step_days), F.lit(0)).cast("int")
    last = F.floor(F.col("_day") / step_days).cast("int")
    tagged = df.crossJoin(F.broadcast(start)).withColumn("_day", day)
    tagged = tagged.withColumn("window_no", F.explode(F.sequence(first, last)))
    part = F.when(F.col("_day") - F.col("window_no") * step_days < train_days, "train").otherwise("test")
    return tagged.withColumn("part", part).drop("_day", "_t0")


def equity_curve(trades: DataFrame) -> DataFrame:
    """Compound return after each trade in entry order."""
    grown = scan(chunk(trades.select("signal_id", "entry_time", "net_return"), [], ["entry_time", "signal_id"]),
                 Scan("_log", "sum", F.log1p("net_return")), Scan("trade_no", "sum", F.lit(1))).rows()
    return grown.select("signal_id", "entry_time", "trade_no", F.exp("_log").alias("cumulative_return"))


def histogram(trades: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and the largest value."""
    ends = trades.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = trades.crossJoin(F.broadcast(ends))
    raw = F.floor(safe_div(F.col(column) - F.col("_lo"), width)).cast("int")
    return rows.groupBy(F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("trades"))


def bucket_stats(trades: DataFrame) -> DataFrame:
    r = F.col("net_return")
    return trades.groupBy("bucket").agg(F.avg(r).alias("avg_return"),
                                        safe_div(F.count_if(r > 0), F.count(F.lit(1))).alias("win_rate"))


def exit_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("trades"))


def report(trades: DataFrame) -> dict[str, DataFrame]:
    """The report tables by name."""
    trades = written_table(trades, "trades")
    return {"returns": histogram(trades, "net_return", 50), "equity": equity_curve(trades),
            "buckets": bucket_stats(trades), "exits": exit_counts(trades),
            "drawdowns": histogram(trades, "max_drawdown", 30)}
