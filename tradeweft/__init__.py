"""Spark-native analytics over decentralised-exchange trades and token transfers.

Every operator takes DataFrames and returns a DataFrame:
``swaps -> priced swaps -> positions -> candles / traders / movers -> features -> labels -> backtest``.
"""
