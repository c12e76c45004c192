"""Token dimension: list load, metadata, issuance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweft.functions import wide as W
from tradeweft.operators.ordered import Scan, chunk, scan


def load_token_dim(listed: DataFrame) -> DataFrame:
    """Token list without the default of 18 decimals, addresses in lower case."""
    return listed.filter(F.col("decimals") != 18).withColumn("address", F.lower("address"))


def _signed(events: DataFrame) -> tuple[DataFrame, int]:
    """Events with the limbs m0, m1, ... of their signed amount, and how many there are."""
    count = W.limb_count(events.schema["amount"].dataType)
    burn = F.col("kind") == "burn"
    parts = W.limbs(F.col("amount"), count)
    return events.withColumns({f"_m{i}": F.when(burn, -p).otherwise(p).cast("decimal(27,0)") for i, p in enumerate(parts)}), count


def _units(total: str, decimals: Column, exact: bool) -> Column:
    """Decimal text of raw units, with the point shifted; as DECIMAL(38,18) unless ``exact`` (null where it does not fit)."""
    plain = F.regexp_replace(total, "^-", "")
    digits = F.lpad(plain, F.greatest(F.length(plain), decimals + 1), F.lit("0"))
    point = F.length(digits) - decimals
    text = F.concat(F.when(F.col(total).startswith("-"), "-").otherwise(""), F.substring(digits, F.lit(1), point), F.lit("."),
                    F.substring(digits, point + 1, decimals))
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return short if exact else text.try_cast("decimal(38,18)")


def issuance(events: DataFrame, decimals: DataFrame, exact: bool = False) -> DataFrame:
    """Minted minus burned units per tracked mint, as DECIMAL(38,18), or as text of any width if ``exact``.

    ``events``: mint, kind (mint / burn), amount (a number or decimal text of up to 256 bits).
    ``decimals``: mint, decimals.
    """
    rows, count = _signed(events)
    total = rows.groupBy("mint").agg(*[F.sum(f"_m{i}").alias(f"_t{i}") for i in range(count)])
    total = total.withColumn("_raw", W.text([F.col(f"_t{i}") for i in range(count)]))
    return total.join(decimals, "mint").select("mint", _units("_raw", F.col("decimals"), exact).alias("issuance"))


def issuance_history(events: DataFrame, decimals: DataFrame, order: list[str], exact: bool = False) -> DataFrame:
    """Issuance after each event, for as-of lookups."""
    rows, count = _signed(events)
    run = scan(chunk(rows, ["mint"], order), *[Scan(f"_t{i}", "sum", F.col(f"_m{i}")) for i in range(count)]).rows()
    run = run.withColumn("_raw", W.text([F.col(f"_t{i}") for i in range(count)]))
    return run.join(decimals, "mint").withColumn("issuance", _units("_raw", F.col("decimals"), exact)) \
        .drop("_raw", *[f"_{c}{i}" for c in "mt" for i in range(count)])


def token_dim(inits: DataFrame, metadata: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """Token dimension from creation, metadata and update events; last value wins per field.

    ``inits``: mint, decimals, created_at, seq. ``metadata``: mint, metadata_acc, name,
    symbol, mutable, seq. ``updates``: metadata_acc, name, symbol, seq. Metadata counts
    only after the token exists, an update only after its metadata.
    """
    base = inits.groupBy("mint").agg(F.max_by(F.struct("decimals", "created_at", order), order).alias("_i")) \
        .select("mint", "_i.decimals", "_i.created_at", F.col(f"_i.{order}").alias("_born"))
    md = metadata.join(base.select("mint", "_born"), "mint").filter(F.col(order) > F.col("_born"))
    account = md.groupBy("metadata_acc").agg(
        F.max_by(F.struct("mint", order), order).alias("_m")).select(
        "metadata_acc", "_m.mint", F.col(f"_m.{order}").alias("_since"))
    up = updates.join(account, "metadata_acc").filter(F.col(order) > F.col("_since"))
    fields = md.select("mint", order, "metadata_acc", "name", "symbol", "mutable").unionByName(
        up.select("mint", order, "metadata_acc", "name", "symbol"), allowMissingColumns=True)

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)

    merged = fields.groupBy("mint").agg(*[latest(c) for c in ("metadata_acc", "name", "symbol", "mutable")])
    return base.drop("_born").join(merged, "mint", "left")
