"""Leak-free expanding history, its leaky counterpart, and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def prior_history(df: DataFrame, key: str, order: list[str], measures: dict[str, Column | str], count: str, strict: bool = False, most: int = scan.MOST) -> DataFrame:
    """Count and averages over the rows of the same key strictly before each row.

    `order` must be total for a result that does not depend on the layout.  With
    `strict` rows of the same instant (the first of `order`) are left out too.
    Averages without history are null.  Keys of more than `most` rows are
    scanned in ranges (operators/scan.py), so no task holds a whole large key.
    """
    value = {name: F.col(v) if isinstance(v, str) else v for name, v in measures.items()}
    sums = {f"_s_{name}": v.cast("double") for name, v in value.items()} | {f"_c_{name}": F.when(v.isNotNull(), 1) for name, v in value.items()}
    rows = scan.prior_sums(df, key, order, {count: F.lit(1), **sums}, most, strict)
    return rows.withColumns({count: F.coalesce(count, F.lit(0)).cast("long")} | {name: F.col(f"_s_{name}") / F.col(f"_c_{name}") for name in measures}).drop(*sums)


def no_history_flags(df: DataFrame, count: str, averages: list[str], flag: str) -> DataFrame:
    """A flag and log count, and 0.0 for averages without history."""
    return df.withColumns({flag: (F.col(count) == 0).cast("int"), f"log_{count}": F.log1p(count)} | {a: F.coalesce(F.col(a), F.lit(0.0)) for a in averages})


def whole_history(df: DataFrame, key: str, value: str, prefix: str = "LEAKY_user", most: int = scan.MOST) -> DataFrame:
    """Average and count over all rows of the key, present and future included; only to measure leakage."""
    return scan.key_totals(df, key, {f"{prefix}_avg_helpful": F.avg(value), f"{prefix}_review_count": F.count("*")}, most)


def arrival_position(df: DataFrame, item: str, order: list[str], most: int = scan.MOST) -> DataFrame:
    return scan.positions(df, item, order, "arrival_position", most)


def temporal_split(df: DataFrame, time: str, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """Adds `split`: train before the first cut, val before the second, else test; in the plan, without a driver round trip."""
    cuts = df.agg(F.percentile_approx(time, F.array(F.lit(train), F.lit(valid)), F.lit(1_000_000)).alias("cuts"))
    which = F.when(F.col(time) < F.col("cuts")[0], "train").when(F.col(time) < F.col("cuts")[1], "val").otherwise("test")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", which).drop("cuts")  # one row


def hash_share(key: str, share: Column | float, seed: int = 42) -> Column:
    """True for a hashed share of keys: by the first eight hex digits of the MD5 of seed and key, which any engine can redo."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)
    bound = F.lit(share) if isinstance(share, float) else share
    limit = F.floor(bound * F.lit(float(1 << 32))).cast("long")
    return F.when(limit >= 1 << 32, True).otherwise(digits < F.lower(F.lpad(F.hex(limit), 8, "0")))


def hash_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds `in_train` by a hash of the key, so that a key's rows stay together whatever the layout; null keys are not in it."""
    return df.withColumn("in_train", F.coalesce(hash_share(key, float(share), seed), F.lit(False)))


def sample_users(df: DataFrame, user: str, share: float, seed: int = 42) -> DataFrame:
    """All rows of a hashed share of users: a filter, with no join and no shuffle."""
    return hash_split(df, user, share, seed).filter("in_train").drop("in_train")


def stratified_sample(df: DataFrame, by: str, shares: dict, key: str, seed: int = 42) -> DataFrame:
    """Rows by a share for each value of `by` (0 where none is given), picked by a hash of the row's key."""
    entries = [F.lit(x) for pair in shares.items() for x in (pair[0], float(pair[1]))]
    share = F.coalesce(F.try_element_at(F.create_map(*entries), F.col(by)), F.lit(0.0))
    return df.filter(F.coalesce(hash_share(key, share, seed), F.lit(False)))
