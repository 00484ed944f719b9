"""Ordered work within keys, where one key may hold any share of the rows.

A window puts all rows of a key into one task.  Here only keys of `most` rows or
fewer are windowed as they are.  Each larger key is cut into ranges of its order
of about `most` rows: cut points come from a hashed sample of the key's rows, a
row finds its range by halving, and (key, range) is what windows are dealt by.
What earlier ranges of a key sum to is a small table, one row a range, joined
back.  Keys that are too large are rows / most at the most, and so is the table
of ranges; they are broadcast up to FEW rows and joined, with adaptive execution
splitting the large side, beyond that.

Rows that are equal in the whole order share a range, so an order should be
total; ties of one instant are the window's own to treat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of a key that one task may hold.
MOST = 1_000_000
#: Sampled rows for each range, and rows of a table that is broadcast.
SAMPLED, FEW = 64, 100_000
PART = "_part"


def large_keys(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
    """(key, _n) of the keys of more than `most` rows, and how many there are; one aggregation that reads the key alone."""
    found = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most))
    return found, found.count()


def small(table: DataFrame, n: int) -> DataFrame:
    """The table with a broadcast hint, if its n rows are few."""
    return F.broadcast(table) if n <= FEW else table


def _place(cuts: Column, x: Column, most: int) -> Column:
    """How many of the sorted cuts are less than x, by halving; `most` bounds their number."""
    steps = [1 << k for k in range(max(most, 1).bit_length() - 1, -1, -1)]
    less = lambda at: (at <= F.size(cuts)) & (F.try_element_at(cuts, F.greatest(at, F.lit(1))) < x)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(less(at + step), at + step).otherwise(at))


def ranges(rows: DataFrame, key: str, order: list[str], most: int = MOST) -> tuple[DataFrame, bool]:
    """The rows with PART, their range within the key (0 for keys that are small enough), and `_large`; and whether any key is too large.

    A null key is a key like any other.
    """
    large, n = large_keys(rows, key, most)
    if not n:
        return rows.withColumns({PART: F.lit(0), "_large": F.lit(False)}), False
    x = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    hot = large.select(F.col(key).alias("_key"), F.col("_n"))
    one_in = max(1, most // SAMPLED)
    picked = rows.select(F.col(key).alias("_k"), x.alias("_x")).filter(F.pmod(F.xxhash64("_x"), F.lit(one_in)) == 0)
    sampled = picked.join(small(hot, n), F.col("_k").eqNullSafe(F.col("_key"))).groupBy("_key", "_n").agg(F.sort_array(F.collect_set("_x")).alias("_xs"))
    parts = F.ceil(F.col("_n") / most).cast("int")
    nth = F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.try_element_at(F.col("_xs"), F.greatest(F.floor(k * F.size("_xs") / parts), F.lit(1)).cast("int")))
    cuts = cut(sampled.select("_key", F.array_distinct(F.filter(nth, lambda c: c.isNotNull())).alias("_cuts")))
    longest = cuts.agg(F.max(F.size("_cuts"))).first()[0] or 0
    dealt = rows.join(small(cuts, n), F.col(key).eqNullSafe(F.col("_key")), "left")
    return dealt.withColumns({PART: F.when(F.col("_cuts").isNull(), 0).otherwise(_place(F.col("_cuts"), x, longest)), "_large": F.col("_cuts").isNotNull()}).drop("_key", "_cuts"), True


def _earlier(ranged: DataFrame, key: str, sums: dict[str, Column]) -> tuple[DataFrame, int]:
    """What the earlier ranges of each large key sum to, by (_key, _range), and how many ranges there are."""
    each = ranged.filter("_large").groupBy(F.col(key).alias("_key"), F.col(PART).alias("_range")).agg(*[F.sum(c).alias(f"_b_{name}") for name, c in sums.items()])
    before = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    found = cut(each.select("_key", "_range", *[F.sum(f"_b_{name}").over(before).alias(f"_b_{name}") for name in sums]))
    return found, found.count()


def _marked(rows: DataFrame, key: str, large: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows of keys that are small enough, and those of large keys, which have `_key`."""
    hot = large.select(F.col(key).alias("_key"), F.lit(True).alias("_large"))
    both = rows.join(small(hot, n), F.col(key).eqNullSafe(F.col("_key")), "left")
    return both.filter("_large IS NULL").drop("_key", "_large"), both.filter("_large").drop("_large")


def prior_sums(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], most: int = MOST, strict: bool = False) -> DataFrame:
    """Adds, by name, the sum of a column over the rows of the same key before each row; null where none has a value.

    With `strict` rows of the same instant (the first of `order`, a whole
    number or a time) are left out too; ranges are then cut between instants.
    """
    by = order[:1] if strict else order
    ranged, any_large = ranges(rows, key, by, most)
    values = {name: F.col(f"_v_{name}") for name in sums}
    ranged = ranged.withColumns({f"_v_{name}": c for name, c in sums.items()})
    window = W.partitionBy(key, PART) if any_large else W.partitionBy(key)  # dealt as other windows of the key, which then share the shuffle
    own = window.orderBy(F.col(order[0]).cast("long")).rangeBetween(W.unboundedPreceding, -1) if strict else window.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if not any_large:
        own_sums = {name: F.sum(v).over(own) for name, v in values.items()}
        return ranged.withColumns(own_sums).drop(PART, "_large", *[f"_v_{name}" for name in sums])
    before, n = _earlier(ranged, key, values)
    joined = ranged.join(small(before, n), F.col(key).eqNullSafe(F.col("_key")) & (F.col(PART) == F.col("_range")), "left")
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    found = joined.withColumns({name: both(F.sum(v).over(own), F.col(f"_b_{name}")) for name, v in values.items()})
    return found.drop(PART, "_large", "_key", "_range", *[f"_v_{name}" for name in sums], *[f"_b_{name}" for name in sums])


def positions(rows: DataFrame, key: str, order: list[str], out: str, most: int = MOST) -> DataFrame:
    """Adds a row's place within its key, from 1."""
    found = prior_sums(rows, key, order, {out: F.lit(1)}, most)
    return found.withColumn(out, (F.coalesce(out, F.lit(0)) + 1).cast("int"))


def key_totals(rows: DataFrame, key: str, totals: dict[str, Column], most: int = MOST) -> DataFrame:
    """Adds, by name, an aggregate over all rows of the same key: a window for most keys, for large ones a partial aggregation joined back."""
    large, n = large_keys(rows, key, most)
    whole = W.partitionBy(key)
    if not n:
        return rows.withColumns({name: c.over(whole) for name, c in totals.items()})
    plain, rest = _marked(rows, key, large, n)
    each = rest.groupBy(F.col("_key").alias("_whole")).agg(*[c.alias(f"_t_{name}") for name, c in totals.items()])  # one row a large key
    found = rest.join(small(each, n), F.col("_key").eqNullSafe(F.col("_whole"))).withColumns({name: F.col(f"_t_{name}") for name in totals}).drop("_key", "_whole", *[f"_t_{name}" for name in totals])
    return plain.withColumns({name: c.over(whole) for name, c in totals.items()}).unionByName(found)


def percent_ranks(rows: DataFrame, key: str, value: str, out: str, count: str, most: int = MOST) -> DataFrame:
    """Adds the rows of a key and each row's percent rank by value (0.0 for a key's only row).

    For large keys the rows are counted by value before anything is ordered, so
    that a value of any share of the rows is one row; nulls come first.
    """
    large, n = large_keys(rows, key, most)
    whole = W.partitionBy(key)
    window = {count: F.count("*").over(whole), out: F.percent_rank().over(whole.orderBy(value))}
    if not n:
        return rows.withColumns(window)
    plain, rest = _marked(rows, key, large, n)
    values = rest.groupBy("_key", F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    below = prior_sums(values, "_key", ["_value"], {"_below": F.col("_n")}, most)
    totals = values.groupBy(F.col("_key").alias("_whole")).agg(F.sum("_n").alias("_all"))
    ranked = cut(below.join(small(totals, n), F.col("_key").eqNullSafe(F.col("_whole"))).select("_whole", "_value", "_all", F.coalesce("_below", F.lit(0)).alias("_below")))
    found = rest.join(small(ranked, ranked.count()), F.col("_key").eqNullSafe(F.col("_whole")) & F.col(value).eqNullSafe(F.col("_value")))
    share = F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(0.0)
    return plain.withColumns(window).unionByName(found.withColumns({count: F.col("_all"), out: share}).drop("_key", "_whole", "_value", "_all", "_below"))
