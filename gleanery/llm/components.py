"""Groups dealt into cells of pairs of blocks, and what connects their items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.components import star_components as components
from gleanery.operators.lineage import cut

__all__ = ["cells", "components", "connections"]


def cells(items: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """Adds `cell` (k, i, j) and `block` so that any two items of a key share a cell of at most about 2 * `most` items.

    A key of up to `most` items is one cell.  A larger one is dealt into blocks,
    with a cell for each pair of blocks, so that no task holds the whole key.
    """
    counts = items.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    dealt = items.join(counts, key, "left").withColumn("_k", F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))
    return dealt.withColumn("block", F.pmod(F.xxhash64(item), F.col("_k"))).withColumn("_o", other).withColumn("cell", F.struct(F.col(key).alias("k"), F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"))).drop("_n", "_k", "_o")


DRAWN = 4


def connections(items: DataFrame, key: str, item: str, most: int, compare: Callable[[DataFrame], DataFrame], members: DataFrame | None = None) -> DataFrame:
    """(a, b): edges that connect what links connect among the items of each key.

    `members` has the key of every item where that is cheaper to count.
    `compare` takes items with `cell` (k, i, j) and `block`, and returns enough
    edges to connect all linked items of each cell: any two where i = j, else
    those of different blocks only.  A key of up to `most` items is one cell.
    The items of a larger one are dealt into blocks and compared within them;
    then a few of each component so found are compared with those of the others;
    and only keys that still have several components, and items that were not
    drawn, compare all items across blocks.  A group of near copies, however
    large, is one component after the second step, at a cost in proportion to
    it; where nothing links, no pair is compared twice.
    """
    counts = cut((items if members is None else members).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most))
    alone = lambda df, block: df.withColumn("block", block).withColumn("cell", F.struct(F.col(key).alias("k"), F.col("block").alias("i"), F.col("block").alias("j")))
    whole = F.lit(0).cast("long")
    if not counts.limit(1).count():
        return compare(alone(items, whole))
    small = compare(alone(items.join(counts, key, "left_anti"), whole))
    columns = items.columns
    large = items.join(counts, key)
    within = cut(compare(alone(large, F.pmod(F.xxhash64(item), F.ceil(F.col("_n") / most))).drop("_n")))
    known = components(within).withColumnsRenamed({"node": item, "root": "_root"})
    named = large.drop("_n").join(known, item, "left").withColumn("_root", F.coalesce("_root", F.col(item)))
    drawn = F.array_distinct(F.array(*[F.min_by(F.struct(*columns), F.xxhash64(item, F.lit(k))) for k in range(DRAWN)]))
    few = cut(named.groupBy(key, "_root").agg(drawn.alias("_few")).select(F.explode("_few").alias("_x")).select("_x.*"))
    drawn_of = few.groupBy(key).agg(F.count("*").alias("_drawn"))
    all_drawn = cut(counts.join(drawn_of, key).filter("_drawn = _n").select(key, F.lit(True).alias("_all")))  # blocks are as before: what lies within them is compared
    meeting = cells(few, key, item, most).join(all_drawn, key, "left").filter("_all IS NULL OR cell.i <> cell.j").drop("_all")
    between = cut(compare(meeting))
    both = within.unionByName(between)
    known = components(both).withColumnsRenamed({"node": item, "root": "_root"})
    roots = large.select(key, item).join(known, item, "left").select(key, F.coalesce("_root", F.col(item)).alias("_root"))
    several = roots.groupBy(key).agg(F.min("_root").alias("_a"), F.max("_root").alias("_b")).filter("_a <> _b").select(key)
    open_ = cut(several.join(all_drawn, key, "left_anti"))
    rest = compare(cells(items.join(open_, key, "left_semi"), key, item, most).filter("cell.i <> cell.j"))
    return small.unionByName(both).unionByName(rest)
