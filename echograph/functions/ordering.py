"""Places in a total order of a whole table, without a task that sees all its rows.

Rows are dealt by range, sorted within their partition and stored; what meets in one place is a row for
each partition, with its number of rows and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.session import materialise


def numbered(df: DataFrame, order: list[Column | str], name: str = "place", running: dict[str, str] | None = None) -> DataFrame:
    """df with each row's place in ``order``, from 1, and for each ``running`` (new name: column) the sum
    of the column up to the row."""
    running = running or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialise(dealt.withColumns({"_part": F.spark_partition_id(), "_at": at}), "ordered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{k}") for k, c in running.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"), *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_sum_{k}") for k in running])
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(sizes), "_part")
    out = out.withColumns({name: F.col("_base") + F.col("_at") + 1, **{k: F.col(f"_sum_{k}") + F.sum(c).over(own) for k, c in running.items()}})
    return out.drop("_part", "_at", "_base", *[f"_sum_{k}" for k in running])


def ranked(df: DataFrame, col: str, name: str = "rank", ties: str = "average", descending: bool = False, tie_break: list[str] | None = None) -> DataFrame:
    """df with the rank of col: ``ordinal`` with ties cut by ``tie_break``, the ``average`` of equal values'
    places, or the ``least`` of them. Ranks are of whole numbers but for ``average``."""
    order = [F.desc(col) if descending else F.asc(col)]
    if ties == "ordinal":
        return numbered(df, [*order, *(tie_break or [])], name)
    values = numbered(df.groupBy(col).agg(F.count("*").alias("_same")), order, "_step", {"_upto": "_same"})
    least = F.col("_upto") - F.col("_same") + 1
    rank = least if ties == "least" else least + (F.col("_same") - 1) / 2
    return df.join(values.select(F.col(col).alias("_value"), rank.alias(name)), F.col(col).eqNullSafe(F.col("_value"))).drop("_value")


def middle(df: DataFrame, by: list[str], col: str, name: str = "upper_median") -> DataFrame:
    """(by, name): the element at n // 2 of each group's sorted values, nulls left out. Equal values count
    once in the order, with how often they occur."""
    values = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_same"))
    placed = numbered(values, [*by, col], "_step", {"_upto": "_same"})
    names = [f"_by{k}" for k in range(len(by))]
    sizes = placed.groupBy(*by).agg(F.max("_upto").alias("_last"), F.sum("_same").alias("_all")).toDF(*names, "_last", "_all")
    target = F.col("_last") - F.col("_all") + F.floor(F.col("_all") / 2) + 1
    same = F.lit(True)
    for c, other in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(other))
    hit = placed.join(sizes, same).filter((F.col("_upto") >= target) & (F.col("_upto") - F.col("_same") < target))
    return hit.select(*by, F.col(col).alias(name))
