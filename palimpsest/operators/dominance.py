"""Sums over points that come before a query in two orders at once, such as time and place, without pairs of the two.

The points of a key are numbered by their first coordinate. A query's points are a prefix of these numbers. A block of 16 ** (k + 1)
numbers is 16 blocks of 16 ** k; for each k a query asks for those of its own block that lie before it, in which 15 running sums
by the second coordinate answer, one for each of the smaller blocks. A point is in one block for each hexadecimal digit of the
number of points, so n points and queries make some n log n rows (16 the base), whatever a key's share of them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of the 16 blocks of a block, those that may lie before a query.
BLOCKS = 15


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def sums(points: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, upto, below of each query: the sums of ``w`` of its key's points with t up to the query's, and of those with a smaller x.

    points: keys, t, x, w (a long). queries: keys, id (unique in its key), t, x. t and x are of any type that has an order, null
    comes first. A key without points: 0, 0. Points of a key without queries are left out of the result.
    """
    p = points.select(*keys, "t", "x", F.col("w").cast("long").alias("w"), F.lit(0).alias("ask"), F.lit(None).cast(queries.schema["id"].dataType).alias("id"))
    q = queries.select(*keys, "t", "x", F.lit(0).cast("long").alias("w"), F.lit(1).alias("ask"), "id")
    by_t = W.partitionBy(*keys).orderBy("t", "ask").rowsBetween(W.unboundedPreceding, 0)
    rows = p.unionByName(q).withColumns({
        "upto": F.sum("w").over(by_t), "count": F.sum(1 - F.col("ask")).over(by_t), "n": F.sum(1 - F.col("ask")).over(W.partitionBy(*keys)),
    })
    # a point's number is how many came before it; a query's how many it asks for
    number = F.col("count") - 1 + F.col("ask")
    levels = F.sequence(F.lit(0), F.length(F.hex("n")) - 1)
    digit = lambda k: _shifted(F.col("number"), 4 * k).bitwiseAND(15)
    # the last of 16 blocks is before nothing, and before the first of them is nothing
    mine = F.filter(levels, lambda k: F.when(F.col("ask") == 1, digit(k) > 0).otherwise(digit(k) < BLOCKS))
    # slim rows: v is a point's w or a query's upto, part a point's block or, below zero, the number of blocks that a query asks for
    rows = rows.select(*keys, "id", "ask", "x", F.when(F.col("ask") == 1, F.col("upto")).otherwise(F.col("w")).alias("v"), number.alias("number"), "n")
    rows = rows.select(*keys, "id", "ask", "x", "v", "number", F.explode_outer(mine).alias("level"))
    part = F.when(F.col("ask") == 1, -F.coalesce(digit(F.col("level")), F.lit(0))).otherwise(digit(F.col("level"))).cast("int")
    rows = rows.where("ask = 1 or level is not null").select(*keys, "id", "ask", "x", "v", part.alias("part"), (_shifted(F.col("number"), 4 * F.coalesce("level", F.lit(0)) + 4) * 16 + F.coalesce("level", F.lit(0))).alias("block"))
    by_x = W.partitionBy(*keys, "block").orderBy("x", F.col("ask").desc()).rowsBetween(W.unboundedPreceding, 0)
    below = lambda k: F.when(F.col("part") < -k, F.coalesce(F.sum(F.when((F.col("ask") == 0) & (F.col("part") == k), F.col("v"))).over(by_x), F.lit(0))).otherwise(0)
    rows = rows.withColumns({f"__b{k}": below(k) for k in range(BLOCKS)}).where("ask = 1")
    total = functools.reduce(lambda a, b: a + b, [F.col(f"__b{k}") for k in range(BLOCKS)])
    return rows.groupBy(*keys, "id").agg(F.first("v").alias("upto"), F.sum(total).alias("below"))
