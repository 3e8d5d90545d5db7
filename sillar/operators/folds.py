"""Sequential folds over ordered rows: budgets, groups, prefixes and line windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered(*cols):
    return F.array_sort(F.collect_list(F.struct(*cols)))


def skip_fit(df: DataFrame, group: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """Rows that fit a budget in order, skipping those that do not and going on: (group, order, used).

    The fold carries positions and sums only.  Null costs count as 0.
    """
    items = df.groupBy(*group).agg(_ordered(F.col(order).alias("o"), F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("c")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:{0},used:bigint>>".format(df.schema[order].dataType.simpleString())).alias("kept"))
    fold = F.aggregate("items", zero, lambda s, x: F.when(s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.array_append(s["kept"], F.struct(x["o"].alias("o"), (s["used"] + x["c"]).alias("used"))).alias("kept"))).otherwise(s))
    return items.select(*group, F.explode(fold["kept"]).alias("k")).select(*group, F.col("k.o").alias(order), F.col("k.used").alias("used"))


def next_fit(df: DataFrame, group: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """The part each row falls into when a part is closed as soon as the next row would overflow it: (group, order, part).

    A row above the budget gets a part of its own.
    """
    items = df.groupBy(*group).agg(_ordered(F.col(order).alias("o"), F.least(F.coalesce(F.col(cost), F.lit(0)), F.lit(budget)).cast("long").alias("c")).alias("items"))
    kind = df.schema[order].dataType.simpleString()
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(1).alias("part"), F.array().cast(f"array<struct<o:{kind},part:int>>").alias("out"))

    def step(s, x):
        closes = (s["used"] > 0) & (s["used"] + x["c"] > budget)
        part = F.when(closes, s["part"] + 1).otherwise(s["part"])
        used = F.when(closes, x["c"]).otherwise(s["used"] + x["c"])
        return F.struct(used.alias("used"), part.alias("part"), F.array_append(s["out"], F.struct(x["o"].alias("o"), part.alias("part"))).alias("out"))

    return items.select(*group, F.explode(F.aggregate("items", zero, step)["out"]).alias("k")).select(*group, F.col("k.o").alias(order), F.col("k.part").alias("part"))


def prefix_cut(df: DataFrame, group: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows before the first that overflows the budget; the first row always stays, no later row comes back in."""
    w = Window.partitionBy(*group).orderBy(*order)
    running = F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("used", running).withColumn("_n", F.row_number().over(w))
    over = F.max(F.when((F.col("used") > budget) & (F.col("_n") > 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_over", over).where("_over = 0").drop("_over", "_n")


def window_lines(text: str | None, size: int = 1500, back: int = 2) -> list[tuple[int, int, int]]:
    """Windows of whole lines of a text: (no, first line, last line), lines from 1.

    Lines are added until a window has ``size`` characters (each line counts one
    more); the next window starts ``back`` lines before its end, but always at
    least one line further, so texts of long lines come to an end.  Null gives no
    window, the empty text one.
    """
    if text is None:
        return []
    lengths = [len(x) + 1 for x in text.split("\n")]
    sums = np.concatenate([[0], np.cumsum(lengths)])
    out, start, n = [], 0, len(lengths)
    while start < n:
        end = int(np.searchsorted(sums, sums[start] + size, "left"))
        end = min(max(end, start + 1), n)
        out.append((len(out) + 1, start + 1, end))
        if end == n:
            break
        start = max(end - back, start + 1)
    return out


def line_windows(text):
    """``window_lines`` as a column."""

    @F.pandas_udf("array<struct<no:int,first:int,last:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"no": a, "first": b, "last": c} for a, b, c in window_lines(t)])

    return run(text)
