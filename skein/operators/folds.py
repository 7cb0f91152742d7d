"""Ordered folds: budgets that skip or stop, and scores that never rise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut, stored

#: Tasks that look for the first rows of one list.
PARTS = 16


def _fold(items: Column, used: Column, budget: int) -> Column:
    """Items of struct<.., size> in order: take one if it still fits beside what is used; (used, kept: places in the list)."""
    start = F.struct(used.cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("at"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).cast("long").alias("used"),
            F.when(fits, F.array_append(acc["kept"], acc["at"])).otherwise(acc["kept"]).alias("kept"),
            (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(items, start, step)


def _first(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each list in the order of "o": those of its parts, then those of all of them."""
    part = Window.partitionBy(*keys, F.pmod(F.xxhash64("o"), F.lit(PARTS))).orderBy("o")
    whole = Window.partitionBy(*keys).orderBy("o")
    few = rows.withColumn("at", F.row_number().over(part)).filter(F.col("at") <= n)
    return few.withColumn("at", F.row_number().over(whole)).filter(F.col("at") <= n).drop("at")


def within_budget(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int, *, stop: bool = False, most: int = 2_000) -> DataFrame:
    """The rows of each key that fit into the budget, taken in order.

    Too large an item is skipped and smaller ones after it may still come; with stop the list ends there. Lists
    may be of any length; sizes are whole numbers from 0, and a null one never fits.

    With stop the end is known from sums: it is among the first budget + 1 rows that have a size. Else a round folds the
    next `most` rows that still fit, and what no longer fits beside the rows taken is dropped before the next
    one; the first row of a round always fits, so the rounds end. Rows of size 0 always fit.
    """
    if budget < 0:
        return df.limit(0)
    ks = [f"k{i}" for i, _ in enumerate(keys)]
    n = F.coalesce(F.col(size).cast("long"), F.lit(budget + 1).cast("long"))
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), n.alias("n"), F.struct(*df.columns).alias("row"))
    checked = F.when(n >= 0, n).otherwise(F.raise_error(F.lit("sizes below 0 have no fold")).cast("long"))
    rows = stored(df.select(*(F.col(c).alias(k) for k, c in zip(ks, keys, strict=True)), place.alias("o"), checked.alias("n")))
    same = lambda other: reduce(lambda a, k: a & rows[k].eqNullSafe(other[f"{k}_"]), ks, F.lit(True))
    named = [F.col(k).alias(f"{k}_") for k in ks]
    if stop:
        upto = F.sum("n").over(Window.partitionBy(*ks).orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
        ends = _first(rows.filter("n > 0"), ks, budget + 1).withColumn("upto", upto).filter(F.col("upto") > budget).groupBy(*ks).agg(F.min("o").alias("end")).select(*named, "end")
        return rows.join(ends, same(ends), "left").filter(F.col("end").isNull() | (F.col("o") < F.col("end"))).select("o.row.*")
    taken, used = [rows.filter("n = 0").select("o.row")], F.lit(0)
    free = rows.filter((F.col("n") > 0) & (F.col("n") <= budget)).withColumn("used", used)
    while True:
        lists = _first(free, ks, most).groupBy(*ks, "used").agg(F.array_sort(F.collect_list(F.struct("o", F.col("n").alias("size")))).alias("items"))
        folded = lists.select(*named, "items", _fold(F.col("items"), F.col("used"), budget).alias("f"))
        done = cut(folded.select(*(f"{k}_" for k in ks), F.col("f.used").alias("used"), F.transform("f.kept", lambda i: F.get("items", i)["o"]["row"]).alias("kept"), F.size("items").alias("n_items"), F.element_at("items", -1)["o"].alias("upto")))
        taken.append(done.select(F.explode("kept").alias("row")))
        left = done.filter((F.col("n_items") == most) & (F.col("used") < budget)).drop("kept", "n_items")
        if not left.limit(1).count():
            return reduce(lambda a, b: a.unionByName(b), taken).select("row.*")
        free = cut(rows.join(left, same(left)).filter((F.col("n") > 0) & (F.col("o") > F.col("upto")) & (F.col("used") + F.col("n") <= budget)).select(*rows.columns, "used"))


def never_rising(scores: Column, factor: float = 0.99) -> Column:
    """A list of scores in which none is above the one before: a higher one becomes factor times its predecessor."""
    out = F.aggregate(scores, F.array().cast("array<double>"), lambda acc, x: F.array_append(acc, F.when((F.size(acc) > 0) & (x > F.element_at(acc, -1)), F.element_at(acc, -1) * factor).otherwise(x)))
    return out
