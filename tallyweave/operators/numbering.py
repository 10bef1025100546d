"""Places of rows in a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The bits of a step's number: keys that cut the rows into ranges are found among so many coarse ones, then among so many behind one of these.
BITS = 6
FAN = 2**BITS
#: The most cuts, which are the rows that the driver's side of the plan holds; one range more.
CUTS = FAN * FAN - 1


def _not_above(cuts: str, key: Column) -> Column:
    """How many of the sorted cuts, fewer than ``FAN``, are not above the key, by one comparison for each bit of the number.

    The key goes in as an array of one, so that it is made once and not for each comparison.
    """
    steps = F.array(*(F.lit(2**n) for n in reversed(range(BITS))))
    search = lambda k: F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(cuts, low + step - 1) <= k, low + step).otherwise(low))
    return F.transform(F.array(key), search)[0]


def _ranged(rows: DataFrame, key: Column, cuts: DataFrame) -> DataFrame:
    """``rows`` with ``_range``: how many of the sorted ``_cuts`` are not above the key.

    A row meets the coarse cuts and the fine ones behind one of them, never all: what a join adds to a row is copied with it.
    """
    coarse = cuts.select(F.filter("_cuts", lambda c, i: i % FAN == FAN - 1).alias("_coarse"))
    fine = cuts.select("_cuts", F.explode(F.sequence(F.lit(0), F.floor(F.size("_cuts") / FAN).cast("int"))).alias("_group")).select("_group", F.slice("_cuts", F.col("_group") * FAN + 1, F.lit(FAN - 1)).alias("_fine"))
    grouped = rows.join(F.broadcast(coarse)).withColumn("_group", _not_above("_coarse", key)).drop("_coarse")
    return grouped.join(F.broadcast(fine), "_group").withColumn("_range", F.col("_group") * FAN + _not_above("_fine", key)).drop("_group", "_fine")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the place of a row by the columns ``order``, from 1; nulls come first.

    Rows that tie stand in the order of a digest of their other columns, so a place depends on the rows alone, and a key that very many rows
    share is spread over the ranges. Up to ``CUTS`` keys with the smallest digests cut the ranges: an even sample of the rows, the same
    whenever the plan is evaluated. Rows are counted by range, the counts run over the ranges, and rows run within their range.
    """
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if c not in order and "map<" not in kind]
    tied = df.withColumn("_tie", F.xxhash64(*rest) if rest else F.lit(0).cast("long"))
    by = [*order, "_tie"]
    key = F.struct(*by)
    chosen = tied.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(CUTS)
    cuts = chosen.agg(F.sort_array(F.collect_set("k")).alias("_cuts"))
    ranged = _ranged(tied, key, cuts)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range: CUTS + 1 at most
    bases = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*by)
    return ranged.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(bases), "_range").withColumn(out, F.col("_base") + F.col("_in")).drop("_range", "_base", "_in", "_tie")
