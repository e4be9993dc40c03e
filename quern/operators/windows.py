"""Window forms that Spark's SQL lacks, and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def qualify(df: DataFrame, window_value: Column, keep, name: str = "_q") -> DataFrame:
    """Rows whose window value passes ``keep``; the filter that QUALIFY is."""
    return df.withColumn(name, window_value).where(keep(F.col(name))).drop(name)


def over_groups(df: DataFrame, value: Column, by: list[str], order: str, before: int, after: int, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: the peers from ``before`` groups back to ``after`` groups on.

    Groups of peers are numbered by dense_rank, and the frame is a range of numbers.
    """
    numbered = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*by).orderBy(order)).cast("long"))
    frame = Window.partitionBy(*by).orderBy("_group").rangeBetween(-before, after)
    return numbered.withColumn(name, value.over(frame)).drop("_group")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, ties: bool = False) -> DataFrame:
    """The first k rows of each group; with ties, also those that rank like the last."""
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def sessions(events: DataFrame, by: str, at: str, gap: str, ties: list[str] = ()) -> DataFrame:
    """Adds session, numbered from 1 for each key: a new one after a pause of more than ``gap``.

    Rows at one time are in one session, so ``ties`` only matters for what else is done in their order.
    """
    order = Window.partitionBy(by).orderBy(at, *ties)
    pause = F.lag(at).over(order)
    opens = F.when(pause.isNull() | (F.col(at) > pause + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    return events.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(order)).drop("_opens")


def gaps_filled(df: DataFrame, by: str, at: str, unit: str, value: str) -> DataFrame:
    """A row for each key and unit of time between its first and last, missing values carried forward."""
    span = df.groupBy(by).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    grid = span.select(by, F.explode(F.expr(f"sequence(_low, _high, INTERVAL 1 {unit})")).alias(at))
    order = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(df.select(by, at, value), [by, at], "left").withColumn(value, F.last(value, ignorenulls=True).over(order))


def over_range(df: DataFrame, value: Column, by: list[str], order: str, before: int, name: str) -> DataFrame:
    """An aggregate over the rows of a key whose ``order`` (a whole number) is up to ``before`` less, or the same.

    Keys are split into cells of ``before``: a row is sorted in its own cell, and is a guest in the next, so a
    key of very many rows is not one task. Rows without an order are left to themselves. Spark goes through a row's whole frame for
    each row: for sums and counts take :func:`scans.over_range`.
    """
    cell = F.floor(F.col(order) / before)
    places = F.array(F.struct(cell.alias("cell"), F.lit(False).alias("guest")), F.struct((cell + 1).alias("cell"), F.lit(True).alias("guest")))
    frame = Window.partitionBy(*by, "_place.cell").orderBy(order).rangeBetween(-before, 0)
    return df.withColumn("_place", F.explode(F.when(F.col(order).isNull(), F.slice(places, 1, 1)).otherwise(places))).withColumn(name, value.over(frame)).where(~F.col("_place.guest")).drop("_place")


def ranked(df: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Adds _rank, from 0, and _n of the non-null values of a key (a number), sorted within cells of ``width`` only."""
    celled = df.where(F.col(value).isNotNull()).withColumn("_cell", F.floor(F.col(value) / width))
    counted = celled.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({"_before": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_n": F.sum("_in").over(Window.partitionBy(*by))})
    within = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(value)) - 1
    return celled.withColumn("_within", within).join(counted.drop("_in"), [*by, "_cell"]).withColumn("_rank", F.col("_before") + F.col("_within")).drop("_cell", "_within", "_before")


def quantiles(df: DataFrame, by: list[str], value: str, width: float, interpolated: dict[str, float], discrete: dict[str, float] | None = None) -> DataFrame:
    """Exact quantiles of each key, named as in the dicts: between neighbours, or the least value with that share up to it.

    No key is gathered whole: values are ranked by way of cells of ``width``, and only the rows at the ranks count.
    Keys without a value don't appear.
    """
    rows = ranked(df.select(*by, value), by, value, width)
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col(value)))
    told = []
    for name, p in interpolated.items():
        place = (F.col("_n") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        told.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    for name, p in (discrete or {}).items():
        told.append(at(F.greatest(F.ceil(F.col("_n") * p) - 1, F.lit(0))).alias(name))
    return rows.groupBy(*by).agg(*told)
