"""Joins that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Tables of up to so many bytes may be broadcast by :func:`lookup_join`.
LOOKUP_BYTES = 16_000_000
#: Rows of a key beyond which :func:`salted_join` spreads it.
HOT_ROWS = 1_000_000


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str, columns: list[str], strict: bool = False, cell: Callable[[Column], Column] | None = None
) -> DataFrame:
    """For each row of left, ``columns`` of the last row of right with the same ``by`` whose ``on`` is not later.

    With strict, earlier. Both sides are put under each other and sorted by key and time; the last row of right so
    far is carried down, so no pair is formed. Rows of left without a match get nulls, as do those with a null key or
    time; a right row with one matches nothing. Of several right rows at one time the largest by ``columns`` counts.

    ``cell``, a function of ``on`` that never falls (its day, say), splits keys of very many rows: each cell is
    sorted apart, and what is carried into it comes from a row for each key and cell.
    """
    extra = [c for c in left.columns if c not in (*by, on)]
    first = 0 if strict else 1
    rows_left = left.select(*by, on, F.lit(first).alias("_side"), F.struct(F.lit(1).alias("_"), *extra).alias("_left"))
    rows_right = right.dropna(subset=[*by, on]).select(*by, on, F.lit(1 - first).alias("_side"), F.struct(*columns).alias("_right"))
    both = rows_left.unionByName(rows_right, allowMissingColumns=True).withColumn("_cell", cell(F.col(on)) if cell else F.lit(0))
    sofar = Window.partitionBy(*by, "_cell").orderBy(F.col(on), F.col("_side"), F.col("_right")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = both.withColumn("_found", F.last("_right", ignorenulls=True).over(sofar)).where(F.col("_left").isNotNull())
    if cell:
        last = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct(on, "_right"))).alias("_last")
        before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*by, "_cell").agg(last).withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
        kept = kept.join(carried, [*by, "_cell"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    found = F.when(F.col(on).isNotNull(), F.col("_found"))
    return kept.withColumn("_found", found).select(*by, on, *[F.col(f"_left.{c}").alias(c) for c in extra], *[F.col(f"_found.{c}").alias(c) for c in columns])


def band_join(left: DataFrame, right: DataFrame, left_key: str, right_low: str, right_high: str, width: float, by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with right_low <= left_key <= right_high (numbers), by way of an equi-join on cells of ``width``.

    A right row goes to every cell its band touches, a left row to its own, so each pair meets once; pick
    ``width`` near the usual band.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    l = left.withColumn("_cell", cell(left_key))
    r = right.withColumn("_cell", F.explode(F.sequence(cell(right_low), cell(right_high))))
    on = (l["_cell"] == r["_cell"]) & (l[left_key] >= r[right_low]) & (l[left_key] <= r[right_high])
    for a, b in by:
        on &= l[a] == r[b]
    return l.join(r, on).drop("_cell")


def salted_join(big: DataFrame, small: DataFrame, key: str, hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """An equi-join that spreads hot keys: those with more than hot_rows rows in big.

    Rows of big with such a key get one of ceil(rows / hot_rows) numbers, rows of small all of them; other rows stay
    one each. Keys are counted with partial sums.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep the big side's rows can be salted")
    hot = big.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = hot.select(key, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))
    columns = [F.col(c) for c in big.columns]
    salts = F.coalesce("_salts", F.lit(1))
    b = lookup_join(big, hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*columns), salts).cast("int")).drop("_salts")
    s = lookup_join(small, hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return b.join(s, [key, "_salt"], how).drop("_salt")


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", most: int = LOOKUP_BYTES) -> DataFrame:
    """Broadcasts lookup if its values take no more than ``most`` bytes, and lets Spark choose otherwise."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in lookup.columns), F.lit(16 * len(lookup.columns)))
    size = lookup.agg(F.sum(width.cast("long")).alias("n")).first()["n"] or 0
    return facts.join(F.broadcast(lookup) if size <= most else lookup, key, how)


def seconds_of(df: DataFrame, name: str) -> Column:
    """Whole seconds of a timestamp; of one without a time zone, seconds of its own clock."""
    at = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.datediff(at, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.unix_seconds(at)


def interval_pairs(left: DataFrame, right: DataFrame, by: str, at: str, within: str, right_at: str) -> DataFrame:
    """Pairs of one key where right_at lies in (at, at + within].

    Times fall in cells as long as ``within``; a left row goes to its own and the next, so only rows that are near
    in time meet, however many a key has.
    """
    width = left.sparkSession.sql(f"SELECT INTERVAL {within} AS w").first()["w"].total_seconds()
    cell = lambda df, c: F.floor(seconds_of(df, c) / width)
    l = left.withColumn("_cell", F.explode(F.sequence(cell(left, at), cell(left, at) + 1)))
    r = right.withColumn("_cell", cell(right, right_at))
    after = F.col(right_at) > F.col(at)
    return l.join(r, [by, "_cell"]).where(after & (F.col(right_at) <= F.expr(f"{at} + INTERVAL {within}"))).drop("_cell")


def count_below(left: DataFrame, right: DataFrame, by: str, left_value: str, right_value: str, width: float, name: str = "n") -> DataFrame:
    """Adds to left how many rows of right with the same ``by`` have a smaller value; no pair is formed.

    Values are sorted within cells of ``width``, and the counts of the cells before are added. Null values count nothing and are not counted.
    """
    extra = [c for c in left.columns if c not in (by, left_value)]
    l = left.select(F.col(by).alias("_by"), F.col(left_value).alias("_value"), F.lit(0).alias("_one"), F.struct("*").alias("_left"))
    r = right.dropna(subset=[by, right_value]).select(F.col(by).alias("_by"), F.col(right_value).alias("_value"), F.lit(1).alias("_one"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_cell", F.floor(F.col("_value") / width))
    here = Window.partitionBy("_by", "_cell").orderBy("_value", "_one").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_by").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = both.groupBy("_by", "_cell").agg(F.sum("_one").alias("_n")).withColumn("_before", F.sum("_n").over(before)).drop("_n")
    kept = both.withColumn("_here", F.sum("_one").over(here)).where(F.col("_left").isNotNull()).join(cells, ["_by", "_cell"], "left")
    total = F.when(F.col("_value").isNotNull(), F.col("_here") + F.coalesce("_before", F.lit(0))).otherwise(F.lit(0))
    return kept.select(*[F.col(f"_left.`{c}`") for c in (by, left_value, *extra)], total.cast("long").alias(name))
