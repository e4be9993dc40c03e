"""Windows over keys of very many rows: prefix scans by cells.

A cell is a value that never falls along the order (a day of a time, a range of numbers). Rows are sorted within a key's cell
only; what cells hand on comes from a table of one row a key and cell. Null keys are a key, and rows of a null order come first, as in
Spark's own windows. Peers are in one cell, since it depends on what the order is by.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

_BEFORE = (Window.unboundedPreceding, -1)
_KINDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def _beside(rows: DataFrame, cells: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of their cell; null keys and cells meet, too."""
    renamed = cells.withColumnsRenamed({c: f"_of_{c}" for c in [*by, "_cell"]})
    on = None
    for c in [*by, "_cell"]:
        same = rows[c].eqNullSafe(renamed[f"_of_{c}"])
        on = same if on is None else on & same
    return rows.join(renamed, on, how).drop(*[f"_of_{c}" for c in [*by, "_cell"]])


def scan(df: DataFrame, by: list[str], order: list, cell: Column, values: dict[str, tuple[str, Column]], peers: bool = True) -> DataFrame:
    """Adds running aggregates from a key's first row on, to the current row and (``peers``) those that are equal in the order.

    ``values``: name: (kind, column), kind being sum, count, min, max or last (the last that is not null).
    """
    celled = df.withColumn("_cell", cell)
    within = Window.partitionBy(*by, "_cell").orderBy(*order)
    within = within.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(*_BEFORE)
    held = celled.withColumns({f"_in_{n}": c for n, (_, c) in values.items()})
    cells = held.groupBy(*by, "_cell").agg(*[_whole(k, F.col(f"_in_{n}"), order).alias(n) for n, (k, _) in values.items()])
    cells = cells.withColumns({f"_carried_{n}": _KINDS["sum" if k == "count" else k](n).over(earlier) for n, (k, _) in values.items()}).drop(*values)
    here = held.withColumns({f"_here_{n}": _KINDS[k](f"_in_{n}").over(within) for n, (k, _) in values.items()})
    out = _beside(here, cells, by)
    for n, (k, _) in values.items():
        out = out.withColumn(n, _both(k, F.col(f"_here_{n}"), F.col(f"_carried_{n}")))
    return out.drop("_cell", *[f"_{x}_{n}" for n in values for x in ("in", "here", "carried")])


def _whole(kind: str, value: Column, order: list) -> Column:
    """What a cell hands on; of ``last``, the value of the last row that has one."""
    if kind != "last":
        return _KINDS[kind](value)
    if any(not isinstance(c, str) for c in order):
        raise ValueError("last needs an order of column names, from the least on")
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def _both(kind: str, here: Column, carried: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(here.isNull(), carried).when(carried.isNull(), here).otherwise(here + carried)
    return {"min": F.least, "max": F.greatest, "last": F.coalesce}[kind](here, carried)


def ranks(df: DataFrame, by: list[str], order: list, cell: Column, names: dict[str, str]) -> DataFrame:
    """Adds ranks of a key's rows; ``names``: what to its column: row_number, rank, dense_rank, rows (of the key), up_to (rows up to the last peer).

    The others are made of these: percent_rank is (rank - 1) / (rows - 1), cume_dist up_to / rows, ntile :func:`tile`.
    """
    celled = df.withColumn("_cell", cell)
    within = Window.partitionBy(*by, "_cell").orderBy(*order)
    peers = within.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = celled.withColumns({"_row": F.row_number().over(within), "_rank": F.rank().over(within), "_dense": F.dense_rank().over(within), "_upto": F.count(F.lit(1)).over(peers)})
    cells = here.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_rows"), F.max("_dense").alias("_values"))
    earlier = Window.partitionBy(*by).orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(*_BEFORE)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = {"_rows_before": zero(F.sum("_rows").over(earlier)), "_values_before": zero(F.sum("_values").over(earlier)), "_all": F.sum("_rows").over(Window.partitionBy(*by))}
    out = _beside(here, cells.withColumns(sums).drop("_rows", "_values"), by)
    told = {"row_number": F.col("_rows_before") + F.col("_row"), "rank": F.col("_rows_before") + F.col("_rank"), "dense_rank": F.col("_values_before") + F.col("_dense"), "rows": F.col("_all"), "up_to": F.col("_rows_before") + F.col("_upto")}
    return out.withColumns({name: told[what] for what, name in names.items()}).drop("_cell", "_row", "_rank", "_dense", "_upto", "_rows_before", "_values_before", "_all")


def tile(row_number: Column, rows: Column, n: int) -> Column:
    """ntile(n) from a row's number and its key's rows: the first rows % n tiles have a row more."""
    small, more = F.floor(rows / n), rows % n
    wide = more * (small + 1)
    return F.when(row_number <= wide, F.floor((row_number - 1) / (small + 1))).otherwise(more + F.floor((row_number - 1 - wide) / F.greatest(small, F.lit(1)))) + 1


def near_rows(df: DataFrame, by: list[str], order: list, cell: Column, before: int, after: int, values: Callable[[WindowSpec], dict[str, Column]], block: int = 100_000) -> DataFrame:
    """Adds what ``values`` makes of a window over a key's rows in order, which looks back ``before`` rows and ahead ``after`` at most.

    Rows are numbered by :func:`ranks` and sorted in blocks of ``block`` numbers; the last rows of a block are guests in
    the next and the first ones in that before. Order rows fully: which of two equal ones comes first is left to chance, as in Spark.
    """
    if block < max(before, after, 1):
        raise ValueError("a block must hold what a window looks back or ahead")
    numbered = ranks(df, by, order, cell, {"row_number": "_number"}).withColumn("_number", F.col("_number") - 1)
    own, at = F.floor(F.col("_number") / block), F.col("_number") % block
    place = lambda number, guest: F.struct(number.alias("block"), F.lit(guest).alias("guest"))
    places = [place(own, False), F.when(at >= block - before, place(own + 1, True)) if before else None, F.when((at < after) & (own > 0), place(own - 1, True)) if after else None]
    placed = numbered.withColumn("_place", F.explode(F.array_compact(F.array(*[p for p in places if p is not None]))))
    window = Window.partitionBy(*by, "_place.block").orderBy("_number")
    return placed.withColumns(values(window)).where(~F.col("_place.guest")).drop("_place", "_number")


def sessions(events: DataFrame, by: str, at: str, gap: str, cell: Column) -> DataFrame:
    """Adds session, numbered from 1 for each key: a new one after a pause of more than ``gap``. Rows at one time are in one session.

    Pauses are found within cells, and at a cell's first rows from the last time before it. Rows without a time are a session of their own, the first.
    """
    width = F.expr(f"INTERVAL {gap}")
    celled = events.withColumn("_cell", cell)
    earlier = Window.partitionBy(by).orderBy(F.col("_cell").asc_nulls_first())
    cells = celled.groupBy(by, "_cell").agg(F.max(at).alias("_last")).withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier.rowsBetween(*_BEFORE))).drop("_last")
    cells = cells.withColumn("_first", F.row_number().over(earlier) == 1)
    # the first row of a cell looks at the cells before, the others at the row before
    joined = _beside(celled, cells, [by])
    order = Window.partitionBy(by, "_cell").orderBy(at)
    pause = F.coalesce(F.lag(at).over(order), F.col("_carried"))
    opens = F.when(F.row_number().over(order) == 1, F.col("_first") | pause.isNull() | (F.col(at) > pause + width)).otherwise(F.col(at) > pause + width)
    marked = joined.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("long")).drop("_carried", "_first", "_cell")
    return scan(marked, [by], [at], cell, {"session": ("sum", F.col("_opens"))}).drop("_opens")


def over_groups(df: DataFrame, by: list[str], order: str, before: int, after: int, values: dict[str, tuple[str, Column]], cell: Column) -> DataFrame:
    """Adds aggregates (sum, count, min or max of a column) over a GROUPS frame: the peers from ``before`` groups back to ``after`` groups on.

    Peers are aggregated first, so the frame runs over a row for each different value of the order, in blocks.
    """
    peers = df.groupBy(*by, order).agg(*[_KINDS[k](c).alias(f"_{n}") for n, (k, c) in values.items()])
    frame = lambda w: {n: _KINDS["sum" if k == "count" else k](f"_{n}").over(w.rowsBetween(-before, after)) for n, (k, _) in values.items()}
    framed = near_rows(peers, by, [F.col(order).asc_nulls_first()], cell, before, after, frame).select(*by, F.col(order).alias("_cell"), *values)
    return _beside(df.withColumn("_cell", F.col(order)), framed, by).drop("_cell")


def over_range(df: DataFrame, by: list[str], order: str, before: int, values: dict[str, tuple[str, Column]], width: int | None = None) -> DataFrame:
    """Adds sums and counts of a column over the rows of a key whose ``order`` (a whole number) is up to ``before`` less, or the same.

    Each is what runs up to a row's value less what runs up to all below the frame, so a row costs the same however many its frame holds. Rows of one
    value are aggregated first. Rows are sorted in cells of ``width``, that of the frame unless another is given. Rows without an order are each other's only ones.
    """
    if any(k not in ("sum", "count") for k, _ in values.values()):
        raise ValueError("only sums and counts can be taken apart")
    peers = df.groupBy(*by, F.col(order).alias("_own")).agg(*[_KINDS[k](c).alias(f"_{n}") for n, (k, c) in values.items()])
    # what is in sums counts its terms, too: a frame of nulls only has no sum
    peers = peers.withColumns({f"_terms_{n}": F.col(f"_{n}").isNotNull().cast("long") for n in values})
    parts = [f"_{x}{n}" for n in values for x in ("", "terms_")]
    ends = peers.where("_own IS NOT NULL").withColumns({"_at": F.col("_own"), "_end": F.lit(1)})
    starts = ends.select(*by, "_own", F.try_subtract("_own", F.lit(before)).alias("_at"), F.lit(0).alias("_end"), *[F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in parts])
    marks = ends.unionByName(starts.where("_at IS NOT NULL"))
    cell = F.floor(F.col("_at") / (width or max(before, 1)))
    run = scan(marks, by, ["_at", "_end"], cell, {f"_run{c}": ("sum", F.col(c)) for c in parts})
    signed = {c: F.sum(F.coalesce(F.when(F.col("_end") == 1, F.col(f"_run{c}")).otherwise(-F.col(f"_run{c}")), F.lit(0))) for c in parts}
    framed = run.groupBy(*by, "_own").agg(*[v.alias(c) for c, v in signed.items()])
    framed = framed.unionByName(peers.where("_own IS NULL"))
    told = [(F.col(f"_{n}") if k == "count" else F.when(F.col(f"_terms_{n}") > 0, F.col(f"_{n}"))).alias(n) for n, (k, _) in values.items()]
    return _beside(df.withColumn("_cell", F.col(order)), framed.select(*by, F.col("_own").alias("_cell"), *told), by).drop("_cell")
