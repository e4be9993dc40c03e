"""Mixing the sources of a corpus to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.common import WORD, unused

#: A source table of up to so many rows is broadcast (a name and three numbers each: a few MB); a larger one is joined with salt.
BROADCAST_SOURCES = 50_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, size) of documents -> (source, source_size, target), a row for each source, null among them.

    The sources in code-point order, null last, weigh ``weights`` over and over. They share ``share`` times all
    sizes; no target is above ``ceiling`` times its source's size, and what is cut goes to the others by weight.
    Sorted by size over weight, the sources at their ceiling come first: source k is below it if (all - the
    ceilings before k) / (the weights from k on) is at most its own ceiling over its weight. Both windows run
    over a row per source, never over documents. The first source below its ceiling has the highest level of
    those that are. Sources without words have target 0.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = per_source.select("source", "source_size", weight.cast("long").alias("weight"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - ceiling * before) / rest
    full = F.col("level") * F.col("weight") > ceiling * F.col("source_size")
    filled = weighed.withColumn("level", level).withColumn("full", full)
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return filled.select("source", "source_size", F.when(F.col("full"), ceiling * F.col("source_size")).otherwise(water * F.col("weight")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that the key and the seed alone decide."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / float(2**32)


def with_copies(docs: DataFrame, seed: int = 42, **plan) -> DataFrame:
    """Adds size, source_size, target and copies to documents.

    Null texts have size 0; null sources are a source of their own. rate = target / source_size (0 for a source
    without words); a document is taken floor(rate) times, and once more if its hashed number is below the rest.
    Columns of these names in docs are replaced. Rows that repeat get the same decision. Empty in, empty out.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    targets = source_targets(docs.select("source", "size"), **plan)
    name, none, salt = (unused(docs, x) for x in ("name", "none", "salt"))
    key = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    targets = targets.select(key[0].alias(name), key[1].alias(none), "source_size", "target")
    docs = docs.withColumns({name: key[0], none: key[1]})
    on = [name, none]
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    else:
        docs = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        targets = targets.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on.append(salt)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    once_more = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed) < rate - whole
    return docs.join(targets, on).withColumn("copies", (whole + F.when(once_more, 1).otherwise(0)).cast("int")).drop(*on)


def mix(docs: DataFrame, seed: int = 42, **plan) -> DataFrame:
    """The mixed corpus: every document as many times as its source's rate says, with the columns of docs."""
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))
    taken = with_copies(rows, seed, **plan).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
