"""Document fingerprints by spot signatures: what follows the common words of a text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.common import with_ranges

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "of", "on",
    "or", "that", "the", "this", "to", "was", "with",
    "als", "auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "mit", "nicht", "sich",
    "sie", "und", "von", "zu",
    "au", "avec", "ce", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour",
    "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)

#: Documents side by side in one range; a range's neighbours need one of its documents besides.
ROWS_PER_RANGE = 32


def signatures(text: Column) -> Column:
    """The sorted set of spot signatures of a text, 8 hex digits each.

    Words are runs of letters and digits, in lower case. Each run of common words opens a chain of the next two
    other words, common words between them skipped; a signature is the start of the chain's MD5. A text without
    any chain has one signature, its own; the empty text (and null) has none.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(*ANCHORS), "#").otherwise(w)), " ")
    runs = F.regexp_replace(marked, "#[# ]*", "# ")
    chains = F.array_distinct(F.regexp_extract_all(runs, F.lit("# (?=([^# ]+ (?:# )?[^# ]+))"), F.lit(1)))
    digest = lambda x: F.substring(F.md5(x), 1, 8)
    found = F.array_sort(F.array_distinct(F.transform(chains, lambda x: digest(F.replace(x, F.lit("# "), F.lit(""))))))
    return F.when(F.size(chains) > 0, found).when(text == "", F.array().cast("array<string>")).otherwise(F.array(digest(text)))


def fingerprint(sigs: Column) -> Column:
    """The whole set as one string."""
    return F.array_join(sigs, "")


def unfold(folded: Column) -> Column:
    """The set of a fingerprint."""
    return F.regexp_extract_all(folded, F.lit(".{8}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def with_next(docs: DataFrame, added: dict[str, Column], columns: list[str]) -> DataFrame:
    """Adds columns, and next, a struct of ``columns`` of the next row by descending doc_id; the first row's after the last.

    What is added is worked out after the rows have been dealt, so that it isn't shuffled.

    Rows of one doc_id follow each other by the hash of their text, null ids come last. Ranges of doc_ids are
    sorted apart; the last document of a range also goes to the next range as a guest, and the last of all to the
    first, so that no window spans the table.
    """
    guest = lambda at, kind: F.struct(at.cast("long").alias("range"), F.lit(kind).alias("guest"))
    follows = F.when((F.col("doc_id") == F.col("_last")) & F.col("_next").isNotNull(), guest(F.col("_next"), 1))
    wraps = F.when((F.col("doc_id") == F.col("_last")) & F.col("_next").isNull(), guest(F.lit(0), 2))
    places = F.array_compact(F.array(guest(F.col("_range"), 0), follows, wraps))
    dealt = with_ranges(docs, "doc_id", ROWS_PER_RANGE).withColumn("_at", F.explode(places)).select(*docs.columns, "_at.range", "_at.guest")
    dealt = dealt.repartition("range").withColumns(added)
    down = Window.partitionBy("range").orderBy(F.col("guest") == 2, F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    here = F.struct(*columns)
    next_ = F.coalesce(F.lead(here).over(down), F.first(here).over(down))
    return dealt.withColumn("next", next_).where("guest = 0").drop("range", "guest")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside that of its edited text and of the next document.

    The edited text has the last floor(n/2) code points of a text of n replaced by the first as many of the next
    document's, or by all of it if that is shorter. Null texts are empty. A row for each row of docs; repeated
    rows are neighbours of each other. Extra columns are left out. Empty in, empty out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, {"folded": fingerprint(signatures(F.col("text")))}, ["text", "folded"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    sets = unfold(F.col("folded")).alias("sigs"), unfold(F.col("next.folded")).alias("next_sigs")
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "folded", edited.alias("edited"), *sets)
    docs = docs.withColumn("edited_sigs", signatures(F.col("edited")))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("folded").alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): documents of equal fingerprints are a class, named by its smallest doc_id."""
    marked = docs.select("doc_id", signatures(F.col("text")).alias("sigs"))
    named = marked.groupBy("sigs").agg(F.min("doc_id").alias("class_id"))
    return marked.join(named, "sigs").select("doc_id", "class_id")


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of classes, a < b, whose sets have a Jaccard similarity of ``least`` or more.

    Classes are partitioned by the logarithm of their set's length, so that a pair is in one partition or in two
    neighbouring ones. Signatures are ordered from rare to common; of a set of n only the first
    n - ceil(least * n) + 1 are joined, since a pair without one of these in common is below ``least``. Pairs whose
    lengths alone rule them out are dropped before the sets are compared. Texts of empty sets are one class.
    """
    marked = docs.select("doc_id", signatures(F.col("text")).alias("sigs"))
    sets = marked.groupBy("sigs").agg(F.min("doc_id").alias("class_id")).where(F.col("class_id").isNotNull())
    sets = sets.withColumn("n", F.size("sigs")).where("n > 0")
    each = sets.select("class_id", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    ordered = each.join(often, "sig").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("rare"))
    width = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    length_class = F.floor(F.log("n") / math.log(1 / least) + 1e-9)
    head = ordered.select("class_id", "n", length_class.alias("part"), F.explode(F.slice("rare", F.lit(1), width.cast("int"))["sig"]).alias("sig"))
    low = head.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1))).alias("x")
    pairs = low.join(head.alias("y"), ["sig", "part"]).where("x.n <= y.n AND x.class_id <> y.class_id").where(F.col("x.n") >= F.col("y.n") * least - 1e-9)
    pairs = pairs.select(F.least("x.class_id", "y.class_id").alias("a"), F.greatest("x.class_id", "y.class_id").alias("b")).distinct()
    left = sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("sigs_a"))
    right = sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("sigs_b"))
    alike = likeness(F.col("sigs_a"), F.col("sigs_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", alike.alias("likeness")).where(F.col("likeness") >= least)
