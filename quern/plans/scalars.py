"""Scalar functions by family, and functions of one's own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quern.catalog import cents, read, register
from quern.functions import text, vectors
from quern.operators import nearest
from quern.plans.registry import query


@query("""SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 4) AS s, length(p_name)::BIGINT AS n, replace(p_name, ' ', '_') AS r, p_brand || '/' || p_type AS c,
  lpad(p_partkey::VARCHAR, 8, '0') AS padded, reverse(p_name) AS back, strpos(p_name, 'e')::BIGINT AS at, split_part(p_name, ' ', 1) AS head FROM part""")
def string_functions(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("u"), F.substring("p_name", 2, 4).alias("s"), F.length("p_name").cast("long").alias("n"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("r"),
        F.concat_ws("/", "p_brand", "p_type").alias("c"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.reverse("p_name").alias("back"),
        F.instr("p_name", "e").cast("long").alias("at"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"),
    )


@query(r"SELECT c_custkey, regexp_extract(c_name, '#0*(\d+)', 1) AS digits, regexp_replace(c_name, '[aeiou]', '*', 'g') AS veiled, regexp_matches(c_mktsegment, '^[A-H]') AS early FROM customer")
def regex_functions(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.regexp_extract("c_name", r"#0*(\d+)", 1).alias("digits"), F.regexp_replace("c_name", "[aeiou]", "*").alias("veiled"), F.col("c_mktsegment").rlike("^[A-H]").alias("early")
    )


@query("SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::BIGINT AS d, md5(a.p_name) AS h, sha256(a.p_name) AS s FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def distance_and_hash(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(after, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").cast("long").alias("d"), F.md5("p_name").alias("h"), F.sha2("p_name", 256).alias("s"))


@query()
def xx_hashes(spark, sf_dir):
    """XXH64 with seed 42, as a signed number."""
    return read(spark, sf_dir, "part").select("p_partkey", F.xxhash64("p_name").alias("x"))


@query("""SELECT o_orderkey, extract(year FROM o_orderdate)::BIGINT AS y, extract(quarter FROM o_orderdate)::BIGINT AS q, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, dayofweek(o_orderdate)::BIGINT + 1 AS dow,
  date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)::BIGINT AS days, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(last_day(o_orderdate), '%Y-%m-%d') AS ends FROM orders""")
def date_functions(spark, sf_dir):
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(at).cast("long").alias("y"), F.quarter(at).cast("long").alias("q"), F.trunc(at, "month").cast("string").alias("m"), F.dayofweek(at).cast("long").alias("dow"),
        F.datediff(at, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.add_months(at, 1).cast("string").alias("next_month"), F.last_day(at).cast("string").alias("ends"),
    )


@query("SELECT event_id, date_trunc('hour', ts) AS h, extract(minute FROM ts)::BIGINT AS m, epoch_us(ts) AS us FROM events")
def time_functions(spark, sf_dir):
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select("event_id", hour.alias("h"), F.minute("ts").cast("long").alias("m"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, floor(l_extendedprice / 1000)::BIGINT AS k, abs(l_quantity - 25) AS off, round(sqrt(l_quantity), 6) AS root, (l_partkey % 7)::BIGINT AS m7,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio, greatest(l_tax, l_discount) AS more FROM lineitem""")
def math_functions(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.floor(F.col("l_extendedprice") / 1000).alias("k"), F.abs(F.col("l_quantity") - 25).alias("off"), F.round(F.sqrt("l_quantity"), 6).alias("root"),
        (F.col("l_partkey") % 7).alias("m7"), F.round(F.try_divide("l_tax", "l_discount"), 6).alias("ratio"), F.greatest("l_tax", "l_discount").alias("more"),
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 11 ELSE floor(c_acctbal / 1000)::BIGINT + 1 END::BIGINT AS bucket FROM customer")
def width_bucket(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.width_bucket("c_acctbal", F.lit(0.0), F.lit(10000.0), F.lit(10)).alias("bucket"))


@query("SELECT s_suppkey, coalesce(s_name, 'none') AS a, coalesce(nullif(s_nationkey, 2), -2) AS b, ifnull(n_name, '?') AS c, s_nationkey IS NOT DISTINCT FROM n_nationkey AS same FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey > 1")
def null_functions(spark, sf_dir):
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation").where("n_regionkey > 1")
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
    return joined.select(
        "s_suppkey", F.coalesce("s_name", F.lit("none")).alias("a"), F.coalesce(F.nullif("s_nationkey", F.lit(2)), F.lit(-2)).alias("b"), F.ifnull("n_name", F.lit("?")).alias("c"), F.col("s_nationkey").eqNullSafe(F.col("n_nationkey")).alias("same")
    )


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_functions(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    return read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("SELECT event_type, sum((props ->> '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def variant_functions(spark, sf_dir):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"))


@query(r"SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/?#]+)', 1) AS host, regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_functions(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", *[F.parse_url("url", F.lit(p)).alias(a) for p, a in (("PROTOCOL", "scheme"), ("HOST", "host"), ("PATH", "path"))])


@query("""SELECT p_partkey, list_sort(w)[1] AS least, len(list_distinct(w))::BIGINT AS n, list_contains(w, 'ring') AS ring, array_to_string(list_reverse(w), '-') AS back,
  list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS total FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def array_functions(spark, sf_dir):
    w = F.split("p_name", " ")
    total = F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.array_min(w).alias("least"), F.size(F.array_distinct(w)).cast("long").alias("n"), F.array_contains(w, "ring").alias("ring"), F.array_join(F.reverse(w), "-").alias("back"), total.alias("total")
    )


@query("""SELECT label, count(*)::BIGINT AS n, round(avg(list_inner_product(embedding[1:63]::DOUBLE[], embedding[2:64]::DOUBLE[])), 6) AS lagged, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS length
  FROM embeddings GROUP BY label""")
def vector_functions(spark, sf_dir):
    e = F.col("embedding")
    lagged = vectors.dot(F.slice(e, 1, 63), F.slice(e, 2, 63))
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(lagged), 6).alias("lagged"), F.round(F.avg(vectors.norm(e)), 6).alias("length"))


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS d
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_distance(spark, sf_dir):
    """The squared distance of each vector from the one of the next id."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vectors.squared_distance(F.col("embedding"), F.col("next")), 6).alias("d"))


@query("""SELECT initials, count(*)::BIGINT AS n FROM (SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') AS initials FROM part) GROUP BY initials""")
def name_initials(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(text.initials(F.col("p_name")).alias("initials")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT q.vec_id AS query_id, arg_max(c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS nearest FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id""")
def vector_nearest(spark, sf_dir):
    """The nearest of all vectors, for every id divisible by 20; the smallest id of several."""
    rows = read(spark, sf_dir, "embeddings")
    return nearest.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding").select("query_id", "nearest")


@query("SELECT count(*)::BIGINT AS asked, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_lists_recall(spark, sf_dir):
    """Whether lists around centroids find the nearest of all vectors for nine of ten ids divisible by 20."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    exact = nearest.nearest(asked, rows, "vec_id", "embedding").select("query_id", F.col("likeness").alias("best"))
    lists = nearest.fit_lists(rows, "vec_id", "embedding", recall=0.99)
    found = nearest.nearest_in_lists(asked, rows, "vec_id", "embedding", lists).select("query_id", "likeness")
    hit = F.coalesce(F.col("likeness") >= F.col("best") - 1e-9, F.lit(False))
    return exact.join(found, "query_id", "left").agg(F.count(F.lit(1)).alias("asked"), (F.avg(hit.cast("double")) >= 0.9).alias("enough"))


@query(r"""SELECT conv_id, role, sum(len(w))::BIGINT AS words, sum(len(list_distinct(w)))::BIGINT AS different FROM
  (SELECT conv_id, role, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations) GROUP BY conv_id, role""")
def word_functions(spark, sf_dir):
    w = text.words(F.col("text"))
    counted = read(spark, sf_dir, "conversations").select("conv_id", "role", w.alias("w"))
    return counted.groupBy("conv_id", "role").agg(F.sum(F.size("w")).alias("words"), F.sum(F.size(F.array_distinct("w"))).alias("different"))


@query(r"""SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM
  (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)) GROUP BY gram HAVING count(*) > 1""")
def word_ngrams(spark, sf_dir):
    grams = read(spark, sf_dir, "benchmark").select(F.explode(text.ngrams(text.words(F.col("text")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT c_custkey, round(c_acctbal * 1.1, 4) AS raised FROM customer")
def pandas_scalar(spark, sf_dir):
    @F.pandas_udf("double")
    def raised(amount: pd.Series) -> pd.Series:
        return (amount * 1.1).round(4)

    return read(spark, sf_dir, "customer").select("c_custkey", F.round(raised("c_acctbal"), 4).alias("raised"))


@query("SELECT p_brand, max(p_size)::BIGINT - min(p_size)::BIGINT AS spread FROM part GROUP BY p_brand")
def pandas_aggregate(spark, sf_dir):
    """A pandas aggregate gets all rows of its group at once, so brands are taken in groups of neighbouring keys first."""

    @F.pandas_udf("long")
    def low(size: pd.Series) -> int:
        return int(size.min())

    @F.pandas_udf("long")
    def high(size: pd.Series) -> int:
        return int(size.max())

    parts = read(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 100_000).alias("some")).agg(low("p_size").alias("low"), high("p_size").alias("high"))
    return parts.groupBy("p_brand").agg((F.max("high") - F.min("low")).alias("spread"))


@query("SELECT user_id, event_id, (round(value * 100)::BIGINT - min(round(value * 100)::BIGINT) OVER (PARTITION BY user_id))::BIGINT AS above FROM events")
def grouped_map(spark, sf_dir):
    """A grouped map gets all rows of its group at once, so a user's least is aggregated before, and groups are runs of neighbouring ids."""

    def above(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["user_id", "event_id"]].assign(above=rows["cents"] - rows["low"])

    events = read(spark, sf_dir, "events").select("user_id", "event_id", cents("value").alias("cents"), F.floor(F.col("event_id") / 20_000).alias("some"))
    low = events.groupBy("user_id").agg(F.min("cents").alias("low"))
    return events.join(low, "user_id").groupBy("some").applyInPandas(above, "user_id long, event_id long, above long")


@query("SELECT o_orderkey, o_orderkey % 9 AS digit FROM orders WHERE o_orderkey % 9 > 5")
def arrow_map(spark, sf_dir):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            rows["digit"] = rows["o_orderkey"] % 9
            yield pa.RecordBatch.from_pandas(rows[rows["digit"] > 5], preserve_index=False)

    return read(spark, sf_dir, "orders").select("o_orderkey").mapInArrow(keep, "o_orderkey long, digit long")


@query("SELECT k, o.n AS orders, c.n AS customers FROM (SELECT o_custkey % 10 AS k, count(*)::BIGINT AS n FROM orders GROUP BY 1) o JOIN (SELECT c_custkey % 10 AS k, count(*)::BIGINT AS n FROM customer GROUP BY 1) c USING (k)")
def cogrouped_map(spark, sf_dir):
    def both(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "orders": [int(a["n"].sum())], "customers": [int(b["n"].sum())]})

    orders = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    customers = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return orders.groupBy("k").cogroup(customers.groupBy("k")).applyInPandas(both, "k long, orders long, customers long")


@query("SELECT s_suppkey, unnest(range(1, s_nationkey % 4 + 2))::BIGINT AS i FROM supplier")
def table_function(spark, sf_dir):
    @F.udtf(returnType="i long")
    class Count:
        def eval(self, n: int):
            for i in range(1, n + 2):
                yield (i,)

    spark.udtf.register("quern_count", Count)
    register(spark, sf_dir, "supplier")
    return spark.sql("SELECT s_suppkey, i FROM supplier, LATERAL quern_count(s_nationkey % 4)")
