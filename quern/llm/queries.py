"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import alignment, bpe, collocations, html_text, language, mixing, near_vectors, quality, simhash, spotsigs, substring, token_files, toxicity
from quern.llm.common import WORD, table


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents"))


_ANCHORS = ", ".join(f"'{w}'" for w in spotsigs.ANCHORS)
OP1_SQL = rf"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER down, first_value(coalesce(text, '')) OVER down) AS next_text
  FROM documents WINDOW down AS (ORDER BY doc_id DESC)
), edited AS (
  SELECT doc_id, text, next_text,
         substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited
  FROM ordered
), each AS (
  SELECT doc_id, 1 AS kind, text AS t FROM edited
  UNION ALL SELECT doc_id, 2, edited FROM edited
  UNION ALL SELECT doc_id, 3, next_text FROM edited
), marked AS (
  SELECT doc_id, kind, t,
         list_transform(list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''),
                        lambda w: CASE WHEN w IN ({_ANCHORS}) THEN '#' ELSE w END) AS m
  FROM each
), words AS (
  SELECT doc_id, kind, t,
         list_transform(list_filter(range(1, len(m) + 1), lambda i: m[i] <> '#' OR i = 1 OR m[i - 1] <> '#'), lambda i: m[i]) AS w
  FROM marked
), chains AS (
  SELECT doc_id, kind, t,
         list_filter(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = '#' AND i < len(w)),
                                    lambda i: list_filter(w[i + 1:i + 3], lambda x: x <> '#')[1:2]),
                     lambda c: len(c) = 2) AS c
  FROM words
), sigs AS (
  SELECT doc_id, kind, t,
         CASE WHEN len(c) > 0 THEN list_sort(list_distinct(list_transform(c, lambda x: substr(md5(x[1] || ' ' || x[2]), 1, 8))))
              WHEN t = '' THEN []::VARCHAR[] ELSE [substr(md5(t), 1, 8)] END AS s
  FROM chains
), side AS (
  SELECT doc_id, max(CASE WHEN kind = 1 THEN t END) AS text, max(CASE WHEN kind = 2 THEN t END) AS edited,
         max(CASE WHEN kind = 1 THEN s END) AS a, max(CASE WHEN kind = 2 THEN s END) AS b, max(CASE WHEN kind = 3 THEN s END) AS c
  FROM sigs GROUP BY doc_id
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
       coalesce(array_to_string(a, ''), '') AS fingerprint, coalesce(array_to_string(b, ''), '') AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END::DOUBLE AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c)))::DOUBLE END::DOUBLE AS near_next
FROM side
"""


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.with_copies(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (mixed["size"] * mixed["copies"]).alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
  WINDOW fill AS (ORDER BY source_size / weight, source IS NULL, source)
), targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size
              ELSE max(CASE WHEN level * weight <= 2.0::DOUBLE * source_size THEN level END) OVER () * weight END AS target
  FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT
        + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE
                    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.store(table(spark, sf_dir, "documents"))
    return token_files.read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.train(docs.where("NOT held_out"))
    return language.identify(docs.drop("lang"), model, keep=["doc_id", "held_out"])


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(found["fp"]).alias("fingerprint"), "component_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)), " ")
    return left.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", quality.held_out())
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.cross_align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(found["groups"] == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", toxicity.held_out())
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang
), counted AS (
  SELECT lang, g, count(*) AS a
  FROM (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM pieces)
  GROUP BY lang, g HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.g, c.a, l.a AS l, r.a AS r, n, k, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM counted) c
  JOIN counted l ON l.lang = c.lang AND l.g = c.g[1:k]
  JOIN counted r ON r.lang = c.lang AND r.g = c.g[k + 1:]
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT x.lang, x.part FROM (
    SELECT lang, g, a, unnest(flatten(list_transform(range(1, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) AS part FROM counted WHERE len(g) > 2
  ) x JOIN counted c ON c.lang = x.lang AND c.g = x.part AND 100 * x.a >= 100 * c.a
)
SELECT lang, row_number() OVER ranked AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.part = b.g)
WINDOW ranked AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' '))
QUALIFY row_number() OVER ranked <= 2000
"""


QUERIES = {
    "op1_spot_signatures": op1_spot_signatures,
    "op2_html_main_text": op2_html_main_text,
    "op3_source_mixing": op3_source_mixing,
    "op4_token_files": op4_token_files,
    "op5_language": op5_language,
    "op6_near_vectors": op6_near_vectors,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_repeated_windows": op9_repeated_windows,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op1_spot_signatures": OP1_SQL,
    "op3_source_mixing": OP3_SQL,
    "op13_collocations": OP13_SQL,
}
