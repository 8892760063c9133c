"""Exact duplicates by skew-safe combining, in built-in functions only.

Rows combine three times, and each time whole normalised texts are compared
(they are grouping keys), never digests alone:

1. locally: the partial aggregate leaves one row per text in each task,
2. by (digest, salt, text): a hot text is spread over ``salts`` tasks,
3. by (digest, text): the few salt winners become one.

The winners, without their texts, go to a table in the shared folder. Documents
then look their winner up by digest; should two texts share one SHA-256, which
the winners' table shows, the lookup compares texts as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle

#: One space for each run of white space; a lone space is left as it is.
BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. The smallest id
    of a group stays; a null id stays only where a group has no other. Rows that
    repeat id and text are one document and share their flags. Other columns of
    ``docs`` are not read, so their names do not matter. No rows give no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content")).select(
        "id", "content", F.unhex(F.sha2("content", 256)).alias("digest"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    by_salt = salted.groupBy("digest", "salt", "content").agg(F.min("id").alias("keep"), F.count("*").alias("size"))
    by_text = by_salt.groupBy("digest", "content").agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))
    winners = settle(by_text.select("digest", "keep", "size"), "dedup_winners")
    clash = winners.groupBy("digest").count().filter("count > 1").limit(1).count() > 0
    if clash:
        found = base.join(settle(by_text, "dedup_texts"), ["digest", "content"])
    else:
        found = base.drop("content").join(winners, "digest")
    return found.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
