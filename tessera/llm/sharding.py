"""Sharding by rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

Each record scores every shard with ``-weight / ln(u)``, u a uniform hash of (key, shard), and goes to
the highest score. A new shard only adds one more score, so a record either stays or moves to the new
shard; a shard of twice the weight wins twice as many records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: u has 52 bits: 13 hexadecimal digits of an MD5, exact in a double.
_SCALE = float(1 << 52)


def stable_key(column: str = "doc_id") -> Column:
    """Text of the record's id; a null id counts as the empty key."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _score(key: Column, shard: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_SCALE)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, n) of the winning shard; ``-n`` is compared, so that a tie goes to the lower number."""
    scored = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("n")) for i, w in enumerate(weights) if w > 0]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def shard(
    docs: DataFrame,
    weights: Sequence[float],
    *,
    grown_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_range: int = 250_000,
) -> DataFrame:
    """Assign every row a shard, a gapless slot in it, and the shard it would have with one shard more.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard.
    Slots follow the MD5 of the key. They are numbered in two steps: each shard is cut into ranges of that
    hash, rows are numbered inside a range, and the sizes of the ranges before it are added, so that no task
    holds a whole shard. Only ids, sizes and checksums are shuffled, never texts.

    Null text has size 8 and checksum 0; null and repeated ids keep all their rows and share a shard (equal
    rows take neighbouring slots); an empty table gives no rows; other columns are not read.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("one shard at least needs a positive weight")
    n = len(weights)
    key = stable_key(id_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(key).alias("_h"),
        rendezvous(key, weights).alias("_best"),
        _score(key, n, grown_weight).alias("_more"),
    ).select(
        "doc_id", "size", "text_crc32", "_h",
        (-F.col("_best.n")).cast("int").alias("shard"),
        F.when(F.col("_more") > F.col("_best.score"), F.lit(n)).otherwise(-F.col("_best.n")).cast("int").alias("grown_shard"),
    )
    # The number of ranges comes from the row count (Parquet footers), so a range stays small at any size.
    ranges = max(1, -(-docs.count() // (max(1, n) * rows_per_range)))
    rows = rows.withColumn("_range", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * ranges).cast("int"))
    inside = Window.partitionBy("shard", "_range").orderBy("_h", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("slot", F.row_number().over(inside).cast("long") - 1)
    if ranges > 1:
        earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        first = rows.groupBy("shard", "_range").count()
        first = first.select("shard", "_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_first"))
        numbered = numbered.join(first, ["shard", "_range"]).withColumn("slot", F.col("slot") + F.col("_first"))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


SHARDS = 24


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * SHARDS)


OP7_SQL = f"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
h AS (SELECT doc_id, text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(strlen(text), 0) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(x, lambda v: ('0x' || v)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM h, crc
), s AS (
  SELECT d.*, r.range AS n, -1.0 / ln((('0x' || substr(md5(key || '#' || r.range), 1, 13))::BIGINT + 0.5) / {1 << 52}.0::DOUBLE) AS score
  FROM d, range({SHARDS + 1}) r
), best AS (
  SELECT doc_id, key, size, text_crc32, arg_max(n, (score, -n)) FILTER (n < {SHARDS}) AS shard, arg_max(n, (score, -n)) AS grown_shard
  FROM s GROUP BY ALL
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM best
"""
