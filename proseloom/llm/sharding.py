"""Operator 6: sharding by a Feistel permutation with cycle walking over global row numbers. JVM-side only.

Row numbers come from a hash order: bucket = hash of (doc_id, text), ascending doc_id inside a bucket. Only narrow
rows (id, size, two hashes) are shuffled, buckets are even whatever the ids are, and the order does not depend on how
the input is split. Buckets grow with the rows (ROWS_A_BUCKET each), so no window does. The permuted number p gives shard = p mod S and slot = p div S, so sizes differ by one row at most
and either side can be computed from the row number alone (law ``rows``).

Nulls: a null id hashes as a null, a null text has size 8 and the crc of no bytes. Rows that are equal in id and text
are interchangeable. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

BUCKETS, MOST_BUCKETS, ROWS_A_BUCKET = 2048, 1_000_000, 100_000
ROUNDS = 6
WALKS = 48


def feistel(x: Column, left: int, right: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of an alternating Feistel network over Z_left x Z_right; a permutation of [0, left*right)."""
    start = F.struct(
        F.floor(x / F.lit(right)).cast("long").alias("a"), (x % F.lit(right)).alias("b"), F.lit(left).cast("long").alias("m"), F.lit(right).cast("long").alias("n")
    )

    def turn(s: Column, key: Column) -> Column:
        moved = F.pmod(s["a"] + F.pmod(F.xxhash64(s["b"], key, F.lit(seed)), s["m"]), s["m"])
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    even = rounds + rounds % 2
    return F.aggregate(F.sequence(F.lit(1), F.lit(even)), start, turn, lambda s: s["a"] * F.lit(right) + s["b"])


def permuted(x: Column, rows: int, seed: int) -> Column:
    """Cycle walking: apply the permutation of the slightly larger domain until the value is below ``rows``.

    The domain exceeds ``rows`` by less than its square root, so one pass is nearly always enough; a value that is
    still outside after WALKS passes raises instead of returning something wrong."""
    left = max(1, int(rows**0.5))
    while left * left < rows:
        left += 1
    right = max(1, -(-rows // left))
    once = feistel(x, left, right, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), once, lambda p, _: F.when(p < rows, p).otherwise(feistel(p, left, right, seed))
    )
    return F.when(once < rows, once).otherwise(walk)


def shard(docs: DataFrame, shards: int = 24, seed: int = 20, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), row_number."""
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("doc_id", raw).alias("h"),
    )
    keyed = staged(keyed, "shard-keys")
    rows = keyed.count()
    buckets = buckets or min(MOST_BUCKETS, max(BUCKETS, rows // ROWS_A_BUCKET))
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    # At most MOST_BUCKETS narrow rows: one small window and a broadcast.
    first = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    if rows == 0:
        return keyed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(0).cast("long").alias("row_number"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "h", "size", "text_crc32"))
    numbered = keyed.join(F.broadcast(first), "bucket").withColumn("row_number", (F.col("base") + place - 1).cast("long"))
    moved = numbered.withColumn("p", permuted(F.col("row_number"), rows, seed))
    p = F.when(F.col("p") < rows, F.col("p")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return moved.withColumn("p", p).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"), F.floor(F.col("p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
