"""Sharding into contiguous runs of near-equal bytes, by DataFrame functions alone.

Documents are put in one global order, equal texts side by side: the first half of the text's MD5, then
doc_id.  Range partitioning gives every partition one stretch of that order.  Each partition's byte and row
totals (one row per partition) are summed into the prefix at which it starts; inside it a running sum goes
on.  A document whose middle byte falls in the k-th of ``shards`` equal stretches of all bytes goes to
shard k, so shards differ by less than the longest document.

A group of copies of any size is spread over range partitions by doc_id, so it never meets in one task.
Defined results: null text has size 1 and CRC 0; texts of any length are sized whole and never cut, so one longer than a
shard's share fills that shard; ties in the order are rows equal in all of it, which may change places unseen; null doc_id sorts first; repeated rows are placed one by
one; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.runtime import table

ORDER = ("key", "doc_id", "size", "text_crc32")


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.md5(text.cast("binary")), 1, 16).alias("key"),
    )
    sized = table(sized, "sizes")  # a few bytes a document: texts are read once
    placed = table(sized.repartitionByRange(parts, *ORDER).withColumn("pid", F.spark_partition_id()), "ordered")

    everything = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = (  # one row for each range partition
        placed.groupBy("pid")
        .agg(F.sum("size").alias("p_bytes"), F.count(F.lit(1)).alias("p_rows"))
        .select(
            "pid",
            F.coalesce(F.sum("p_bytes").over(before), F.lit(0)).alias("base_bytes"),
            F.coalesce(F.sum("p_rows").over(before), F.lit(0)).alias("base_rows"),
            F.sum("p_bytes").over(everything).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("pid").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = (
        placed.repartitionByRange(parts, "pid")
        .withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy(*ORDER)))
        .join(F.broadcast(totals), "pid")
        .withColumn("row", F.col("base_rows") + F.col("nth") - 1)
        .withColumn("middle2", 2 * (F.col("base_bytes") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (middle2 * {shards}) div (2 * all_bytes)) as int)"))
    )
    first = run.groupBy("shard").agg(F.min("row").alias("first_row"))
    return run.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
