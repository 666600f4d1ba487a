"""Contiguous shards of near equal bytes, from global prefix sums over per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pick, utf8_bytes


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_share: float = 0.01,
) -> DataFrame:
    """Cut all documents, in the order of their text's hash, into ``n_shards`` contiguous shards of near equal bytes.

    Rows are range-sorted by (hash of the text, hash of the id, id), each partition is summed, and the running sum of
    the partitions' totals gives every row its global byte position. The shard is that position's place among
    ``n_shards`` equal targets. Copies of a text are neighbours in this order: a group of equal texts that holds at
    most ``group_share`` of a shard's target is placed whole, by its middle; a larger one may be cut, by rows. A shard
    so differs from its target by at most that share, or by one document where a document is larger.

    Size is UTF-8 bytes plus 1 (null text: 1). Returns doc_id, size, text_crc32 (null text: that of no bytes), law
    (``bytes``), shard, slot (0, 1, ... within the shard, in the global order), grown_shard (null). One row for each
    input row; repeated rows stay; an empty table gives an empty result; other columns are ignored.

    Only ids and numbers are moved, never texts. Copies of one text, however many, spread over the range partitions.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select(
        "doc_id",
        (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
        F.xxhash64(F.col("doc_id")).alias("id_key"),
    )
    ranged = rows.repartitionByRange("text_key", "id_key", "doc_id")
    ranged = checkpoint(ranged.withColumn("part", F.spark_partition_id()))

    # One row for each partition: where it starts, in bytes and rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_start"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_rank"),
            F.sum("bytes").over(everything).alias("total"),
        )
    )
    # Texts whose copies lie in more than one partition: fewer than there are partitions.
    crossing = (
        ranged.groupBy("text_key", "part")
        .agg(F.sum("size").alias("bytes"))
        .groupBy("text_key")
        .agg(F.min_by("bytes", "part").alias("head"), F.min("part").alias("head_part"), F.sum("bytes").alias("cross_bytes"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    ends = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    crossing = (
        crossing.join(F.broadcast(parts.select(F.col("part").alias("head_part"), "part_start")), "head_part")
        .join(F.broadcast(ends.withColumnRenamed("part", "head_part")), "head_part")
        .select("text_key", (F.col("part_start") + F.col("bytes") - F.col("head")).alias("cross_start"), "cross_bytes")
    )

    order = ["text_key", "id_key", "doc_id", "size"]
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("part", "text_key")
    placed = (
        ranged.withColumn("row_end", F.sum("size").over(running))
        .withColumn("row_rank", F.count(F.lit(1)).over(running) - 1)
        .withColumn("group_first", F.min(F.col("row_end") - F.col("size")).over(alike))
        .withColumn("group_size", F.sum("size").over(alike))
        .join(F.broadcast(parts), "part")
        .join(F.broadcast(crossing), "text_key", "left")
    )
    start = F.col("part_start") + F.col("row_end") - F.col("size")
    group_start = F.coalesce(F.col("cross_start"), F.col("part_start") + F.col("group_first"))
    group_bytes = F.coalesce(F.col("cross_bytes"), F.col("group_size"))
    whole = group_bytes * n_shards <= F.lit(float(group_share)) * F.col("total")
    middle_twice = F.when(whole, group_start * 2 + group_bytes).otherwise(start * 2 + F.col("size"))
    shard = F.least(F.lit(n_shards - 1), F.expr("div(middle_twice * %d, total * 2)" % n_shards)).cast("int")
    placed = placed.withColumn("middle_twice", middle_twice).select(
        "doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("part_rank") + F.col("row_rank")).alias("rank")
    )
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
