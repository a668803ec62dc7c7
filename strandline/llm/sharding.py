"""Contiguous shards of near-equal byte size, cut from global prefix sums with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, only, table

#: Rows of a range to aim at, and the most ranges; the table of totals has a row for each.
ROWS, RANGES = 10_000, 20_000


def shard_by_bytes(docs: DataFrame, size: Column, shards: int = 16, key: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """Add ``shard``, ``slot`` and ``position`` to ``docs`` under the law ``bytes``; input columns of these names give way.

    Rows are ordered by ``key`` (null first), rows of one key by a hash of all columns; rows that are equal
    throughout are interchangeable. The rows are written once, dealt into ranges of that order (so pass
    light ones: texts can be joined afterwards). Ranges are split by key, hash and place, so a key that very
    many rows share, or lack, is split too. Each range's rows and bytes are summed, the prefix sums over
    the ranges' totals give where a range begins, and a running sum inside the range gives where a row
    begins. A row goes to the shard in which its middle byte lies, so each shard is a contiguous run whose
    bytes differ from an equal share by less than the largest row. ``slot`` counts a shard's rows from 0 in
    that order; ``position`` counts all rows. No task holds more than the rows of one range. An empty table
    gives no rows. Sizes must be positive.
    """
    docs = docs.drop("shard", "slot", "position")
    given = docs.columns
    # read once: what follows works on the written rows, whose places no longer change
    once = cut_lineage(docs.withColumns({"_size": size.cast("long"), "_tie": F.xxhash64(*given), "_place": F.monotonically_increasing_id()}), few_files=True)
    ranges = min(RANGES, max(1, -(-once.count() // rows)))
    order = [F.col(key).asc_nulls_first(), F.col("_tie"), F.col("_place")]
    dealt = cut_lineage(once.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows at most
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
    )
    whole = totals.agg(F.sum("_bytes").alias("_all"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        dealt.withColumns({"_end": F.sum("_size").over(inside), "_nth": F.count(F.lit(1)).over(inside)})
        .join(F.broadcast(starts), "_range")
        .join(F.broadcast(whole))
        .withColumns({
            "position": F.col("_row0") + F.col("_nth") - 1,
            "_middle": 2 * (F.col("_byte0") + F.col("_end")) - F.col("_size"),
        })
        .withColumn("shard", F.least(F.expr(f"_middle * {shards} div (2 * _all)"), F.lit(shards - 1)).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("position").alias("_first"))  # ``shards`` rows
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("position") - F.col("_first")).select(
        *(f"`{c}`" for c in given), "shard", "slot", "position"
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards by bytes (UTF-8 bytes of the text plus 1; null text: 0 plus 1)."""
    docs = only(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32")
    )
    return shard_by_bytes(light, F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "position",
    )
