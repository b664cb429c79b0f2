"""Sharding of documents into shards of near equal bytes (operator 5).

Method: longest-processing-time scheduling.  Groups that must stay together (equal
texts) are sorted by size, and each goes to the least-loaded shard through a heap.

Scale: the heap sees a bounded number of items.  Groups above ``total / bundles``
bytes are items of their own (fewer than ``bundles`` can exist); all smaller groups
are hashed into ``bundles`` bundles.  Slots come from per-item row counts, so no
shard is ever gathered in one task; a large group is numbered in ``cells`` by
document hash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUNDLES_PER_SHARD = 512
#: Bytes that each row counts beside its text.
ROW_BYTES = 8


def longest_first(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (item, size): by size downwards, each to the least-loaded shard; ties by number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_by_size(df: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row.

    Equal texts (null and empty count as equal) share a shard; ``slot`` runs from 0 without gaps
    in each shard.  Repeated rows and null ids each keep a slot of their own.  An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    bundles = shards * bundles_per_shard
    text = F.coalesce(F.col(text_column), F.lit(""))
    digest = F.md5(text)
    slim = stored(df.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        digest.alias("text_md5"),
    ), "shard-rows")
    total = slim.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    limit = max(1, int(total["b"] or 0) // bundles)
    large = slim.groupBy("text_md5").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).filter(F.col("bytes") > limit)
    # fewer than `bundles` groups can each hold more than 1/bundles of all bytes
    found = sorted((r["text_md5"], int(r["bytes"]), int(r["n"])) for r in large.collect())
    per_cell = max(1, int(total["n"] or 0) // bundles)
    own = [(md5, bundles + i, -(-n // per_cell)) for i, (md5, _, n) in enumerate(found)]
    own_items = F.broadcast(spark.createDataFrame(own, "text_md5 string, own_item long, own_cells long"))
    items = slim.join(own_items, "text_md5", "left").select(
        "doc_id", "size", "text_crc32",
        F.coalesce("own_item", F.pmod(F.xxhash64("text_md5"), F.lit(bundles))).alias("item"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("own_cells")), F.lit(0)).alias("cell"),
    )
    cells = [(r["item"], r["cell"], int(r["bytes"]), int(r["n"])) for r in items.groupBy("item", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()]
    sizes: dict[int, int] = {}
    for item, _, size, _ in cells:
        sizes[item] = sizes.get(item, 0) + size
    placed = longest_first(list(sizes.items()), shards)
    filled = dict.fromkeys(range(shards), 0)
    plan = []
    for item, cell, _, n in sorted(cells):
        shard = placed[item]
        plan.append((item, cell, shard, filled[shard]))
        filled[shard] += n
    # at most bundles + their cells rows: bounded by the parameters, not by the data
    where = F.broadcast(spark.createDataFrame(plan, "item long, cell long, shard int, first_slot long"))
    order = Window.partitionBy("item", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    return items.withColumn("rank", F.row_number().over(order)).join(where, ["item", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - 1).alias("slot"))
