"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal text form a group. Small groups are gathered by hash into a
fixed number of bundles; a group above a small share of a shard's capacity is
an item of its own and stays whole, and only one above a large share of it, which
would not fit evenly, is split by doc_id. So the packer sees a number of items that
depends on the number of shards, not on the data. Items are placed in falling size,
each into the shard where the dot product of its demand with the residual capacity
is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Bundles a shard, and the shares of a shard from which a group is an item of its own and from which it is split.
BUNDLES, LARGE, HOT = 256, 1 / 256, 1 / 2


def pack(demand: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; demand: items x dimensions."""
    share = demand / np.maximum(demand.sum(axis=0), 1) * shards  # 1.0 fills a shard in that dimension
    residual = np.ones((shards, demand.shape[1]))
    place = np.zeros(len(share), int)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        after = residual - share[i]
        score = residual @ share[i]
        fits = (after >= 0).all(axis=1)
        # Beyond capacity, the shard that stays least overfull; residuals may be negative there.
        k = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(after.min(axis=1)))
        place[i] = k
        residual[k] = after[k]
    return place


def shard(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per input row.

    Size is the UTF-8 bytes of the text plus 16; null texts count as empty ones,
    and all empty texts are one group. Rows with equal text stay together, but
    for groups above HOT of a shard in bytes, tokens or rows; those are split by
    doc_id into pieces of about LARGE, which balance. Rows with equal doc_id and text stay
    together always. Slots are numbered from 0 within each shard without gaps, ties
    in any order. An empty table gives an empty result. Other columns are not read.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), word_count(text).alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group"))
    d = materialise(d, "shard-sizes")
    total = d.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    limit = [(x or 0) * LARGE / shards for x in total]
    share = F.greatest(*(F.col(c) / F.lit(max(m, 1e-9)) for c, m in zip(("size", "tokens", "rows"), limit)))
    # No more than 3 * shards / LARGE groups can be above the limit in some dimension.
    large = d.groupBy("group").agg(*sums).where(share > 1).select("group", F.when(share > HOT / LARGE, F.ceil(share)).otherwise(1).cast("int").alias("pieces"))
    large = materialise(large, "shard-large")
    d = d.join(F.broadcast(large), "group", "left")
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
    bundle = F.pmod(F.xxhash64("group"), F.lit(shards * BUNDLES))
    d = d.withColumn("item", F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), bundle.cast("string"))).otherwise(F.concat_ws("/", "group", piece.cast("string"))))

    items = d.groupBy("item").agg(*sums).toPandas().sort_values("item", ignore_index=True)  # as many as the bundles and pieces
    items["shard"] = pack(items[["size", "tokens", "rows"]].to_numpy(float).reshape(-1, 3), shards)
    items["base"] = items.groupby("shard")["rows"].cumsum() - items["rows"]
    placed = spark.createDataFrame(items[["item", "shard", "base"]].astype({"shard": "int32", "base": "int64"}), "item string, shard int, base long") if len(items) else spark.createDataFrame([], "item string, shard int, base long")
    d = d.join(F.broadcast(placed), "item")
    slot = F.col("base") + F.row_number().over(Window.partitionBy("item").orderBy("group", "doc_id")) - 1
    return d.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"), "tokens")
