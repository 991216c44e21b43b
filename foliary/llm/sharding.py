"""Sharding (5): best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Groups (equal texts) of a share of all bytes that matters are items of their own; smaller ones are bundled by a hash
into a fixed number of items, so the list that is packed has a bound that no table can exceed. Items enter by falling
size the shard whose remaining capacity is the least that holds them, found in an ordered set of remainders. The
capacity is the least for which the given number of shards suffices.

With a capacity of its own there are as many shards as that needs, so nothing has a bound on the driver: small groups
are bundled up to a sixteenth of a shard, and items are packed in tasks of a range of their hash each.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm.common import table, written

#: A group of more than 1 / (shards * LARGE) of all bytes is an item of its own; the others share BUNDLES items. Rows of a
#: group that are numbered in one task, at most about so many.
SHARDS, LARGE, BUNDLES, SLOTS = 16, 256, 8192, 500
#: With a capacity: bundles to a shard's bytes at least, groups of a slice that is bundled in one task, items packed in one task.
PART, SLICE, RANGE = 32, 500_000, 30_000


def best_fit_decreasing(items: list[tuple[int, int]], capacity: int, most: int | None = None) -> dict[int, int] | None:
    """{item: shard} for (item, size) pairs: fewest shards by best fit; None once ``most`` shards don't suffice."""
    free: list[tuple[int, int]] = [(capacity, k) for k in range(most)] if most else []
    used = len(free)
    out: dict[int, int] = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            left, shard = free.pop(at)
        elif most is None and size <= capacity:
            left, shard, used = capacity, used, used + 1
        else:
            return None
        insort(free, (left - size, shard))
        out[item] = shard
    return out


def even_shards(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Best fit decreasing into ``shards`` shards of the least capacity that it finds enough."""
    total, largest = sum(s for _, s in items), max((s for _, s in items), default=0)
    low, high = max(-(-total // shards), largest), max(2 * -(-total // shards), 2 * largest, 1)
    found = best_fit_decreasing(items, high, shards)
    while low < high:
        mid = (low + high) // 2
        packed = best_fit_decreasing(items, mid, shards)
        if packed is None:
            low = mid + 1
        else:
            high, found = mid, packed
    return found or {}


def _within_capacity(groups: DataFrame, capacity: int) -> DataFrame:
    """(key, item, shard) for groups (key, bytes), none of them larger than capacity.

    Groups of up to 1 / PART of a shard are bundled in the order of their key; a bundle ends once it has that much, so it
    is no larger than 2 / PART. Each range of items has shards of its own, of which at most the emptiest is a loss.
    """
    unit = max(1, capacity // PART)
    sized = groups.withColumn("small", F.col("bytes") <= unit)
    slices = 1 + sized.where("small").count() // SLICE
    small = sized.where("small").withColumn("slice", F.expr(f"pmod(xxhash64(key), {slices})"))
    before = F.sum("bytes").over(Window.partitionBy("slice").orderBy("key")) - F.col("bytes")
    bundled = small.withColumn("item", F.concat_ws("-", F.lit("bundle"), F.col("slice").cast("string"), F.floor(before / unit).cast("string")))
    named = written(bundled.select("key", "item", "bytes").unionByName(sized.where("not small").select("key", F.col("key").alias("item"), "bytes")))
    items = named.groupBy("item").agg(F.sum("bytes").alias("bytes"))
    ranges = 1 + items.count() // RANGE

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        found = best_fit_decreasing(list(zip(rows["item"], rows["bytes"], strict=True)), capacity)
        return pd.DataFrame({"item": list(found), "range": rows["range"].iloc[0], "local": list(found.values())})

    packed = written(items.withColumn("range", F.expr(f"pmod(xxhash64(item), {ranges})")).groupBy("range").applyInPandas(pack, "item string, range long, local long"))
    counts = packed.groupBy("range").agg((F.max("local") + 1).alias("n"))  # a row for each RANGE items
    first = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("first"))
    return named.join(packed.join(first, "range"), "item").select("key", "item", (F.col("first") + F.col("local")).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row per input row: id, size, crc, item, shard, slot (gapless from 0 in each shard).

    Size: UTF-8 bytes of the text plus 1; null counts as empty. Rows with equal texts, repeated rows and null ids
    among them, lie in one shard. Without ``capacity`` the given number of shards is as even as it gets; if one text
    holds more than a shard's share, its shard is as large as it must be. With a ``capacity`` in bytes there are as few
    shards as best fit decreasing needs, and a group that doesn't fit raises. Extra columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.sha2(text, 256).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    if capacity is not None:
        groups = written(groups)
        if (groups.agg(F.max("bytes")).first()[0] or 0) > capacity:
            raise ValueError(f"a group of equal texts is larger than {capacity} bytes")
        # A shard has a bound in bytes, so numbering its rows does too.
        slot = F.row_number().over(Window.partitionBy("shard").orderBy("key", "id")) - 1
        return rows.join(_within_capacity(groups, capacity), "key").select("id", "size", "crc", F.xxhash64("item").alias("item"), "shard", slot.cast("long").alias("slot"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = written(groups.withColumn("large", F.col("bytes") > total / (shards * LARGE)).withColumn("item", F.expr(f"if(large, cast(null as long), pmod(xxhash64(key), {BUNDLES}))")))
    # At most shards * LARGE rows: each holds more than its share of all bytes.
    large = [(BUNDLES + k, r["key"], r["bytes"], max(1, -(-r["n"] // SLOTS))) for k, r in enumerate(groups.where("large").orderBy("key").collect())]
    small = groups.where("not large").groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()
    items = [(r["item"], r["bytes"]) for r in small] + [(k, b) for k, _, b, _ in large]
    packed = even_shards(items, shards)
    spark = docs.sparkSession
    place = F.broadcast(spark.createDataFrame([(k, s) for k, s in packed.items()], "item long, shard int"))
    keys = F.broadcast(spark.createDataFrame([(k, key, n) for k, key, _, n in large], "own long, key string, salts long"))
    dealt = rows.join(keys, "key", "left").select(
        "id", "size", "crc",
        F.coalesce("own", F.expr(f"pmod(xxhash64(key), {BUNDLES})")).alias("item"),
        F.expr("if(own is null, 0L, pmod(xxhash64(id), salts))").alias("salt"),
    ).join(place, "item")
    ahead = dealt.groupBy("shard", "item", "salt").agg(F.count("*").alias("n"))
    ahead = ahead.select("item", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("item", "salt")) - F.col("n")).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("item", "salt").orderBy("id", "crc")) - 1
    return dealt.withColumn("within", within).join(ahead, ["item", "salt"]).select("id", "size", "crc", "item", "shard", (F.col("ahead") + F.col("within")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
