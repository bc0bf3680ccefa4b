"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots. Only slots are ever placed: a small versioned table maps slot
to shard, built from the bytes of each slot and edited, not rebuilt, when shards come or go. Everything is DataFrame
expressions; what is gathered into one row is the list of slots, whose number is fixed.

Nulls: a null text counts as empty, a null doc_id hashes like any other value. Equal doc_ids with different texts are
told apart by the text and equal rows by their ordinal, so neither can make a hot slot. An empty table gives an empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxtrail.runtime import materialize, new_shared_path

VIRTUAL_SLOTS = 4096
ROW_BYTES = 8
COPIES_A_ROW = 1024
MAP = "version int, virtual_slot int, shard int, bytes long, n_rows long"


def records(docs: DataFrame, n_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: all that placing needs, one row per input row.

    Equal rows are counted, not moved, and numbered from 0; every one after the first is hashed with its number. They are
    written out ``COPIES_A_ROW`` at a time, so no task makes all copies of a row.
    """
    key = ("doc_id", "size", "text_crc32")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    step = F.lit(COPIES_A_ROW).cast("long")
    parts = counted.select(*key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)).alias("first")).repartition(*key, "first")
    copies = parts.select(*key, F.explode(F.sequence("first", F.least(F.col("first") + step, "n") - 1)).alias("ordinal"))
    name = F.xxhash64("doc_id", "text_crc32", "size")
    salted = F.when(F.col("ordinal") == 0, name).otherwise(F.xxhash64("doc_id", "text_crc32", "size", "ordinal"))
    return copies.select(*key, F.pmod(salted, F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_stats(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot; combined on the map side, at most one row per slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def _largest_first(slots: Column, loads: Column) -> Column:
    """Gives each slot, largest first, to the shard with the least bytes so far.

    ``slots``: array of (bytes, virtual_slot); ``loads``: bytes already in each shard. Returns (virtual_slot, shard).
    """

    def place(acc: Column, slot: Column) -> Column:
        shard = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["loads"], lambda v, j: F.when(j == shard, v + slot["bytes"]).otherwise(v)).alias("loads"),
            F.array_append(acc["placed"], F.struct(slot["virtual_slot"].alias("virtual_slot"), shard.alias("shard"))).alias("placed"),
        )

    empty = F.array().cast("array<struct<virtual_slot:int,shard:int>>")
    ordered = F.array_sort(slots, lambda a, b: F.when(a["bytes"] != b["bytes"], F.signum(b["bytes"] - a["bytes"])).otherwise(a["virtual_slot"] - b["virtual_slot"]).cast("int"))
    return F.aggregate(ordered, F.struct(loads.alias("loads"), empty.alias("placed")), place)["placed"]


def _slot_list() -> Column:
    return F.collect_list(F.struct("bytes", "virtual_slot"))


def new_map(stats: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """First version of the map: version, virtual_slot, shard, bytes, n_rows. Only slots that hold rows are listed."""
    loads = F.array_repeat(F.lit(0).cast("long"), n_shards)
    placed = stats.agg(_slot_list().alias("slots")).select(F.inline(_largest_first(F.col("slots"), loads)))
    return stats.join(placed, "virtual_slot").select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "n_rows")


def rebalance(slot_map: DataFrame, stats: DataFrame, n_shards: int) -> DataFrame:
    """Next version of the map for current ``stats`` and ``n_shards``, moving as few slots as needed.

    A shard keeps its slots, smallest first, while they fit into an equal share of all bytes; the rest, slots of
    shards that no longer exist and slots seen for the first time are dealt out, largest first, to the emptiest shard.
    """
    share = F.sum("bytes").over(W.partitionBy()) / n_shards
    now = stats.join(slot_map.select("virtual_slot", "shard"), "virtual_slot", "left").withColumn("share", share)
    filled = F.sum("bytes").over(W.partitionBy("shard").orderBy("bytes", "virtual_slot"))
    judged = now.withColumn("stays", F.coalesce((F.col("shard") < n_shards) & (filled <= F.col("share")), F.lit(False)))
    start = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda i: F.aggregate("slots", F.lit(0).cast("long"), lambda held, s: held + F.when(s["stays"] & (s["shard"] == i), s["bytes"]).otherwise(F.lit(0))),
    )
    moved = F.transform(F.filter("slots", lambda s: ~s["stays"]), lambda s: F.struct(s["bytes"].alias("bytes"), s["virtual_slot"].alias("virtual_slot")))
    listed = judged.agg(F.collect_list(F.struct("bytes", "virtual_slot", "shard", "stays")).alias("slots"))
    placed = listed.select(F.inline(_largest_first(moved, start)))
    places = judged.where("stays").select("virtual_slot", "shard").unionByName(placed)
    version = (slot_map.agg(F.max("version")).first()[0] or 0) + 1
    return stats.join(places, "virtual_slot").select(F.lit(version).alias("version"), "virtual_slot", "shard", "bytes", "n_rows")


def store_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version; earlier ones stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One stored version, by default the newest."""
    maps = spark.read.schema(MAP).parquet(path)
    if version is not None:
        return maps.where(F.col("version") == version)
    return maps.join(F.broadcast(maps.agg(F.max("version").alias("version"))), "version")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``records`` with shard and ``slot``, the row's place in its shard, gapless from 0.

    Places are counted per virtual slot and shifted by the rows of the shard's earlier slots, so no shard is ever
    sorted as a whole. The map has at most one row per virtual slot and is broadcast.
    """
    before = F.sum("n_rows").over(W.partitionBy("shard").orderBy("virtual_slot")) - F.col("n_rows")
    base = slot_map.select("virtual_slot", "shard", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(base), "virtual_slot").withColumn("slot", F.col("before") + F.col("inside")).drop("before", "inside")


def has_map(spark, path: str) -> bool:
    """Whether a map was stored at ``path``, asked of the store that Spark writes to."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> DataFrame:
    """Places every row by the newest map at ``map_path``; texts are read once, only sizes and checksums are kept.

    Without a map there, or without a path, the first version is made and stored. A stored one is edited for the rows as they are now and
    stored as the next version; rows of slots that stay where they were do not move.
    """
    spark = docs.sparkSession
    map_path = map_path or new_shared_path(spark, "slot_map")
    rows = materialize(records(docs, n_slots), "shard_records")
    stats = materialize(slot_stats(rows), "shard_stats")
    store_map(rebalance(read_map(spark, map_path), stats, n_shards) if has_map(spark, map_path) else new_map(stats, n_shards), map_path)
    return place(rows, read_map(spark, map_path))


def op8_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 of nearly equal bytes, by the first version of a stored map.

    Rows are spread for equal bytes, so equal texts under different doc_ids are not kept together.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = shard_documents(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
