"""Sharding over fixed virtual slots, native Spark only.

A record hashes into one of ``slots`` virtual slots, for good. Bytes and rows are summed per slot,
and a versioned map of at most ``slots`` rows says which shard holds each slot. Rebalancing edits
that map: it adds a version, made from the latest stored one, and never changes an older one; records
never rehash.

The hash takes doc_id, text and, where whole rows repeat, the number of the copy, so neither one id
nor one row with a third of the table fills a slot. Nulls: a null text has no bytes, a null doc_id is
told apart by its text. Ties in a slot are rows with the same id, checksum and size, which are alike in
all that is returned. Texts of any length are read once, for length and hashes. Other columns, whatever
their names, are not read. An empty table gives no rows and a map of empty slots.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echograph.session import materialise, new_path

SLOTS = 8192
SHARDS = 16


#: Copies of one row that leave a task at a time.
_COPIES = 4096


def slot_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): all that is read of the texts, in one scan. Rows that
    repeat are counted with map-side combination, then dealt out again by the number of the copy."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text).alias("hash"),
    )
    once = read.groupBy("doc_id", "size", "text_crc32", "hash").agg(F.count("*").alias("n"))
    chunks = once.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_COPIES).cast("long"))))
    many = chunks.filter("n > 1").repartition("hash", "first")
    copies = F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + _COPIES) - 1))
    rows = chunks.filter("n = 1").withColumn("copy", F.lit(0).cast("long")).unionByName(many.withColumn("copy", copies))
    slot = F.pmod(F.when(F.col("copy") == 0, F.col("hash")).otherwise(F.xxhash64("hash", "copy")), F.lit(slots)).cast("int")
    return rows.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_totals(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of every slot, empty ones too."""
    spark = records.sparkSession
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = spark.range(slots, numPartitions=1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def initial_map(totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0: slots dealt in turn, before any sizes are known."""
    return totals.select(F.lit(0).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"))


def rebalance(shard_map: DataFrame, totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map: each shard keeps its largest slots up to the mean load, and the
    others move, largest first, each to the shard that is lightest by then. New shards (``shards``
    over those in the map) fill up the same way, and shards beyond ``shards`` are emptied. The fold runs
    over ``slots`` entries, a constant."""
    load = totals.join(shard_map, "virtual_slot")
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / F.lit(shards)
    upto = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    load = load.withColumn("mean", mean).withColumn("upto", F.sum("bytes").over(upto))
    load = load.withColumn("stays", (F.col("upto") <= F.col("mean")) & (F.col("shard") < shards))
    entry = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes")
    state = load.agg(
        F.array_sort(F.collect_list(F.when(~F.col("stays"), entry))).alias("moving"),
        F.array(*[F.sum(F.when((F.col("shard") == s) & F.col("stays"), F.col("bytes")).otherwise(F.lit(0))) for s in range(shards)]).alias("loads"),
        F.max("version").alias("version"),
    )

    def place(acc, slot):
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int")
        loads = F.transform(acc["loads"], lambda x, i: F.when(i + 1 == to, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array(to - 1)).alias("to"))

    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))
    moved = state.select("version", "moving", F.aggregate("moving", start, place, lambda acc: acc["to"]).alias("to"))
    moved = moved.select(F.inline(F.arrays_zip(F.col("moving.virtual_slot").alias("virtual_slot"), F.col("to").alias("to"))))
    return (
        load.join(moved.select(F.col("virtual_slot"), F.col("to").cast("int").alias("to")), "virtual_slot", "left")
        .select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"))
    )


def save_map(shard_map: DataFrame, path: str, version: int) -> None:
    """Store a version beside the others; one that is there already is an error, never overwritten."""
    shard_map.select("virtual_slot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def map_version(spark: SparkSession, path: str) -> int | None:
    """The latest stored version."""
    try:
        return spark.read.parquet(path).agg(F.max(F.col("version").cast("int"))).first()[0]
    except AnalysisException:  # nothing is stored there yet
        return None


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest by default."""
    version = map_version(spark, path) if version is None else version
    return spark.read.parquet(f"{path}/version={version}").select(F.lit(version).alias("version"), "virtual_slot", "shard")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record's shard and its place there, after one rebalancing by bytes.

    Returns doc_id, size, text_crc32, virtual_slot, map_version, shard and slot (places in a shard,
    gapless from 0, by virtual slot, then doc_id and crc). The map below ``map_path`` is edited, or made
    with versions 0 (slots in turn) and 1. Only the records (no text) shuffle; the map joined in has
    ``slots`` rows.
    """
    spark = docs.sparkSession
    records = materialise(slot_records(docs, slots), "shard-records")
    totals = materialise(slot_totals(records, slots), "shard-totals")
    path = map_path or new_path(spark, "shard-map")
    latest = map_version(spark, path) if map_path else None
    if latest is None:
        latest = 0
        save_map(initial_map(totals, shards), path, latest)
    save_map(rebalance(load_map(spark, path, latest), totals, shards), path, latest + 1)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        load_map(spark, path, latest + 1)
        .join(totals, "virtual_slot")
        .select("virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(placed), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "virtual_slot", "map_version", "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"))
    )


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
