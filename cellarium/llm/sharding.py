"""Sharding by fixed virtual slots and a versioned slot-to-shard map; DataFrame operations only.

A record's slot is a hash of its id, for ever; a shard owns a set of slots. Bytes are summed by slot, and the map of a
new version is edited so that the shards' sums come close while few slots move. The map is a small table (one row per
slot and version) kept in the shared folder.

Defined cases: a null id hashes like any value; a null text has no bytes; repeated rows are placed one by one; rows of
equal id share a slot; an empty table has an empty result and every slot in its map. Extra columns are ignored by the
query; `place` keeps them all and replaces columns named as its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellarium.llm.common import materialize

#: Slots never change in number once records are stored, so there are thousands for a few shards.
SLOTS = 4096
SHARDS = 8

MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType(), False), T.StructField("virtual_slot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False), T.StructField("bytes", T.LongType(), False), T.StructField("n_rows", T.LongType(), False)])


def slot_of(key: str, slots: int = SLOTS):
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n_rows) for every slot, empty ones too. records: virtual_slot, size. At most `slots` rows leave each task."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = records.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def first_map(spark: SparkSession, loads: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """The heaviest slot goes to the lightest shard, and so on. Loads are `slots` rows, a number fixed beforehand, so the driver holds them."""
    rows = loads.collect()
    held = [0] * shards
    out = []
    for r in sorted(rows, key=lambda r: (-r.bytes, r.virtual_slot)):
        k = min(range(shards), key=lambda i: (held[i], i))
        held[k] += r.bytes
        out.append((version, r.virtual_slot, k, r.bytes, r.n_rows))
    return spark.createDataFrame(sorted(out, key=lambda x: x[1]), MAP_SCHEMA)


def rebalanced_map(spark: SparkSession, old: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, for new loads or another number of shards.

    A slot moves only from a shard above the mean to one below it, and only if that narrows the gap between the two;
    slots of shards that are gone are dealt first. Every other slot stays where it is.
    """
    before = old.collect()
    owner = {r.virtual_slot: r.shard for r in before}
    version = max((r.version for r in before), default=0) + 1
    load = {r.virtual_slot: (r.bytes, r.n_rows) for r in loads.collect()}
    held = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    lost = []
    for s, (size, _) in load.items():
        k = owner.get(s, shards)
        if k < shards:
            held[k] += size
            own[k].append(s)
        else:
            lost.append(s)
    for s in sorted(lost, key=lambda s: (-load[s][0], s)):
        k = min(range(shards), key=lambda i: (held[i], i))
        held[k] += load[s][0]
        own[k].append(s)
    for slots in own:
        slots.sort(key=lambda s: (load[s][0], s))
    for _ in range(len(load)):
        high, low = max(range(shards), key=lambda i: (held[i], -i)), min(range(shards), key=lambda i: (held[i], i))
        half = (held[high] - held[low]) / 2
        fits = [s for s in own[high] if 0 < load[s][0] <= half]
        if not fits:
            break
        s = fits[-1]
        own[high].remove(s)
        own[low].append(s)
        own[low].sort(key=lambda s: (load[s][0], s))
        held[high] -= load[s][0]
        held[low] += load[s][0]
    return spark.createDataFrame(sorted((version, s, k, *load[s]) for k, slots in enumerate(own) for s in slots), MAP_SCHEMA)


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records (virtual_slot, doc_id, text_crc32, size, ...) with shard and slot, their gapless place in the shard.

    Rows are numbered within their virtual slot and shifted by the rows of the shard's slots before it, so no task orders a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long").alias("_base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    kept = [c for c in records.columns if c not in ("shard", "slot", "_base", "_rank")]
    # the map has a fixed number of small rows
    return records.select(*kept, rank.alias("_rank")).join(F.broadcast(base), "virtual_slot").select(*kept, "shard", (F.col("_base") + F.col("_rank") - 1).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    records = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"), slot_of("doc_id").alias("virtual_slot"))
    slot_map = materialize(first_map(spark, slot_loads(docs.select(size.alias("size"), slot_of("doc_id").alias("virtual_slot"))), SHARDS), "slot-map-v1")
    out = place(records, slot_map)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
