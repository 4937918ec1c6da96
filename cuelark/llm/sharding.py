"""Sharding over fixed virtual slots with a versioned, editable slot map.

A record's hash names one of a few thousand virtual slots, for good. Which shard
a slot lies in is said by a map with a version: rebalancing and growing edit the
map, moving few slots, and never rehash records. Each version is stored; the next
run edits the latest. Only the per-slot sums (as many rows as slots) come to the
driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from cuelark.llm.storage import cut, local_table, shared_dir

SLOTS, SHARDS, SEED = 4096, 16, 7


@dataclass(frozen=True)
class SlotMap:
    """Slot i lies in shard ``shard_of[i]``; every edit makes the next version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(i % shards for i in range(slots)))

    def rebalanced(self, weight: list[int]) -> SlotMap:
        """The map after moving slots from the heaviest to the lightest shard.

        Each move takes the slot that brings the two nearest to each other; it
        ends when no single move narrows the gap between them.
        """
        held: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(self.shard_of):
            held[shard].append(slot)
        load = [sum(weight[i] for i in slots) for slots in held]
        while True:
            high, low = max(range(self.shards), key=lambda s: (load[s], -s)), min(range(self.shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            moves = [i for i in held[high] if 0 < weight[i] < gap]
            if not moves:
                break
            slot = min(moves, key=lambda i: (abs(gap - 2 * weight[i]), i))
            held[high].remove(slot)
            held[low].append(slot)
            load[high] -= weight[slot]
            load[low] += weight[slot]
        shard_of = list(self.shard_of)
        for shard, slots in enumerate(held):
            for slot in slots:
                shard_of[slot] = shard
        return self if tuple(shard_of) == self.shard_of else replace(self, version=self.version + 1, shard_of=tuple(shard_of))

    def grown(self, weight: list[int]) -> SlotMap:
        """The map with one more shard, which alone receives slots: a fair part of each shard's weight."""
        shard_of, part = list(self.shard_of), [0] * self.shards
        load = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            load[shard] += weight[slot]
        for slot, shard in sorted(enumerate(self.shard_of), key=lambda x: (-weight[x[0]], x[0])):
            if (part[shard] + weight[slot]) * (self.shards + 1) <= load[shard]:
                part[shard] += weight[slot]
                shard_of[slot] = self.shards
        return SlotMap(self.version + 1, self.shards + 1, tuple(shard_of))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes this version as one JSON line beside the earlier ones."""
        local_table(spark, [(json.dumps(self.__dict__),)], StructType().add("value", StringType())).coalesce(1).write.mode("overwrite").text(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The version asked for, or the latest."""
        lines = spark.read.text(f"{path}/version={version}" if version else path).select("value").collect()
        held = max((json.loads(x.value) for x in lines), key=lambda x: x["version"])
        return cls(held["version"], held["shards"], tuple(held["shard_of"]))


    @classmethod
    def latest(cls, spark: SparkSession, path: str, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """The latest version stored, or the first map where there is none."""
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        return cls.load(spark, path) if known else cls.first(shards, slots)


def map_home(spark: SparkSession, name: str) -> str:
    """The folder of a table's slot maps, in the shared folder."""
    return f"{shared_dir(spark)}/cuelark-slot-maps/{xxhash.xxh3_64_hexdigest(name)}"


def virtual_slot(*key: Column, slots: int = SLOTS, seed: int = SEED) -> Column:
    """The slot of a record's key; null parts count too."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(slots)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, at: SlotMap | None = None, home: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) a row of ``docs(doc_id, text)``.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1) and ``text_crc32``
    the unsigned CRC-32 of those bytes (null: 0). The law is ``bytes``: the map
    ``at`` (or the latest stored in the folder ``home``, or the first one) is
    rebalanced by the slots' bytes until no move of a slot helps, and stored there
    if that has made a version. ``slot`` is the row's place in its shard,
    gapless from 0 in the order of virtual slot, doc_id, size and checksum; equal
    rows take neighbouring places. The virtual slot is that of doc_id and checksum:
    rows that repeat a doc_id, or have none, are spread by their texts, and rows
    equal in both share one. An empty table gives an empty one; a very long
    text counts whole; other columns are never read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"))
    rows = cut(rows.withColumn("virtual_slot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots=slots)))
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    held = {r.virtual_slot: (r.bytes, r.n) for r in sums.collect()}
    old = at or (SlotMap.latest(spark, home, shards, slots) if home else SlotMap.first(shards, slots))
    plan = old.rebalanced([held.get(i, (0, 0))[0] for i in range(slots)])
    if home and plan.version != old.version:
        plan.save(spark, home)
    begin, entries = [0] * plan.shards, []
    for slot, number in enumerate(plan.shard_of):
        entries.append((slot, number, begin[number]))
        begin[number] += held.get(slot, (0, 0))[1]
    places = local_table(spark, entries, StructType().add("virtual_slot", IntegerType()).add("shard", IntegerType()).add("first", LongType()))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(places), "virtual_slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(plan.version).alias("map_version"))
