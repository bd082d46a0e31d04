"""Sharding by fixed virtual slots.

A record's slot is a hash of it and never changes. Bytes are summed per slot, a
versioned map, stored in the shared folder, sends each slot to a shard. A run obeys the
stored map; where its bytes no longer fit, the map is edited and the edit stored as the
next version: only the records of the slots it moves change shard. The map and the byte
sums have one row per virtual slot, a fixed number, so they may be collected and broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Virtual slots; fixed for the lifetime of a data set.
SLOTS = 8192
#: How far above the mean a shard may be before the map is edited.
SLACK = 0.01


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def balance(weights: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """slot -> shard, heaviest slot first onto the lightest shard; ties by number."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return out


def rebalance(old: list[int], weights: dict[int, int], shards: int, slack: float = SLACK) -> list[int]:
    """An edited copy of old for new weights or another number of shards.

    Slots of shards that are gone and, of shards above (1 + slack) times the mean,
    the lightest slots that bring them down, go heaviest first to the lightest
    shard. All other slots stay.
    """
    mean = sum(weights.values()) / shards
    load, mine, moving = [0] * shards, [[] for _ in range(shards)], []
    for slot, shard in enumerate(old):
        if shard < shards:
            load[shard] += weights.get(slot, 0)
            mine[shard].append(slot)
        else:
            moving.append(slot)
    for shard in range(shards):
        for slot in sorted(mine[shard], key=lambda s: (weights.get(s, 0), s)):
            if load[shard] <= mean * (1 + slack):
                break
            if weights.get(slot, 0):
                moving.append(slot)
                load[shard] -= weights[slot]
    out, heap = list(old), [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(moving, key=lambda s: (-weights.get(s, 0), s)):
        least, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (least + weights.get(slot, 0), shard))
    return out


def map_frame(spark: SparkSession, shard_of: list[int], version: int) -> DataFrame:
    """version, vslot, shard: the map as rows, made inside the JVM."""
    line = ",".join(map(str, shard_of))
    return spark.range(1).select(F.posexplode(F.split(F.lit(line), ",")).alias("vslot", "shard")).select(F.lit(version).alias("version"), "vslot", F.col("shard").cast("int").alias("shard"))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def map_path(spark: SparkSession, name: str) -> str:
    """Where the shared folder keeps the map of a data set."""
    return f"{shared_dir(spark)}/slot_map/{name}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written whole, in order."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    whole = [n for n in names if n.startswith("version=") and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.split("=")[1]) for n in whole)


def save_map(spark: SparkSession, shard_of: list[int], version: int, path: str) -> None:
    """Store one version of the map; versions lie side by side and are never changed.

    A folder of this version without its end mark is what an interrupted run left.
    """
    if version in versions(spark, path):
        raise ValueError(f"version {version} of {path} exists")
    map_frame(spark, shard_of, version).drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.parquet(f"{path}/version={version}").collect()  # one row per virtual slot
    return [s for _, s in sorted((r["vslot"], r["shard"]) for r in rows)]


def current_map(spark: SparkSession, path: str, weights: dict[int, int], shards: int, slots: int = SLOTS, slack: float = SLACK) -> tuple[list[int], int]:
    """(map, version) to obey for these bytes: the stored one, edited where it does not fit.

    The first version balances these bytes. Later ones are edits: of a map for another
    number of shards, or of one whose fullest shard is over (1 + slack) times the mean
    and gets lighter by the edit. Every version is stored before it is obeyed.
    """
    known = versions(spark, path)
    if not known:
        made = balance(weights, shards, slots)
    else:
        old = load_map(spark, path, known[-1])
        if len(old) != slots:
            raise ValueError(f"the map at {path} has {len(old)} slots, not {slots}; slots are fixed for the lifetime of a data set")

        def fullest(shard_of: list[int]) -> int:
            load = [0] * max(shards, max(shard_of) + 1)
            for slot, n in weights.items():
                load[shard_of[slot]] += n
            return max(load)

        made = rebalance(old, weights, shards, slack)
        same_shards = max(old) < shards and (len(set(old)) == shards or not weights)
        if made == old or same_shards and (fullest(made) >= fullest(old) or fullest(old) <= sum(weights.values()) / shards * (1 + slack)):
            return old, known[-1]
    version = (known or [0])[-1] + 1
    save_map(spark, made, version, path)
    return made, version


def shard_documents(docs: DataFrame, path: str, shards: int = 40, overhead: int = 16, slots: int = SLOTS, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot (place in its shard, gapless from 0), map_version.

    Law `bytes`: shards have nearly equal sizes, a record's being the UTF-8 bytes of
    its text plus overhead. path: the data set's map (map_path); map_version says which
    of its versions a row obeys. Null texts have no bytes, null and repeated ids are
    ordinary rows, an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = cut(rows.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), slots=slots)))
    sums = cut(rows.groupBy("vslot").agg(F.sum("size").alias("s_bytes"), F.count("*").alias("s_rows")))  # one row per virtual slot
    shard_of, version = current_map(spark, path, {r[0]: r[1] for r in sums.select("vslot", "s_bytes").collect()}, shards, slots, slack)
    where = map_frame(spark, shard_of, version)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    known = where.join(sums, "vslot").withColumn("s_before", F.coalesce(F.sum("s_rows").over(before), F.lit(0)))
    within = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumn("s_row", F.row_number().over(within) - 1).join(F.broadcast(known.select("vslot", "shard", "s_before", "version")), "vslot")
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("s_before") + F.col("s_row")).cast("long").alias("slot"), F.col("version").alias("map_version"))
