"""Operator 9, sharding over fixed virtual slots [native].

Records are hashed into a fixed number of virtual slots (thousands). Bytes and
rows are aggregated per slot, and a small versioned map says which shard holds
each slot. The map is stored, a Parquet folder per version: ``store_map`` writes
one, ``stored_map`` reads one, ``edit_map`` stores an edited copy of the last one
as the next version. Growing or rebalancing edits the map, never the hash: only
the rows of the slots that change hands move.

Rows of one slot are numbered in ``BUCKETS`` buckets by their text's CRC, so that
many rows of one id, or without one, are no single window.

Defined results: a null id hashes as the empty string; a null text has no bytes
and the CRC of the empty text; repeated rows each get a place of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage

#: Fixed number of virtual slots; the map's size, and so all that is broadcast, is bounded by it.
SLOTS = 8192
#: Buckets of a slot whose rows are numbered apart; the table of their sizes has SLOTS * BUCKETS rows at most.
BUCKETS = 16
#: Bytes added to each record for its framing.
OVERHEAD = 16


def slot_of(key: str, slots: int = SLOTS) -> Column:
    """Virtual slot of a key column: the first 32 bits of its MD5, modulo ``slots``."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).cast("int")


def grow(assignment: list[int], shards: int) -> list[int]:
    """The map edited for one shard more: the new shard takes single slots from the fullest ones, and nothing else moves."""
    owned: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(assignment):
        owned[shard].append(slot)
    heap = [(-len(v), s) for s, v in owned.items()]
    heapq.heapify(heap)
    edited = list(assignment)
    for _ in range(len(assignment) // (shards + 1)):
        size, shard = heapq.heappop(heap)
        edited[owned[shard].pop()] = shards
        heapq.heappush(heap, (size + 1, shard))
    return edited


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map of ``shards`` shards, grown one at a time from a single shard: it depends on the two counts alone."""
    assignment = [0] * slots
    for n in range(1, shards):
        assignment = grow(assignment, n)
    return assignment


def rebalance(assignment: list[int], slot_bytes: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """The map edited so that shard bytes come within ``tolerance`` of their mean, moving as few slots as a greedy pass finds.

    Not for the ``key`` law, whose map may not depend on the data.
    """
    edited, load, owned = list(assignment), {}, {}
    for slot, shard in enumerate(assignment):
        load[shard] = load.get(shard, 0) + slot_bytes.get(slot, 0)
        owned.setdefault(shard, []).append(slot)
    mean = sum(load.values()) / max(1, len(load))
    for _ in range(len(assignment)):
        high, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fits = [s for s in owned[high] if 0 < slot_bytes.get(s, 0) < gap]
        if load[high] <= mean * (1 + tolerance) or not fits:
            break
        best = min(fits, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        owned[high].remove(best)
        owned[low].append(best)
        edited[best] = low
        load[high] -= slot_bytes[best]
        load[low] += slot_bytes[best]
    return edited


def _map_rows(spark: SparkSession, assignment: list[int]) -> DataFrame:
    """A map as rows (vslot, shard); built from a string literal, so without Python or RDD code."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, assignment))), ",")).alias("vslot", "s")).select("vslot", F.col("s").cast("int").alias("shard"))


def store_map(spark: SparkSession, path: str, assignment: list[int], version: int = 1) -> int:
    """Write a map as a version of the store at ``path``; a version that is there already is an error, never overwritten."""
    _map_rows(spark, assignment).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return version


def map_versions(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions: (vslot, shard, version); at most ``SLOTS`` rows each."""
    return spark.read.parquet(path).select("vslot", "shard", F.col("version").cast("int").alias("version"))


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """A stored version, the last one by default: its number and its shard per slot."""
    maps = map_versions(spark, path)
    version = maps.agg(F.max("version")).first()[0] if version is None else version
    return version, [r["shard"] for r in maps.filter(F.col("version") == version).orderBy("vslot").collect()]


def edit_map(spark: SparkSession, path: str, edit: Callable[[list[int]], list[int]]) -> int:
    """Store ``edit`` of the last version as the next one; of two edits of one version, the second fails."""
    version, assignment = stored_map(spark, path)
    return store_map(spark, path, edit(assignment), version + 1)


def placed_rows(df: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """Per row: doc_id (the key), size, text_crc32, vslot and bucket."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    return df.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"), crc.alias("text_crc32"),
        slot_of(key, slots).alias("vslot"), (crc % BUCKETS).cast("int").alias("bucket"),
    )


def slot_loads(rows: DataFrame) -> DataFrame:
    """Rows and bytes per bucket of a virtual slot: (vslot, bucket, rows, bytes)."""
    return rows.groupBy("vslot", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def slot_bytes(df: DataFrame, key: str, text: str, slots: int = SLOTS) -> dict[int, int]:
    """Bytes per virtual slot, what ``rebalance`` weighs; at most ``slots`` entries."""
    return {r["vslot"]: r["bytes"] for r in placed_rows(df, key, text, slots).groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def shard_by_map(df: DataFrame, key: str, text: str, maps: DataFrame, version: int) -> DataFrame:
    """Each row's shard under a version of the maps, its place there and its shard under the next version.

    The versions, joined with the loads of their slots, are stored (at most
    ``SLOTS * BUCKETS`` rows) and merged with the rows, which the numbering has
    dealt by slot and bucket already. A row's place in its shard is the
    number of rows in the shard's earlier buckets plus its place in its own, so no
    window spans a whole shard.
    """
    both = maps.filter(F.col("version").isin(version, version + 1))
    wide = both.groupBy("vslot").agg(F.max(F.when(F.col("version") == version, F.col("shard"))).alias("shard"), F.max(F.when(F.col("version") == version + 1, F.col("shard"))).alias("grown_shard"))
    rows = placed_rows(df, key, text)
    earlier = Window.partitionBy("shard").orderBy("vslot", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("vslot")
    loads = slot_loads(rows).join(F.broadcast(wide), "vslot").select("vslot", "bucket", "shard", "grown_shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("bytes").over(whole).alias("vslot_bytes"))
    stored = stage(loads, "slot_loads")
    inside = Window.partitionBy("vslot", "bucket").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("place", F.row_number().over(inside)).join(stored.hint("merge"), ["vslot", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), "grown_shard", "vslot", "vslot_bytes"
    )


def shard_by_key(df: DataFrame, key: str, text: str, shards: int, path: str | None = None) -> DataFrame:
    """``shard_by_map`` under the ``key`` law: version 1 is the map of ``shards`` shards, version 2 its stored copy grown by one shard.

    ``path``: the store of the maps, kept there for later edits; by default one of this call's own in the shared folder.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/slot_map-{uuid.uuid4().hex}"
    first = store_map(spark, path, first_map(shards))
    edit_map(spark, path, lambda assignment: grow(assignment, shards))
    return shard_by_map(df, key, text, map_versions(spark, path), first)


SHARDS = 40


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_key(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", SHARDS)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def sql() -> str:
    base = first_map(SHARDS)
    csv = lambda a: ",".join(map(str, a))
    return f"""
WITH m AS (SELECT string_split('{csv(base)}', ',') AS m0, string_split('{csv(grow(base, SHARDS))}', ',') AS m1, [{csv(_crc_table())}]::BIGINT[] AS t),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INT AS vslot FROM documents),
c AS (SELECT doc_id, size::BIGINT AS size, vslot, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, x: xor(a >> 8, t[(xor(a & 255, x) + 1)::INT])), 4294967295::BIGINT) AS text_crc32, m0[vslot + 1]::INT AS shard, m1[vslot + 1]::INT AS grown_shard FROM d, m)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY vslot, text_crc32 % {BUCKETS}, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard, vslot,
  sum(size) OVER (PARTITION BY vslot)::BIGINT AS vslot_bytes FROM c"""
