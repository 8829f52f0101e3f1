"""Shards by balanced label propagation.

Documents are linked when their texts are equal; a group of equal texts is a hub node, so
a group of any size has one link a member and no pairs. Starting from an even deal by a
hash, each round moves documents towards the shard that holds most of their group, under
quotas:

1. Members of each group are counted by shard (a partial aggregate, at most one row for
   each group and shard). A group that is larger than a shard gets as many of its fullest
   shards as it needs.
2. Each shard admits those who want it, linked documents before single ones, until its
   quota is full. The others wait in a pool and fill, in the order of their groups, the
   places that remain. So after every round all counts are at most one apart.
3. Rounds go on while fewer documents are cut off from the main shard of their group. Each
   round lowers a whole number, so they end.

Places in a shard come from counts of hashed buckets and a row number inside a bucket; a
group that is large for a bucket is salted over several. No task holds a whole shard; what
one task does see are the counts of all buckets, one number for every `bucket_rows` rows.
What is known of a group comes to its members by a broadcast of counted size or by salts.

Defined cases: a null text counts as an empty one; repeated rows each take a place; a null
id is dealt by its null hash; fewer rows than shards leave shards empty; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import with_one_row_a_key
from .store import Scratch
from .text import text_or_empty


@dataclass(frozen=True)
class Params:
    shards: int = 40
    bucket_rows: int = 5_000
    overhead: int = 16
    """Bytes that a document takes besides its text."""
    broadcast_rows: int = 1_000_000


def _ranked(df: DataFrame, within: list[str], bucket: dict[str, Column], order: list[str], out: str) -> DataFrame:
    """Adds `out`, a rank from 0 inside `within`, in the order of the buckets and then of `order`.

    What a window sees is one bucket, or the counts of buckets.
    """
    keys = [*within, *bucket]
    df = df.withColumns(bucket)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return df.join(offsets, keys).withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_before", *bucket)


def _buckets(rows: int, p: Params) -> dict[str, Column]:
    """Buckets by group, where a group that is large for one is salted."""
    n = max(1, rows // p.bucket_rows)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("members") / p.bucket_rows))
    return {"_b": F.pmod(F.xxhash64("g"), F.lit(n)).cast("int"), "_salt": F.pmod(F.xxhash64("doc_id"), pieces).cast("int")}


def _wishes(now: DataFrame, quota: int, scratch: Scratch, p: Params) -> DataFrame:
    """Adds `wish`, the shard that each row wants: its own, unless most of its group are elsewhere."""
    votes = now.where("members > 1").groupBy("g", "members", "shard").agg(F.count("*").alias("n"))
    full = votes.groupBy("g").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.pmod(F.xxhash64("g", "shard"), F.lit(1 << 20)).alias("tie"), "shard"))).alias("by"), F.first("members").alias("m"))
    mains = scratch.save(full.select("g", F.slice(F.col("by")["shard"], F.lit(1), F.ceil(F.col("m") / quota).cast("int")).alias("mains")))
    other = F.get("mains", F.pmod(F.xxhash64("doc_id"), F.size("mains")).cast("int"))
    wish = F.when(F.col("mains").isNull() | F.array_contains("mains", F.col("shard")), F.col("shard")).otherwise(other)
    return with_one_row_a_key(now, mains, ["g"], "doc_id", p.broadcast_rows, "left").withColumn("wish", wish).drop("mains")


def _round(now: DataFrame, rows: int, scratch: Scratch, p: Params) -> DataFrame:
    """One round of moves: new shard and slot for every row."""
    low, more = divmod(rows, p.shards)
    quota = F.lit(low) + (F.col("wish") < more).cast("int")
    linked = (F.col("members") == 1).cast("int")
    asked = _ranked(_wishes(now, max(1, low), scratch, p), ["wish"], {"_p": linked, **_buckets(rows, p)}, ["g", "doc_id", "crc"], "place")
    asked = scratch.save(asked.withColumn("admitted", F.col("place") < quota))
    # the 40 totals of wishes tell where places remain
    got = {r.wish: r["count"] for r in asked.groupBy("wish").count().collect()}
    free, start = [], 0
    for s in range(p.shards):
        size = low + (s < more)
        taken = min(size, got.get(s, 0))
        if size > taken:
            free.append((s, start, start + size - taken, taken))
        start += size - taken
    stay = asked.where("admitted").select("doc_id", "size", "crc", "g", "members", F.col("wish").alias("shard"), F.col("place").alias("slot"))
    if not free:
        return stay
    pool = _ranked(asked.where("not admitted").withColumn("_one", F.lit(0)), ["_one"], _buckets(rows, p), ["g", "doc_id", "crc"], "at")
    place = F.coalesce(*[F.when((F.col("at") >= a) & (F.col("at") < b), F.struct(F.lit(s).alias("shard"), (F.col("at") - a + taken).alias("slot"))) for s, a, b, taken in free])
    placed = pool.withColumn("to", place).select("doc_id", "size", "crc", "g", "members", F.col("to.shard").alias("shard"), F.col("to.slot").alias("slot"))
    return stay.unionByName(placed)


def cut(now: DataFrame) -> int:
    """Documents outside the fullest shard of their group."""
    votes = now.where("members > 1").groupBy("g", "shard").agg(F.count("*").alias("n"))
    return votes.groupBy("g").agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def shard(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; counts of shards are at most one apart."""
    scratch = Scratch(df.sparkSession, "sharding")
    body = text_or_empty(text)
    docs = df.select(F.col(key).alias("doc_id"), (F.octet_length(body) + p.overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("g"))
    docs = scratch.save(docs)
    rows = docs.count()
    shared = scratch.save(docs.groupBy("g").agg(F.count("*").alias("members")).where("members > 1"))
    start = with_one_row_a_key(docs, shared, ["g"], "doc_id", p.broadcast_rows, "left").fillna(1, ["members"]).withColumn("_one", F.lit(0))
    n = max(1, rows // p.bucket_rows)
    deal = {"_b": F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")}
    start = _ranked(start, ["_one"], deal, ["doc_id", "crc"], "r").withColumn("shard", (F.col("r") % p.shards).cast("int")).withColumn("slot", F.floor(F.col("r") / p.shards)).drop("r", "_one")
    now = scratch.save(start.select("doc_id", "size", "crc", "g", "members", "shard", "slot"))
    scratch.keep(now)
    least = cut(now)
    while least:
        then = scratch.save(_round(now, rows, scratch, p).select("doc_id", "size", "crc", "g", "members", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")))
        left = cut(then)
        better = then if left < least else now
        scratch.keep(better)
        if better is now:
            break
        now, least = then, left
    return now.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))
