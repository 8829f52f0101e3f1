"""Benchmark passages in documents, by a prefix-filtered set join.

A window of an item is a set of shingles, and a document contains the window only if it
contains all of them. So by the prefix rule one necessary shingle is enough to look for,
and the rarer it is the fewer places have to be looked at. The steps:

1. The words of all documents are cut once and written.
2. The words of the items are counted in all documents, a partial aggregate and no more.
   Shingles are ordered by the count that these word counts let expect. Every window keeps
   its first shingle in that order; a window with a word that no document has is out.
3. The kept shingles alone are joined with the shingles of the documents. The place of the
   shingle in its window gives the start of a candidate; starts below zero or too near the
   end of the document are out.
4. The words of candidate documents, and of no others, are moved to their candidates and
   compared with the words of the window at each start.

All steps are DataFrame functions. Item words, item shingles and the numbers of candidate
rows are broadcast if their counted rows are few; beyond that the joins are shuffled.

Defined cases: a null text has no words; an item without words has no window; an item
with fewer words than a window is one window; equal windows of several items count for
each item; repeated rows, and rows without an id, are each judged by their own text; an
empty table of items leaves all documents clean. Other columns of the inputs are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import ascii_lower, text_or_empty

#: What separates words here: everything in ASCII but letters (lower-cased before) and digits.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Params:
    window: int = 10
    shingle: int = 4
    broadcast_rows: int = 1_000_000


def plain_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda w: w != "")


def _shingle(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(w, i + k) for k in range(size)])


def windows(items: DataFrame, p: Params, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, item, w, length, offset, size, h): a row for each shingle of each distinct window of an item."""
    out = items.select(F.col(item).alias("item"), plain_words(text_or_empty(text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(p.window))
    out = out.select("item", length.alias("length"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("start"))
    out = out.select("item", "length", F.slice("w", F.col("start") + 1, F.col("length")).alias("w")).distinct()
    size = F.least(F.col("length"), F.lit(p.shingle))
    out = out.withColumn("size", size).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("length") - size)))
    h = F.coalesce(*[F.when(F.col("size") == k, _shingle(F.col("w"), F.col("offset"), k)) for k in range(1, p.shingle + 1)])
    return out.withColumn("h", h).withColumn("window", F.xxhash64("item", "w"))


def rarity(cut: DataFrame, parts: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """(h, expected): for each item shingle whose words all occur in documents, the logarithm of its expected count, but for a constant."""
    each = parts.select("h", F.slice("w", F.col("offset") + 1, F.col("size")).alias("s")).dropDuplicates(["h"]).select("h", F.size("s").alias("size"), F.explode("s").alias("word"))
    words = _few(scratch.save(each.select("word").distinct()), p)
    counts = scratch.save(cut.select(F.explode("w").alias("word")).join(words, "word").groupBy("word").agg(F.count("*").alias("n")))
    found = each.join(_few(counts, p), "word").groupBy("h", "size").agg(F.sum(F.log("n")).alias("expected"), F.count("*").alias("known"))
    return found.where("known = size").select("h", "expected")


def _few(df: DataFrame, p: Params) -> DataFrame:
    """A written table, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= p.broadcast_rows else df


def matches(cut: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, n_words, at, h): places of the shingles in documents."""
    found = None
    for size in sizes:
        hashed = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: _shingle(F.col("w"), i, size))  # noqa: B023
        one = cut.where(F.col("n_words") >= size).select("row", "n_words", F.posexplode(hashed).alias("at", "h")).join(shingles, "h")
        found = one if found is None else found.unionByName(one)
    return found


def decontaminate(documents: DataFrame, items: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, hit_spans) for every row of `documents`.

    item_ids are strings in order; hit_spans are (start, length) of the occurrences, in words.
    """
    scratch = Scratch(documents.sparkSession, "decontamination")
    cut = documents.select(F.col(key).alias("doc_id"), plain_words(text_or_empty(text)).alias("w")).withColumn("n_words", F.size("w"))
    parts = scratch.save(windows(items, p, item, item_text))
    sizes = [r.size for r in parts.select("size").distinct().orderBy("size").collect()]  # at most p.shingle
    if not sizes:
        none = cut.select("doc_id", F.col("n_words").cast("long").alias("n_words"))
        return none.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<start:int,length:int>>").alias("hit_spans"))

    cut = scratch.save(cut.withColumn("row", F.monotonically_increasing_id()))
    ranked = parts.join(_few(scratch.save(rarity(cut, parts, scratch, p)), p), "h", "left")
    prefix = ranked.groupBy("window", "item", "w", "length").agg(F.min(F.struct("expected", "h", "offset")).alias("rarest"), F.count("expected").alias("present"), F.count("*").alias("all"))
    prefix = scratch.save(prefix.where("present = `all`").select("item", "w", "length", F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset")))
    found = scratch.save(matches(cut, _few(scratch.save(prefix.select("h").distinct()), p), sizes))

    start = F.col("at") - F.col("offset")
    placed = found.join(_few(prefix, p), "h").withColumn("start", start).where("start >= 0 and start + length <= n_words")
    tried = scratch.save(placed.groupBy("row").agg(F.collect_set(F.struct("start", "length", "w", F.col("item").cast("string").alias("item"))).alias("tried")))
    words = cut.select("row", "w").join(_few(scratch.save(tried.select("row")), p), "row", "left_semi")
    hit = F.filter("tried", lambda c: F.slice(F.col("w"), c["start"] + 1, c["length"]) == c["w"])
    both = words.join(tried, "row").select("row", hit.alias("hits")).where(F.size("hits") > 0)
    both = scratch.save(both.select(
        "row",
        F.array_sort(F.array_distinct(F.transform("hits", lambda c: c["item"]))).alias("item_ids"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"))))).alias("hit_spans"),
    ))
    scratch.keep(cut, both)
    both = cut.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words")).join(_few(both, p), "row", "left")
    both = both.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("item_ids", "hit_spans")])
    # spans are in order and the words that one adds are those past the furthest end so far
    covered = F.aggregate(
        "hit_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, c: F.struct((a["n"] + F.greatest(F.lit(0), c["start"] + c["length"] - F.greatest(c["start"], a["end"]))).alias("n"), F.greatest(a["end"], c["start"] + c["length"]).alias("end")),
        lambda a: a["n"],
    )
    return both.select("doc_id", "n_words", covered.cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "hit_spans")
