"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set is its distinct shingles, hashed to 64 bits. Its sketch is the k least
hashes. The steps:

1. Documents with equal sets form a class, found by grouping on a 128-bit digest of the
   sorted set and its size; what follows sees one representative of each class.
2. Inverted lists of retained values generate overlaps. Two sets of the wanted similarity
   share at least `overlap` retained values (but for a chance under 1e-8), so by the prefix
   rule it is enough to list the rarest values of every sketch: a passage that very many
   documents share leaves no trace unless it makes up about half of a document.
3. Every list links its members to its least member first, and each member goes to the
   best of these centres. After the links are verified, lists that hold one component
   are done, so a large group of near copies costs a star.
4. For the documents of the other lists the same rule is applied to their whole sets, in
   which it is exact: only documents meet whose rarest fifth has a value in common. A few
   rounds of stars about centres drawn by a hash join what belongs together; then all
   pairs across components are tried, so no link between different texts is lost.
5. The sketch of the union, taken from two sketches, estimates the similarity and drops
   clearly lower pairs; the full sets of the others decide.

Values that exactly the same documents hold give the same pairs, and stand in the lists
once: a passage counts as one value, however long it is.

Hot values and centres: tables with one row a value are broadcast when their counted rows
are few, else salted; a centre with many members gets a copy of its set for every
`block_rows` of them; where all pairs of a list are tried, the list is cut into blocks and
each pair of blocks is a key of its own.

The chance in step 2 can be bought off: with `EXACT` the sketch is the whole set, and no
link is missed at all.

Defined cases: a null text or one without words has an empty set, is linked with nothing
and is kept; fewer words than a shingle has make one shingle of all; repeated rows with
the same key are one document and share its fate, those without words too; a null key is
its own component and is kept; an empty table gives an empty result. Input columns other than key and text are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .joins import with_one_row_a_key
from .store import Scratch
from .text import ascii_lower, text_or_empty, words


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 80
    """Least similarity, in percent of the union."""
    k: int = 64
    overlap: int = 31
    """Shared values among k that similar sets have: 64 draws at 0.8 give fewer with chance 4e-9."""
    star_rounds: int = 3
    broadcast_rows: int = 1_000_000
    """Tables of ids with more rows than this are joined by shuffles, never broadcast."""
    block_rows: int = 500
    """Members of a hot centre or list that meet in one task at a time."""


EXACT = {"k": 1 << 30, "overlap": 1 << 29}
"""Settings of `Params` without the chance of a missed link; sketches are whole sets then."""


def hashes(w: Column, size: int) -> Column:
    """Distinct hashes of the `size`-word shingles of the array column `w`."""
    n = F.size(w)
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.array_distinct(F.when(n >= size, each).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>")))


def sets(df: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, s): the full set of each row."""
    out = df.select(F.col(key).alias("doc_id"), words(ascii_lower(text_or_empty(text))).alias("w"))
    return out.select("doc_id", hashes(F.col("w"), p.shingle).alias("s"))


def sketches(df: DataFrame, p: Params, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch): set size, digest of the set, the k least hashes."""
    out = sets(df, p, key, text).select("doc_id", F.sort_array("s").alias("s"))
    return out.select(
        "doc_id", F.size("s").cast("long").alias("n_shingles"), F.xxhash64("s").alias("d1"), F.xxhash64(F.reverse("s")).alias("d2"), F.slice("s", 1, p.k).alias("sketch")
    )


def _postings(reps: DataFrame, retained: Column, needed: Column) -> DataFrame:
    """(value, id, n, at): the rarest values of each sketch, where others hold them too, and their places in its order.

    `needed` of the `retained` values of a sketch must be shared, so all but the rarest
    retained - needed + 1 can be left out of the lists.
    """
    each = reps.select("id", "n", F.explode("sketch").alias("value"))
    marks = [F.sum(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 31))).alias(f"mark{k}") for k in range(3)]  # of the holders, repeated ones too
    shared = each.groupBy("value").agg(F.count("*").alias("df"), *marks).where("df > 1")
    # of values with the same holders the least comes first in every sketch, and stands for all
    holders = ["df", "mark0", "mark1", "mark2"]
    first = shared.groupBy(*holders).agg(F.min("value").alias("first"))
    shared = shared.join(first, holders).select("value", "df", (F.col("value") == F.col("first")).alias("first"))
    held = each.join(shared, "value").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value", "first"))).alias("held"))
    own = retained - F.size("held")  # values that no other sketch holds come first
    held = held.withColumns({"own": own, "take": (retained - needed + 1 - own).cast("int")}).where("take > 0")
    each = held.select("id", "n", "own", F.posexplode(F.slice("held", F.lit(1), F.col("take"))).alias("k", "v"))
    return each.where("v.first").select("v.value", "id", "n", (F.col("own") + F.col("k")).cast("long").alias("at"))


def _near_size(a: Column, b: Column, p: Params) -> Column:
    return 100 * F.least(a, b) >= p.percent * F.greatest(a, b)


def _few(df: DataFrame, p: Params) -> DataFrame:
    """A written table of ids, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= p.broadcast_rows else df


def _by_value(lists: DataFrame, values: DataFrame, p: Params, how: str = "inner") -> DataFrame:
    return with_one_row_a_key(lists, values, ["value"], "id", p.broadcast_rows, how)


def _fanned(pairs: DataFrame, scratch: Scratch, p: Params) -> tuple[DataFrame, DataFrame]:
    """(a, b, salt), and (a, pieces): a centre with many members is met in pieces, a salt each."""
    pieces = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / p.block_rows).cast("int").alias("pieces")))
    hot = _few(scratch.save(pieces.where("pieces > 1")), p)
    salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int"), F.lit(0))
    return scratch.save(pairs.join(hot, "a", "left").select("a", "b", salt.alias("salt"))), pieces


def _copies(centres: DataFrame, pieces: DataFrame) -> DataFrame:
    """A row of each centre for each of its pieces."""
    return centres.join(pieces, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")


def _estimated(pairs: DataFrame, reps: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """Adds `estimate`, from the sketch of the union, and drops pairs that are clearly unlike."""
    pairs, pieces = _fanned(pairs, scratch, p)
    left = _copies(reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), pieces)
    right = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    both = pairs.join(right, "b").join(left, ["a", "salt"])
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, p.k)
    both = both.select("a", "b", union.alias("u"), F.array_intersect("sa", "sb").alias("common"))
    estimate = F.size(F.array_intersect("u", "common")) / F.size("u")
    return both.select("a", "b", estimate.alias("estimate")).where(F.col("estimate") >= p.overlap / p.k)


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """Those (a, b) of a written table whose full sets, made anew from the texts, are similar enough."""
    pairs, pieces = _fanned(pairs, scratch, p)
    texts = docs.select(F.col("doc_id"), "text")
    members = sets(texts.join(_few(pairs, p), texts.doc_id == F.col("b")).select(F.struct("a", "b", "salt").alias("doc_id"), "text"), p)
    members = members.select("doc_id.*", F.col("s").alias("sb"))
    centres = sets(texts.join(_few(pieces.select(F.col("a").alias("doc_id")), p), "doc_id"), p).select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    return _enough(members.join(_copies(centres, pieces), ["a", "salt"]).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both")), p)


def _alike(pairs: DataFrame, whole: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """Those (a, b) whose whole sets, given as (id, n, sketch), are similar enough."""
    pairs, pieces = _fanned(pairs, scratch, p)
    left = _copies(whole.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), pieces)
    right = whole.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return _enough(pairs.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both")), p)


def _enough(common: DataFrame, p: Params) -> DataFrame:
    return common.where(100 * F.col("both") >= p.percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct()


def _placed(lists: DataFrame, found: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """The lists that hold more than one component, with the component `c` of each member."""
    placed = lists.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed = scratch.save(placed.groupBy("value").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("value"))
    return _by_value(placed, mixed, p, "left_semi")


def _pairs_across(open_: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """(a, b): all pairs of different components in the lists that can be similar enough, each at the first value that both list."""
    # what precedes that value in one set is not in the other
    ordered = open_.groupBy("id", "n", "c").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
    each = ordered.select("id", "n", "c", F.col("v")["value"].alias("values"), F.posexplode("v").alias("k", "p"))
    each = each.select("p.value", "p.at", "id", "n", "c", F.slice("values", F.lit(1), F.col("k")).alias("earlier"))
    long = scratch.save(open_.groupBy("value").agg(F.ceil(F.count("*") / p.block_rows).cast("int").alias("blocks")).where("blocks > 1"))
    each = _by_value(each, long, p, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = each.select("value", own.alias("bx"), other.alias("by"), *[F.col(o).alias(o + "a") for o in ("id", "n", "c", "at", "earlier")])
    y = each.select("value", own.alias("by"), other.alias("bx"), *[F.col(o).alias(o + "b") for o in ("id", "n", "c", "at", "earlier")])
    most = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    reachable = (100 + p.percent) * most >= p.percent * (F.col("na") + F.col("nb"))
    met = x.join(y, ["value", "bx", "by"]).where((F.col("ida") < F.col("idb")) & (F.col("ca") != F.col("cb")) & reachable & ~F.arrays_overlap("earliera", "earlierb"))
    return met.select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def assign(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `df`."""
    scratch = Scratch(df.sparkSession, "near_dedup")
    docs = df.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    sketched = scratch.save(sketches(docs, p))

    full = sketched.where("n_shingles > 0 and doc_id is not null")
    same_set = ["n_shingles", "d1", "d2"]
    classes = scratch.save(full.groupBy(*same_set).agg(F.min("doc_id").alias("id"), F.count("*").alias("c")).where("c > 1").drop("c"))
    full = with_one_row_a_key(full, classes, same_set, "doc_id", p.broadcast_rows, "left").withColumn("id", F.coalesce("id", "doc_id"))
    other = sketched.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.lit(None).cast(sketched.schema["doc_id"].dataType).alias("id"))
    members = scratch.save(full.select("doc_id", "n_shingles", "id").unionByName(other))
    reps = scratch.save(full.where("doc_id = id").dropDuplicates(["id", "d1", "d2"]).select("id", F.col("n_shingles").alias("n"), "sketch"))

    enough = F.ceil(F.col("n") * p.percent / 100)
    lists = scratch.save(_postings(reps, F.least(F.col("n"), F.lit(p.k)), F.least(F.lit(p.overlap), enough)))
    centre = scratch.save(lists.groupBy("value").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("members")).where("members > 1"))
    stars = _by_value(lists, centre, p).where((F.col("id") != F.col("c.id")) & _near_size(F.col("n"), F.col("c.n"), p))
    stars = _estimated(scratch.save(stars.select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()), reps, scratch, p)
    # for each member the centre that it is most like
    best = scratch.save(stars.groupBy("b").agg(F.min(F.struct((-F.col("estimate")).alias("e"), "a")).alias("m")).select("m.a", "b"))
    links = _verified(best, docs, scratch, p)

    # rows with one key and different texts are one document: their classes are linked by it
    same = members.where("id is not null").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    several = same.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least <> most").select("a")
    links = scratch.save(links.unionByName(same.join(several, "a", "left_semi").distinct()))
    found = scratch.save(components(links, scratch))

    left = scratch.save(_placed(lists, found, scratch, p).select(F.col("id").alias("doc_id")).distinct())
    # written before it is filtered: a filter on what the shingles give would be pushed below them and cut the words anew for each
    whole = scratch.save(sets(docs.join(_few(left, p), "doc_id", "left_semi"), p))
    whole = whole.select(F.col("doc_id").alias("id"), F.size("s").cast("long").alias("n"), F.col("s").alias("sketch")).where("n > 0")
    lists = scratch.save(_postings(whole, F.col("n"), enough).distinct())

    def linked(pairs: DataFrame) -> None:
        """Adds the links among these pairs, and what they change in the components."""
        nonlocal links, found
        new = scratch.save(_alike(scratch.save(pairs.distinct()), whole, scratch, p))
        if not new.isEmpty():
            links = scratch.save(links.unionByName(new))
            found = scratch.save(components(links, scratch))

    for turn in range(p.star_rounds):
        open_ = scratch.save(_placed(lists, found, scratch, p))
        drawn = scratch.save(open_.groupBy("value").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "c")).alias("m")))
        pairs = _by_value(open_, drawn, p).where((F.col("c") != F.col("m.c")) & _near_size(F.col("n"), F.col("m.n"), p))
        linked(pairs.select(F.col("m.id").alias("a"), F.col("id").alias("b")))
    linked(_pairs_across(scratch.save(_placed(lists, found, scratch, p)), scratch, p))

    # rows without words whose key has a row with words belong to that document
    bare = scratch.save(members.where("id is null and doc_id is not null").select("doc_id").distinct())
    lent = scratch.save(same.join(_few(bare.withColumnRenamed("doc_id", "a"), p), "a", "left_semi").groupBy("a").agg(F.min("b").alias("lent")))
    if not lent.isEmpty():
        members = scratch.save(members.join(_few(lent.withColumnRenamed("a", "doc_id"), p), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("id", "lent").alias("id")))
    scratch.keep(members, found)

    out = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component_id", F.coalesce("component", "id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
