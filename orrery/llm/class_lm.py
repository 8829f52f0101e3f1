"""Language-model scores from a class bigram model (Brown classes found by exchange).

P(word | previous) = P(class | class of the previous) * P(word | class), the latter from the
word's own count.

* Words are counted over all training rows, exactly. Those with a share of `Params.share` of
  the tokens, of which there can't be more than 1 / share, have numbers that every task
  knows; a rarer word goes by a hash, its slot among 2 ** slot_bits. Both are clustered
  alike; that rarer words of one slot have one class is the price of a table of classes (one
  byte each) that can be sent to every task at any size.
* Exchange clustering: a word or slot met at least `Params.least_count` times moves to the
  class that raises the likelihood of the class bigrams most. All rarer words, and those
  never met, belong to one of 2 ** ending_bits pools by a hash of their ending, and a pool
  moves as a word does.
* A pass counts over all training rows the class bigrams and, for those whose turn it is,
  the classes before and after them, as sparse counts. Half of the words and pools have
  their turn in a pass, so that words which would follow each other don't swap for ever;
  slots begin in the second pass, when the frequent words have left their first classes.
* After `Params.passes` passes the loop ends when two passes have raised the likelihood by
  less than `Params.least_gain`; as it is bounded, the loop ends.

To the driver come the counts of frequent words, and in each pass the class bigrams and the
moves: at most 1 / share + 2 ** slot_bits / cycle rows of two numbers, whatever the corpus.

Defined cases: a null or empty text has the end token alone; repeated rows are scored, and
counted, each; with no training row every probability comes from the smoothing; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import SPACES, ascii_lower, sliced, text_or_empty, through_pandas

END = 0  # the number of the end token, which also stands before the first word
POOLED = 255  # in a table of classes: the class is that of the pool
RARE, POOL = 1 << 31, 1 << 32


@dataclass(frozen=True)
class Params:
    share: float = 3e-6
    least_count: int = 5
    """Words met less often don't move on their own."""
    slot_bits: int = 23
    ending_bits: int = 8
    """With the bits of slots at most 31."""
    ending_bytes: int = 2
    classes: int = 32
    """At most 255."""
    passes: int = 6
    """At least so many passes of exchange."""
    cycle: int = 2
    """Passes in which each slot has a turn."""
    slots_from: int = 1
    """The first pass in which slots have turns."""
    least_gain: float = 0.005
    """In nats a token, of two passes; the loop goes on while they gain so much."""
    add: float = 0.5
    backing: float = 20.0
    """Weight, in tokens, of the class unigram behind a class bigram."""


@dataclass(frozen=True)
class Frequent:
    """Frequent words, numbered from 1, and the totals of the training rows."""

    words: dict[bytes, int]
    counts: np.ndarray
    """Of the end token and of each of these words."""
    tokens: int
    vocabulary: int
    least: float


@dataclass
class Classes:
    """The classes of the end token and frequent words, of slots, and of pools.

    A number below RARE is a frequent word; above, the low bits are a slot and those over
    them a pool. A pool itself is named POOL + pool where its moves are told.
    """

    words: np.ndarray
    slots: np.ndarray
    pools: np.ndarray

    def __getstate__(self) -> tuple:
        return self.words, zlib.compress(self.slots.tobytes(), 1), self.pools

    def __setstate__(self, state: tuple) -> None:
        self.words, packed, self.pools = state
        self.slots = np.frombuffer(zlib.decompress(packed), np.uint8)

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        return numbers & len(self.slots) - 1

    def pool(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers & RARE - 1) // len(self.slots)

    def of_numbers(self, numbers: np.ndarray) -> np.ndarray:
        rare = np.flatnonzero(numbers >= RARE)
        out = self.words[np.where(numbers < RARE, numbers, 0)].astype(np.int64)
        own = self.slots[self.slot(numbers[rare])]
        out[rare] = np.where(own == POOLED, self.pools[self.pool(numbers[rare])], own)
        return out

    def moved(self, names: np.ndarray, to: np.ndarray) -> Classes:
        """Of words that share a slot the last one in the arrays has its way."""
        out = Classes(self.words.copy(), self.slots.copy(), self.pools.copy())
        word, pool = names < RARE, names >= POOL
        rare = ~word & ~pool
        out.words[names[word]], out.slots[self.slot(names[rare])], out.pools[names[pool] - POOL] = to[word], to[rare], to[pool]
        return out

    def now(self, names: np.ndarray) -> np.ndarray:
        pool = names >= POOL
        return np.where(pool, self.pools[np.where(pool, names - POOL, 0)], self.of_numbers(np.where(pool, 0, names)))


def rare_numbers(words: list[bytes], p: Params) -> np.ndarray:
    """RARE, the pool by a hash of the word's ending, the slot by a hash of the word."""
    endings = [w[-p.ending_bytes :] for w in words]
    pool = np.fromiter(map(zlib.crc32, endings), np.int64, len(words)) >> 7 & (1 << p.ending_bits) - 1
    return RARE | pool << p.slot_bits | np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (1 << p.slot_bits) - 1


def rare_number(word: bytes, p: Params) -> int:
    return int(rare_numbers([word], p)[0])


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the training rows of (held_out, text)."""
    each = docs.where("not held_out").select(F.explode(F.split("text", SPACES)).alias("word")).where("word <> ''")
    return each.groupBy("word").agg(F.count("*").alias("c"))


def find_frequent(docs: DataFrame, vocabulary: DataFrame, p: Params) -> Frequent:
    """At most 1 / share words come to the driver."""
    ends = docs.where("not held_out").count()
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = total[0] + ends, total[1] + (ends > 0)
    least = max(float(p.least_count), p.share * tokens)
    often = vocabulary.where(F.col("c") >= least).orderBy(F.desc("c"), "word").toPandas()
    return Frequent({w.encode(): 1 + k for k, w in enumerate(often["word"])}, np.array([ends, *often["c"]], np.int64), tokens, distinct, least)


def encode(docs: DataFrame, frequent: Frequent, p: Params) -> DataFrame:
    """(row, doc_id, held_out, numbers, rare): the number of each token, and the words that have none of their own."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent.words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            out, rare = [], []
            for text in batch["text"]:
                split = text.encode().split()  # at the six ASCII spaces
                ids = np.full(len(split) + 1, END, np.int64)
                ids[:-1] = np.fromiter(map(known.get, split, repeat(-1)), np.int64, len(split))
                at = np.flatnonzero(ids < 0)
                missing = [split[k] for k in at.tolist()]
                ids[at] = rare_numbers(missing, p)
                out.append(ids.astype("<u4").tobytes())
                rare.append([w.decode() for w in missing])
            yield batch[["row", "doc_id", "held_out"]].assign(numbers=out, rare=rare)

    return through_pandas(docs, run, "row long, held_out boolean, numbers binary, rare array<string>")


def _flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of a batch, and where documents begin."""
    now = np.frombuffer(b"".join(column), "<u4").astype(np.int64)
    sizes = np.array([len(x) // 4 for x in column], np.int64)
    return now, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def neighbours(encoded: DataFrame, sent: Broadcast, turn: int, p: Params, buckets: int = 256, tokens_at_once: int = 4_000_000) -> DataFrame:
    """(number, codes, counts), sparse counts over all training rows; `sent` holds the classes.

    For numbers that have their turn: code c < K: class c before it, K + c: class c after
    it, and 2 K + K a + b: both, of one token. Number -1 - a has the bigrams of class a, code b.

    Counts travel as arrays, a row for each bucket of numbers.
    """
    k = p.classes
    wide = 2 * k + k * k

    def dealt(key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        bucket = ((key // wide).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        bucket, key, n = bucket[order], key[order], n[order]
        begin = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
        ends = np.append(begin, len(bucket))[1:]
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
        return pd.DataFrame({"bucket": bucket[begin].astype(np.int64), "keys": pd.Series(cut(key), dtype=object), "n": pd.Series(cut(n), dtype=object)})

    def merged(rows: pa.Table) -> pa.Table:
        key, n = (np.frombuffer(b"".join(rows[x].to_pylist()), np.int64) for x in ("keys", "n"))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        begin = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        key, n = key[begin], np.add.reduceat(n, begin)
        number, code = key // wide, (key % wide).astype(np.int32)
        begin = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
        name, size = number[begin], np.diff(np.append(begin, len(number)))
        # the sum of a rarer word is how often it was met; of others it isn't asked
        stay = (name < RARE) | (name >= POOL) | (np.add.reduceat(n, begin) >= p.least_count)
        ends, held = np.concatenate([[0], np.cumsum(size[stay])]).astype(np.int32), np.repeat(stay, size)
        lists = [pa.ListArray.from_arrays(ends, x[held]) for x in (code, n)]
        return pa.table({"number": name[stay], "codes": lists[0], "counts": lists[1]})

    def flat_counts(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = sent.value
        bigrams = np.zeros(k * k, np.int64)
        common: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held = 0

        def counted() -> Iterator[pd.DataFrame]:
            # half of the frequent words are a table, slots a sorted list
            dense = np.bincount(np.concatenate(common), minlength=1)
            found = np.flatnonzero(dense)
            yield dealt((found // (2 * k) * 2 + turn % 2) * wide + found % (2 * k), dense[found])
            yield dealt(*flat_counts(keys))

        for batch in sliced(batches):
            now, begin = _flat(batch["numbers"])
            cls = classes.of_numbers(now)
            left = np.concatenate([[0], cls[:-1]])
            left[begin] = 0
            after = np.append(cls[1:], 0)  # what follows the end token belongs to no bigram
            bigrams += np.bincount(left * k + cls, minlength=k * k)
            mine = np.flatnonzero((now < RARE) & (now % 2 == turn % 2) & (now != END))
            at = now[mine] // 2 * (2 * k)
            common += [at + left[mine], at + k + after[mine]]
            mine = np.flatnonzero(now >= RARE)
            rare, before, behind = now[mine], left[mine], after[mine]
            slot, pool = classes.slot(rare), classes.pool(rare)
            of_pool = (classes.slots[slot] == POOLED) & (pool % 2 == turn % 2)
            names = (POOL + pool[of_pool]) * wide
            keys += [names + before[of_pool], names + k + behind[of_pool]]
            if turn >= p.slots_from:
                turned = slot % p.cycle == turn % p.cycle
                keys.append(rare[turned] * wide + 2 * k + before[turned] * k + behind[turned])
            held += len(now)
            if held >= tokens_at_once:
                yield from counted()
                common, keys, held = [], [], 0
        if held:
            yield from counted()
        found = np.flatnonzero(bigrams)
        yield dealt((-1 - found // k) * wide + found % k, bigrams[found])

    rows = encoded.where("not held_out").select("numbers").mapInPandas(run, "bucket long, keys binary, n binary")
    return rows.groupBy("bucket").applyInArrow(merged, "number long, codes array<int>, counts array<long>")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def transitions(counted: DataFrame, p: Params) -> np.ndarray:
    """Class bigram counts, K by K."""
    out = np.zeros((p.classes, p.classes))
    for r in counted.where("number < 0").collect():  # a row for each class
        out[-1 - r.number, r.codes] = r.counts
    return out


def histograms(codes: list, counts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and after each of several numbers, from their sparse counts."""
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    code, n = np.concatenate(codes).astype(np.int64), np.concatenate(counts).astype(float)
    pair = code - 2 * k
    both = pair >= 0
    left, right = np.zeros((len(codes), k)), np.zeros((len(codes), k))
    one = code < k
    np.add.at(left, (row[one], code[one]), n[one])
    one = (code >= k) & ~both
    np.add.at(right, (row[one], code[one] - k), n[one])
    np.add.at(left, (row[both], pair[both] // k), n[both])
    np.add.at(right, (row[both], pair[both] % k), n[both])
    return left, right


def gains(left: np.ndarray, right: np.ndarray, a: np.ndarray, g: np.ndarray) -> np.ndarray:
    """What moving each word (its classes before and after, its class a now) to each class adds to the likelihood, in nats.

    Exact for a word that never follows itself. Rows and columns of the class bigrams
    change for a and the new class b, and their four crossings by both.
    """
    f, i, diag = _xlogx, np.arange(len(a)), np.diag(g)
    row, col, before, after = g[a], g[:, a].T, g.sum(axis=0), g.sum(axis=1)
    nl, nr = left.sum(axis=1)[:, None], right.sum(axis=1)[:, None]

    def apart(counts: np.ndarray, g: np.ndarray) -> np.ndarray:
        """For each word and b, what its counts add to row b of g, but for the columns a and b; from counts that aren't zero alone."""
        t, y = np.nonzero(counts)
        base = np.ascontiguousarray(g.T)
        change = f(base[y] + counts[t, y][:, None]) - f(base)[y]
        change[np.arange(len(y)), y] = 0
        change[y == a[t]] = 0
        out = np.zeros(counts.shape)
        if len(t):
            first = np.flatnonzero(np.diff(t, prepend=-1))
            out[t[first]] = np.add.reduceat(change, first, axis=0)
        return out

    def left_behind(change: np.ndarray) -> np.ndarray:
        """The same of (word, class) where only the sum depends on b."""
        return (change.sum(axis=1) - change[i, a])[:, None] - change

    less = lambda x: f(np.maximum(x, 0))
    gain = apart(right, g) + apart(left, g.T)
    gain += left_behind(less(row - right) - f(row)) + left_behind(less(col - left) - f(col))
    ra, la, aa = right[i, a][:, None], left[i, a][:, None], diag[a][:, None]
    gain += less(aa - ra - la) - f(aa) + less(row - right + la) - f(row) + less(col + ra - left) - f(col) + f(diag + right + left) - f(diag)
    gain -= less(after[a][:, None] - nr) - f(after[a])[:, None] + f(after + nr) - f(after)
    gain -= less(before[a][:, None] - nl) - f(before[a])[:, None] + f(before + nl) - f(before)
    gain[i, a] = 0
    gain[:, 0] = -np.inf  # the end token is alone in its class
    return gain


def best_classes(counted: DataFrame, sent: Broadcast, bigrams: np.ndarray, p: Params) -> DataFrame:
    """(number, class, n) of those that move: where each raises the likelihood most; n tokens follow."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = sent.value
        for batch in sliced(batches, 1_000):
            left, right = histograms(list(batch["codes"]), list(batch["counts"]), p.classes)
            t = batch["number"].to_numpy()
            own = classes.now(t)
            best = gains(left, right, own, bigrams).argmax(axis=1)
            yield pd.DataFrame({"number": t, "class": best, "n": left.sum(axis=1)})[best != own]

    return counted.where("number >= 0").mapInPandas(run, "number long, class int, n double")


def likelihood(bigrams: np.ndarray) -> float:
    """Nats a token that class bigrams gain over class unigrams."""
    parts = _xlogx(bigrams).sum() - _xlogx(bigrams.sum(axis=0)).sum() - _xlogx(bigrams.sum(axis=1)).sum() + _xlogx(bigrams.sum())
    return float(parts / max(bigrams.sum(), 1))


def start_classes(frequent: Frequent, p: Params) -> Classes:
    """Frequent words dealt by frequency, pools in turn, all slots pooled."""
    deal = lambda n: (1 + np.arange(n) % (p.classes - 1)).astype(np.uint8)
    return Classes(np.append(np.uint8(0), deal(len(frequent.words))), np.full(1 << p.slot_bits, POOLED, np.uint8), deal(1 << p.ending_bits))


def exchange(encoded: DataFrame, frequent: Frequent, scratch: Scratch, p: Params) -> tuple[Classes, np.ndarray]:
    """The class of every number, and the class bigram counts."""
    of = start_classes(frequent, p)
    buckets = max(256, frequent.tokens // 1_000_000)  # what one bucket holds is bounded
    reached: list[float] = []
    while True:
        turn = len(reached)
        sent = encoded.sparkSession.sparkContext.broadcast(of)
        counted = scratch.save(neighbours(encoded, sent, turn, p, buckets))
        bigrams = transitions(counted, p)
        reached.append(likelihood(bigrams))
        done = turn >= max(2, p.passes) and reached[-1] - reached[-3] < p.least_gain
        if not done:
            moved = best_classes(counted, sent, bigrams, p).toPandas().sort_values(["n", "number"])
            of = of.moved(moved["number"].to_numpy(np.int64), moved["class"].to_numpy(np.uint8))
        scratch.discard(counted)
        sent.destroy()
        if done:
            return of, bigrams


def distinct_by_class(vocabulary: DataFrame, frequent: Frequent, of: Classes, p: Params) -> np.ndarray:
    """How many distinct training words each class has."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, 5_000):
            numbers = rare_numbers([w.encode() for w in batch["word"]], p)
            found, n = np.unique(sent.value.of_numbers(numbers), return_counts=True)
            yield pd.DataFrame({"class": found, "n": n})

    out = np.bincount(of.words, minlength=p.classes) - (frequent.counts[END] == 0) * (np.arange(p.classes) == 0)
    for r in vocabulary.where(F.col("c") < frequent.least).select("word").mapInPandas(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r[0]] += r.n
    sent.destroy()
    return out


def score_tables(bigrams: np.ndarray, distinct: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the transitions, and of what a word's count + add is divided by, for each class: its known words and one unknown."""
    n = bigrams.sum(axis=0)
    unigram = (n + p.add) / (n.sum() + p.add * p.classes)
    move = (bigrams + p.backing * unigram) / (bigrams.sum(axis=1, keepdims=True) + p.backing)
    return np.log10(move), np.log10(n + p.add * (distinct + 1))


def score(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    scratch = Scratch(df.sparkSession, "class_lm")
    docs = df.select(F.col(key).alias("doc_id"), ascii_lower(text_or_empty(text)).alias("text")).withColumn("held_out", held_out())
    vocabulary = scratch.save(count_words(docs))
    frequent = find_frequent(docs, vocabulary, p)
    encoded = scratch.save(encode(docs.withColumn("row", F.monotonically_increasing_id()), frequent, p))
    of, bigrams = exchange(encoded, frequent, scratch, p)
    tables = score_tables(bigrams, distinct_by_class(vocabulary, frequent, of, p), p)
    scratch.keep(vocabulary, encoded)
    sent = df.sparkSession.sparkContext.broadcast((of, np.log10(frequent.counts + p.add), int(frequent.counts[END] > 0), *tables))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, own, end_known, move, divisor = sent.value
        for batch in batches:
            now, begin = _flat(batch["numbers"])
            cls = classes.of_numbers(now)
            left = np.concatenate([[0], cls[:-1]])
            left[begin] = 0
            often = now < RARE
            counts = np.where(often, own[np.where(often, now, 0)], 0.0)  # of the others it comes from the join
            per = lambda x: np.add.reduceat(x, begin)
            yield batch[["row", "doc_id", "held_out"]].assign(
                n_tokens=per(np.ones(len(now), np.int64)), n_often=per(often.astype(np.int64)) - 1 + end_known, counts=per(counts), moves=per(move[left, cls] - divisor[cls])
            )

    parts = through_pandas(encoded.select("row", "doc_id", "held_out", "numbers"), run, "row long, held_out boolean, n_tokens long, n_often long, counts double, moves double")
    each = encoded.select("row", F.explode("rare").alias("word"))
    rare = each.join(vocabulary.where(F.col("c") < frequent.least), "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + p.add)).alias("rare"), F.count("c").alias("met"))
    both = parts.join(rare, "row", "left").fillna(0, ["rare", "met"])
    counts, value = F.col("counts") + F.col("rare"), F.col("moves") + F.col("counts") + F.col("rare")
    whole = math.log10(frequent.tokens + p.add * (frequent.vocabulary + 1))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.col("met")).cast("long").alias("n_known"), F.lit(frequent.tokens).cast("long").alias("train_tokens"),
        (counts - F.col("n_tokens") * whole).alias("base_score"), value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )
