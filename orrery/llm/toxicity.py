"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Rows with a label are dealt by the crc32 of their id. Remainder 0 of 5 is held out and
teaches nothing; 1, 2 and 3 teach the lexicon; 4 teaches the trees and, other rows of it by a
hash of the id, the calibration, so no step is fitted to rows that an earlier step has seen. Features of a text alone: densities of a
fixed and of a learned lexicon, hits near a second person, capitals, punctuation and
obfuscation. Id, language and source are no features.

The learned lexicon counts every row of its folds. A term is in it if its link with the
label is both sure (`least_z`) and strong (`least_odds`, which keeps words out that are
common in all texts and pass the former wherever there are very many rows); of these the
model holds the `lexicon_terms` surest, a bound of its size as the number of trees is.
Trees and calibration are fitted on at most `Params.sample_rows` rows each, chosen by a hash
of the id. Texts are read whole.

Defined cases: null and empty texts get a score like any other, from features that are all
zero; labels of ids that are missing, null or contradictory (several rows: the highest
wins) don't stop a run; where either label is missing from the trees' rows, the score is
0.9 for texts with a word of the fixed lexicon and else 0.1; where it is missing from the
calibration's rows only, the trees' rows calibrate, too; repeated rows get equal
scores; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import text_or_empty, through_pandas

#: Common insults, in English, German, Spanish and French.
INSULTS = frozenset(
    """
    idiot idiots stupid moron morons imbecile dumb dumbass fool loser losers scum trash garbage clown pathetic
    worthless disgusting filth filthy vermin retard retarded bastard bitch asshole arsehole cunt dick prick
    whore slut fuck fucking fucker motherfucker shit bullshit crap pig swine parasite subhuman degenerate coward
    jerk creep freak wanker twat scumbag dickhead
    dumm blöd blödmann trottel arschloch scheisse scheiße wichser hure schlampe abschaum versager drecksau
    missgeburt hurensohn schwachkopf widerlich
    idiota estúpido estúpida imbécil tonto tonta basura escoria gilipollas cabrón puta puto mierda asqueroso
    asquerosa perdedor patético inútil pendejo
    idiote stupide imbécile connard connasse salope putain merde ordure crétin abruti débile pauvre raté enculé
    """.split()
)
#: Second persons in the same languages.
SECOND_PERSON = frozenset("you your yours yourself youre u ur ya du dich dir dein deine deiner ihr euch euer tú ti tu tus usted ustedes vosotros te toi ton ta tes vous votre vos".split())
#: Characters that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"})

LETTERS = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"\b[A-Z]{2,}\b")
MIXED = re.compile(r"[^\W\d_][^\W_]*[0-9@$!|*][0-9@$!|*]*[^\W_]*[^\W\d_]")
CHUNK = re.compile(r"[\w@$!|*]+")
LONGEST_WORD = 64
"""Longer runs of word characters are no words, and not looked at for look-alikes; their patterns would take the cube of the length."""
SPACED = re.compile(r"(?<!\w)(?:\w[.\-_* ]){3,}\w(?!\w)")
DRAWN_OUT = re.compile(r"([^\W\d_])\1{2,}")

FEATURES = (
    "fixed_density", "fixed_kinds", "learned_density", "learned_kinds", "learned_weight", "learned_top",
    "prefix_density", "prefix_weight", "near_second_person", "capitals", "exclamations", "questions",
    "obfuscated", "obfuscated_hits", "drawn_out", "log_words",
)


@dataclass(frozen=True)
class Params:
    lexicon_terms: int = 20_000
    least_z: float = 4.5
    """Least signed root of the likelihood ratio of a learned term."""
    least_odds: float = 0.7
    """Least logarithm of the ratio of odds of a learned term."""
    prefix: int = 4
    sample_rows: int = 200_000
    trees: int = 20
    depth: int = 3
    step: float = 0.3
    near_words: int = 5
    broadcast_rows: int = 1_000_000


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def features_of(text: str, learned: dict[str, float], p: Params) -> list[float]:
    words = LETTERS.findall(text.lower())
    n = max(len(words), 1)
    fixed = [w for w in words if w in INSULTS]
    hits = [learned[w] for w in words if w in learned]
    starts = [learned[x] for x in ["^" + w[: p.prefix] for w in words if len(w) > p.prefix] if x in learned]
    near = 0
    if fixed or hits:
        person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        if person:
            insults = [i for i, w in enumerate(words) if w in INSULTS or w in learned]
            at = 0
            for i in insults:
                while at < len(person) and person[at] < i - p.near_words:
                    at += 1
                near += at < len(person) and person[at] <= i + p.near_words
    mixed = [m for c in CHUNK.findall(text) if len(c) <= LONGEST_WORD and not c.isalpha() for m in MIXED.findall(c)]
    spaced = [re.sub(r"[.\-_* ]", "", m.group()) for m in SPACED.finditer(text)]
    drawn = [m.start() for m in DRAWN_OUT.finditer(text)] if DRAWN_OUT.search(text) else []
    plain = [m.translate(LOOKALIKES).replace("*", "").lower() for m in mixed] + [s.lower() for s in spaced]
    plain += [w for w in (DRAWN_OUT.sub(r"\1", w) for w in words) if w in INSULTS] if drawn else []
    return [
        100 * len(fixed) / n, float(len(set(fixed))), 100 * len(hits) / n, float(len({w for w in words if w in learned})) if hits else 0.0,
        sum(hits) / n, max(hits, default=0.0), 100 * len(starts) / n, sum(starts) / n, float(near),
        len(CAPITALS.findall(text)) / n, text.count("!") / n, text.count("?") / n,
        (len(mixed) + len(spaced)) / n, float(sum(w in INSULTS or w in learned for w in plain)), len(drawn) / n, math.log1p(len(words)),
    ]


def featurize(docs: DataFrame, learned: dict[str, float], p: Params) -> DataFrame:
    """(doc_id, held_out, features) of every row; the learned lexicon is bounded by its parameter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "remainder"]].assign(features=[features_of(t, learned, p) for t in batch["text"]])

    return through_pandas(docs.select("doc_id", F.coalesce(fold(), F.lit(-1)).alias("remainder"), "text"), run, "remainder long, features array<double>")


def learn_lexicon(docs: DataFrame, labels: DataFrame, p: Params) -> dict[str, float]:
    """Words and word beginnings that mark label 1, with their log odds, from whole texts of all rows of folds 1 to 3."""
    few = labels.where(fold().isin(1, 2, 3))
    few = F.broadcast(few) if few.count() <= p.broadcast_rows else few
    told = docs.where(fold().isin(1, 2, 3)).join(few, "doc_id")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    told = told.select("toxic", words.alias("w"))
    starts = F.transform(F.filter("w", lambda w: F.length(w) > p.prefix), lambda w: F.concat(F.lit("^"), F.substring(w, 1, p.prefix)))
    terms = told.select("toxic", F.explode(F.array_distinct(F.concat("w", starts))).alias("term"))
    total = told.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("t >= 3")
    t, n, rate = F.col("t"), F.col("n"), F.lit((total.t + 0.5) / (total.n + 1.0))
    odds = F.log((t + 0.5) / (total.t + 1.0)) - F.log((n - t + 0.5) / (total.n - total.t + 1.0))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(t, n * rate) + part(n - t, n * (1 - rate)))))
    scored = counted.where(t > n * rate).select("term", odds.alias("odds"), ratio.alias("z")).where((F.col("z") >= p.least_z) & (F.col("odds") >= p.least_odds))
    return {r.term: r.odds for r in scored.orderBy(F.desc("z"), "term").limit(p.lexicon_terms).collect()}


def _sample(df: DataFrame, rows: int) -> DataFrame:
    """At most about `rows` rows by a hash of the id, the same ones in every run."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def score(documents: DataFrame, labels: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `documents`."""
    scratch = Scratch(documents.sparkSession, "toxicity")
    docs = documents.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    told = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    told = scratch.save(told.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 0))
    learned = learn_lexicon(docs, told, p)
    rows = scratch.save(featurize(docs, learned, p))

    known = rows.where("remainder = 4").join(told, "doc_id").select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(10)) < 6).alias("grows"), F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("x"))
    grow, adjust = (scratch.save(_sample(known.where(F.col("grows") == g), p.sample_rows)) for g in (True, False))
    out = rows.select("doc_id", (F.col("remainder") == 0).alias("held_out"), "features")
    if grow.select("label").distinct().count() < 2:
        raw = F.when(F.get("features", F.lit(0)) > 0, F.lit(0.9)).otherwise(F.lit(0.1))
        return out.select("doc_id", "held_out", raw.alias("score"), (raw >= 0.5).cast("int").alias("predicted"))

    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=p.trees, maxDepth=p.depth, stepSize=p.step, minInstancesPerNode=2, seed=7).fit(grow.coalesce(8))
    margin = vector_to_array("rawPrediction")[1]
    to_margin = lambda df: trees.transform(df).withColumn("margin", margin)
    if adjust.select("label").distinct().count() < 2:
        adjust = grow
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(to_margin(adjust).select("margin", "label"))
    scratch.keep(rows)
    scored = steps.transform(to_margin(out.withColumn("x", array_to_vector("features"))).select("doc_id", "held_out", "margin"))
    # a small part of the margin itself orders rows that calibration puts on one step
    value = 0.98 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated"))) + 0.02 / (1 + F.exp(-2 * F.col("margin")))
    return scored.select("doc_id", "held_out", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
