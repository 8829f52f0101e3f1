"""From raw documents to training sequences: five stages, each over all that the one before kept.

Defined cases, in every stage: rows that share an id are one document, so a stage drops or
keeps them together, and near-dedup leaves the row with the longest text; a row without an
id is a document of its own, judged by its own text and never a copy of another; a null
text is an empty one, stays null where texts are carried, and packs as its end token alone;
an empty table gives an empty result; all other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontamination, filters, near_dedup, packing, pii, toxicity
from orrery.llm.store import Scratch

KEY = "_pipeline_key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated score under one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn(KEY, F.col("doc_id").cast("string"))
    docs = filters.keyed(docs, KEY)
    scored = toxicity.score(docs, labels, key=KEY).where("predicted = 1")
    return filters.without(docs, scored.withColumnRenamed("doc_id", KEY), KEY).drop(KEY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near copies (five-word shingles, 0.8)."""
    return filters.one_each(filters.only(docs, near_dedup.assign(docs).where("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    docs = filters.keyed(docs, KEY)
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=KEY).where("n_hit > 0")
    return filters.without(docs, found.withColumnRenamed("doc_id", KEY), KEY).drop(KEY)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of their kinds."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, neighbours along the curve."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: Trees, tokenizers and the curve have no form in SQL; a test holds every stage against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch.inside(name):
            docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.discard(before)
    return docs
