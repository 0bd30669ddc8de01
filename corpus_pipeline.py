"""The corpus pipeline: classify quality, drop near-duplicates, cut repeated passages, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Edge cases are those of the
operators: null texts are empty texts, which the classifier judges by its prior; an empty table goes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import bpe, classifier, mixing, neardup, substring
from codestrata.llm.common import materialise, quoted, table
from codestrata.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. It learns from the labelled documents of this stage's input."""
    own = {c: f"__own_{c.lower()}" for c in docs.columns if c.lower() in ("score", "predicted")}
    scored = classifier.score(docs.withColumnsRenamed(own), classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").drop("score", "predicted").withColumnsRenamed({v: k for k, v in own.items()}).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of smallest id; rows that repeat it go, too."""
    return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars follows the text.

    Null texts stay null and empty ones empty; rows that repeat id and text lose the same; an own column n_removed or removed stays as it is.
    """
    names = ("n_removed", "removed")
    own = {c: f"__own_{c.lower()}" for c in docs.columns if c.lower() in names}
    out = substring.dedup(docs.withColumnsRenamed(own)).drop(*names).withColumnsRenamed({v: k for k, v in own.items()})
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every epoch in which a document is taken. Documents without words give no rows; a null source is a source of its own."""
    return mixing.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for every row; a null text has no tokens."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [("quality_classifier", quality), ("near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("source_mixing", mix_sources), ("bpe", encode)]
#: The classifier, the sketches and the encoder aren't stated in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
