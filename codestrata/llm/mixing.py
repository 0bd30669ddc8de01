"""Mixing sources to target weights.

Method: every document gets a hash-random key (md5 of its id and text). Within a source the keys are cut into ranges; word counts are
summed by range and a prefix sum over these sums finds the one range in which the source's budget ends. That range is cut again, and
only the rows of the last, small range are ordered by key. The result is one threshold a source, so documents are never shuffled or
sorted: a row is taken if its key lies before its source's threshold. A budget above the source's size repeats whole epochs first.

Only DataFrame functions are used. A source of any size is spread over all tasks, and the sums are partial before any shuffle.

Edge cases: null or blank texts have size 0 and nothing is taken from them; a null source is a source of its own, last in the order;
null ids count as empty; repeated rows share a key, and where the budget ends among them each gives the same share of what is left,
rounded down; an empty table gives no rows; other columns pass through, but one that has the name of an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise, other_fields, quoted

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Hexadecimal digits of the key that make the ranges of each level: 4096 ranges a source, then 4096 in the range of the cut.
LEVELS = (3, 6)
#: Up to so many sources their thresholds (about 100 bytes each) are broadcast; with more they are joined.
BROADCAST_SOURCES = 65_536


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs) -> + target.

    Water filling in closed form: in the order of cap/weight, sources are capped as long as the level that would be left for the
    others lies above their own; the rest get level * weight. One row per source: this table is metadata.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    d = d.withColumn("__total", F.sum("source_size").over(everyone) * F.lit(float(share)))
    d = d.withColumn("__cap", F.col("source_size") * epochs)
    level = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    d = d.withColumn("__cap_before", F.coalesce(F.sum("__cap").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("__w_from", F.sum("__w").over(level.rowsBetween(0, W.unboundedFollowing)))
    left = F.col("__total") - F.col("__cap_before")
    d = d.withColumn("__capped", F.col("__cap") * F.col("__w_from") <= left * F.col("__w"))
    d = d.withColumn("__first_open", F.min(F.when(~F.col("__capped"), F.struct(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.encode(F.col("source"), "utf-8"), left.alias("left"), F.col("__w_from").alias("w")))).over(everyone))
    share_of = F.col("__first_open")["left"] * F.col("__w") / F.col("__first_open")["w"]
    return d.select("source", "source_size", "n_docs", F.when(F.col("__capped") | F.col("__first_open").isNull(), F.col("__cap").cast("double")).otherwise(share_of).alias("target"))


def _cut(ranges: DataFrame, key: str) -> DataFrame:
    """Of (source, left, key, words, n): the one key per source in which the budget ends, with what is left of it there."""
    before = W.partitionBy("source").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    r = ranges.withColumn("__here", F.col("left") - F.coalesce(F.sum("words").over(before), F.lit(0)))
    return r.where((F.col("__here") > 0) & (F.col("__here") <= F.col("words"))).select("source", key, F.col("__here").alias("left"), "n")


def thresholds(slim: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs (whole ones), rest, and the cut: key, words left at the key, rows with that key.

    ``slim`` has source, key, size. Each level reads only the range in which the level before found the cut. Where the rest is 0 the
    cut is null and nothing is taken beyond the whole epochs.
    """
    first = F.substring("key", 1, LEVELS[0])
    level = materialise(slim.groupBy("source", first.alias("range")).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-ranges")
    sources = source_targets(level.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("epochs", whole).withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    sources = materialise(sources, "mix-sources")
    left = sources.select(F.col("source").alias("__s"), F.col("rest").alias("left"))
    cut = _cut(level.join(left, level["source"].eqNullSafe(left["__s"])).drop("__s"), "range")
    for digits in (*LEVELS[1:], None):
        cut = materialise(cut, "mix-cut")
        at = _small(cut.select(F.col("source").alias("__s"), F.col("range").alias("__r"), "left"))
        rows = slim.join(at, slim["source"].eqNullSafe(at["__s"]) & F.col("key").startswith(F.col("__r")))
        name = F.substring("key", 1, digits) if digits else F.col("key")
        cut = _cut(rows.groupBy("source", name.alias("range")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("left").alias("left")), "range")
    cut = materialise(cut.select(F.col("source").alias("__s"), F.col("range").alias("cut_key"), F.col("left").alias("cut_left"), F.col("n").alias("cut_rows")), "mix-keys")
    return sources.join(cut, sources["source"].eqNullSafe(cut["__s"]), "left").drop("__s")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target (double) and taken (the words that the mix takes from the document).

    Each source gives floor(target) words: whole epochs, then its documents in key order until the budget is used up, of the last one
    only as many words as are left.
    """
    outputs = ["size", "source_size", "target", "taken"]
    kept = [quoted(f.name) for f in other_fields(docs, outputs)]
    slim = materialise(docs.select("source", key_of(F.col("doc_id"), F.col("text")).alias("key"), size_of(F.col("text")).alias("size")), "mix-slim")
    by_source = _small(materialise(thresholds(slim, weights, share, epochs).select(F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "epochs", "cut_key", "cut_left", "cut_rows")]), "mix-thresholds"))
    d = docs.select(*kept, key_of(F.col("doc_id"), F.col("text")).alias("__key"), size_of(F.col("text")).alias("__size"))
    d = d.join(by_source, d["source"].eqNullSafe(by_source["__source"]))
    part = F.when(F.col("__key") < F.col("__cut_key"), F.col("__size")).when(F.col("__key") == F.col("__cut_key"), F.floor(F.col("__cut_left") / F.col("__cut_rows"))).otherwise(F.lit(0))
    return d.select(*kept, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__epochs") * F.col("__size") + part).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document appears once for every epoch that takes words from it, whole.

    The document at the budget's end is kept whole, so a source exceeds its target by less than one document.
    """
    outputs = ["size", "source_size", "target", "taken"]
    hidden = {c: f"__own_{c.lower()}" for c in docs.columns if c.lower() in outputs}
    mixed = mix(docs.withColumnsRenamed(hidden), **options)
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    rows = mixed.where(F.col("taken") > 0).select("*", F.explode(copies).alias("__epoch"))
    return rows.drop(*outputs, "__epoch").withColumnsRenamed({v: k for k, v in hidden.items()}).select(*map(quoted, docs.columns))
