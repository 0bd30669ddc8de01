"""Near-duplicates by Order MinHash.

Method: a text's k-mers are its shingles of five words, each with the number of its occurrence in the text, so that all are distinct. For
each of ``SKETCHES`` hash functions the ``PICKS`` k-mers of smallest hash are taken and kept *in the order of the text*; two texts that
agree in one such tuple are candidates. That happens the more often the smaller their edit distance is, and seldom for texts
that share k-mers in another order. A candidate pair is verified by banded alignment: the longest common subsequence of the
two k-mer sequences, within the band that the threshold allows; the similarity is common / (n + m - common), at most the Jaccard
similarity of the shingles and equal to it where the order agrees. 0.8 or more links two texts; groups are connected components.

Scale: equal texts (after lower-casing and white space) are one class from the start. In a bucket no pairs of all members are
made: every member is compared with a centre; links join labels, and only members whose labels still differ are compared with the next
centre. After ``ROUNDS`` such rounds the texts of buckets that still have differing labels are compared over labels, so that no link
found by a bucket is lost: not all pairs, which are quadratic in a hot bucket of dissimilar texts, but all that share a k-mer among the rarest
ones, without which the threshold is out of reach; the pairs of a hot k-mer are spread over tasks by salt. Texts travel compressed, and only those of
candidates; the k-mers of those left after the rounds are shuffled, too.

Edge cases: null and empty texts are in no group, each row alone; texts of fewer than five words are one k-mer, so only equal ones match;
null ids rank last; rows that repeat id and text are one document, of which all rows get the same answer; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, quoted
from .graph import components

K = 5
THRESHOLD = 0.8
SKETCHES, PICKS = 16, 3
ROUNDS = 2
#: A task of the last comparison has one of so many shares of a k-mer's texts on its left side, if more than HOT texts have it.
SALTS, HOT = 16, 256
#: So many words are remembered; so many texts are taken from Arrow at once.
CACHE_WORDS, SLICE = 100_000, 512
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.random.default_rng(20).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str], cache: dict | None = None) -> np.ndarray:
    """64-bit hashes of the occurrence-labelled k-mers, in the order of the text."""
    cache = {} if cache is None else cache
    if len(cache) > CACHE_WORDS:
        cache.clear()
    ids = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids.append(h)
    if not ids:
        return np.zeros(0, np.uint64)
    h = np.array(ids, np.uint64)
    n = max(1, len(h) - K + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(K, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out = _mix(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if len(same):  # number the occurrences of repeated k-mers
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        occurrence = (np.arange(n) - start).astype(np.uint64)
        labelled = np.empty(n, np.uint64)
        labelled[order] = _mix(ranked + occurrence * np.uint64(0xD6E8FEB86659FD93))
        return np.where(np.isin(np.arange(n), order[np.flatnonzero(occurrence > 0)]), labelled, out)
    return out


def sketch(kmers: np.ndarray) -> list[int]:
    """One 64-bit key for each hash function: the PICKS k-mers of smallest hash, in text order."""
    picks = min(PICKS, len(kmers))
    keys = []
    at = max(1, (1 << 19) // max(1, len(kmers)))
    for lo in range(0, SKETCHES, at):
        h = _mix(kmers[None, :] ^ _SEEDS[lo : lo + at, None])
        best = np.sort(np.argpartition(h, picks - 1, axis=1)[:, :picks], axis=1)
        key = np.zeros(len(h), np.uint64)
        for i in range(picks):
            key = _mix(key * np.uint64(3) + kmers[best[:, i]])
        keys.append(key)
    return np.concatenate(keys).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Alignment similarity of two k-mer sequences; 0.0 as soon as the threshold is out of reach."""
    n, m = len(a), len(b)
    need = threshold * (n + m) / (1 + threshold)  # common k-mers for the threshold
    if not n or min(n, m) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n + m - 2 * need  # k-mers without partner, hence the farthest diagonal
    keep = np.abs(i - j) <= band + 1e-9
    if keep.sum() < need - 1e-9:
        return 0.0
    j = j[keep][np.argsort(i[keep])]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        common = len(tails)
    else:
        common = len(j)
    found = common / (n + m - common)
    return found if found >= threshold - 1e-12 else 0.0


def _sketches(docs: DataFrame) -> DataFrame:
    """(id, key, cls, n, keys, blob) of every row; cls is a digest of the normalised text, null without words."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        z = zstandard.ZstdCompressor(level=3)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            cls, n, keys, blobs = [], [], [], []
            for text in batch[1].to_pylist():
                words = (text or "").lower().split()
                if not words:
                    cls.append(None), n.append(0), keys.append(None), blobs.append(None)
                    continue
                raw = " ".join(words).encode("utf-8", "surrogatepass")
                kmers = shingles(words, cache)
                cls.append(hashlib.md5(raw).digest()), n.append(len(kmers)), keys.append(sketch(kmers)), blobs.append(z.compress(raw))
            yield pa.RecordBatch.from_arrays([batch[0], batch[2], pa.array(cls, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text", _key().alias("key")).mapInArrow(run, schema)


def _key():
    """With the id it names a row's document; rows equal in both are the same document."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, cache, last = zstandard.ZstdDecompressor(), {}, (None, None)
        load = lambda blob: shingles(z.decompress(blob).decode("utf-8", "surrogatepass").split(), cache)
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if last[0] != a:
                    last = (a, load(x))
                good.append(similarity(last[1], load(y), threshold) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    t = texts.select("cls", "blob")
    p = pairs.join(t.select(F.col("cls").alias("b"), F.col("blob").alias("y")), "b").join(t.select(F.col("cls").alias("a"), F.col("blob").alias("x")), "a")
    return p.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _fits(n: str, m: str, threshold: float):
    """A similarity of the threshold needs lengths in this ratio."""
    return F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9


def _sharing(classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``classes`` (cls, n, label) with other labels, among them all whose similarity reaches the threshold.

    Such a pair has at least ``threshold * n`` k-mers of either text in common. With k-mers in one order for all texts, the rarest first,
    the first common one is among the first ``n - threshold * n + 1`` of both. Only those are joined, and of them none that one text alone has.
    """
    classes = materialise(classes, "neardup-open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, cache = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for cls, blob in zip(batch.column("cls").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                kmers = shingles(z.decompress(blob).decode("utf-8", "surrogatepass").split(), cache).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([cls] * len(kmers), pa.binary()), pa.array(kmers)], ["cls", "kmer"])

    rows = materialise(texts.join(classes.select("cls"), "cls", "left_semi").select("cls", "blob").mapInArrow(run, "cls binary, kmer long"), "neardup-kmers")
    shared = rows.groupBy("kmer").agg(F.count("*").alias("held")).where("held > 1")
    # Of a text's k-mers those that no other text has come first; the rest of the prefix is filled by the shared ones.
    own = rows.join(shared, "kmer").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("held", "kmer"))).alias("at"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-6) + 1 - (F.col("n") - F.size("at"))
    first = classes.join(own, "cls").withColumn("prefix", prefix.cast("int")).where("prefix > 0")
    first = first.select("cls", "n", "label", (F.col("n") - F.size("at")).alias("before"), F.posexplode(F.slice("at", F.lit(1), F.col("prefix"))).alias("i", "at"))
    first = first.select("cls", "n", "label", "at.kmer", "at.held", (F.col("n") - F.col("before") - F.col("i")).alias("rest"))
    first = materialise(first, "neardup-prefixes")
    salts = F.when(F.col("held") > HOT, SALTS).otherwise(1)
    left = first.withColumn("salt", F.pmod(F.xxhash64("cls"), salts).cast("int"))
    right = first.select("kmer", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("rest").alias("least"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # From the first common k-mer on, both have to have as many as the threshold asks for in common.
    enough = F.least("rest", "least") >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m")) - 1e-6
    met = left.join(right, ["kmer", "salt"]).where((F.col("label") < F.col("other")) & _fits("n", "m", threshold) & enough)
    return met.select(F.col("cls").alias("a"), "b").distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, copy_of, group_id, kept) of every row: the smallest id with the same words, the smallest of the group, and whether the row
    is the group's document that stays. Texts without words have copy_of and group_id null and stay."""
    rows = materialise(_sketches(docs), "neardup-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    classes = materialise(rows.where("cls IS NOT NULL").groupBy("cls").agg(first.alias("own"), F.first("n").alias("n"), F.first("keys").alias("keys")), "neardup-classes")
    members = classes.select("cls", "n", F.posexplode("keys").alias("i", "key")).select("cls", "n", F.xxhash64("i", "key").alias("bucket"))
    # Buckets of one class are most of all; what is left is small and is kept.
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(members.join(sizes, "bucket"), "neardup-buckets")
    texts = rows.where("cls IS NOT NULL").join(members.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("blob").alias("blob"))
    texts = materialise(texts, "neardup-texts")
    edges, labels = None, members.select(F.col("cls").alias("node"), F.col("cls").alias("label")).distinct()
    labelled = members.withColumn("label", F.col("cls"))
    for turn in range(ROUNDS + 1):
        open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), F.col("cls").alias("cls"), F.col("n").alias("n"), F.col("label").alias("label"))).alias("c")).where("low <> high")
        if turn < ROUNDS:
            met = labelled.join(open_.select("bucket", "c"), "bucket").where((F.col("label") != F.col("c.label")) & _fits("n", "c.n", threshold))
            pairs = met.select(F.col("c.cls").alias("a"), F.col("cls").alias("b")).distinct()
        else:
            pairs = _sharing(labelled.join(open_.select("bucket"), "bucket", "left_semi").select("cls", "n", "label").distinct(), texts, threshold)
        found = _verify(pairs, texts, threshold)
        edges = materialise(found if edges is None else found.union(edges), "neardup-edges")
        labels = components(edges)
        if turn < ROUNDS:
            labelled = materialise(members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "neardup-labels")
    named = classes.select("cls", "own").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    grouped = named.groupBy("label").agg(F.min(F.struct("own", "cls")).alias("best"))
    named = materialise(named.join(grouped, "label").select("cls", F.col("own.id").alias("copy_of"), F.col("best.own.id").alias("group_id"), F.col("best.cls").alias("best")), "neardup-named")
    out = rows.select("id", "key", "cls").join(named, "cls", "left")
    return out.select(F.col("id").alias("doc_id"), "copy_of", "group_id", (F.col("cls").isNull() | ((F.col("cls") == F.col("best")) & F.col("id").eqNullSafe(F.col("group_id")))).alias("kept"), "key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document of smallest id, and of rows that repeat its id and text one."""
    found = groups(docs, threshold)
    gone = materialise(found.where("NOT kept").select(F.col("doc_id").alias("__i"), F.col("key").alias("__k")).distinct(), "neardup-gone")
    twice = found.where("kept AND group_id IS NOT NULL").groupBy(F.col("doc_id").alias("__i"), F.col("key").alias("__k")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    twice = materialise(twice, "neardup-twice")
    d = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", _key())
    on = lambda t: d["__id"].eqNullSafe(t["__i"]) & (d["__key"] == t["__k"])
    if twice.isEmpty():
        return d.join(gone, on(gone), "left_anti").select(*map(quoted, docs.columns))
    once = d.join(twice, on(twice), "left_semi").dropDuplicates(["__id", "__key"])
    out = d.join(twice, on(twice), "left_anti").unionByName(once).join(gone.withColumnsRenamed({"__i": "__gi", "__k": "__gk"}), F.col("__id").eqNullSafe(F.col("__gi")) & (F.col("__key") == F.col("__gk")), "left_anti")
    return out.select(*map(quoted, docs.columns))
