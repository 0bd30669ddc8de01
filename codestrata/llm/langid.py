"""Language identification of web pages by Bayesian evidence fusion.

Method: the posterior of a page's language combines four kinds of evidence:
- text: naive Bayes over hashed byte trigrams of the visible text, counted over all labelled documents, tempered because trigrams overlap;
- the language declared in the markup: P(declared | language), from the pages' text posteriors by declared language;
- the address suffix: P(suffix | language), from the same posteriors by suffix;
- the host: a prior from the text posteriors of the host's other pages, smoothed by its domain's, and this by all pages'.

Scale: trigram counts are summed in each task (languages x ``BUCKETS`` numbers) before they are combined. Posteriors are summed by host
with partial sums; domains and suffixes are summed from hosts. A host with a third of all pages costs one row a task there, and the join
of pages with hosts is salted. What is broadcast is one array per language.

Edge cases: a null or empty page has only its address as evidence; a null address or one without host has host, domain and suffix ''; a
declared language that no document has counts as 'other', none as ''; documents without language or text don't train; repeated pages are
pages of their own; without any labelled document lang is null; an empty table gives no rows. Ties go to the first language by name.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BUCKETS = 1 << 14
#: Trigrams that count as one independent observation, and the most that a text may count in all.
TEMPER, MOST = 4.0, 60.0
#: Pages that a coarser level's distribution is worth.
STRENGTH = 5.0
SALTS = 16
_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)")


def visible_text(page: str) -> str:
    return html_lib.unescape(_TAG.sub(" ", _DROP.sub(" ", page)))


def declared_language(page: str) -> str:
    found = _DECLARED.search(page)
    return found[1].lower() if found else ""


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix), lower case."""
    found = _HOST.match((url or "").strip())
    if not found:
        return "", "", ""
    labels = found[1].lower().rstrip(".").split(".")
    return ".".join(labels), ".".join(labels[-2:]), labels[-1]


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-case letters, runs of other ASCII read as one space."""
    raw = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 5:
        return np.zeros(0, np.int64)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)


def fit_text(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and log P(trigram | language)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])

    schema = "lang string, counts binary"
    labelled = docs.select("text", F.lower(F.trim("lang")).alias("lang")).where("text IS NOT NULL AND lang <> ''")
    rows = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in labelled.mapInArrow(part, schema).repartition("lang").mapInArrow(add, schema).collect()}
    langs = sorted(rows)
    counts = np.array([rows[x] for x in langs], np.float64).reshape(len(langs), BUCKETS)
    return langs, np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, suffix, text_lang (by text alone), lang and probability (of lang) for every page."""
    langs, table = fit_text(docs)
    size = len(langs)
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast((langs, table))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        known = set(names)
        for batch in batches:
            rows = []
            for url, page in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                own = trigrams(visible_text(page or ""))
                scale = min(1 / TEMPER, MOST / max(1, len(own)))
                declared = declared_language(page or "")
                rows.append((*address(url), declared if declared in known or not declared else "other", (weights[:, own].sum(1) * scale).tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string()] * 4 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch[0], *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], ["page_id", "host", "domain", "suffix", "declared", "ll"])

    read_pages = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, "page_id long, host string, domain string, suffix string, declared string, ll array<double>")
    if not langs:
        return read_pages.select("page_id", "host", "declared", "suffix", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    own = [f"p{i}" for i in range(size)]
    d = read_pages.withColumn("top", F.array_max("ll")).withColumn("e", F.transform("ll", lambda x: F.exp(x - F.col("top"))))
    d = d.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    d = materialise(d.select("page_id", "host", "domain", "suffix", "declared", "ll", *[(F.col("e")[i] / F.col("z")).alias(p) for i, p in enumerate(own)]), "langid-pages")

    sums = [F.sum(p).alias(p) for p in own]
    hosts = materialise(d.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), *sums), "langid-hosts")
    total = hosts.agg(F.sum("n").alias("n"), *sums).first()
    n = total["n"] or 0
    overall = [((total[p] or 0) + 1 / size) / (n + 1) for p in own]
    level = lambda name: hosts.groupBy(name).agg(F.sum("n").alias(f"{name}_n"), *[F.sum(p).alias(f"{name}_{p}") for p in own])
    h = hosts.join(level("domain"), "domain").join(level("suffix"), "suffix")
    for i, p in enumerate(own):
        h = h.withColumn(f"up_{p}", (F.col(f"domain_{p}") + STRENGTH * overall[i]) / (F.col("domain_n") + STRENGTH))
        # P(suffix | language) / P(suffix): the constant of a suffix drops out, and no suffix gets no evidence.
        h = h.withColumn(f"suffix_ll_{p}", F.when(F.col("suffix") == "", F.lit(0.0)).otherwise(F.log((F.col(f"suffix_{p}") + STRENGTH * overall[i]) / ((F.col("suffix_n") + STRENGTH) * F.lit(overall[i])))))
    h = h.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), *[F.col(p).alias(f"h_{p}") for p in own], *[f"up_{p}" for p in own], *[f"suffix_ll_{p}" for p in own], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("h_salt"))
    declared = {r["declared"]: [r[p] for p in own] for r in d.groupBy("declared").agg(*sums).collect()}  # at most languages + 2 rows
    d = d.withColumn("salt", F.pmod(F.xxhash64("page_id", "ll"), F.lit(SALTS)).cast("int"))
    d = d.join(h, (d["host"] == h["h_host"]) & (d["salt"] == h["h_salt"]))
    scores = []
    for i, p in enumerate(own):
        prior = F.log((F.col(f"h_{p}") - F.col(p) + STRENGTH * F.col(f"up_{p}")) / (F.col("h_n") - 1 + STRENGTH))
        said = F.lit(0.0)
        for name, row in declared.items():
            if name:
                said = F.when(F.col("declared") == name, F.lit(float(np.log((row[i] + 0.5) / (overall[i] * (n + 1) + 0.5 * (size + 1)))))).otherwise(said)
        scores.append((F.col("ll")[i] + prior + F.col(f"suffix_ll_{p}") + said).alias(f"s{i}"))
    d = d.withColumn("s", F.array(*scores)).withColumn("best", F.array_max("s"))
    names = F.array(*[F.lit(x) for x in langs])
    at = lambda column: F.element_at(names, F.array_position(column, F.array_max(column)).cast("int"))
    return d.select("page_id", "host", "declared", "suffix", at(F.col("ll")).alias("text_lang"), at(F.col("s")).alias("lang"), (1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))).alias("probability"))
