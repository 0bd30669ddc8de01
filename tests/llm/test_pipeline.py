import collections
import hashlib

import corpus_pipeline as C
import pytest
from codestrata.llm import mixing, queries
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit("mine"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "bpe":
            assert out.columns == docs.columns
        docs = C.materialise(out, "test")
        rows[name] = docs.collect()
    good = {r["doc_id"] for r in rows["quality_classifier"]}
    assert sum(i in good for i, q in labels.items() if q) > 0.97 * sum(labels.values())
    assert sum(i in good for i, q in labels.items() if not q) < 0.2 * sum(1 - q for q in labels.values())
    assert len({r["doc_id"] for r in rows["near_dedup"]}) == len(rows["near_dedup"]) < len(good)
    assert {r["doc_id"] for r in rows["substring_dedup"]} == {r["doc_id"] for r in rows["near_dedup"]}
    assert all(r["n_chars"] == len(r["text"]) for r in rows["substring_dedup"])
    mixed = collections.Counter(r["doc_id"] for r in rows["source_mixing"])
    assert max(mixed.values()) <= mixing.MAX_EPOCHS
    texts = {r["doc_id"]: r["text"] for r in rows["source_mixing"]}
    assert len(rows["bpe"]) == len(rows["source_mixing"]) and all(r["exact"] and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows["bpe"])


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in C.STAGES:
        docs = C.materialise(stage(spark, docs, SMALL), "test")
    key = lambda d: sorted(map(str, d.select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert key(C.run(spark, SMALL)) == key(docs)


def test_passage_inside_a_line(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"some words of the first document and then {passage} and others that follow", 0), (2, f"another one begins in quite a different manner {passage} until it stops elsewhere", 0)]
    out = {r["doc_id"]: r for r in C.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), SMALL).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["n_chars"] == len(out[2]["text"])
    assert len(set(out[2]["text"].split()) & set(passage.split())) < 20
    assert out[2]["text"].startswith("another one begins in quite a different manner") and out[2]["text"].endswith("until it stops elsewhere")


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, want.select(*columns).fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in every column, repeated rows, ties, empty and very long texts, and columns with clashing names."""
    long = " ".join(f"word{i % 4000} of the text" for i in range(40_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id but some words of the plain kind", None, "a", 5), (3, long, "en", "b", len(long)), (4, "the same row of words twice", "en", "b", 27), (4, "the same row of words twice", "en", "b", 27), (5, " \t\n", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("Score", F.lit("mine")).withColumn("x.y", F.lit(1)).withColumn("Removed", F.lit(2))
    spark.createDataFrame([(1, 1), (3, 1), (4, 1), (None, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
        docs = C.materialise(out, "test")
    assert docs.where("NOT exact").isEmpty() and {r["doc_id"] for r in docs.collect()} <= {1, 2, None, 3, 4, 5}
