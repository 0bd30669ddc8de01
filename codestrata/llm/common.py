"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word is a maximal run of characters other than space and U+0009..U+000D; ``bytes.split()`` cuts UTF-8 at exactly these.
WORD = "[^\\x20\\x09-\\x0D]+"
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set to a temporary one only where the session names none (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_mod(id_col: str, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus``; null ids have no remainder and count as remainder -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def as_text(values) -> list[str]:
    """Texts of a pandas column with null as the empty text."""
    return ["" if v is None or v != v else v for v in values]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def quoted(name: str) -> str:
    """A column's name for Spark, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def other_fields(df: DataFrame, names) -> list[T.StructField]:
    """Fields that none of ``names`` replaces; Spark tells names apart by letters, not by their case."""
    low = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in low]


def carried(fields: list[T.StructField]) -> tuple[list, list[T.StructField]]:
    """Columns and fields of other columns under plain names, since names with dots don't go through mapInArrow; toDF gives them back."""
    return [F.col(quoted(f.name)).alias(f"__k{i}") for i, f in enumerate(fields)], [T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(fields)]


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], compute: Callable[[list[str]], list[list]]) -> DataFrame:
    """``df`` with columns that ``compute`` makes from the texts of a batch, one list per field.

    The other columns pass as Arrow data, whatever their types and nulls; one that has the name of a new column is replaced.
    """
    kept = other_fields(df, [f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            *own, text = batch.columns
            made = compute([t or "" for t in text.to_pylist()])
            yield pa.RecordBatch.from_arrays(own + [pa.array(m, k) for m, k in zip(made, kinds, strict=True)], [f.name for f in plain] + [f.name for f in fields])

    columns, plain = carried(kept)
    out = df.select(*columns, F.col(quoted(text_col)).alias("__text")).mapInArrow(run, T.StructType(plain + fields))
    return out.toDF(*[f.name for f in kept], *[f.name for f in fields])
