"""REST calls matched to endpoints: an equi-join on the address template with residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

#: Rows of one address that meet in a task at once, on either side.
BLOCK = 1000


def _block(df: DataFrame, blocks: Column) -> Column:
    """Number of a row's block, by the hash of the row; maps and variants can't be hashed."""
    own = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind]
    return F.pmod(F.xxhash64(*own), blocks)


def _in_blocks(c: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers __i of calls and __j of endpoints, such that each pair of one address meets in one (__i, __j).

    An address of many rows is cut into blocks on both sides, and each block of one side is sent to those of the other: a task holds BLOCK rows of either side
    or so, however many rows an address has, and the pairs of one address are made by many tasks. Only addresses of more than BLOCK rows are
    broadcast, which are at most one in BLOCK rows.
    """
    nc = c.groupBy(F.col("__base").alias("__address")).agg(F.count("*").alias("__nc"))
    ne = e.groupBy(F.col("endpoint_url").alias("__address")).agg(F.count("*").alias("__ne"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).alias(n)
    many = F.broadcast(nc.where(f"__nc > {BLOCK}").join(ne.where(f"__ne > {BLOCK}"), "__address", "full_outer").select("__address", blocks("__nc"), blocks("__ne")))
    n_c, n_e = F.coalesce("__nc", F.lit(1)), F.coalesce("__ne", F.lit(1))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = c.join(many, c["__base"] == many["__address"], "left").select(*c.columns, _block(c, n_c).alias("__i"), others(n_e).alias("__j"))
    right = e.join(many, e["endpoint_url"] == many["__address"], "left").select(*e.columns, _block(e, n_e).alias("__j"), others(n_c).alias("__i"))
    spark = c.sparkSession
    # A number of its own: rows are few for the pairs they make, and would be put into few partitions by their size.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return left.repartition(n, "__base", "__i", "__j"), right.repartition(n, "endpoint_url", "__i", "__j")


def match_calls(calls: DataFrame, endpoints: DataFrame, exclude_by: str = "service", within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of calls (url, http_method, service) and endpoints (url, http_method, service, required array).

    A call matches an endpoint of another service whose address equals the call's address before the query, whose method is the same or
    ALL, and whose required parameters the query names. ``exclude_by`` is the column that tells services apart: the name, or an id. Both sides
    agree in the columns ``within``, such as the number of a snapshot of the whole system.
    All columns come out with the prefixes call_ and endpoint_. The pairs of an address are as many as its calls times its endpoints; see ``_in_blocks``.
    """
    c = calls.select(*[F.col(x).alias(f"call_{x}") for x in calls.columns], U.base(F.col("url")).alias("__base"), U.query(F.col("url")).alias("__query"))
    e = endpoints.select(*[F.col(x).alias(f"endpoint_{x}") for x in endpoints.columns])
    c, e = _in_blocks(c, e)
    method = (F.col("call_http_method") == F.col("endpoint_http_method")) | (F.col("endpoint_http_method") == "ALL")
    other = F.col(f"call_{exclude_by}") != F.col(f"endpoint_{exclude_by}")
    on = (F.col("__base") == F.col("endpoint_url")) & (c["__i"] == e["__i"]) & (c["__j"] == e["__j"]) & method & other
    for column in within:
        on = on & F.col(f"call_{column}").eqNullSafe(F.col(f"endpoint_{column}"))
    found = c.join(e.hint("merge"), on).drop(c["__i"], c["__j"], e["__i"], e["__j"])
    required = F.coalesce(F.col("endpoint_required"), F.array().cast("array<string>"))
    return found.where((F.size(required) == 0) | U.names_parameters(F.col("__query"), required)).drop("__base", "__query")
