"""Small pieces that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the separators between words, in Java and DuckDB regex syntax.
GAP = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in ``characters`` (code points, as bigint)."""
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("bigint")


def document_key(doc_id: Column) -> Column:
    """Order key of documents: null ids come last and count as one shared id."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(2**63 - 1))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def paired_blocks(rows: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Cut large groups so that any two rows of a group still meet in some block.

    A group of more than ``limit`` rows is dealt into ``k`` chunks by a hash of ``member``
    and every pair of chunks becomes a block, so a row is repeated ``k`` times and no block
    holds much over ``2 * limit`` rows, however large the group is. Adds ``block``, which
    is ``i * 2**20 + j`` for chunks ``i <= j``, and ``chunk``.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    k = F.ceil(F.col("_n") / limit).cast("int")
    chunk = F.pmod(F.xxhash64(member), k).cast("int")
    with_chunk = rows.join(sizes, keys).withColumn("_k", k).withColumn("chunk", chunk)
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    low, high = F.least("chunk", "_o"), F.greatest("chunk", "_o")
    return (
        with_chunk.withColumn("_o", other)
        .withColumn("block", low.cast("bigint") * 2**20 + high)
        .drop("_o", "_k", "_n")
    )
