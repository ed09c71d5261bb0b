"""Pages of an ordered table from a stored index.

The rows are written once in order: range partitions, sorted inside, one folder per
partition, with the place of every row in it. A small table keeps how many rows lie before
each partition, so a page reads the one or two partitions it lies in, however large its
offset is. Rows that agree in the order columns are ordered by a digest of the whole row,
which also lets a value that many rows share spread over partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a partition.
ROWS = 100_000


def write_pages(df: DataFrame, order: Sequence[str], path: str, rows: int = ROWS) -> int:
    """Store ``df`` in order under ``path``; returns the number of rows."""
    total = df.count()
    parts = max(1, -(-total // rows))
    keys = [*order, F.xxhash64(*df.columns)]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # An id counts on from a partition's start, which is a multiple of 2**33.
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_at": F.pmod(F.monotonically_increasing_id(), F.lit(2**33))})
    placed.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/rows")
    # An empty table leaves no partition to read its columns from.
    df.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    spark = df.sparkSession
    schema = ", ".join([df.schema.toDDL(), "_at bigint", "_part int"])
    counts = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # one row per partition of the stored table
    before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")
    counts.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return total


def read_page(spark: SparkSession, path: str, offset: int, size: int = 200) -> DataFrame:
    """One page in order; the offset is clamped to the last row and floored to a page start."""
    index = spark.read.parquet(f"{path}/index")
    total = index.agg(F.max(F.col("before") + F.col("n"))).first()[0] or 0
    start = max(0, min(offset, max(0, total - 1))) // size * size
    # partitions of one page
    inside = index.where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).collect()
    if not inside:
        return spark.read.parquet(f"{path}/columns")
    folders = [f"{path}/rows/_part={r['_part']}" for r in inside]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*folders)
    place = F.col("_at") + F.coalesce(*[F.when(F.col("_part") == r["_part"], r.before) for r in inside])
    kept = rows.withColumn("_place", place)
    page = kept.where((F.col("_place") >= start) & (F.col("_place") < start + size))
    return page.orderBy("_place").drop("_part", "_at", "_place")
