"""Order statistics that stay distributed when one group holds most of the rows.

A plain ``Window.partitionBy(group).orderBy(value)`` sends a whole group to one
task, and ``percentile`` keeps a whole group in one buffer. Here a group is cut into
*value blocks* first: a stateless, monotone function of the value, so every run and
every retried task agrees on it. Per-block totals (a bounded number per group) give
each block its starting offset, and the exact order inside a block is resolved by
window functions partitioned by ``(group, block)``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12


def value_block(value: Column, bits: int = BLOCK_BITS) -> Column:
    """Log-linear block of a double: 2**bits equal steps per power of two.

    Monotone over all doubles in Spark's order: the infinities have outermost blocks of
    their own and NaN comes last. A log2 rounded up at a power of two changes nothing,
    because ``e*n + v/2**e*n`` is continuous there.
    """
    n = 1 << bits
    value = value.cast("double")
    endless = F.isnan(value) | (F.abs(value) == float("inf"))
    # The arithmetic below never sees a value without a finite logarithm. It stands outside
    # the conditions so that Spark evaluates its repeated parts once a row.
    size = F.when(endless | (value == 0), F.lit(1.0)).otherwise(F.abs(value))
    outermost = 4096 * n
    exponent = F.floor(F.log2(size))
    place = (exponent + 1100) * n + F.floor(size / F.pow(F.lit(2.0), exponent) * n)
    sign = F.when(endless, 0).when(value > 0, 1).when(value < 0, -1).otherwise(0)
    special = (
        F.when(F.isnan(value), outermost + 1)
        .when(value == float("inf"), outermost)
        .when(value == float("-inf"), -outermost)
        .otherwise(0)
    )
    return F.coalesce(special + sign * place, F.lit(0)).cast("bigint")


def running_totals(
    df: DataFrame, by: Sequence[str], value: str, amount: Column | None = None
) -> DataFrame:
    """Distinct ``value`` per group: weight ``n``, weight ``before`` it, group ``total``.

    Rows are first compressed to (group, value) counts with map-side partial
    aggregation, so copies of one value never pile up in one task.
    """
    weight = F.count(F.lit(1)) if amount is None else F.sum(amount)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(weight.alias("n"))
        .withColumn("_block", value_block(F.col(value)))
    )
    blocks = counts.groupBy(*by, "_block").agg(F.sum("n").alias("_in_block"))
    order = Window.partitionBy(*by).orderBy("_block")
    offsets = blocks.select(
        *by,
        "_block",
        (F.sum("_in_block").over(order) - F.col("_in_block")).alias("_offset"),
        F.sum("_in_block").over(Window.partitionBy(*by)).alias("total"),
    )
    inside = Window.partitionBy(*by, "_block").orderBy(value)
    return counts.join(offsets, [*by, "_block"]).select(
        *by,
        value,
        "n",
        (F.col("_offset") + F.sum("n").over(inside) - F.col("n")).alias("before"),
        "total",
    )


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """1-based average rank of every distinct value in its group, with its count ``n``."""
    return running_totals(df, by, value).withColumn(
        "rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    )


#: Rows of a value block up to which one task ranks them one by one.
BLOCK_ROWS = 1 << 20
#: Blocks over which rows without a value are spread.
NULL_BLOCKS = 1 << 12


def with_average_ranks(
    df: DataFrame, by: Sequence[str], value: str, name: str, same_rows: DataFrame | None = None
) -> DataFrame:
    """``df`` with the 1-based average rank of ``value`` in its group; null without a value.

    Rows move once, to the task of their (group, value block), and are ranked there. Larger
    blocks than ``BLOCK_ROWS`` are compressed to counts per value instead, so copies of one value
    never pile up in one task. ``same_rows`` is a table with the same groups and values that
    costs less to read again.
    """
    by = list(by)
    keys = [*by, "_block"]
    has = F.col(value).isNotNull()
    block = value_block(F.col(value))
    values = (df if same_rows is None else same_rows).where(has).select(*by, value, block.alias("_block"))
    blocks = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    order = Window.partitionBy(*by).orderBy("_block")
    offsets = blocks.withColumn("_offset", F.sum("_size").over(order) - F.col("_size"))
    large = F.broadcast(offsets.where(F.col("_size") > BLOCK_ROWS).drop("_size"))
    outside = F.lit(1 << 40) + F.pmod(F.xxhash64(*df.columns), F.lit(NULL_BLOCKS))
    rows = df.withColumn("_block", F.when(has, block).otherwise(outside))
    inside = Window.partitionBy(*keys).orderBy(value)
    # The default frame ends with the last copy of a value.
    rank = (F.rank().over(inside) + F.count(F.lit(1)).over(inside)) / F.lit(2.0)
    light = rows.join(large, keys, "left_anti").withColumn("_rank", rank).join(offsets.drop("_size"), keys, "left")
    ranks = average_ranks(values.join(large.select(*keys), keys), keys, value).select(*keys, value, F.col("rank").alias("_rank"))
    heavy = rows.join(large, keys).join(ranks, [*keys, value])
    columns = [*df.columns, (F.col("_offset") + F.col("_rank")).alias(name)]
    return light.select(*columns).unionByName(heavy.select(*columns))


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float], amount: Column | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name.

    ``amount`` weighs rows that are counts already.
    """
    long = percentile_table(df, by, value, sorted(set(quantiles.values())), amount)
    picks = [
        F.max(F.when(F.col("q") == F.lit(float(q)), F.col("quantile"))).alias(name)
        for name, q in quantiles.items()
    ]
    return long.groupBy(*by).agg(*picks)


def percentile_table(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], amount: Column | None = None
) -> DataFrame:
    """Exact quantiles in long form ``(by..., q, quantile)``; any number of them."""
    # A wanted 0-based position p lies between ranks floor(p) and ceil(p); a distinct
    # value covers the ranks [before, before + n).
    totals = running_totals(df, by, value, amount)
    steps = len(quantiles) - 1
    if steps > 0 and all(q == i / steps for i, q in enumerate(quantiles)):
        # Even steps: the few that a value can take part in follow from its ranks.
        span = F.greatest(F.col("total") - 1, F.lit(1))
        low = F.when(F.col("total") > 1, F.greatest(F.floor((F.col("before") - 1) * steps / span), F.lit(0))).otherwise(0)
        high = F.when(F.col("total") > 1, F.least(F.ceil((F.col("before") + F.col("n")) * steps / span), F.lit(steps))).otherwise(steps)
        places = F.explode(F.sequence(low.cast("bigint"), high.cast("bigint")))
        spread = totals.withColumn("_i", places).withColumn("q", F.col("_i") / float(steps)).drop("_i")
    else:
        spread = totals.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    spread = spread.select(*by, value, "n", "before", "total", "q").withColumn("_p", (F.col("total") - 1) * F.col("q"))
    low, high = F.floor("_p"), F.ceil("_p")
    first, last = F.col("before"), F.col("before") + F.col("n")
    hits = spread.where(
        ((low >= first) & (low < last)) | ((high >= first) & (high < last))
    )
    edges = hits.groupBy(*by, "q", "_p").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    fraction = F.col("_p") - F.floor("_p")
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction
    # Equal neighbours need no interpolation, which infinities could not stand.
    return edges.select(
        *by, "q", F.when((F.col("_lo") == F.col("_hi")) | (fraction == 0), F.col("_lo")).otherwise(between).alias("quantile")
    )


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    name: str = "frame",
    total: str | None = None,
) -> DataFrame:
    """0-based row number per group; ``block`` must be monotone in ``order``.

    Two levels: block sizes give offsets, rows are numbered inside (group, block).
    ``total`` names an optional column with the group's row count.
    """
    marked = df.withColumn("_block", block)
    sizes = marked.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_block")
    columns = [(F.sum("_size").over(before) - F.col("_size")).alias("_offset")]
    if total:
        columns.append(F.sum("_size").over(Window.partitionBy(*by)).alias(total))
    offsets = sizes.select(*by, "_block", *columns)
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    return (
        marked.join(offsets, [*by, "_block"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("int"))
        .drop("_block", "_offset")
    )


SPLITTERS = 32


def sampled_block(df: DataFrame, key: str) -> Column:
    """Monotone block of a text key from at most 1024 sampled splitters.

    The splitters are the keys with the smallest MD5 (a repeatable top-n, not a sort)
    and become a constant of the plan, so retried tasks agree. A 32 x 32 search tree
    finds the block with at most 64 comparisons.
    """
    n = SPLITTERS * SPLITTERS
    rows = df.select(key).distinct().orderBy(F.md5(key), key).limit(n).collect()
    keys = sorted((r[0] for r in rows if r[0] is not None), key=lambda k: k.encode())
    fine = [keys[i : i + SPLITTERS] for i in range(0, len(keys), SPLITTERS)]
    tree = F.from_json(F.lit(json.dumps(fine)), "array<array<string>>")
    coarse = F.from_json(F.lit(json.dumps([f[0] for f in fine])), "array<string>")
    at = F.size(F.filter(coarse, lambda s: s <= F.col(key)))
    inside = F.size(F.filter(F.get(tree, at - 1), lambda s: s <= F.col(key)))
    return F.when(at == 0, 0).otherwise(at * (SPLITTERS + 1) + F.coalesce(inside, F.lit(0)))


def first_by(*order: Column, payload: Sequence[Column]) -> Column:
    """Aggregate: payload of the row that is smallest by ``order`` (partial-aggregable).

    Written as min(struct) because min_by/max_by leave ties undefined.
    """
    return F.min(F.struct(*order, *payload))
