"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources take weights in turn and share ``share`` times all words; a target stops
at ``cap`` times its source's size and the excess is shared again by weight. Water filling
has a closed form over the sources ordered by cap per weight.

Schedule: slot ``i`` lies at the golden-ratio point ``i * G mod 2**31``, an exact integer
form of the fractional parts of ``i * phi``. Points fall through the cumulative targets to
a source, so every stretch of the schedule is close to the target mix. Slots are ranked
per source; rank ``r`` takes block ``r mod blocks`` of the source's shuffled documents.

Nothing holds a source in one task: ranks and positions are prefix sums over chunks of
slots and over hash cells of documents, with exact order only inside a chunk or a cell.

Edge cases: a null text has size 0 and is never taken; a null source is the last source;
rows with the same id are separate rows; empty input gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm.common import GAP, words
from motionlake.session import settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Blocks per document of average size.
BLOCKS_PER_DOCUMENT = 4
#: The odd integer next to 2**31 / golden ratio; odd, so a full period visits every point.
GOLDEN = 1327217885
POINTS = 2**31
CHUNK = 65536
CELL_BITS = 19
CELL_ROWS = 4096


def document_sizes(docs: DataFrame) -> DataFrame:
    """One row per document: id, source, size in words, and its shuffle key."""
    return docs.select(
        "doc_id",
        "source",
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"),
    )


def source_targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights=WEIGHTS) -> DataFrame:
    """One row per source: ``sid, source, source_size, target`` and slot interval bounds."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    numbered = per_source.withColumn(
        "sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).select(
        "sid",
        "source",
        "source_size",
        (F.col("source_size") * cap).alias("limit"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).alias("w"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("whole"),
    )
    by_fill = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("sid"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("whole") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("w").over(after)
    filled = numbered.withColumn("level", level).withColumn(
        "open", F.when(F.col("limit") / F.col("w") >= F.col("level"), F.struct(F.col("limit") / F.col("w"), "sid", "level"))
    )
    final = F.coalesce(F.min("open").over(everything)["level"] * F.col("w"), F.col("limit").cast("double"))
    targets = filled.withColumn("target", F.least(F.col("limit").cast("double"), final))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    words_of = F.round("target").cast("bigint")
    return (
        targets.withColumn("_t", words_of)
        .withColumn("_all", F.greatest(F.sum("_t").over(everything), F.lit(1)))
        .withColumn("high", F.floor(F.sum("_t").over(upto) / F.col("_all") * POINTS).cast("bigint"))
        .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0)))
        .select("sid", "source", "source_size", "target", "low", "high")
    )


def schedule(targets: DataFrame, slots: int, block: int) -> DataFrame:
    """Every slot in order: ``slot, sid, rank, block``; past ``CAP`` passes a slot stays out."""
    spark = targets.sparkSession
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") % POINTS) * GOLDEN % POINTS).alias("at")
    )
    # An equi-join on the point's cell with the interval check behind it: a source is
    # listed in the cells it touches, so there are at most cells + sources rows.
    cells = targets.where("high > low").select(
        "sid",
        "low",
        "high",
        F.ceil(F.col("source_size") / block).alias("blocks"),
        F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))).alias("cell"),
    )
    placed = points.withColumn("cell", F.shiftright("at", CELL_BITS)).join(cells, "cell")
    placed = placed.where("at >= low AND at < high").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = placed.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")
    inside = Window.partitionBy("sid", "chunk").orderBy("slot")
    ranked = placed.join(counts.select("sid", "chunk", offset.alias("offset")), ["sid", "chunk"]).withColumn(
        "rank", F.col("offset") + F.row_number().over(inside) - 1
    )
    return ranked.where(F.col("rank") < F.col("blocks") * CAP).select(
        "slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block")
    )


def positions(sizes: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Every document with the word position ``start`` in its source's shuffled order."""
    digits = max(1, math.ceil(math.log(max(rows, 1) / CELL_ROWS + 1, 16)))
    keyed = (
        sizes.join(targets.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("cell", F.substring("order", 1, digits))
    )
    totals = keyed.groupBy("sid", "cell").agg(F.sum("size").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("sid").orderBy("cell")) - F.col("n")
    inside = Window.partitionBy("sid", "cell").orderBy("order", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return keyed.join(totals.select("sid", "cell", offset.alias("offset")), ["sid", "cell"]).select(
        "doc_id", "sid", "size", (F.col("offset") + running).alias("start")
    )


def block_words(words_in_all: int, rows: int) -> int:
    return max(1, words_in_all // (BLOCKS_PER_DOCUMENT * max(rows, 1)))


def mix_sources(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` and whole ``copies``.

    ``taken`` counts words with repeats; ``copies`` is how often the block that holds the
    document's first word is taken.
    """
    sizes = settle(document_sizes(docs))
    whole = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block_words(whole[1], whole[0])
    targets = settle(source_targets(sizes))
    slots = schedule(targets, round(SHARE * whole[1] / block), block)
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    placed = positions(sizes, targets, whole[0])
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select(
        "doc_id", "sid", "size", "start", F.explode(F.sequence(first, last)).alias("block")
    )
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(
        F.col("start"), F.col("block") * block
    )
    n = F.coalesce(F.col("times"), F.lit(0))
    taken = (
        pieces.join(times, ["sid", "block"], "left")
        .groupBy("sid", "start", "doc_id", "size")
        .agg(F.sum(overlap * n).alias("taken"), F.sum(F.when(F.col("block") == first, n).otherwise(0)).alias("copies"))
        .select("doc_id", "sid", "size", "taken", "copies")
    )
    none = F.lit(0).cast("bigint")
    empty = placed.where("size = 0").select("doc_id", "sid", "size", none.alias("taken"), none.alias("copies"))
    return taken.unionByName(empty).join(targets, "sid").select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as its ``copies``, with all their columns.

    Rows that agree in id, source and size share their copies evenly, rounded.
    """
    mix = mix_sources(docs).groupBy("doc_id", "source", "size").agg(F.round(F.avg("copies")).cast("int").alias("copies"))
    mix = mix.where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies"
    )
    carried = docs.select(F.struct("*").alias("r")).withColumn("n", F.size(words(F.col("r.text"))).cast("bigint"))
    same = (
        F.col("r.doc_id").eqNullSafe(F.col("_id"))
        & F.col("r.source").eqNullSafe(F.col("_source"))
        & (F.col("n") == F.col("_size"))
    )
    repeated = carried.join(mix, same).select("r", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("r.*")


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for ``doc_id, size, source_size, target, taken``."""
    size = f"len(list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> ''))"
    weight = "CASE " + " ".join(f"WHEN sid % {len(WEIGHTS)} = {j} THEN {w}" for j, w in enumerate(WEIGHTS)) + " END"
    return f"""
WITH d AS (SELECT doc_id, source, CAST({size} AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM {docs}),
g AS (SELECT count(*) AS n, coalesce(CAST(sum(size) AS BIGINT), 0) AS s,
  greatest(1, coalesce(CAST(sum(size) AS BIGINT), 0) // ({BLOCKS_PER_DOCUMENT} * greatest(count(*), 1))) AS b FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, {CAP} * source_size AS lim, {weight} AS w, sum(source_size) OVER () * {SHARE}::DOUBLE AS whole FROM s0),
s2 AS (SELECT *, lim / w AS fill, (whole - coalesce(sum(lim) OVER (ORDER BY lim / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY lim / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, (SELECT level FROM s2 WHERE fill >= level ORDER BY fill, sid LIMIT 1) AS final FROM s2),
s4 AS (SELECT *, least(CAST(lim AS DOUBLE), coalesce(final * w, CAST(lim AS DOUBLE))) AS target FROM s3),
s5 AS (SELECT *, CAST(floor(CAST(sum(CAST(round(target) AS BIGINT)) OVER (ORDER BY sid) AS DOUBLE)
  / greatest(sum(CAST(round(target) AS BIGINT)) OVER (), 1) * {POINTS}) AS BIGINT) AS high FROM s4),
s6 AS (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low, CAST(ceil(source_size / (SELECT b FROM g)) AS BIGINT) AS blocks FROM s5),
p AS (SELECT i, (i % {POINTS}) * {GOLDEN} % {POINTS} AS pt FROM (SELECT unnest(range(CAST(round({SHARE} * s / b) AS BIGINT))) AS i FROM g)),
r AS (SELECT sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank FROM p JOIN s6 ON pt >= low AND pt < high),
t AS (SELECT sid, rank % blocks AS block, count(*) AS times FROM r WHERE rank < {CAP} * blocks GROUP BY ALL),
q AS (SELECT row_number() OVER () AS row, doc_id, sid, size, source_size, target,
  sum(size) OVER (PARTITION BY sid ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
x AS (SELECT q.*, b, unnest(range(CAST(start // b AS BIGINT), CAST((start + size - 1) // b + 1 AS BIGINT))) AS block FROM q, g WHERE size > 0),
k AS (SELECT row, sum((least(start + size, (block + 1) * b) - greatest(start, block * b)) * times) AS taken FROM x JOIN t USING (sid, block) GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (row)"""
